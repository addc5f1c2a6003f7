"""Cleaning log (M18) and follow-up columns.

Rules, in order:
1. a NULL ``change`` flag means TRUE;
2. log rows whose id is duplicated in the data are rejected;
3. log rows whose id is not in the data are rejected;
4. log rows naming a column the data lacks are rejected;
5. only ``change = TRUE`` rows are applied;
6. writes go in log order, the last write to a cell wins;
7. the changelog keeps, per applied row, the cell's value before any write.

Distributed form: the log is reduced to one row per id -- the last write per
known column as a map -- and left-joined to the data, whose rows are written
once, those that the log names apart from the rest.  That is the only pass over
the data and its only shuffle.  Counts, old values, writes and rejects all come
from the named rows, of which there are as many as the log has ids; the others
are passed on as they are.  Nothing is collected.  A hot id is handled by the
partial aggregations and by AQE's skew-join split: every join has its large
side on the splittable side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import exprs as X
from souk.sources.store import materialize


@dataclass
class Cleaned:
    clean: DataFrame
    changelog: DataFrame
    rejects: DataFrame
    raw: DataFrame


def _id_text(df: DataFrame, id_col: str) -> Column:
    return df[f"`{id_col}`"].cast("string")


def _reason(n: Column, columns: Sequence[str]) -> Column:
    """Why a log row is rejected, from the count of its id in the data; NULL: accepted."""
    return (F.when(n > 1, F.lit("duplicated_id")).when(n.isNull(), F.lit("unknown_id"))
            .when(~F.col("variable").isin(sorted(columns)), F.lit("unknown_variable")))


def _classified(log: DataFrame, counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Log rows with ``reason`` and the boolean ``change``; counts: __id, __n of the ids the log names."""
    j = log.join(counts, F.col("uuid") == F.col("__id"), "left")
    return j.select("seq", "uuid", "variable", "new_value", X.to_flag(F.col("change")).alias("change"),
                    _reason(F.col("__n"), columns).alias("reason"))


def classify_log(data: DataFrame, log: DataFrame, id_col: str) -> DataFrame:
    """Log rows with ``reason`` (NULL = accepted) and the boolean ``change``."""
    # only ids that the log names are counted
    named = log.select(F.col("uuid").alias("__named")).distinct()
    ids = data.select(_id_text(data, id_col).alias("__id"))
    counts = (ids.join(named, F.col("__id") == F.col("__named"), "left_semi")
              .groupBy("__id").agg(F.count(F.lit(1)).alias("__n")))
    return _classified(log, counts, data.columns)


def duplicate_ids(data: DataFrame, id_col: str) -> DataFrame:
    """Ids occurring more than once in the data (A14), with their count."""
    return (data.groupBy(_id_text(data, id_col).alias("uuid")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def missing_ids(log: DataFrame, data: DataFrame, id_col: str) -> DataFrame:
    """Distinct log ids that the data does not contain (J5, anti-join): the
    check to run before cleaning."""
    ids = data.select(_id_text(data, id_col).alias("uuid"))
    return log.select("uuid").distinct().join(ids, "uuid", "left_anti")


def rejects(data: DataFrame, log: DataFrame, id_col: str) -> DataFrame:
    """Rejected log rows and why."""
    return classify_log(data, log, id_col).where(F.col("reason").isNotNull())


def _old_value(variable: Column, columns: Sequence[str], held: Sequence[str]) -> Column:
    """The value of the named column; ``held`` names the columns' copies."""
    expr = F.lit(None).cast("string")
    for c, h in zip(columns, held):
        expr = F.when(variable == c, F.col(h)).otherwise(expr)
    return expr


def last_writes(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """__wid, __writes: per id that the log names, its last write per known column as
    a map.  The map holds at most one entry per column, whatever the log's length."""
    counts = X.to_flag(F.col("change")) & F.col("variable").isin(list(columns))
    last = log.withColumn("__on", F.coalesce(counts, F.lit(False))).groupBy("uuid", "variable", "__on") \
        .agg(F.max_by("new_value", "seq").alias("v"))
    entries = F.collect_list(F.when(F.col("__on"), F.struct("variable", "v")))
    return last.groupBy(F.col("uuid").alias("__wid")).agg(F.map_from_entries(entries).alias("__writes")).where("__wid is not null")


def apply_cleaning_log(data: DataFrame, log: DataFrame, id_col: str = "uuid") -> Cleaned:
    """(clean, changelog, rejects, raw)."""
    variables = [c for c in data.columns if c != id_col]
    dtypes = dict(data.dtypes)
    writes = last_writes(log, data.columns)
    met = data.join(writes, _id_text(data, id_col) == writes["__wid"], "left")
    met = materialize(met.withColumn("__met", F.col("__wid").isNotNull()), "cleaning", partition_by=("__met",))
    named = met.where(F.col("__met"))
    counts = named.groupBy(F.col("__wid").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))

    single = counts.where(F.col("__n") == 1).select(F.col("__id").alias("__one"))
    hits = named.join(single, F.col("__wid") == F.col("__one"), "left")
    m = F.when(F.col("__one").isNotNull(), F.col("__writes"))
    out = []
    for c in data.columns:
        new = m[c] if dtypes[c] == "string" else m[c].try_cast(dtypes[c])
        # map_contains_key, not coalesce: a NULL new value really nulls the cell
        has = F.lit(False) if c == id_col else F.map_contains_key(m, F.lit(c))
        out.append(F.when(has, new).otherwise(F.col(f"`{c}`")).alias(c))
    clean = met.where(~F.col("__met")).select(*[F.col(f"`{c}`") for c in data.columns]).unionByName(hits.select(*out))

    # changelog: the value each accepted row found before any write.  Every
    # accepted id occurs exactly once in the data (unknown and duplicated ids
    # were rejected), so an inner join returns the same rows as a left join --
    # and lets AQE split a hot id on either side.
    held = [f"__d{i}" for i in range(len(variables))]  # data columns may be named like the log's
    old = named.select(F.col("__wid").alias("__did"), *[F.col(f"`{c}`").cast("string").alias(h) for c, h in zip(variables, held)])
    old = old.join(single, F.col("__did") == F.col("__one"), "left_semi")
    classified = _classified(log, counts, data.columns)
    known = log.select("seq", "uuid", "variable", "new_value", X.to_flag(F.col("change")).alias("change")) \
        .where(F.col("change") & F.col("variable").isin(sorted(data.columns)))
    cl = known.join(old, F.col("uuid") == F.col("__did"), "inner").select(
        F.col("variable"), F.col("uuid"), _old_value(F.col("variable"), variables, held).alias("old_value"),
        F.col("new_value"), F.col("change"), F.lit(id_col).alias("id_column"), F.col("seq"))
    return Cleaned(clean=clean, changelog=cl, rejects=classified.where(F.col("reason").isNotNull()),
                   raw=data)


def derive_followups(df: DataFrame, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """``(new, condition column, value, source)``: copy ``source`` into
    ``new`` where ``condition == value``, NULL elsewhere (F21)."""
    return df.withColumns({new: X.conditional_copy(F.col(cond) == F.lit(val), F.col(src))
                           for new, cond, val, src in rules})
