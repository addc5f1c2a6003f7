"""Reshaping (R1-R6) and the report pieces built from them.

Wide outputs for the report template are produced in two steps: a long
(key, num, str) table, which is the distributed result, and a one-row pivot
of it.  The pivot runs on an already aggregated table (one row per report
cell), never on observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import exprs as X

def unpivot(df: DataFrame, ids: Sequence[str], var_name: str = "var_name",
            value_name: str = "var_value", values: Sequence[str] | None = None) -> DataFrame:
    """Wide -> long."""
    vals = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), vals, var_name, value_name)


def pivot_one(df: DataFrame, key: str, value: str, keys: Sequence[str],
              by: Sequence[str] = ()) -> DataFrame:
    """Long -> wide, column name = key (R2); of several values of a cell the largest."""
    return df.groupBy(*by).pivot(key, list(keys)).agg(F.max(value))


def to_long(df: DataFrame, key: Column, num: Column | None = None,
            text: Column | None = None) -> DataFrame:
    """One report cell per row."""
    return df.select(key.alias("key"),
                     (num if num is not None else F.lit(None)).cast("double").alias("num"),
                     (text if text is not None else F.lit(None)).cast("string").alias("str"))


def wide_to_long(df: DataFrame, key_prefix: Column | str, ids: Sequence[str] = ()) -> DataFrame:
    """Every numeric non-id column becomes a cell ``<prefix><column>``."""
    vals = [f.name for f in df.schema.fields
            if f.name not in ids and f.dataType.typeName() in ("double", "float", "integer", "long")]
    if not vals:
        return df.sparkSession.createDataFrame([], "key string, num double, str string")
    long = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in vals]) \
        .unpivot(list(ids), vals, "__var", "__val")
    pre = F.lit(key_prefix) if isinstance(key_prefix, str) else key_prefix
    return long.select(F.concat(pre, F.col("__var")).alias("key"), F.col("__val").alias("num"),
                       F.lit(None).cast("string").alias("str"))


def cell_text(num: Column, text: Column, digits: int = 0) -> Column:
    """A report cell as text: the text if any, else the number rounded half-even
    (integral values without a decimal point; NaN / Inf spelled out)."""
    r = X.half_even(num, digits)
    as_num = (F.when(F.isnan(r), F.lit("NaN"))
              .when(r == X.INF(), F.lit("Inf")).when(r == X.NEG_INF(), F.lit("-Inf"))
              .when(r == F.floor(r), r.cast("long").cast("string"))
              .otherwise(r.cast("string")))
    return F.coalesce(text, as_num)


def pivot_report(long: DataFrame, keys: Sequence[str] | None = None, digits: int = 0) -> DataFrame:
    """The long report -> one row, one column per key (J9 without any
    cross product: every piece is unioned first, then turned once).

    The report is a few thousand cells of already aggregated results.  They
    are de-duplicated per key, gathered into one key-sorted array and read
    back by position -- a pivot with thousands of values generates one
    aggregate buffer per value and is far slower to plan and compile.  The
    key list comes from the (small) cell table unless given.
    """
    cells = (long.groupBy("key")
             .agg(F.max(cell_text(F.col("num"), F.col("str"), digits)).alias("v")))
    if keys is None:
        # report-sized; sorted here (code-point order = Spark's UTF-8 byte order)
        keys = sorted(r[0] for r in cells.select("key").collect())
    else:
        keys = sorted(set(keys))
        cells = cells.where(F.col("key").isin(keys))
    row = cells.agg(F.array_sort(F.collect_list(F.struct("key", "v"))).alias("a"))
    # one expression list handed over at once: per-column Column objects cost
    # a round trip each
    quote = lambda k: "`" + k.replace("`", "``") + "`"
    return row.selectExpr(*[f"a[{i}].v AS {quote(k)}" for i, k in enumerate(keys)])


def top_k(stats: DataFrame, variables: Sequence[str], areas: Sequence[str], k: int,
          area_col: str = "independent_var_value") -> DataFrame:
    """The k largest ``numbers`` per (area, question); ties by answer
    code ascending; rank column added.  Spark plans the row_number filter as
    a per-partition group limit before the shuffle."""
    w = Window.partitionBy(area_col, "dependent_var").orderBy(
        F.col("numbers").desc_nulls_last(), F.col("dependent_var_value").asc_nulls_last())
    f = stats.where(F.col("dependent_var").isin(list(variables)) & F.col(area_col).isin(list(areas)))
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_answers(stats: DataFrame, variables: Sequence[str], areas: Sequence[str], k: int,
                scale: float = 100.0) -> DataFrame:
    """M14 in long form: ``numbers_<area>_<var>_<rank>`` (share x100) and
    ``dependent_var_value_<area>_<var>_<rank>`` (the answer)."""
    t = top_k(stats, variables, areas, k)
    new_var = X.paste("independent_var_value", "dependent_var", "rank")
    nums = to_long(t, F.concat(F.lit("numbers_"), new_var), num=F.col("numbers") * scale)
    txt = to_long(t, F.concat(F.lit("dependent_var_value_"), new_var),
                  text=F.col("dependent_var_value"))
    return nums.unionByName(txt)


def area_scalars(stats: DataFrame, mean_vars: Sequence[str], share_vars: Sequence[str],
                 areas: Sequence[str], scale: float = 100.0) -> DataFrame:
    """M15 in long form: means as ``<area>_<var>``; shares x100 as
    ``numbers_<area>_<var>_<value>`` plus the value as
    ``dependent_var_value_<area>_<var>_<value>``."""
    a = F.col("independent_var_value").isin(list(areas))
    m = stats.where(a & F.col("dependent_var").isin(list(mean_vars)))
    means = to_long(m, X.paste("independent_var_value", "dependent_var"), num=F.col("numbers"))
    s = stats.where(a & F.col("dependent_var").isin(list(share_vars)))
    new_var = X.paste("independent_var_value", "dependent_var", "dependent_var_value")
    shares = to_long(s, F.concat(F.lit("numbers_"), new_var), num=F.col("numbers") * scale)
    vals = to_long(s, F.concat(F.lit("dependent_var_value_"), new_var),
                   text=F.col("dependent_var_value"))
    return means.unionByName(shares).unionByName(vals)


def area_by_var(stats: DataFrame, var_keys: Sequence[str]) -> DataFrame:
    """One row per area, one column per ``<question>.<answer>`` of ``var_keys``;
    of several numbers of a cell the largest."""
    s = stats.select("independent_var_value",
                     F.concat(F.col("dependent_var"), F.lit("."),
                              X.na_text("dependent_var_value")).alias("var"),
                     "numbers")
    g = s.groupBy("independent_var_value")
    return g.pivot("var", list(var_keys)).agg(F.max("numbers"))
