"""Hierarchical gap filling (M5) and settlement medians."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk import config
from souk.functions import exprs as X
from souk.operators.selection import exact_medians
from souk.sources.store import materialize

FILL_LEVELS = (("settlement", "month"), ("district", "month"), ("regions", "month"), ("regions",))
MEDIAN_KEYS = ["settlement", "district", "regions", "month", "collection_order"]


def basket_measures(columns: Sequence[str], excluded: Iterable[str] = config.MEDIAN_EXCLUDED) -> list[str]:
    ex = {e.lower() for e in excluded}
    return [c for c in columns
            if c.startswith("price_") and c.lower() not in ex and "_price" not in c.lower()]


def settlement_medians(item_prices: DataFrame, months: Sequence[str],
                       excluded: Iterable[str] = config.MEDIAN_EXCLUDED) -> DataFrame:
    """Exact median per settlement and round of every basket measure."""
    ms = basket_measures(item_prices.columns, excluded)
    return exact_medians(item_prices.where(F.col("month").isin(list(months))), MEDIAN_KEYS, ms)


def _carried(state: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The states of larger cells: sums, counts and gaps add up."""
    return state.groupBy(*keys).agg(F.array(*[
        F.struct(F.sum(F.col("__s")[i]["sum"]).alias("sum"), F.sum(F.col("__s")[i]["n"]).alias("n"),
                 F.sum(F.col("__s")[i]["gaps"]).alias("gaps")) for i in range(n)]).alias("__s"))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    right = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *columns)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return left.join(right, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def _filled(s: Column, mean: Column) -> Column:
    """A cell's state after its gaps were filled with the mean (NULL: no values, nothing filled)."""
    hit = mean.isNotNull() & (s["gaps"] > 0)
    kept = hit & ~F.isnan(mean)  # a NaN fills the gap but counts in no later mean
    return F.struct(F.when(kept, s["sum"] + s["gaps"] * mean).otherwise(s["sum"]).alias("sum"),
                    F.when(kept, s["n"] + s["gaps"]).otherwise(s["n"]).alias("n"),
                    F.when(hit, F.lit(0).cast("long")).otherwise(s["gaps"]).alias("gaps"))


def fill_means(df: DataFrame, measures: Sequence[str], levels: Sequence[Sequence[str]] = FILL_LEVELS) -> list[DataFrame]:
    """Per level, a table of its keys and the array ``__mean`` of the means that fill its gaps.

    The rows are reduced once to cells of all keys together: per measure the sum
    and count of the values and the number of gaps.  A level's mean is the sum
    over the count of its cells; filling turns a cell's state into sum + gaps x
    mean, count + gaps, no gaps.  Cells are then merged to the keys that later
    levels still need, so the tables shrink on the way up and no level looks at
    rows again.
    """
    n = len(measures)
    later = [sorted({k for keys in levels[i:] for k in keys}) for i in range(len(levels))]
    state = df.groupBy(*later[0]).agg(F.array(*[
        F.struct(F.coalesce(F.sum(X.nan_to_null(m)), F.lit(0.0)).alias("sum"), F.count(X.nan_to_null(m)).alias("n"),
                 F.count(F.when(F.col(m).isNull(), 1)).alias("gaps")) for m in measures]).alias("__s"))
    out = []
    for i, keys in enumerate(levels):
        state = materialize(state, "fill_cells")
        total = _carried(state, keys, n)
        means = total.select(*keys, F.transform("__s", lambda s: F.when(s["n"] > 0, s["sum"] / s["n"])).alias("__mean"))
        out.append(means)
        if i + 1 < len(levels):
            cells = _null_safe(state, means, keys, ["__mean"])
            cells = cells.withColumn("__s", F.zip_with("__s", "__mean", _filled))
            state = _carried(cells, later[i + 1], n)
    return out


def impute_hierarchical(df: DataFrame, measures: Sequence[str] | None = None,
                        levels: Sequence[Sequence[str]] = FILL_LEVELS) -> DataFrame:
    """Fill NULL measures from the mean of the surrounding area, level by level.

    Sequential: each level's mean sees the values filled before it, by the
    carried states of ``fill_means``.  Rows only meet small tables of group
    means, by joins whose large side stays spread out: no group of rows is
    gathered, however many settlements a region has.
    """
    ms = list(measures or [c for c in df.columns if c.startswith("price_")])
    columns = df.columns
    tables = fill_means(df, ms, levels)
    for i, (keys, means) in enumerate(zip(levels, tables, strict=True)):
        df = _null_safe(df, means.withColumnRenamed("__mean", f"__mean{i}"), keys, [f"__mean{i}"])
    filled = {m: F.coalesce(F.col(m), *[F.col(f"__mean{i}")[at] for i in range(len(levels))]) for at, m in enumerate(ms)}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in columns])
