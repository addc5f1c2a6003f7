"""Area means and assessment counts (M3, M4; A1-A6, A9-A11).

Means skip NULL and NaN but not Inf, and a non-finite result becomes NULL.

The observations are reduced to sums and counts twice: per settlement (within
district and region, per month) and per market of a settlement.  Both reductions
run map-side, so the shuffles carry one row per group and task, whatever the number of
observations or how skewed an area is.  Markets can be nearly as many as the
observations, settlements are few: only the settlements' sums are expanded, in one
``GROUPING SETS`` pass, to the four levels without a market, and a market's sums
are shuffled once.  Each level's mean is sum(sums) / sum(counts) -- exactly the
mean over the raw rows, not a mean of means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import exprs as X
from souk.operators.rounds import measure_columns

LEVELS: dict[str, list[str]] = {
    "national": ["month", "collection_order"],
    "market": ["settlement", "market_final", "month", "collection_order"],
    "settlement": ["regions", "district", "settlement", "month", "collection_order"],
    "district": ["regions", "district", "month", "collection_order"],
    "region": ["regions", "month", "collection_order"],
}
CELL_KEYS = ["regions", "district", "settlement", "market_final", "month", "collection_order"]
AREA_KEYS = LEVELS["settlement"]
AREA_LEVELS = [level for level in LEVELS if level != "market"]


def _sum_col(m: str) -> str:
    return f"__s_{m}"


def _cnt_col(m: str) -> str:
    return f"__n_{m}"


def _dbl_col(m: str) -> str:
    return f"__r_{m}"


def _inf_col(m: str) -> str:
    return f"__i_{m}"


def cell_sums(item_prices: DataFrame, measures: Sequence[str] | None = None,
              keys: Sequence[str] = tuple(CELL_KEYS)) -> DataFrame:
    """Per finest cell, or group of ``keys``: the two sums and the count of each
    measure's finite values, and the number of infinite ones (NaN skipped)."""
    ms = list(measures or measure_columns(item_prices))
    aggs = []
    for m in ms:
        aggs += [F.sum(X.decimal_part(m)).alias(_sum_col(m)), F.sum(X.double_part(m)).alias(_dbl_col(m)),
                 X.finite_count(m).alias(_cnt_col(m)),
                 F.count(F.when(X.is_inf(m), 1)).alias(_inf_col(m))]
    return item_prices.groupBy(*keys).agg(*aggs)


def _mean_from_cells(m: str) -> Column:
    mean = X.mean_of(F.sum(_sum_col(m)), F.sum(_dbl_col(m)), F.sum(_cnt_col(m)))
    return F.when(F.sum(_inf_col(m)) == 0, mean).alias(m)


def area_means(item_prices: DataFrame, level: str,
               measures: Sequence[str] | None = None) -> DataFrame:
    """One level's means (A1-A5)."""
    ms = list(measures or measure_columns(item_prices))
    keys = LEVELS[level]
    return (item_prices.groupBy(*keys)
            .agg(*[X.clean_mean(m).alias(m) for m in ms]))


def all_level_means(item_prices: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """All five levels (A6), tagged by ``level``.  Reads ``item_prices`` twice: pass a stored table."""
    ms = list(measures or measure_columns(item_prices))
    return _tagged(levels_of_areas(cell_sums(item_prices, ms, AREA_KEYS)), area_means(item_prices, "market", ms))


def levels_of_sums(areas: DataFrame, markets: DataFrame) -> DataFrame:
    """All five levels from sums and counts per settlement and per market; both may hold a
    group several times."""
    return _tagged(levels_of_areas(areas), markets.groupBy(*LEVELS["market"]).agg(*[_mean_from_cells(m) for m in _summed(markets)]))


def _summed(sums: DataFrame) -> list[str]:
    return [c.removeprefix("__s_") for c in sums.columns if c.startswith("__s_")]


def _tagged(levels: DataFrame, markets: DataFrame) -> DataFrame:
    """The key columns that a level lacks are NULL there."""
    ms = [c for c in markets.columns if c not in CELL_KEYS]
    out = levels.unionByName(markets.withColumn("level", F.lit("market")), allowMissingColumns=True)
    return out.select("level", *CELL_KEYS, *ms)


def levels_of_areas(areas: DataFrame) -> DataFrame:
    """The four levels without a market from the settlements' sums and counts.

    ``grouping()`` tells a rolled-up key from a genuinely NULL one.
    """
    ms = _summed(areas)
    sets = [[F.col(k) for k in LEVELS[lv]] for lv in AREA_LEVELS]
    level = (F.when(F.grouping("regions") == 1, F.lit("national")).when(F.grouping("district") == 1, F.lit("region"))
             .when(F.grouping("settlement") == 1, F.lit("district")).otherwise(F.lit("settlement")))
    out = areas.groupingSets(sets, *[F.col(k) for k in AREA_KEYS]).agg(
        level.alias("level"), *[_mean_from_cells(m) for m in ms])
    return out.select("level", *AREA_KEYS, *ms)


def level_from_all(all_means: DataFrame, level: str) -> DataFrame:
    """One level out of the combined table, with that level's key columns."""
    ms = [c for c in all_means.columns if c not in CELL_KEYS and c != "level"]
    return all_means.where(F.col("level") == level).select(*LEVELS[level], *ms)


def assessment_counts(item_prices: DataFrame, month: str) -> DataFrame:
    """Markets assessed (distinct, NULL counted) and rows, per region and
    nationally, for one round (A9, A10, U4).

    Distinct markets come from a (region, market) pre-aggregation: a NULL
    market is a group of its own, so it counts once, as it should.
    """
    cells = (item_prices.where(F.col("month") == month)
             .groupBy("regions", "market_final").agg(F.count(F.lit(1)).alias("n")))
    # national and regional rows in one pass over the cells
    g = cells.groupingSets([[], [F.col("regions")]], F.col("regions")).agg(
        F.count(F.lit(1)).alias("num_market_assessed"), F.sum("n").alias("num_assessed"),
        F.grouping("regions").alias("__g"))
    level = F.when(F.col("__g") == 1, F.lit("national")).otherwise(F.col("regions"))
    return g.select(level.alias("level"), "num_market_assessed", "num_assessed")


def settlements_per_region(item_prices: DataFrame) -> DataFrame:
    """Distinct settlements per (region, month), NULL counted."""
    return (item_prices.groupBy("regions", "month", "settlement").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("regions", "month").agg(F.count(F.lit(1)).alias("markets_numer")))
