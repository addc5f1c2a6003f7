"""Minimum expenditure basket (M6-M9) and area ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk import config
from souk.functions import exprs as X
from souk.functions import names as N
from souk.operators import impute as I
from souk.operators.selection import ranked

BasketItems = Sequence[tuple[str, Sequence[float], str]]


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def basket_lines(df: DataFrame, items: BasketItems = config.BASKET_ITEMS,
                 food_order: Sequence[str] = config.FOOD_TOTAL_ORDER,
                 household: int = config.HOUSEHOLD_SIZE) -> DataFrame:
    """M6 + M7: per-line costs and the hygiene, energy, other, food and full totals.

    Any NULL line makes its totals NULL.
    """
    lines: dict[str, Column] = {}
    groups: dict[str, list[str]] = {}
    for item, factors, group in items:
        c = F.col(f"price_{item}")
        for f in factors:
            c = c * F.lit(f)
        lines[f"meb_{item}"] = c * F.lit(household)
        groups.setdefault(group, []).append(f"meb_{item}")
    lit = lambda v: F.lit(v).cast("double")
    hygiene = [lit(v) for _, v in config.BASKET_FIXED_HYGIENE] + \
        [F.col(m) for m in groups.get("hygiene", [])]
    other = {f"meb_{k}": lit(v) for k, v in config.BASKET_FIXED_OTHER}
    yearly = sum(v for _, v in config.BASKET_YEARLY) / 12
    energy = [lit(config.BASKET_LIGHTING)] + [F.col(m) for m in groups.get("energy", [])]
    food = [F.col(f"meb_{i}") for i in food_order if f"meb_{i}" in lines]
    df = df.withColumns(lines)
    df = df.withColumn("meb_hygiene", _sum(hygiene))
    df = df.withColumns(other)
    df = df.withColumn("meb_other_hdd", lit(yearly))
    df = df.withColumn("meb_energy", _sum(energy))
    df = df.withColumn("meb_food", _sum(food))
    full = [F.col("meb_food")] + [F.col(k) for k in other] + \
        [F.col("meb_hygiene"), F.col("meb_other_hdd"), F.col("meb_energy")]
    return df.withColumn("meb_full", _sum(full))


def round_numeric(df: DataFrame, digits: int = 0, skip: Sequence[str] = ()) -> DataFrame:
    """Half-even rounding of every floating column (F16)."""
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[X.half_even(c, digits).alias(c) if c in dbl and c not in skip else F.col(c)
                       for c in df.columns])


def meb(item_prices: DataFrame, months: Sequence[str],
        items: BasketItems = config.BASKET_ITEMS,
        food_order: Sequence[str] = config.FOOD_TOTAL_ORDER,
        baseline: DataFrame | None = None) -> DataFrame:
    """M8: settlement medians -> gap filling -> basket -> rounded; baseline rows
    (a precomputed basket table for an earlier round) are stacked on top."""
    return meb_from_medians(I.settlement_medians(item_prices, months), items, food_order, baseline)


def meb_from_medians(med: DataFrame, items: BasketItems = config.BASKET_ITEMS,
                     food_order: Sequence[str] = config.FOOD_TOTAL_ORDER,
                     baseline: DataFrame | None = None) -> DataFrame:
    """M8 from medians that are there already (one run serves several rounds)."""
    ms = [c for c in med.columns if c.startswith("price_")]
    filled = I.impute_hierarchical(med, ms)
    b = basket_lines(filled, items, food_order)
    b = b.drop(*[c for c in b.columns if c.startswith("price_") or c.startswith("meb1_")])
    b = round_numeric(b)
    if baseline is not None:
        b = baseline.unionByName(b, allowMissingColumns=True)
    return N.keys_first(b, ["month"])


def meb_rollup(meb_df: DataFrame, level: str) -> DataFrame:
    """M9: mean of the rounded settlement baskets per region or nationally,
    rounded again, food/full renamed with the level prefix (A8)."""
    ms = [c for c in meb_df.columns if c.startswith("meb_")]
    if level == "regional":
        keys, prefix = ["regions", "month", "collection_order"], "regional_"
    elif level == "national":
        keys, prefix = ["month", "collection_order"], "national_"
    else:
        raise ValueError(level)
    out = meb_df.groupBy(*keys).agg(*[X.mean_skip_na(m).alias(m) for m in ms])
    if level == "national":
        out = out.withColumn("regions", F.lit(config.NATIONWIDE_LABEL))
    out = round_numeric(out)
    return out.withColumnsRenamed({"meb_food": prefix + "meb_food", "meb_full": prefix + "meb_full"})


def rank_all(meb_df: DataFrame, month: str, area: str = "settlement", value: str = "meb_full") -> DataFrame:
    """Every area of one round with its rank, 1 = most expensive; ties by area
    name, NULL cost last.  Ranked by ranges (``selection.ranked``), not in one task."""
    cur = meb_df.where(F.col("month") == month).select(area, value)
    return ranked(cur, [F.col(value).desc_nulls_last(), F.col(area).asc_nulls_last()]) \
        .select(area, value, F.col("rank").cast("int").alias("rank"))


def rank_areas(meb_df: DataFrame, month: str, k: int = 3, area: str = "settlement",
               value: str = "meb_full") -> DataFrame:
    """The k most and k least expensive areas of one round, with their
    global rank (1 = most expensive).

    Ties keep a stable order (area name ascending); NULL cost sorts last.
    Instead of a global window (one task), both ends are taken with a
    top-k (``TakeOrderedAndProject``) and the bottom ranks are offset by
    the row count, a scalar subquery.
    """
    cur = meb_df.where(F.col("month") == month).select(area, value)
    desc = [F.col(value).desc_nulls_last(), F.col(area).asc_nulls_last()]
    asc = [F.col(value).asc_nulls_first(), F.col(area).desc_nulls_first()]
    top = cur.orderBy(*desc).limit(k) \
        .withColumn("rank", F.row_number().over(Window.orderBy(*desc)))
    n = cur.select(F.count(F.lit(1))).scalar()
    bottom = cur.orderBy(*asc).limit(k) \
        .withColumn("rank", (n - F.row_number().over(Window.orderBy(*asc)) + 1).cast("int"))
    return top.unionByName(bottom)
