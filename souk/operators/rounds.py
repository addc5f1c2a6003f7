"""Stacking rounds and deriving item prices (M1, M2)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk import config
from souk.functions import exprs as X
from souk.functions import names as N

OBS_KEYS = ["month", "country", "district", "regions", "settlement", "market_final"]
PRICE_KEYS = ["uuid", "month", "regions", "district", "settlement", "market_final"]


def stack_rounds(rounds: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing in one round is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rounds)


def region_of(sub_region: F.Column, west_nile: Iterable[str] = config.WEST_NILE_SUBREGIONS,
              default: str = config.REGION_DEFAULT, other: str = config.REGION_OTHER) -> F.Column:
    return F.when(sub_region.isin(list(west_nile)), F.lit(other)).otherwise(F.lit(default))


def attach_geography(obs: DataFrame, settlements: DataFrame, districts: DataFrame,
                     west_nile: Iterable[str] = config.WEST_NILE_SUBREGIONS) -> DataFrame:
    """Left-join settlement then district lookups (J1, J2), derive region.

    Both lookups are one row per key; Spark broadcasts them when their
    estimated size is under the broadcast threshold and shuffles otherwise.
    """
    df = obs.join(settlements, "settlement", "left")
    df = df.join(districts, "district", "left")
    sub = X.sentence_case(F.col("F15Regions"))
    return df.withColumn("regions", region_of(sub, west_nile))


def finish_observations(df: DataFrame, month_names=config.MONTH_NAMES) -> DataFrame:
    """Month name (F7), drop unknown months (P9), resolve 'Other' markets (F19),
    drop helper columns, add country, keys first."""
    df = df.withColumn("month", X.month_name(F.col("month"), month_names)) \
        .where(F.col("month").isNotNull())
    other = F.col("market_other") if "market_other" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("market_final",
                       F.when(F.col("market") == "Other", other).otherwise(F.col("market")))
    df = df.drop("market", "market_other", "day", "F15Regions", "DName2019", "sub_regions")
    df = df.withColumn("country", F.lit("uganda"))
    return N.keys_first(df, OBS_KEYS)


def stack_and_enrich(rounds: Sequence[DataFrame], settlements: DataFrame, districts: DataFrame,
                     west_nile: Iterable[str] = config.WEST_NILE_SUBREGIONS) -> DataFrame:
    """M1: three rounds -> one tagged, geo-enriched observation table."""
    return finish_observations(attach_geography(stack_rounds(rounds), settlements, districts,
                                                west_nile))


def price_columns(columns: Sequence[str]) -> list[str]:
    """Price and weight measures by name."""
    return N.match_names(
        columns, contains=["price"], starts_with=["weight_"],
        exclude_starts_with=["price_increase", "price_decrease", "challenge_"],
        exclude_ends_with=["_prices"], exclude=PRICE_KEYS)


def item_prices(obs: DataFrame, this_round: str = config.THIS_ROUND,
                last_round: str = config.LAST_ROUND,
                unit_items: Iterable[str] = config.UNIT_PRICED_ITEMS) -> DataFrame:
    """M2: measures only; sentinels recoded (F12); unit prices (F13); round tag."""
    measures = price_columns(obs.columns)
    dtypes = dict(obs.dtypes)
    cols = {m: X.recode_sentinels(m, is_text=dtypes[m] == "string") for m in measures}
    for item in unit_items:
        p, w = f"price_{item}", f"weight_{item}"
        if p in cols:
            wc = cols.get(w, F.lit(None).cast("double"))
            cols[p] = X.safe_div(cols[p], wc)
    keep = _means_wanted(measures)
    order = (F.when(F.col("month") == this_round, F.lit(config.ORDER_THIS))
             .when(F.col("month") == last_round, F.lit(config.ORDER_LAST))
             .otherwise(F.lit(config.ORDER_OTHER)))
    keys = [F.col(k) if k in obs.columns else F.lit(None).cast("string").alias(k)
            for k in PRICE_KEYS]   # a round without ids (the baseline file has none)
    return obs.select(*keys, *[cols[m].alias(m) for m in keep],
                      order.alias("collection_order"))


def _means_wanted(measures: Sequence[str]) -> list[str]:
    return [m for m in measures if "weight" not in m.lower() and "observed" not in m.lower()]


def measure_columns(df: DataFrame) -> list[str]:
    """The measures of an item price table: every one that ``item_prices`` keeps."""
    return _means_wanted(price_columns(df.columns))
