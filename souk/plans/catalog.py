"""Registered queries: one per operator group of the survey workflow.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole bound tables.  ``compare_form`` rounds floating columns to 6 decimals
(half-even) so results can be hashed against another engine whose sums run
in a different order; the library itself never rounds except where the
workflow does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk import config
from souk.functions import exprs as X
from souk.operators import means as M
from souk.operators import reshape as R
from souk.operators import survey as S
from souk.plans import roundtrip as RT
from souk.plans.market import MarketRound
from souk.sources.store import releases, stamp

_ROUNDS: dict[str, tuple[tuple, MarketRound]] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def market_round(spark: SparkSession, sf_dir: str) -> MarketRound:
    """The workflow over one folder, whose written tables all queries share as long
    as they are there: a new application, a release of the written tables or a
    table that changed starts a new one."""
    state = (spark.sparkContext.applicationId, releases(), *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in TABLES))
    if sf_dir not in _ROUNDS or _ROUNDS[sf_dir][0] != state:
        _ROUNDS[sf_dir] = state, MarketRound(spark, sf_dir)
    return _ROUNDS[sf_dir][1]


def compare_form(df: DataFrame, digits: int = 6) -> DataFrame:
    dtypes = df.dtypes
    if not any(t in ("double", "float") for _, t in dtypes):
        return df
    quote = lambda k: "`" + k.replace("`", "``") + "`"
    return df.selectExpr(*[f"bround({quote(c)}, {digits}) AS {quote(c)}" if t in ("double", "float")
                           else quote(c) for c, t in dtypes])


def _stacked_measures(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("price_") or c.startswith("weight_")]


def q_null_tokens_sentinels(m: MarketRound) -> DataFrame:
    s = m.stacked
    tokens = list(config.NULL_TOKENS)
    return s.select("uuid", "month", "settlement",
                    F.when(~F.col("market").isin(tokens), F.col("market")).alias("market"),
                    *[X.recode_sentinels(c).alias(c) for c in _stacked_measures(s)])


def q_round_stack(m: MarketRound) -> DataFrame:
    return m.stacked.select("uuid", "month", "collection_order", "day", "settlement", "market",
                            "market_other")


def q_geo_enrich(m: MarketRound) -> DataFrame:
    return m.obs


def q_centroid_union(m: MarketRound) -> DataFrame:
    return m.settlements.select("settlement", "district", "objectid", "name", "type",
                                "longitude", "latitude")


def q_market_other(m: MarketRound) -> DataFrame:
    s = m.stacked
    return s.select("uuid", "month", "market", "market_other",
                    F.when(F.col("market") == "Other", F.col("market_other"))
                    .otherwise(F.col("market")).alias("market_final"))


def q_unit_price(m: MarketRound) -> DataFrame:
    return m.item_prices.select(
        "uuid", "month", "settlement", "collection_order",
        *[X.finite_or_null(f"price_{i}").alias(f"price_{i}") for i in config.BIND_UNIT_ITEMS])


def _level(level: str) -> Callable[[MarketRound], DataFrame]:
    return lambda m: m.means(level)


def q_count_region(m: MarketRound) -> DataFrame:
    return m.counts.where(F.col("level") != "national")


def q_unpivot_items(m: MarketRound) -> DataFrame:
    sett = m.means("settlement").where(F.col("collection_order") == config.ORDER_THIS)
    ms = [c for c in sett.columns if c.startswith("price_")]
    return R.unpivot(sett.select("settlement", *ms), ["settlement"])


def q_stat_format(m: MarketRound) -> DataFrame:
    st = m.stats
    pct = ~F.col("dependent_var").isin(list(config.BIND_NUMERIC))
    fmt_p = S.format_stat(F.col("numbers"), F.col("min"), F.col("max"), percent=True)
    fmt_n = S.format_stat(F.col("numbers"), F.col("min"), F.col("max"), percent=False)
    return st.select("dependent_var", "dependent_var_value", "independent_var",
                     "independent_var_value", F.when(pct, fmt_p).otherwise(fmt_n).alias("formatted"))


def q_flag_substring(m: MarketRound) -> DataFrame:
    return m.survey_events.select("uuid", "event_types", "mobile_accepted")


QUERIES: dict[str, Callable[[MarketRound], DataFrame]] = {
    "null_tokens_sentinels": q_null_tokens_sentinels,
    "round_stack": q_round_stack,
    "geo_enrich": q_geo_enrich,
    "centroid_union": q_centroid_union,
    "market_other": q_market_other,
    "unit_price": q_unit_price,
    "mean_national": _level("national"),
    "mean_market": _level("market"),
    "mean_settlement": _level("settlement"),
    "mean_district": _level("district"),
    "mean_region": _level("region"),
    "mean_all_levels": lambda m: m.all_means,
    "count_region": q_count_region,
    "count_national": lambda m: m.counts,
    "settlements_per_region": lambda m: M.settlements_per_region(m.item_prices),
    "median_settlement": lambda m: m.medians,
    "impute_hierarchical": lambda m: m.imputed,
    "basket_settlement": lambda m: m.meb,
    "basket_region": lambda m: m.meb_regional,
    "basket_national": lambda m: m.meb_national,
    "cleaning_apply": lambda m: m.cleaned.clean,
    "cleaning_changelog": lambda m: m.cleaned.changelog,
    "cleaning_rejects": lambda m: m.cleaned.rejects,
    "derive_followups": lambda m: m.followups,
    "pct_change_settlement": lambda m: m.change_settlement,
    "pct_change_region": lambda m: m.change_region,
    "pct_change_national": lambda m: m.change_national,
    "pct_change_meb_settlement": lambda m: m.change_meb_settlement,
    "pct_change_meb_region": lambda m: m.change_meb_region,
    "pct_change_meb_national": lambda m: m.change_meb_national,
    "pct_change_merged": lambda m: m.change_settlement_merged,
    "rank_top_bottom": lambda m: m.rank,
    "rank_all": lambda m: m.rank_all,
    "share_select_one": lambda m: m.shares_one,
    "share_select_multiple": lambda m: m.shares_multiple,
    "numeric_mean_ci": lambda m: m.numeric,
    "label_first_match": lambda m: m.labelled,
    "top_answers": lambda m: m.top_answers,
    "area_scalars": lambda m: m.area_scalars,
    "stat_format": q_stat_format,
    "attach_p_value": lambda m: m.with_p_value,
    "unpivot_items": q_unpivot_items,
    "pivot_two_values": lambda m: m.top_wide,
    "area_by_var_wide": lambda m: R.area_by_var(m.stats, config.BIND_AREA_KEYS),
    "report_long": lambda m: m.report_long,
    "report_by_settlement": lambda m: m.report_by_settlement,
    "report_row": lambda m: m.report_row,
    "analyse_plan": lambda m: m.planned,
    "label_by_list": lambda m: m.labelled_by_list,
    "read_rounds_csv": RT.rounds_read,
    "read_rejects": RT.rounds_rejected,
    "read_drift": RT.rounds_drift,
    "means_from_files": RT.rounds_means,
    "read_cleaning_log_csv": RT.log_read,
    "basket_from_file": RT.basket_from_file,
    "means_incremental": RT.means_incremental,
    "export_rows": RT.export_rows,
    "export_summary": RT.export_summary,
    "flag_substring": q_flag_substring,
}


def run(name: str, spark: SparkSession, sf_dir: str, compare: bool = True) -> DataFrame:
    df = QUERIES[name](market_round(spark, sf_dir))
    return compare_form(df) if compare else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in QUERIES}
