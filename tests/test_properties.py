"""Properties of the whole workflow on the smallest bound tables."""

from pyspark.sql import functions as F

from souk.functions import exprs as X

from conftest import SF_SMALL
from souk.operators import means as M
from souk.operators import survey as S
from souk.plans.catalog import market_round


def test_union_counts_add_up(spark):
    m = market_round(spark, SF_SMALL)
    assert m.stacked.count() == sum(r.count() for r in m.rounds)


def test_level_rows_equal_distinct_keys(spark):
    m = market_round(spark, SF_SMALL)
    allm = m.all_means
    for level, keys in M.LEVELS.items():
        n = allm.where(F.col("level") == level).count()
        assert n == m.item_prices.select(*keys).distinct().count(), level


def test_shares_sum_to_one(spark):
    m = market_round(spark, SF_SMALL)
    sums = m.shares_one.groupBy("dependent_var", "independent_var_value") \
        .agg(F.sum("numbers").alias("s")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-9 for r in sums)


def test_report_keys_unique(spark):
    m = market_round(spark, SF_SMALL)
    long = m.report_long
    assert long.count() == long.select("key").distinct().count()


def test_plan_driven_analysis_equals_parts(spark):
    m = market_round(spark, SF_SMALL)
    plan = spark.createDataFrame([("o_orderpriority", "select_one"), ("o_totalprice", "numeric")],
                                 "dependent_variable string, dependent_variable_type string")
    got = S.analyse_plan(m.survey_orders, plan)
    want = S.select_one_shares(m.survey_orders, ["o_orderpriority"]).unionByName(
        S.numeric_means(m.survey_orders, ["o_totalprice"]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_p_value_is_null_without_a_test(spark):
    m = market_round(spark, SF_SMALL)
    named = F.col("dependent_var") == "o_orderpriority"
    assert m.with_p_value.where(F.col("p_value").isNull() == named).count() == 0
    assert m.with_p_value.where(named).count() > 0
    assert m.with_p_value.count() == m.stats.count()  # tests named twice do not multiply rows


def test_medians_of_bound_data_match_spark(spark):
    from souk.operators import impute as I
    m = market_round(spark, SF_SMALL)
    months = ["October", "September"]
    got = I.settlement_medians(m.item_prices, months)
    ms = [c for c in got.columns if c not in I.MEDIAN_KEYS]
    want = m.item_prices.where(F.col("month").isin(months)).groupBy(*I.MEDIAN_KEYS).agg(
        *[F.median(X.nan_to_null(c)).alias(c) for c in ms])
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, want.collect())) == sorted(map(key, got.select(*want.columns).collect()))
