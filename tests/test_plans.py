"""Plan shapes that carry to large data: partial aggregation before every
shuffle, broadcast lookups, top-k instead of a global window, no cross
products."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from souk.operators import basket as B
from souk.operators import means as M
from souk.operators import reshape as R
from souk.plans.catalog import market_round


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_five_levels_expand_after_preaggregation(spark):
    m = market_round(spark, SF_SMALL)
    plan = physical(M.all_level_means(m.item_prices))
    # innermost first: partial agg -> exchange -> final agg -> expand
    lines = [ln.strip() for ln in plan.splitlines()]
    expand = max(i for i, ln in enumerate(lines) if "Expand" in ln)
    below = "\n".join(lines[expand:])
    assert "Exchange" in below and "HashAggregate" in below


def test_markets_are_shuffled_once_and_not_expanded(spark):
    m = market_round(spark, SF_SMALL)
    plan = physical(M.all_level_means(m.item_prices))
    # the rows that are multiplied are the settlements' sums
    assert all("market_final" not in ln for ln in plan.splitlines() if "Expand" in ln)
    shuffled = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln and "market_final" in ln]
    assert len(shuffled) == 1


def test_observation_lookups_are_broadcast(spark):
    m = market_round(spark, SF_SMALL)
    plan = physical(m.item_prices)
    assert "SortMergeJoin" not in plan
    obs_plan = physical(m.obs)
    assert "BroadcastHashJoin" in obs_plan and "SortMergeJoin" not in obs_plan


def test_rank_uses_top_k_not_global_window(spark):
    df = spark.createDataFrame([(f"s{i}", float(i), "Oct") for i in range(50)],
                               "settlement string, meb_full double, month string")
    plan = physical(B.rank_areas(df, "Oct", 3))
    assert "TakeOrderedAndProject" in plan


def test_top_answers_group_limit(spark):
    m = market_round(spark, SF_SMALL)
    plan = physical(R.top_k(m.shares_one, ["o_orderpriority"], ["uganda"], 3))
    assert "WindowGroupLimit" in plan


def test_no_cross_products_in_report(spark):
    m = market_round(spark, SF_SMALL)
    plan = physical(m.report_cells())
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_settlement_is_preaggregated(spark):
    # a third of all rows in one settlement: the shuffle of the cell
    # aggregation carries at most one row per cell and task
    rows = [("r", "d", "hot", "m", "Oct", 4, float(i % 7)) for i in range(3000)] + \
           [("r", "d", f"s{i % 40}", "m", "Oct", 4, float(i % 5)) for i in range(6000)]
    df = spark.createDataFrame(rows, "regions string, district string, settlement string, "
                                     "market_final string, month string, collection_order int, "
                                     "price_x double").repartition(8)
    cells = M.cell_sums(df, ["price_x"])
    assert cells.count() == 41
    plan = physical(cells)
    assert plan.count("HashAggregate") >= 2   # partial + final around the exchange
    hot = M.level_from_all(M.all_level_means(df), "settlement").where(F.col("settlement") == "hot").first()
    assert abs(hot.price_x - sum(i % 7 for i in range(3000)) / 3000) < 1e-12


def test_hot_group_median_matches_spark_and_spreads(spark):
    from souk.operators import impute as I
    # one group holds a third of the rows, with many distinct values
    rows = [("hot", float(i % 997) + 0.25) for i in range(6000)] + \
           [(f"g{i % 30}", float(i % 13)) for i in range(12000)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    got = {r.g: r.x for r in I.exact_medians(df, ["g"], ["x"]).collect()}
    want = {r.g: r.x for r in df.groupBy("g").agg(F.median("x").alias("x")).collect()}
    assert got == want and got["empty"] is None
