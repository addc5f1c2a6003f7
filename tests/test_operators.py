"""Operators on hand-made frames: golden values and properties."""

import math

import pytest
from pyspark.sql import functions as F

from souk import config
from souk.operators import basket as B
from souk.operators import change as C
from souk.operators import cleaning as CL
from souk.operators import dims as D
from souk.operators import impute as I
from souk.operators import means as M
from souk.operators import reshape as R
from souk.operators import rounds as RD
from souk.operators import survey as S


@pytest.fixture
def prices(spark):
    rows = [
        # uuid, month, regions, district, settlement, market, price_a, price_b, order
        ("1", "October", "west nile", "d1", "s1", "m1", 10.0, 1.0, 4),
        ("2", "October", "west nile", "d1", "s1", "m2", 20.0, None, 4),
        ("3", "October", "west nile", "d1", "s2", None, 30.0, float("inf"), 4),
        ("4", "October", "south west", "d2", "s3", "m3", None, 4.0, 4),
        ("5", "September", "west nile", "d1", "s1", "m1", 8.0, 2.0, 3),
        ("6", "September", "south west", "d2", "s3", "m3", 4.0, 2.0, 3),
        ("7", "March", "west nile", "d1", "s1", "m1", 5.0, 1.0, 1),
        ("8", "March", "south west", "d2", "s3", "m3", 2.0, float("nan"), 1),
    ]
    return spark.createDataFrame(rows, "uuid string, month string, regions string, district string, "
                                       "settlement string, market_final string, price_a double, "
                                       "price_b double, collection_order int")


def test_stack_rounds_fills_missing(spark):
    a = spark.createDataFrame([(1, "x")], "month int, market_other string")
    b = spark.createDataFrame([(2,)], "month int")
    out = RD.stack_rounds([a, b]).orderBy("month").collect()
    assert [tuple(r) for r in out] == [(1, "x"), (2, None)]


def test_item_prices_unit_and_sentinel(spark):
    obs = spark.createDataFrame(
        [("u1", "October", "r", "d", "s", "m", 1000.0, 0.0, 50.0, 99.0, 7.0),
         ("u2", "March", "r", "d", "s", "m", 300.0, 3.0, 99.0, 2.0, 8.0)],
        "uuid string, month string, regions string, district string, settlement string, "
        "market_final string, price_charcoal double, weight_charcoal double, price_fish double, "
        "weight_fish double, price_maize double")
    out = {r.uuid: r for r in RD.item_prices(obs).collect()}
    assert out["u1"].price_charcoal == math.inf and out["u1"].price_fish is None
    assert out["u2"].price_charcoal == 100.0 and out["u2"].price_fish is None
    assert out["u1"].collection_order == 4 and out["u2"].collection_order == 1
    assert "weight_fish" not in RD.item_prices(obs).columns


def test_all_levels_equal_each_level(spark, prices):
    allm = M.all_level_means(prices)
    for level, keys in M.LEVELS.items():
        a = sorted(map(tuple, M.level_from_all(allm, level).collect()), key=str)
        b = sorted(map(tuple, M.area_means(prices, level).select(*keys, "price_a", "price_b").collect()),
                   key=str)
        assert a == b, level


def test_level_means_values(spark, prices):
    reg = {(r.regions, r.month): r for r in M.area_means(prices, "region").collect()}
    wn = reg[("west nile", "October")]
    assert wn.price_a == 20.0 and wn.price_b is None          # Inf in the group -> NULL
    assert reg[("south west", "March")].price_b is None       # only NaN -> NULL


def test_counts_null_market_counts_once(spark, prices):
    got = {r.level: (r.num_market_assessed, r.num_assessed)
           for r in M.assessment_counts(prices, "October").collect()}
    assert got == {"national": (4, 4), "west nile": (3, 3), "south west": (1, 1)}


def test_impute_is_sequential(spark):
    df = spark.createDataFrame([
        ("s1", "d1", "r", "Oct", 1.0), ("s2", "d1", "r", "Oct", None),
        ("s3", "d2", "r", "Oct", None), ("s4", "d2", "r", "Oct", None),
        ("s5", "d3", "r", "Oct", 5.0)], "settlement string, district string, regions string, "
                                        "month string, price_x double")
    got = {r.settlement: r.price_x for r in I.impute_hierarchical(df).collect()}
    # s2 from d1 (1.0); s3, s4 from the region mean of the values after the district fill
    assert got["s2"] == 1.0 and got["s3"] == pytest.approx((1.0 + 1.0 + 5.0) / 3)
    assert got["s1"] == 1.0 and got["s5"] == 5.0


def test_impute_never_changes_values(spark, prices):
    med = I.settlement_medians(prices, ["October", "September"])
    filled = I.impute_hierarchical(med)
    a = {(r.settlement, r.month): r for r in med.collect()}
    for r in filled.collect():
        for c in ("price_a", "price_b"):
            if a[(r.settlement, r.month)][c] is not None:
                assert r[c] == a[(r.settlement, r.month)][c]


def test_median_is_mean_of_middle(spark):
    df = spark.createDataFrame([("s", "d", "r", "Oct", 4, x) for x in (1.0, 5.0, 3.0, 10.0)],
                               "settlement string, district string, regions string, month string, "
                               "collection_order int, price_x double")
    assert I.settlement_medians(df, ["Oct"]).first().price_x == 4.0


def test_basket_fixed_lines(spark):
    df = spark.createDataFrame([(100.0,)], "price_maize_f double")
    items = [("maize_f", (8.7,), "food")]
    r = B.basket_lines(df, items, ["maize_f"]).first()
    assert r.meb_hygiene == 6597.0
    assert r.meb_other_hdd == pytest.approx(71533 / 12)
    assert r.meb_energy == 5000.0
    assert r.meb_food == pytest.approx(100 * 8.7 * 5)
    fixed = sum(v for _, v in config.BASKET_FIXED_OTHER)
    assert r.meb_full == pytest.approx(100 * 8.7 * 5 + fixed + 6597 + 71533 / 12 + 5000)


def test_basket_null_line_nulls_totals(spark):
    df = spark.createDataFrame([(None, 3.0)], "price_maize_f double, price_beans double")
    items = [("maize_f", (8.7,), "food"), ("beans", (5.4,), "food")]
    r = B.basket_lines(df, items, ["maize_f", "beans"]).first()
    assert r.meb_food is None and r.meb_full is None and r.meb_beans == pytest.approx(81.0)


def test_rank_top_bottom(spark):
    df = spark.createDataFrame([(f"s{i}", float(v), "Oct") for i, v in enumerate([5, 9, 1, 7, 3, 8, 2])] +
                               [("sx", None, "Oct")], "settlement string, meb_full double, month string")
    got = sorted((r.rank, r.settlement) for r in B.rank_areas(df, "Oct", 3).collect())
    assert got == [(1, "s1"), (2, "s5"), (3, "s3"), (6, "s6"), (7, "s2"), (8, "sx")]


def test_period_change_against_itself_is_zero(spark, prices):
    sm = M.area_means(prices, "settlement")
    same = sm.unionByName(sm.where("collection_order = 4").withColumn("collection_order", F.lit(3)))
    ch = C.period_change(same, ["settlement"], ["price_a"], baselines={"last_round": 3}).collect()
    assert ch and all(r.a_perct_last_round in (0.0, None) for r in ch)


def test_period_change_pairs_by_key(spark, prices):
    sm = M.area_means(prices, "settlement")
    ch = {r.settlement: r for r in C.item_change(sm, ["settlement"]).collect()}
    # s1: Oct 15, Sep 8, Mar 5; s3 Oct NULL a; s2 has no baseline -> dropped
    assert set(ch) == {"s1", "s3"}
    assert ch["s1"].a_perct_last_round == pytest.approx((15 - 8) / 8 * 100)
    assert ch["s1"].a_perct_march == pytest.approx(200.0)


def test_region_join_is_case_insensitive(spark):
    a = spark.createDataFrame([("south west", 1.0)], "regions string, x double")
    b = spark.createDataFrame([("south West", 2.0)], "regions string, y double")
    out = C.merge_changes([C.with_lower_key(a, "regions"), C.with_lower_key(b, "regions")], ["regions"])
    assert out.first().y == 2.0


@pytest.fixture
def log_case(spark):
    data = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0), (3, "c", 30.0)],
                                 "id long, status string, price double")
    log = spark.createDataFrame([
        (1, "1", "status", "x", None), (2, "1", "status", "y", "TRUE"),       # last write wins
        (3, "2", "price", "25.5", "FALSE"),                                   # not applied
        (4, "3", "status", "z", "TRUE"),                                      # duplicated id
        (5, "9", "status", "z", "TRUE"),                                      # unknown id
        (6, "2", "nope", "z", "TRUE"),                                        # unknown column
        (7, "2", "status", None, "TRUE")],                                    # NULL really nulls
        "seq long, uuid string, variable string, new_value string, change string")
    return data, log


def test_cleaning_rules(spark, log_case):
    data, log = log_case
    res = CL.apply_cleaning_log(data, log, "id")
    clean = sorted(map(tuple, res.clean.collect()))
    assert clean == [(1, "y", 10.0), (2, None, 20.0), (3, "c", 30.0), (3, "c", 30.0)]
    rej = {r.seq: r.reason for r in res.rejects.collect()}
    assert rej == {4: "duplicated_id", 5: "unknown_id", 6: "unknown_variable"}
    cl = {r.seq: (r.old_value, r.new_value) for r in res.changelog.collect()}
    assert cl == {1: ("a", "x"), 2: ("a", "y"), 7: ("b", None)}


def test_cleaning_no_change_is_identity(spark, log_case):
    data, log = log_case
    res = CL.apply_cleaning_log(data, log.withColumn("change", F.lit("FALSE")), "id")
    assert sorted(map(tuple, res.clean.collect())) == sorted(map(tuple, data.collect()))


def test_followups(spark):
    df = spark.createDataFrame([("More secure", "r1"), ("Less secure", "r2"), (None, "r3")],
                               "safety string, safety_reason string")
    out = CL.derive_followups(df, [("more", "safety", "More secure", "safety_reason")]).collect()
    assert [r.more for r in out] == ["r1", None, None]


@pytest.fixture
def answers(spark):
    return spark.createDataFrame([
        ("1", "uganda", "south west", "a", "cash mobile_money", "12"),
        ("2", "uganda", "south west", "b", "cash", "x"),
        ("3", "uganda", "west nile", "a", None, "30"),
        ("4", "uganda", "west nile", None, "mobile_money mobile_money", "40")],
        "uuid string, country string, regions string, safety string, payment_type string, "
        "customer_number string")


def test_select_one_shares_sum_to_one(spark, answers):
    st = S.select_one_shares(answers, ["safety"])
    sums = st.groupBy("independent_var_value").agg(F.sum("numbers").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    got = {(r.independent_var_value, r.dependent_var_value): r.numbers for r in st.collect()}
    assert got[("uganda", "a")] == pytest.approx(2 / 3) and got[("west nile", "a")] == 1.0


def test_select_multiple_shares(spark, answers):
    st = S.select_multiple_shares(answers, ["payment_type"])
    got = {(r.independent_var_value, r.dependent_var_value): r.numbers for r in st.collect()}
    assert got[("uganda", "mobile_money")] == pytest.approx(2 / 3)
    assert got[("uganda", "cash")] == pytest.approx(2 / 3)
    assert got[("west nile", "mobile_money")] == 1.0


def test_numeric_means(spark, answers):
    st = {r.independent_var_value: r for r in S.numeric_means(answers, ["customer_number"]).collect()}
    assert st["uganda"].numbers == pytest.approx((12 + 30 + 40) / 3)
    assert st["south west"].numbers == 12.0 and st["south west"].se is None


def test_label_first_match(spark):
    stats = spark.createDataFrame([("q", "1"), ("q", "9")], "dependent_var string, dependent_var_value string")
    choices = spark.createDataFrame([(2, "1", "second"), (1, "1", "first")], "seq long, name string, label string")
    got = sorted((r.dependent_var_value or "") for r in S.label_choices(stats, choices).collect())
    assert got == ["", "first"]


def test_top_k_ties_by_code(spark):
    st = spark.createDataFrame([("q", v, "uganda", n) for v, n in [("b", 0.5), ("a", 0.5), ("c", 0.9), ("d", 0.1)]],
                               "dependent_var string, dependent_var_value string, independent_var_value string, "
                               "numbers double")
    got = [(r.rank, r.dependent_var_value) for r in R.top_k(st, ["q"], ["uganda"], 3).orderBy("rank").collect()]
    assert got == [(1, "c"), (2, "a"), (3, "b")]


def test_unpivot_pivot_roundtrip(spark):
    df = spark.createDataFrame([("s1", 1.0, 2.0), ("s2", 3.0, None)], "settlement string, a double, b double")
    long = R.unpivot(df, ["settlement"])
    back = R.pivot_one(long, "var_name", "var_value", ["a", "b"], by=["settlement"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_report_row(spark):
    long = spark.createDataFrame([("k1", 1.5, None), ("k2", None, "s"), ("k3", 2.5, None)],
                                 "key string, num double, str string")
    row = R.pivot_report(long).first().asDict()
    assert row == {"k1": "2", "k2": "s", "k3": "2"}


def test_centroid_union(spark):
    s = spark.createDataFrame([(1, "a1", "adj", 10.0, 1.0), (2, "a2", "adj", 20.0, 3.0), (3, "b", "x", 0.0, 0.0)],
                              "OBJECTID int, NAME0 string, DISTRICT string, Longitude double, Latitude double")
    out = {r.settlement: r for r in D.prepare_settlements(s, "adj").collect()}
    assert out["adj"].longitude == 15.0 and out["adj"].latitude == 2.0 and len(out) == 4


def test_duplicate_and_missing_ids(spark, log_case):
    data, log = log_case
    assert [tuple(r) for r in CL.duplicate_ids(data, "id").collect()] == [("3", 2)]
    assert [r.uuid for r in CL.missing_ids(log, data, "id").collect()] == ["9"]


def test_keep_present_semi_join(spark, prices):
    base = prices.where("collection_order = 3")
    got = {r.settlement for r in C.keep_present(prices.where("collection_order = 4"), base,
                                                ["settlement"]).collect()}
    assert got == {"s1", "s3"}


def test_name_level_helpers(spark):
    from souk.functions import names as N
    df = spark.createDataFrame([("a", 1.0, 2)], "k string, x double, n int")
    assert N.numeric_columns(df) == ["x", "n"]
    assert N.add_prefix(df, "national_", skip=["k"]).columns == ["k", "national_x", "national_n"]
    assert N.keys_first(df, ["n"]).columns == ["n", "k", "x"]


def test_label_by_list_name(spark):
    stats = spark.createDataFrame([("q", "1")], "dependent_var string, dependent_var_value string")
    choices = spark.createDataFrame([(1, "other", "1", "wrong"), (2, "mine", "1", "right")],
                                    "seq long, list_name string, name string, label string")
    assert S.label_choices(stats, choices).first().dependent_var_value == "wrong"
    assert S.label_choices(stats, choices, list_name="mine").first().dependent_var_value == "right"
