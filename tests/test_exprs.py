"""Scalar rules N1-N16 and F-functions on hand-made frames."""

import math

from pyspark.sql import functions as F

from souk.functions import exprs as X
from souk.functions import names as N
from souk.operators import survey as S


def one(spark, expr, schema="x double", rows=((1.0,),)):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("r")).collect()


def test_safe_div_ieee(spark):
    df = spark.createDataFrame([(1000.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (10.0, 4.0), (None, 0.0),
                                (3.0, None)], "p double, w double")
    got = [r[0] for r in df.select(X.safe_div("p", "w")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert got[3] == 2.5 and got[4] is None and got[5] is None


def test_clean_mean_skips_nan_not_inf(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0),
                                ("b", 1.0), ("b", float("inf")),
                                ("c", None)], "k string, x double")
    got = {r.k: r.m for r in df.groupBy("k").agg(X.clean_mean("x").alias("m")).collect()}
    assert got == {"a": 2.0, "b": None, "c": None}


def test_exact_mean_is_order_independent(spark):
    vals = [(0.1,), (0.2,), (0.3,)] * 11
    a = spark.createDataFrame(vals, "x double").repartition(7)
    b = spark.createDataFrame(list(reversed(vals)), "x double").coalesce(1)
    ma = a.agg(X.clean_mean("x")).first()[0]
    mb = b.agg(X.clean_mean("x")).first()[0]
    assert ma == mb == 0.2


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(X.half_even("x")).collect()] == [0.0, 2.0, 2.0, -2.0]


def test_count_distinct_counts_null_once(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), (None,), ("b",)], "m string")
    assert df.agg(X.count_distinct_na("m")).first()[0] == 3


def test_paste_writes_na(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(X.paste("a", "b")).first()[0] == "x_NA"


def test_first_replace_only_first(spark):
    df = spark.createDataFrame([("rhino",), ("rhino rhino",), ("other",)], "s string")
    got = [r[0] for r in df.select(X.first_replace("s", "rhino", "rhino camp")).collect()]
    assert got == ["rhino camp", "rhino camp rhino", "other"]


def test_sentence_case_not_initcap(spark):
    df = spark.createDataFrame([("WEST NILE",), ("acholi",), (None,)], "s string")
    assert [r[0] for r in df.select(X.sentence_case("s")).collect()] == ["West nile", "Acholi", None]


def test_to_number_failures_null(spark):
    df = spark.createDataFrame([("12.5",), ("small ring",), (None,)], "s string")
    assert [r[0] for r in df.select(X.to_number("s")).collect()] == [12.5, None, None]


def test_contains_null_is_false(spark):
    df = spark.createDataFrame([("a purchase",), (None,), ("view",)], "s string")
    got = [r[0] for r in df.select(X.yes_no(X.contains_or_false("s", "purchase"))).collect()]
    assert got == ["yes", "no", "no"]


def test_month_name_guards_range(spark):
    df = spark.createDataFrame([(3,), (0,), (13,), (None,), (10,)], "m int")
    assert [r[0] for r in df.select(X.month_name("m")).collect()] == ["March", None, None, None, "October"]


def test_to_flag_null_is_true(spark):
    df = spark.createDataFrame([("TRUE",), ("FALSE",), (None,), ("junk",)], "c string")
    assert [r[0] for r in df.select(X.to_flag("c")).collect()] == [True, False, True, True]


def test_recode_sentinels(spark):
    df = spark.createDataFrame([("99",), ("yes",), ("no",), ("12",)], "s string")
    got = [r[0] for r in df.select(X.recode_sentinels("s", is_text=True)).collect()]
    assert got == [None, 1.0, None, 12.0]
    dn = spark.createDataFrame([(99.0,), (5.0,)], "x double")
    assert [r[0] for r in dn.select(X.recode_sentinels("x")).collect()] == [None, 5.0]


def test_pct_change_keeps_inf(spark):
    df = spark.createDataFrame([(10.0, 0.0), (0.0, 0.0), (15.0, 10.0)], "a double, b double")
    got = [r[0] for r in df.select(X.pct_change("a", "b")).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == 50.0


def test_format_stat(spark):
    df = spark.createDataFrame([(0.4567, 0.4, 0.5), (0.0, 0.0, 0.0), (1234.567, 1200.123, 1300.6),
                                (0.0, None, None)], "n double, lo double, hi double")
    pct = [r[0] for r in df.select(S.format_stat(F.col("n"), F.col("lo"), F.col("hi"), True)).collect()]
    num = [r[0] for r in df.select(S.format_stat(F.col("n"), F.col("lo"), F.col("hi"), False)).collect()]
    assert pct[0] == "46% (40%-50%)" and pct[1] == "0%"
    assert num[1] == "0" and num[2] == "1234.57 (1200.12-1301)" and num[3] == "0 "


def test_name_helpers():
    cols = ["uuid", "price_maize", "torch_price", "price_increase_item", "weight_dodo", "a_prices",
            "challenge_x", "Observed_price"]
    from souk.operators.rounds import price_columns
    assert price_columns(cols) == ["price_maize", "torch_price", "weight_dodo", "Observed_price"]
    assert N.syntactic_name("_uuid") == "X_uuid" and N.syntactic_name("dependent.var") == "dependent_var"
    assert N.match_names(["A_Price", "b"], contains=["price"]) == ["A_Price"]
