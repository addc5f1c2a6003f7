"""Rules at the edges: large and small values, NULL areas, clashing names, odd headers."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from souk.functions import exprs as X
from souk.operators import change as C
from souk.operators import cleaning as CL
from souk.operators import impute as I
from souk.operators import means as M
from souk.operators import reshape as R
from souk.operators import rounds as RD
from souk.operators import survey as S
from souk.sources import files as FS


@pytest.mark.parametrize("values", [[1e-9, 3e-9], [770123456789.0, 770123456791.0], [1e15, 3e15, 2.5], [1e300, -1e300],
                                    [0.1, 0.2, 1e-12], [2.0, None, float("nan")]])
def test_mean_has_no_value_range(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "g string, x double")
    got = df.groupBy("g").agg(X.clean_mean("x").alias("m")).first()["m"]
    want = statistics.fmean([v for v in values if v is not None and not math.isnan(v)])
    assert got == pytest.approx(want, rel=1e-12)


def test_all_levels_take_any_magnitude(spark):
    rows = [("r", "d", "s", "m", "October", 4, v) for v in (1e-9, 3e-9)] + \
           [("r", "d", "t", "m", "October", 4, v) for v in (1e15, 3e15)] + [("r", "d", "u", "m", "October", 4, math.inf)]
    df = spark.createDataFrame(rows, "regions string, district string, settlement string, market_final string, "
                                     "month string, collection_order int, price_x double")
    got = {r["settlement"]: r["price_x"] for r in M.level_from_all(M.all_level_means(df), "settlement").collect()}
    assert got["s"] == pytest.approx(2e-9, rel=1e-12) and got["t"] == 2e15 and got["u"] is None


def test_medians_of_any_values(spark):
    groups = {"big": [1e300, -1e300, 3.0], "even": [1.0, 2.0, 10.0, 11.0], "inf": [math.inf, 1.0, math.inf],
              "neg": [-5.0, -1.5, -1.4999, 0.0], "tens": [9.99999, 10.0, 10.0, 100.0, 1000.0], "nil": [None, math.nan]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    got = {r["g"]: r["x"] for r in I.exact_medians(df, ["g"], ["x"]).collect()}
    for g, vs in groups.items():
        vs = [v for v in vs if v is not None and not math.isnan(v)]
        assert got[g] == (statistics.median(vs) if vs else None), g


def test_standard_error_of_large_close_values(spark):
    df = spark.createDataFrame([(str(i), "u", "r" + str(i % 3), str(5e9 + i % 3)) for i in range(2000)],
                               "uuid string, country string, regions string, n string")
    got = S.numeric_means(df, ["n"]).where("independent_var = 'country'").first()
    want = statistics.stdev([float(i % 3) for i in range(2000)]) / math.sqrt(2000)
    assert got["se"] == pytest.approx(want, rel=1e-6)


def test_measures_follow_the_price_names(spark):
    obs = spark.createDataFrame([("1", "October", 2.0, 4.0, 9.0)], "uuid string, month string, Price_A double, wholesaleprice double, weight_b double")
    items = RD.item_prices(obs, unit_items=())
    assert RD.measure_columns(items) == ["Price_A", "wholesaleprice"]
    assert M.area_means(items, "national").first()["wholesaleprice"] == 4.0


def test_flags(spark):
    df = spark.createDataFrame([(x,) for x in ("no", "0", "N", "F", "FALSE", "false", "False", "T", None)], "x string")
    got = [r["f"] for r in df.select(X.to_flag("x").alias("f")).collect()]
    assert got == [True, True, True, False, False, False, False, True, True]


def test_cleaning_with_the_default_id_and_clashing_names(spark):
    data = spark.createDataFrame([("a", "x", "1", 5, "p"), ("b", "y", "2", 6, "q"), ("c", "z", "3", 7, "r"), ("c", "z", "3", 7, "r")],
                                 "uuid string, variable string, new_value string, seq int, `challenge.none` string")
    log = spark.createDataFrame([(1, "a", "variable", "new", "TRUE"), (2, "a", "seq", "9", None), (3, "b", "challenge.none", "Q", "no"),
                                 (4, "b", "new_value", "0", "FALSE"), (5, "c", "seq", "1", "T"), (6, "d", "seq", "1", "T")],
                                "seq long, uuid string, variable string, new_value string, change string")
    got = CL.apply_cleaning_log(data, log)
    assert sorted(map(tuple, got.clean.collect()))[:2] == [("a", "new", "1", 9, "p"), ("b", "y", "2", 6, "Q")]
    assert sorted((r["seq"], r["old_value"]) for r in got.changelog.collect()) == [(1, "x"), (2, "5"), (3, "q")]
    assert sorted((r["seq"], r["reason"]) for r in got.rejects.collect()) == [(5, "duplicated_id"), (6, "unknown_id")]


def test_null_areas_meet(spark):
    a = spark.createDataFrame([(None, 1.0), ("s", 2.0)], "settlement string, x double")
    b = spark.createDataFrame([(None, 3.0)], "settlement string, y double")
    got = {r["settlement"]: (r["x"], r["y"]) for r in C.merge_changes([a, b], ["settlement"]).collect()}
    assert got == {None: (1.0, 3.0), "s": (2.0, None)}


def test_settlements_of_two_districts_do_not_mix(spark):
    rows = [("r", "d1", "s", o, v) for o, v in ((4, 100.0), (3, 50.0), (1, 50.0))] + \
           [("r", "d2", "s", o, v) for o, v in ((4, 30.0), (3, 200.0), (1, 60.0))]
    df = spark.createDataFrame(rows, "regions string, district string, settlement string, collection_order int, price_x double")
    got = C.item_change(df, ["settlement"])
    assert got.columns == ["settlement", "x_perct_last_round", "x_perct_march"]
    assert sorted(r["x_perct_last_round"] for r in got.collect()) == [-85.0, 100.0]


def test_statistics_as_text(spark):
    df = spark.createDataFrame([(12345678.5, None, 3.0), (0.456, None, 0.5), (0.1, 0.2, 0.3)], "n double, lo double, hi double")
    got = df.select(S.format_stat(F.col("n"), F.col("lo"), F.col("hi"), False).alias("a"),
                    S.format_stat(F.col("n"), F.col("lo"), F.col("hi"), True).alias("p")).collect()
    assert got[0]["a"] == "12345678.5 (NA-3)"
    assert got[1]["p"] == "46% (NA%-50%)"
    assert got[2]["a"] == "0.1 (0.2-0)"


def test_odd_files(spark, tmp_path):
    path = tmp_path / "round.csv"
    path.write_text("_uuid,month,challenge.none,settlement\n1,99999999999,NA,rhino\n2,10,x,b\n")
    df = FS.read_round(FS.read_table(spark, str(path)), id_col="X_uuid")
    assert df.columns == ["uuid", "month", "challenge_none", "settlement"]
    assert [(r["month"], r["challenge_none"], r["settlement"]) for r in df.orderBy("uuid").collect()] == [
        (None, None, "rhino camp"), (10, "x", "b")]


def test_cleaning_log_order(spark, tmp_path):
    one = tmp_path / "log.csv"
    one.write_text("uuid,indicator,new_value,change\n" + "".join(f"{i},v,{i},TRUE\n" for i in range(50)))
    log = FS.read_cleaning_log(spark, str(one)).orderBy("seq").collect()
    assert [r["uuid"] for r in log] == [str(i) for i in range(50)]
    many = tmp_path / "logs"
    many.mkdir()
    for k in (1, 0):
        (many / f"part{k}.csv").write_text(f"uuid,indicator,new_value,change,n\na,v,{k},TRUE,{k}\n")
    with pytest.raises(ValueError):
        FS.read_cleaning_log(spark, str(many) + "/*.csv")
    rows = FS.read_cleaning_log(spark, str(many) + "/*.csv", seq_col="n").orderBy("seq").collect()
    assert [r["new_value"] for r in rows] == ["0", "1"]


def test_report_of_any_region(spark):
    from souk.plans.market import MarketRound
    df = spark.createDataFrame([("karamoja", 2.0), ("south west", 3.0)], "regions string, x double")
    got = {r["key"]: r["num"] for r in MarketRound._by_region(None, df).collect()}
    assert got == {"karamoja_x": 2.0, "southwest_x": 3.0}


def test_wide_tables_do_not_depend_on_row_order(spark):
    stats = spark.createDataFrame([("a", "q", "x", 1.0), ("a", "q", "x", 2.0)],
                                  "independent_var_value string, dependent_var string, dependent_var_value string, numbers double")
    assert R.area_by_var(stats, ["q.x"]).first()["q.x"] == 2.0
    assert R.pivot_one(stats, "dependent_var", "numbers", ["q"]).first()["q"] == 2.0
