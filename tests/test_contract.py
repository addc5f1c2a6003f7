"""Files under a contract, exports that are whole or not there, rounds added one by one, the report template."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from souk.operators import cleaning as CL
from souk.operators import means as M
from souk.operators import report as RP
from souk.operators.increment import RoundStore
from souk.plans import template
from souk.plans.catalog import compare_form, market_round
from souk.sources import export as EX
from souk.sources import files as FS
from souk.sources.contract import INTEGER, NUMBER, Field, header_issues, read_contract
from test_plans import physical

FIELDS = [Field("uuid", required=True), Field("month", INTEGER, required=True, strict=True), Field("price_a", NUMBER),
          Field("market")]


def files(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_rows_rejects_and_drift(spark, tmp_path):
    path = files(
        tmp_path,
        a="uuid,month,price_a,market\n1,10,5.5,m 1 \n2,x,1,m\n,10,1,m\n4,10,cheap,\"m, n\"\n5,10\n6,10,1,m,7\n7,10.5,1,m\n8,,1,m\n",
        b="market,uuid,month,extra,price_a\nNA,9,9,e,99\n,10,9, ,1e3\n",
        c="uuid,month,market\n11,3,z\n", d="", e="uuid,month,price_a,market,uuid\n12,4,2,q,other\n", _hidden="uuid\n99\n")
    got = read_contract(spark, path, FIELDS)
    rows = sorted(((r.uuid, r.month, r.price_a, r.market, r.extra, r.uuid_2) for r in got.rows.collect()), key=lambda r: int(r[0]))
    assert rows == [("1", 10, 5.5, "m 1 ", None, None), ("4", 10, None, "m, n", None, None), ("9", 9, 99.0, None, "e", None),
                    ("10", 9, 1000.0, None, None, None), ("11", 3, None, "z", None, None), ("12", 4, 2.0, "q", None, "other")]
    rejects = sorted((r.reason, r.line) for r in got.rejects.collect())
    assert [r for r, _ in rejects] == ["malformed", "malformed", "missing month", "missing uuid", "no integer month", "no integer month"]
    assert {"5,10", "6,10,1,m,7"} == {line for r, line in rejects if r == "malformed"}
    assert all(r.file.endswith("/a.csv") for r in got.rejects.collect())
    drift = {(r.file.rsplit("/", 1)[1][0], r.column, r.issue) for r in got.drift.collect()}
    assert drift == {("b", "extra", "unexpected"), ("b", "market", "moved"), ("b", "uuid", "moved"), ("c", "price_a", "missing"),
                     ("d", None, "empty"), ("e", "uuid", "repeated")}


def test_nothing_to_read(spark, tmp_path):
    got = read_contract(spark, files(tmp_path, a=""), FIELDS)
    assert got.rows.columns == ["uuid", "month", "price_a", "market"] and got.rows.count() == got.rejects.count() == 0


def test_header_issues():
    names = [f.name for f in FIELDS]
    assert header_issues(names, FIELDS) == []
    assert header_issues(["month", "uuid", "price_a", "market"], FIELDS) == [("month", "moved"), ("uuid", "moved"), ("price_a", "moved")]


def frames(spark, n):
    return {"First table": spark.range(n).withColumn("x", F.lit("a")), "second": spark.range(2 * n).selectExpr("id AS y")}


def test_a_broken_export_leaves_the_old_one(spark, tmp_path):
    base = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        EX.read_export(spark, base)
    first = EX.publish(spark, base, frames(spark, 3))
    assert first["tables"]["First table"]["rows"] == 3 and first["number"] == 0

    broken = frames(spark, 5)
    broken["second"] = broken["second"].withColumn("y", F.raise_error(F.lit("lost executor")).cast("string"))
    with pytest.raises(Exception, match="lost executor"):
        EX.publish(spark, base, broken)
    found = EX.read_export(spark, base)
    assert {n: df.count() for n, df in found.items()} == {"First table": 3, "second": 6}
    assert EX.current(spark, base) == first

    again = EX.publish(spark, base, frames(spark, 5), {"second": ("csv", FS.write_csv)})
    repeat = EX.publish(spark, base, frames(spark, 5), {"second": ("csv", FS.write_csv)})
    assert (again["number"], repeat["number"]) == (1, 2)
    want = {n: sorted(map(tuple, df.collect())) for n, df in EX.read_export(spark, base).items()}
    gone = EX.prune(spark, base)
    assert len(gone) == 5 and EX.prune(spark, base) == []  # three versions, one of them unfinished, and two manifests
    assert {n: sorted(map(tuple, df.collect())) for n, df in EX.read_export(spark, base).items()} == want
    assert len(want["First table"]) == 5 and len(want["second"]) == 10


def test_rounds_added_one_by_one(spark, tmp_path):
    m = market_round(spark, SF_SMALL)
    store = RoundStore(spark, str(tmp_path))
    store.add("March", m.item_prices)
    store.add("October", m.item_prices.withColumn("price_economy", F.lit(1.0)))
    store.add("October", m.item_prices)  # replaces
    two = M.all_level_means(m.item_prices.where("month <> 'September'"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.means()) == key(two)
    store.add("September", m.item_prices)
    assert len(store.rounds()) == 3 and key(store.means()) == key(M.all_level_means(m.item_prices))
    plan = physical(M.cell_sums(m.item_prices.where(F.col("month") == "October")))
    assert "PartitionFilters: [isnotnull(month" in plan  # the other rounds' folders are not read


def test_a_round_stored_as_cells_still_counts(spark, tmp_path):
    m = market_round(spark, SF_SMALL)
    store = RoundStore(spark, str(tmp_path))
    store.add("October", m.item_prices)
    march = m.item_prices.where(F.col("month") == "March")
    EX.publish(spark, f"{tmp_path}/round-March", {"cells": M.cell_sums(march)})
    key = lambda df: sorted(map(str, compare_form(df).collect()))
    assert key(store.means()) == key(M.all_level_means(m.item_prices.where("month <> 'September'")))


def test_report_columns_come_from_the_template(spark):
    cells = [("b", RP.NUMBER, "key b"), ("a", RP.TEXT, "key a"), ("gone", RP.NUMBER, "no such key"), ("same", RP.TEXT, "key a")]
    long = spark.createDataFrame([("key b", 2.5, None), ("key a", None, "text"), ("other", 1.0, None), ("key b", 1.0, None)],
                                 "key string, num double, str string")
    row = RP.report_from_template(long, cells)
    assert row.columns == ["b", "a", "gone", "same"] and [tuple(r) for r in row.collect()] == [("2", "text", None, "text")]
    assert [tuple(r) for r in RP.report_from_template(long.limit(0), cells).collect()] == [(None,) * 4]
    assert [r.key for r in RP.unused(long, cells).collect()] == ["other"]
    with pytest.raises(ValueError):
        RP.report_from_template(long, [*cells, ("a", RP.TEXT, "x")])


def test_template_covers_the_report(spark):
    cells = template.cells()
    assert len({name for name, *_ in cells}) == len(cells)
    # ranks count from the bound areas, of which the smallest tables lack some
    left = {r.key for r in RP.unused(market_round(spark, SF_SMALL).report_long, cells).collect()}
    assert all(k.startswith("expansive_rank_") for k in left)


def test_cleaning_scans_the_data_once(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(1000).selectExpr("CAST(id % 900 AS STRING) AS uuid", "CAST(id AS STRING) AS v").write.parquet(path)
    log = spark.createDataFrame([(1, "5", "v", "x", None), (2, "950", "v", "x", None), (3, "7", "w", "x", None), (4, "899", "v", None, "TRUE")],
                                "seq long, uuid string, variable string, new_value string, change string")
    done = CL.apply_cleaning_log(spark.read.parquet(path), log)
    for out in (done.clean, done.changelog, done.rejects):
        assert path not in physical(out)  # all of them start from the rows that were written on the one pass
    assert {r.reason for r in done.rejects.collect()} == {"duplicated_id", "unknown_id"}
    assert done.clean.count() == 1000 and done.clean.where("uuid = '899' AND v IS NULL").count() == 1
    assert [tuple(r)[:4] for r in done.changelog.collect()] == [("v", "899", "899", None)]
