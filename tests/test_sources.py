"""Readers and writers on small files in a test folder."""

from pyspark.sql import functions as F

from souk.sources import files


def test_read_table_null_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("_uuid,settlement,price_x,price_blank\n1,Koro ,NA,\n2, ,12.5, \n3,rhino,x,NA\n")
    df = files.read_table(spark, str(p), numeric=["price_x", "price_blank"])
    rows = sorted(map(tuple, df.collect()))
    assert df.columns == ["X_uuid", "settlement", "price_x", "price_blank"]
    assert rows == [("1", "Koro ", None, None), ("2", None, 12.5, None), ("3", "rhino", None, None)]
    assert dict(df.dtypes)["price_blank"] == "double"


def test_read_round(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("_uuid,month,settlement\na,10,rhino\nb,x,rhino camp\n")
    df = files.read_round(files.read_table(spark, str(p)), id_col="X_uuid")
    assert sorted(map(tuple, df.collect())) == [("a", 10, "rhino camp"), ("b", None, "rhino camp camp")]


def test_write_tables_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1.5)], "k string, v double")
    paths = files.write_tables({"Region mean": df, "Rank settlements": df}, str(tmp_path), "2020-10-01")
    assert len(paths) == 2 and all("2020-10-01" in p for p in paths.values())
    back = spark.read.parquet(paths["Region mean"])
    assert back.count() == 2
    files.write_csv(df, str(tmp_path / "out_csv"))
    text = "".join(f.read_text() for f in (tmp_path / "out_csv").glob("*.csv"))
    assert "a,n/a" in text and "b,1.5" in text


def test_read_cleaning_log(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("uuid,indicator,new_value,change\nu1,safety,Less secure,\nu2,safety,More secure,FALSE\n")
    log = files.read_cleaning_log(spark, str(p))
    assert log.columns == ["seq", "uuid", "variable", "new_value", "change"]
    assert log.orderBy("seq").select("uuid").collect()[0][0] == "u1"


def test_export_writes_every_table(spark, tmp_path):
    from conftest import SF_SMALL
    from souk.plans.catalog import market_round
    m = market_round(spark, SF_SMALL)
    paths = m.export(str(tmp_path), "2020-10-30")
    assert len(paths) == 9 + 6 + 3
    report = spark.read.option("header", True).csv(paths["report"])
    assert report.count() == 1 and len(report.columns) > 100


def test_tables_are_written_in_the_run_folder(spark):
    import os
    from souk.sources import store
    kept = store.materialize(spark.range(3).toDF("x"), "probe")
    assert kept.count() == 3
    folder = store.run_folder(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    # only look: other tests of this session still read their tables
    assert any(n.startswith("probe-") for n in os.listdir(folder))
