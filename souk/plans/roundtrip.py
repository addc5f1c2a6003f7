"""The workflow's files, written from the bound tables and read back.

Real rounds arrive as files that people made: a column is missing in one month,
moved in another, a row is cut or holds text for a number.  These plans write the
bound rounds that way, by a rule on the order key, and read them under a
contract; the baseline basket, the cleaning log and the exports make the same trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk import config
from souk.functions import exprs as X
from souk.operators import means as M
from souk.operators import rounds as RD
from souk.operators.increment import RoundStore
from souk.plans.market import MarketRound
from souk.sources import export, tpch
from souk.sources import files as FS
from souk.sources.contract import INTEGER, NUMBER, Field, Loaded, read_contract
from souk.sources.store import materialize, run_folder

PRICES = [f"price_{i}" for i in config.BIND_ITEMS]
WEIGHTS = ["weight_economy", "weight_large"]
ROUND_FIELDS = [Field("uuid", required=True), Field("month", INTEGER, required=True, strict=True), Field("day", INTEGER),
                Field("settlement", required=True), Field("market"), Field("market_other"),
                *[Field(p, NUMBER) for p in PRICES], *[Field(w, NUMBER) for w in WEIGHTS]]
#: The rule by which rows of the written rounds are spoiled: the order key is divisible by this number.
CUT, WORDED, NAMELESS = 97, 89, 83


def folder(m: MarketRound, name: str) -> str:
    return f"{run_folder(m.spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _spoiled(df: DataFrame) -> DataFrame:
    """All columns as text; some rows with one value too many, no number for the month, no id."""
    key = F.split("uuid", "-")[0].cast("long")

    def text(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit("NA"))
        if c == "market":
            return F.when(key % CUT == 0, F.concat(v, F.lit(",one too many"))).otherwise(v)
        if c == "month":
            return F.when(key % WORDED == 0, F.lit("n/k")).otherwise(v)
        return F.when(key % NAMELESS == 0, F.lit("")).otherwise(v) if c == "uuid" else v

    return df.select(*[text(c).alias(c) for c in df.columns])


def write_rounds(m: MarketRound) -> str:
    """Three folders of CSV files: as the contract says but for a column more; moved columns; a column less."""
    base = folder(m, "rounds")
    names = [f.name for f in ROUND_FIELDS]
    this, last, first = (df.select(*[c for c in names if c in df.columns]) for df in m.rounds)
    this = this.withColumn("enumerator", F.concat(F.lit("e"), F.col("day").cast("string")))
    moved = [c for c in last.columns if c.startswith("weight_")]
    last = last.select(*moved, *[c for c in last.columns if c not in moved])
    for name, df in (("this", this), ("last", last), ("first", first)):
        # no quoting: a comma in a value cuts the row
        _spoiled(df).write.option("header", True).option("quote", "").csv(f"{base}/{name}")
    return base


def load_rounds(m: MarketRound) -> Loaded:
    base = write_rounds(m)
    return read_contract(m.spark, [f"{base}/{n}" for n in ("this", "last", "first")], ROUND_FIELDS)


def _round_name(c: str) -> Column:
    return F.regexp_extract(c, r"/(\w+)/[^/]*$", 1).alias("round")


def rounds_read(m: MarketRound) -> DataFrame:
    """The accepted rows of all rounds."""
    return FS.read_round(load_rounds(m).rows).select(*[f.name for f in ROUND_FIELDS], "enumerator")


def rounds_rejected(m: MarketRound) -> DataFrame:
    """Rejected rows per round and reason."""
    return load_rounds(m).rejects.groupBy(_round_name("file"), "reason").agg(F.count(F.lit(1)).alias("n"))


def rounds_drift(m: MarketRound) -> DataFrame:
    """Header drift per round."""
    loaded = load_rounds(m)
    return loaded.drift.select(_round_name("file"), "column", "issue").distinct()


def rounds_means(m: MarketRound) -> DataFrame:
    """From files to the five levels: the accepted rows through geography, item prices and means."""
    rows = FS.read_round(load_rounds(m).rows).drop("enumerator")
    obs = RD.stack_and_enrich([rows], m.settlement_lookup, m.district_lookup, west_nile=config.BIND_WEST_NILE)
    items = RD.item_prices(obs, m.this_round, m.last_round, unit_items=config.BIND_UNIT_ITEMS)
    return M.all_level_means(materialize(items, "items_read"))


def log_read(m: MarketRound) -> DataFrame:
    """The cleaning log, written as CSV in several files with its sequence numbers."""
    path = folder(m, "log") + ".csv"
    log = tpch.cleaning_log(m.spark, m.sf_dir).withColumnRenamed("variable", "indicator")
    FS.write_csv(log, path, na="NA")
    return FS.read_cleaning_log(m.spark, path, seq_col="seq")


def basket_from_file(m: MarketRound) -> DataFrame:
    """S3: the baseline basket written as CSV, read as the precomputed table it is, and stacked under this round's."""
    path = folder(m, "baseline") + ".csv"
    FS.write_csv(m.meb_baseline, path, na="NA")
    baseline = FS.read_baseline_meb(m.spark, path)
    current = m.meb.where(F.col("collection_order") != config.ORDER_OTHER)
    return baseline.unionByName(current, allowMissingColumns=True)


def exported(m: MarketRound) -> str:
    base = folder(m, "export")
    m.export(base, "2020-10-30")
    return f"{base}/2020-10-30"


def export_rows(m: MarketRound) -> DataFrame:
    """Every table of an export with the rows that are read back."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
             for name, df in export.read_export(m.spark, exported(m)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def export_summary(m: MarketRound) -> DataFrame:
    """The analysis table of an export, read back from its CSV."""
    stats = export.read_export(m.spark, exported(m))["analysis"]
    return stats.withColumn("numbers", X.to_number("numbers"))


def means_incremental(m: MarketRound) -> DataFrame:
    """The five levels from a store to which the rounds were added one by one, the last one twice."""
    store = RoundStore(m.spark, folder(m, "round-store"))
    for month in (m.baseline_round, m.last_round, m.this_round, m.this_round):
        store.add(month, m.item_prices)
    return store.means()
