"""Binding of the survey workflow onto the TPC-H-like test tables.

The test tables hold no survey rounds, so every survey input is derived from
them with plain joins (see README, "Test binding"):

* observations: lineitem joined to orders, customer, nation and part;
  one row per line in March, September or October.  A settlement is
  ``nation/segment``, a district is the nation, a market is the supplier.
* settlement and district dimensions: customer x nation, nation x region.
* survey answers: orders (select-one, numeric) and events (select-multiple).
* cleaning: orders plus a copy of every 101st order, and a log built from
  order keys.

Everything here is lazy except the joined observations, which are written
once (partitioned by month) because every price output reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk import config
from souk.functions import exprs as X
from souk.sources.store import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region")


def settlement_key(nation_name: Column, segment: Column) -> Column:
    return F.concat(F.lower(nation_name), F.lit("/"), F.lower(segment))


# --------------------------------------------------------------------------
# Observations
# --------------------------------------------------------------------------

def raw_observations(spark: SparkSession, sf_dir: str, months=config.ROUND_MONTHS,
                     store: bool = True) -> DataFrame:
    """All line-level price observations of the bound rounds (wide)."""
    orders = (table(spark, sf_dir, "orders")
              .where(F.month("o_orderdate").isin(list(months)))
              .select("o_orderkey", "o_custkey",
                      F.month("o_orderdate").alias("month"),
                      F.dayofmonth("o_orderdate").alias("day")))
    cust = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(_nation(spark, sf_dir).select("n_nationkey", "n_name"),
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", settlement_key(F.col("n_name"), F.col("c_mktsegment"))
                    .alias("settlement")))
    # orders x customer first: the month filter shrinks the orders side to
    # about a quarter before it meets lineitem (and when that side is small
    # enough, Spark's runtime bloom filter also prunes lineitem before its
    # shuffle).
    oc = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("ptype"))
    x = (li.join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(part, F.col("l_partkey") == F.col("p_partkey")))
    supp = F.col("l_suppkey")
    market = (F.when(supp % 17 == 0, F.lit(None).cast("string"))
              .when(supp % 10 == 0, F.lit("Other"))
              .otherwise(F.concat(F.lit("S"), supp.cast("string"))))
    prices = [F.when(F.col("ptype") == t, F.col("l_extendedprice")).alias(f"price_{t}")
              for t in config.BIND_ITEMS]
    q = F.col("l_quantity")
    out = x.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("uuid"),
        "month", "day", "settlement",
        market.alias("market"),
        F.concat(F.lit("part "), (F.col("l_partkey") % 3).cast("string")).alias("market_other"),
        *prices,
        F.when(q == 25, F.lit(0.0)).otherwise(q).alias("weight_economy"),
        F.when(q == 7, F.lit(99.0)).otherwise(q).alias("weight_large"),
    )
    # written once, one directory per month: the rounds read back only their
    # own month (partition pruning) and the four-way join never reruns
    return materialize(out, "observations", partition_by=("month",)) if store else out


def rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(this round, last round, baseline round) as separate frames.

    Column sets differ like real round files do: the baseline round has no
    ``market_other`` column, so stacking must union by name with NULL fill.
    """
    raw = raw_observations(spark, sf_dir)
    this = raw.where(F.col("month") == 10)
    last = raw.where(F.col("month") == 9)
    base = raw.where(F.col("month") == 3).drop("market_other")
    return this, last, base


def settlement_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per settlement: district, type and a coordinate pair
    (aggregates of the customers' account balances)."""
    c = table(spark, sf_dir, "customer")
    n = _nation(spark, sf_dir)
    return (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(settlement_key(F.col("n_name"), F.col("c_mktsegment")).alias("NAME0"),
                     F.lower("n_name").alias("DISTRICT"))
            .agg(F.min("c_custkey").alias("OBJECTID"),
                 F.lit("Uganda").alias("NAME"),
                 F.lit("settlement").alias("TYPE"),
                 F.avg("c_acctbal").alias("Longitude"),
                 F.max("c_acctbal").alias("Latitude")))


def district_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = _region(spark, sf_dir)
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("OBJECTID"),
        F.col("r_name").alias("F15Regions"),
        F.col("n_name").alias("DName2019"))


# --------------------------------------------------------------------------
# Survey answers
# --------------------------------------------------------------------------

def region_rule(r_name: Column, west_nile=config.BIND_WEST_NILE) -> Column:
    sub = X.sentence_case(r_name)
    return F.when(sub.isin(list(west_nile)), F.lit(config.REGION_OTHER)) \
        .otherwise(F.lit(config.REGION_DEFAULT))


def survey_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One respondent per order: select-one and numeric answers."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal")
    n = _nation(spark, sf_dir).select("n_nationkey", "n_regionkey")
    r = _region(spark, sf_dir)
    x = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
         .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    return x.select(
        F.col("o_orderkey").cast("string").alias("uuid"),
        F.lit("uganda").alias("country"),
        region_rule(F.col("r_name")).alias("regions"),
        "o_orderpriority", "o_orderstatus",
        F.col("n_regionkey").cast("string").alias("home_region"),
        F.col("n_nationkey").cast("string").alias("home_nation"),
        "o_totalprice",
        F.when(F.col("o_orderkey") % 11 == 0, F.col("c_name"))
         .otherwise(F.col("c_acctbal").cast("string")).alias("customer_number"),
    )


def survey_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One respondent per user and day; the select-multiple answer lists the
    distinct event types of that day, sorted, separated by blanks."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.array_sort(F.collect_set("event_type")).alias("types"))
    answers = F.concat_ws(" ", "types")
    return g.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("d").cast("string")).alias("uuid"),
        F.lit("uganda").alias("country"),
        F.when(F.col("user_id") % 2 == 0, F.lit(config.REGION_DEFAULT))
         .otherwise(F.lit(config.REGION_OTHER)).alias("regions"),
        answers.alias("event_types"),
        X.yes_no(X.contains_or_false(answers, config.BIND_FLAG_WORD)).alias("mobile_accepted"),
    )


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice list with repeated codes: code = region key, label = nation name,
    list order = nation key."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("seq"),
                    F.lit("home_region").alias("list_name"),
                    F.col("n_regionkey").cast("string").alias("name"),
                    F.col("n_name").alias("label"))


def analysis_plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(config.BIND_PLAN, "dependent_variable string, dependent_variable_type string, "
                                                   "independent_variable string, repeat_for_variable string")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(config.BIND_QUESTIONS, "name string, type string")


def choice_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists that share the codes 0 to 4: regions and nations by their keys."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")

    def listed(df: DataFrame, name: str, key: str, label: str) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("seq"), F.lit(name).alias("list_name"),
                         F.col(key).cast("string").alias("name"), F.col(label).alias("label"))

    return listed(r, "region_names", "r_regionkey", "r_name").unionByName(listed(n, "nation_names", "n_nationkey", "n_name"))


# --------------------------------------------------------------------------
# Cleaning
# --------------------------------------------------------------------------

def cleaning_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, with every 101st order present twice (duplicated ids) -- one
    scan: each row is exploded into its number of copies."""
    o = table(spark, sf_dir, "orders")
    copies = F.when(F.col("o_orderkey") % 101 == 0, F.lit(2)).otherwise(F.lit(1))
    return o.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy")


SEQ_BLOCK = 10 ** 13


def cleaning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows (seq, uuid, variable, new_value, change) in four blocks, plus
    one unknown id -- one scan of the order keys: every key is exploded into
    the log rows of the blocks it belongs to."""
    k = F.col("o_orderkey")

    def entry(n: int, cond: Column, variable: str, value, change: Column) -> Column:
        row = F.struct((F.lit(n * SEQ_BLOCK) + k).alias("seq"),
                       k.cast("string").alias("uuid"),
                       F.lit(variable).alias("variable"),
                       F.lit(value).cast("string").alias("new_value"),
                       change.cast("string").alias("change"))
        return F.when(cond, row)

    chg1 = F.when(k % 3 == 1, F.lit("TRUE")).when(k % 3 == 2, F.lit("FALSE"))
    entries = F.array(
        entry(1, k % 7 == 0, "o_orderpriority", "1-URGENT", chg1),
        entry(2, k % 14 == 0, "o_orderpriority", None, F.lit("TRUE")),
        entry(3, k % 21 == 0, "no_such_column", "x", F.lit("TRUE")),
        entry(4, k % 7 == 0, "o_orderstatus", "F", F.lit("TRUE")))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    log = (o.where((k % 7 == 0) | (k % 21 == 0))
           .select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
           .select("e.*"))
    unknown = spark.range(1).select(
        F.lit(5 * SEQ_BLOCK).alias("seq"), F.lit("10000000").alias("uuid"),
        F.lit("o_orderstatus").alias("variable"), F.lit("F").alias("new_value"),
        F.lit("TRUE").alias("change"))
    return log.unionByName(unknown)


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test results for the first select-one question, one per region of the
    table: several per grouping, none for other questions."""
    r = table(spark, sf_dir, "region")
    grouping = F.when(F.col("r_regionkey") % 2 == 0, F.lit("regions")).otherwise(F.lit("country"))
    return r.select(F.lit(config.BIND_SELECT_ONE[0]).alias("dependent_var"), grouping.alias("independent_var"),
                    ((F.col("r_regionkey") + 1) / 100).alias("p_value"))
