"""Exact order statistics by repeated histograms.

The middle value of every (group, measure) is found without shuffling the values:

* pass 0 counts the values of each group and takes their ends;
* pass 1 cuts the range between the ends into ``BUCKETS`` buckets and keeps, per
  bucket, a count and its smallest and largest value.  A bucket of one distinct
  value is the answer;
* the values of the buckets that hold a middle position are written once, as
  narrow rows, and every further pass cuts what is left of those in the same way.

Only counts per bucket are shuffled, at most ``BUCKETS`` rows per group, measure
and task, so a group with a third of all rows costs what any other group does.
The input is read three times, whatever the number of passes.
Buckets are equal steps of the value or, where the ends are far apart, of its
1024th root (ten square roots: correctly rounded and order-preserving on every
machine), so a pass divides the remaining range by ``BUCKETS`` whatever the
distribution; doubles are told apart after at most 15 passes, prices after 3.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import exprs as X
from souk.sources.store import materialize

BUCKETS = 32
#: Ends that differ by more than this factor are cut in steps of the root.
FAR = 1000.0


def _root(v: Column) -> Column:
    size = F.abs(v)
    for _ in range(10):
        size = F.sqrt(size)
    return F.signum(v) * size


def _share(v: Column, lo: Column, hi: Column, far: Column) -> Column:
    """Where v lies between lo and hi, from 0 to 1; rises with v."""
    # halves: the difference of two large doubles must stay finite
    plain = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(far, (_root(v) - _root(lo)) / (_root(hi) - _root(lo))).otherwise(plain)


def _bucket(v: Column, lo: Column, hi: Column, far: Column, number: int) -> Column:
    return F.least(F.floor(_share(v, lo, hi, far) * number), F.lit(number - 1)).cast("int")


def _is_far(lo: Column, hi: Column) -> Column:
    small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    return (F.signum(lo) != F.signum(hi)) | (large / FAR > small)


def _ends(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Pass 0: one row per group, its number ``g`` and per measure the counts and finite ends."""
    aggs = []
    for i, m in enumerate(measures):
        fin = F.when(X.is_finite(m), F.col(m).cast("double"))
        aggs.append(F.struct(F.count(fin).alias("n"), F.min(fin).alias("lo"), F.max(fin).alias("hi"),
                             F.count(F.when(F.col(m) == X.NEG_INF(), 1)).alias("low"),
                             F.count(F.when(F.col(m) == X.INF(), 1)).alias("high")).alias(f"__m{i}"))
    groups = df.groupBy(*keys).agg(*aggs)
    return materialize(groups.select(F.monotonically_increasing_id().alias("__g"), *keys,
                                     F.array(*[f"__m{i}" for i in range(len(measures))]).alias("__ends")), "group_ends")


def _middle(ends: DataFrame) -> DataFrame:
    """g, m, t (position of the lower middle among the finite values), even, and the answer where the ends give it."""
    s = ends.select("__g", F.posexplode("__ends").alias("m", "e")).select("__g", "m", "e.*")
    total = F.col("n") + F.col("low") + F.col("high")
    t = F.floor((total + 1) / 2) - F.col("low")
    even = total % 2 == 0
    s = s.withColumn("t", t).withColumn("even", even).where(total > 0)

    def at(place: Column) -> Column:
        return (F.when(place < 1, X.NEG_INF()).when(place > F.col("n"), X.INF())
                .when((F.col("lo") == F.col("hi")) | (place == 1), F.col("lo")).when(place == F.col("n"), F.col("hi")))

    upper = F.col("t") + F.when(F.col("even"), 1).otherwise(0)
    return s.select("__g", "m", "t", "even", "lo", "hi", at(F.col("t")).alias("lower"), at(upper).alias("upper"))


def _values(df: DataFrame, ends: DataFrame, keys: Sequence[str], measures: Sequence[str], state: DataFrame) -> DataFrame:
    """(g, m, v and the state) of every finite value whose group and measure are still open."""
    groups = ends.select("__g", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    cells = F.array(*[F.struct(F.lit(i).alias("m"), F.col(m).cast("double").alias("v")) for i, m in enumerate(measures)])
    rows = df.join(groups, same).select("__g", F.inline(cells)).where(X.is_finite("v"))
    return rows.join(state, ["__g", "m"])


def _narrowed(buckets: DataFrame) -> DataFrame:
    """The state after a pass that gave (b, c, least, most) per bucket: the middle's bucket, or the answer."""
    w = Window.partitionBy("__g", "m").orderBy("b")
    counts = buckets.withColumn("upto", F.col("below") + F.sum("c").over(w)).withColumn("next_least", F.lead("least").over(w))
    hit = counts.where((F.col("upto") - F.col("c") < F.col("t")) & (F.col("t") <= F.col("upto")))
    next_one = F.coalesce("next_least", "beyond")
    lower = F.when(F.col("least") == F.col("most"), F.col("least"))
    upper = F.when(~F.col("even") | (F.col("t") < F.col("upto")), lower).otherwise(F.when(lower.isNotNull(), next_one))
    return hit.select("__g", "m", "t", "even", F.col("least").alias("lo"), F.col("most").alias("hi"),
                      (F.col("upto") - F.col("c")).alias("below"), next_one.alias("beyond"), lower.alias("lower"), upper.alias("upper"))


STATE = ["__g", "m", "t", "even", "below", "beyond"]


def _start(middle: DataFrame) -> DataFrame:
    """The state before pass 1: every group and measure whose ends are not the answer."""
    return middle.where("lower is null or upper is null").select(
        "__g", "m", "t", "even", F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("beyond"), "lo", "hi")


def _with_far(state: DataFrame) -> DataFrame:
    """Decided once per group and measure, not per value."""
    return state.withColumn("far", _is_far(F.col("lo"), F.col("hi")))


def _inside(values: DataFrame) -> DataFrame:
    """The values between the ends that the last pass left."""
    return values.where(F.col("v").between(F.col("lo"), F.col("hi")))


def _pass(values: DataFrame) -> DataFrame:
    """One pass over values between ends: counts and ends of the buckets, and what follows from them."""
    bucket = _bucket(F.col("v"), F.col("lo"), F.col("hi"), F.col("far"), BUCKETS)
    rows = values.groupBy(*STATE, bucket.alias("b"))
    return _narrowed(rows.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most")))


def exact_medians(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Exact median (mean of the two middle values; NULL and NaN skipped) of each
    measure per group; NULL keys are groups, too, and a group without values
    keeps a row of NULLs.

    One job per pass; the state between two passes is one row per group and measure
    that is still open, joined back by the planner's choice (a broadcast below its
    threshold).
    """
    ms = list(measures)
    ends = _ends(df, keys, ms)
    middle = materialize(_middle(ends), "middles")
    done = [middle.where("lower is not null and upper is not null").select("__g", "m", "lower", "upper")]
    values, left = _values(df, ends, keys, ms, _with_far(_start(middle))), None
    while True:
        state = materialize(_pass(values), "median_pass")
        done.append(state.where("lower is not null").select("__g", "m", "lower", "upper"))
        open_ = state.where("lower is null")
        if open_.isEmpty():
            break
        open_ = open_.drop("lower", "upper")
        if left is None:
            rows = _values(df, ends, keys, ms, open_.select("__g", "m", "lo", "hi"))
            left = materialize(_inside(rows).select("__g", "m", "v"), "median_values")
        values = _inside(left.join(_with_far(open_), ["__g", "m"]))
    found = reduce(DataFrame.unionByName, done)
    value = F.lit(0.5) * F.col("lower") + F.lit(0.5) * F.col("upper")
    wide = found.groupBy("__g").agg(*[F.max(F.when(F.col("m") == i, value)).alias(f"__v{i}") for i in range(len(ms))])
    out = ends.select("__g", *keys).join(wide, "__g", "left")
    return out.select(*keys, *[F.col(f"__v{i}").alias(m) for i, m in enumerate(ms)])


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the position 1..n of every row in a total order.

    The rows are dealt out by ranges of the order and numbered within each range;
    the counts of the ranges, one row per task, give each range its offset.  No
    task sees more than its range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    placed = materialize(placed, "ranges")  # a recomputed range could hold other rows
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.array_sort(F.collect_list(F.struct("__range", "n"))).alias("a"))
    offsets = every.select(F.posexplode("a").alias("i", "r"), "a").select(
        F.col("r.__range").alias("__range"),
        F.aggregate(F.slice("a", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("__before"))
    out = placed.join(offsets, "__range")
    return out.select(*[F.col(c) for c in df.columns], (F.col("__before") + F.col("__at") + 1).alias(rank))
