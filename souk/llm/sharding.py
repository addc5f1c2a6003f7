"""Operator 2: a reproducible shuffle into shards by a Feistel permutation.

Rows get a global number 0..N-1 in an order that depends on their content
alone; a keyed Feistel network over Z_a x Z_b (a*b just above N) with cycle
walking permutes the numbers; position p gives ``shard = p mod shards`` and
``slot = p div shards``.  Shard sizes differ by one row at most (law ``rows``),
slots are gapless, and both can be computed for any number without the others.

DataFrame functions only.  Row numbers come without a global sort: rows are
dealt into hash buckets whose number grows with N, numbered inside the bucket,
and shifted by the bucket's offset, so no task holds more than a bucket.

Defined results: a null text counts as empty (size 8, CRC-32 0).  Rows equal in
id and text are numbered consecutively; which of them gets which number makes
no difference.  An empty table gives no rows.  Other input columns are ignored.
The law ``rows`` says nothing about equal texts: copies spread over the shards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import table, write_shared


@dataclass(frozen=True)
class Params:
    shards: int = 24
    seed: int = 20240601
    rounds: int = 4
    #: Rows per numbering bucket, on average.
    bucket_rows: int = 20_000


def feistel(number: Column, n: int, seed: int, rounds: int) -> Column:
    """The keyed permutation of 0..n-1 (n >= 1), applied to ``number``.

    Alternating Feistel rounds permute Z_a x Z_b; numbers that land in the
    fewer than ``a`` places at or above n walk on.  A walk meets only such
    places, so ``outside`` steps always suffice; for a large n sixteen do, and
    a row that needed more would raise an error, never a wrong place.
    """
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)
    outside = a * b - n
    steps = min(outside, 16)

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % b).cast("long").alias("r"))

        def turn(acc: Column, i: Column) -> Column:
            left = F.pmod(acc["l"] + F.pmod(F.xxhash64(F.lit(seed), i, acc["r"]), F.lit(a)), F.lit(a))
            mixed = F.struct(acc["r"].alias("r"), left.alias("l"))
            return F.transform(F.array(mixed), lambda m: F.struct(
                m["l"].alias("l"),
                F.pmod(m["r"] + F.pmod(F.xxhash64(F.lit(seed), F.lit(-1) - i, m["l"]), F.lit(b)), F.lit(b)).alias("r"),
            ))[0]

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn,
                           lambda acc: acc["l"] * b + acc["r"])

    place = once(number)
    if steps:
        place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), place,
                            lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))
    if steps < outside:
        place = F.transform(F.array(place), lambda p: F.when(p < n, p).otherwise(
            F.raise_error(F.lit("cycle walk did not end")).cast("long")))[0]
    return place


def number_rows(rows: DataFrame, keys: list[str], bucket_rows: int) -> tuple[DataFrame, int]:
    """(rows with a ``number`` 0..N-1, N); the order is that of a hash of ``keys``.

    Equal rows travel as one row with a count until they are numbered, so a
    row that repeats without end fills no bucket.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__copies"))
    counted = write_shared(counted.withColumn("__h", F.xxhash64(*keys)), "numbered")
    total = counted.agg(F.sum("__copies")).first()[0] or 0
    buckets = max(1, -(-total // bucket_rows))
    counted = counted.withColumn("__bucket", F.pmod(F.col("__h"), F.lit(buckets)))
    sizes = counted.groupBy("__bucket").agg(F.sum("__copies").alias("__size"))
    # offsets: one row per bucket, summed in two levels so that no single task sees them all
    sizes = sizes.withColumn("__block", F.floor(F.col("__bucket") / 1024))
    blocks = sizes.groupBy("__block").agg(F.sum("__size").alias("__block_size"))
    blocks = blocks.select("__block", (F.sum("__block_size").over(Window.orderBy("__block")) - F.col("__block_size")).alias("__base"))
    inside = F.sum("__size").over(Window.partitionBy("__block").orderBy("__bucket")) - F.col("__size")
    offsets = (sizes.withColumn("__inside", inside).join(blocks, "__block")
               .select("__bucket", (F.col("__base") + F.col("__inside")).alias("__offset")))
    order = Window.partitionBy("__bucket").orderBy("__h", *keys)
    numbered = counted.withColumn("__before", F.sum("__copies").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__copies"))
    numbered = numbered.join(offsets, "__bucket").withColumn(
        "__first", F.col("__offset") + F.col("__before"))
    each = F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__copies") - 1))
    return numbered.select(*keys, each.alias("number")), total


def shuffle_into_shards(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, size, text_crc32, number, position, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(rows, ["doc_id", "size", "text_crc32"], params.bucket_rows)
    position = feistel(F.col("number"), max(n, 1), params.seed, params.rounds)
    return (numbered.withColumn("position", position)
            .withColumn("shard", (F.col("position") % params.shards).cast("int"))
            .withColumn("slot", F.floor(F.col("position") / params.shards).cast("long")))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents in shards 0 to 23, law ``rows``."""
    out = shuffle_into_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "number", "position")
