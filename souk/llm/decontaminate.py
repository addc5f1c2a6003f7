"""Operator 3: benchmark decontamination by size-partitioned MinHash containment.

Which documents hold a benchmark item?  The Jaccard similarity of a short item
and a long document says nothing, so the search estimates containment: each
item is represented by the shingles that its MinHash functions pick (a bottom-k
sample of its own shingles), and a document is a candidate for the item if it
holds enough of them.  Items are partitioned by size; a partition fixes how
many samples an item gets and how many must be found, such that an item whose
containment reaches the threshold is missed with a probability below
``miss``.  Candidates are verified by exact containment of the shingle sets.

DataFrame functions only.  The item samples are broadcast after a count shows
that they fit; more of them are joined by shuffle.

Words are runs of letters, digits and non-ASCII characters of the lower-cased
text; shingles are ``words`` of them.  Defined results: items without words and
documents that are null or empty match nothing; an item of fewer words is one
shingle of all its words.  Repeated rows of a document give one result row per
item; repeated item ids with different texts are searched each and the best
containment counts.  Rows without an id are searched as well (doc_id null).
Other input columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import table, write_shared

NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Params:
    words: int = 5
    threshold: float = 0.8
    #: Item partitions: (largest number of shingles, samples per item). Items
    #: of at most as many shingles as samples are represented in full.
    partitions: tuple[tuple[int, int], ...] = ((24, 24), (256, 24), (1 << 62, 32))
    #: Bound on the chance that the samples miss an item at the threshold.
    miss: float = 1e-6
    #: Rows of the item or candidate side up to which it is broadcast (about 24 bytes each).
    broadcast_rows: int = 1_000_000


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NON_WORD), lambda w: w != "")


def shingle_hashes(hashes: Column, length: int) -> Column:
    """64-bit hashes of all runs of ``length`` words, each once, from the words' hashes.

    ``hashes`` is bound to a variable first: a filter on the result that the
    optimizer moves below the hashes' own projection would else compute all of
    them again for every run.
    """

    def runs(h: Column) -> Column:
        last = F.size(h) - length
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(length)]))
        return F.when(last >= 0, F.array_distinct(each)).otherwise(F.array().cast("array<long>"))

    return F.get(F.transform(F.array(hashes), runs), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def needed_hits(samples: int, threshold: float, miss: float) -> int:
    """Largest m with P(Binomial(samples, threshold) < m) <= miss (at least 1)."""
    tail, m = 0.0, 0
    while m <= samples:
        tail += math.comb(samples, m) * threshold ** m * (1 - threshold) ** (samples - m)
        if tail > miss:
            break
        m += 1
    return max(1, m)


def item_table(items: DataFrame, params: Params) -> DataFrame:
    """item (row key), item_id, length, shingles, n_item, sample, needed of every item with words."""
    hashed = (items.select("item_id", word_hashes(F.col("text")).alias("h"))
              .where(F.size("h") > 0).dropDuplicates())
    hashed = hashed.withColumn("length", F.least(F.size("h"), F.lit(params.words)))
    shingles = F.coalesce(*[F.when(F.col("length") == n, shingle_hashes(F.col("h"), n))
                            for n in range(1, params.words + 1)])
    out = hashed.select(F.xxhash64("item_id", "h").alias("item"), "item_id", "length",
                        shingles.alias("shingles")).withColumn("n_item", F.size("shingles"))
    size, samples, needed = F.col("n_item"), F.lit(None), F.lit(None)
    for most, k in reversed(params.partitions):
        samples = F.when(size <= most, k).otherwise(samples)
        needed = F.when(size <= most, needed_hits(k, params.threshold, params.miss)).otherwise(needed)
    # the bottom-k sample under a hash of its own, so that it is spread over the item
    mixed = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(3)).alias("o"), s.alias("s"))))
    full = size <= samples
    return (out.withColumn("sample", F.transform(F.slice(mixed, F.lit(1), samples.cast("int")), lambda x: x["s"]))
            .withColumn("needed", F.when(full, F.ceil(size * params.threshold)).otherwise(needed).cast("int")))


def sized(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def find_items(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """Pairs with containment >= threshold: doc_id, text_hash, item_id, n_item, n_shared, containment."""
    known = write_shared(item_table(items, params), "items")
    lengths = [r["length"] for r in known.select("length").distinct().collect()]  # at most ``words`` numbers
    n_items = known.count()
    text_hash = F.xxhash64("text").alias("text_hash")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")

    found = None
    for length in sorted(lengths) or [params.words]:
        samples = known.where(F.col("length") == length).select("item", "needed", F.explode("sample").alias("shingle"))
        hashed = docs.where("text is not null").select(doc_id, text_hash, word_hashes(F.col("text")).alias("h"))
        exploded = hashed.select("doc_id", "text_hash", F.explode_outer(shingle_hashes(F.col("h"), length)).alias("shingle"))
        n_samples = samples.count()
        hits = exploded.join(sized(samples, n_samples, params.broadcast_rows), "shingle")
        some = hits.groupBy("doc_id", "text_hash", "item").agg(F.count("*").alias("hits"), F.first("needed").alias("needed"))
        some = some.where(F.col("hits") >= F.col("needed")).select("doc_id", "text_hash", "item")
        found = some if found is None else found.unionByName(some)
    candidates = write_shared(found, "candidates")

    # exact containment, for candidates only
    n = candidates.count()
    left = docs.where("text is not null").select(doc_id, "text", text_hash).alias("d")
    pairs = left.join(sized(candidates, n, params.broadcast_rows).alias("c"),
                      F.col("d.text_hash").eqNullSafe(F.col("c.text_hash"))
                      & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")))
    pairs = pairs.select("d.doc_id", "d.text_hash", "c.item", "d.text")
    pairs = pairs.join(sized(known.select("item", "item_id", "length", "shingles", "n_item"), n_items,
                             params.broadcast_rows // 16), "item")
    pairs = pairs.withColumn("h", word_hashes(F.col("text")))
    own = F.coalesce(*[F.when(F.col("length") == k, shingle_hashes(F.col("h"), k)) for k in sorted(lengths) or [params.words]])
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect(own, F.col("shingles"))))
    pairs = pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    pairs = pairs.where(F.col("containment") >= params.threshold)
    best = F.max(F.struct("containment", "n_shared", "n_item"))
    return (pairs.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b"))
            .select("doc_id", "text_hash", "item_id", "b.n_item", "b.n_shared", "b.containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` (all its columns) without the documents that hold an item."""
    bad = write_shared(find_items(docs, items, params).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    side = sized(bad, bad.count(), params.broadcast_rows)
    return docs.join(side, (F.xxhash64(docs["text"]) == side["__hash"])
                     & docs["doc_id"].cast("long").eqNullSafe(side["__id"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document that holds a benchmark item, with the item."""
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").dropDuplicates()
