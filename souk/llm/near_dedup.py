"""Operator 5: near-duplicate groups by MinHash bands and odd sketches.

Documents with 100 * |A n B| >= percent * |A u B| of their distinct word
shingles are linked; a group is a connected component.

1. One pass over the texts gives each document its set size, a 128-bit key of
   its set, band keys of its MinHash values, and odd sketches: a hash-threshold
   MinHash sample of the set (level l keeps one shingle in 2^l, at most about
   ``sample`` of them) is folded into a parity bitmap.  The XOR of two bitmaps
   has at most as many ones as the samples differ in, so with level 0 (all
   small sets) too many ones prove that a pair is below the threshold.
2. Equal sets become one node.  Buckets of equal band keys link every member
   to two leaders only; pairs that their odd sketches allow are confirmed on
   the full sets, and the confirmed links give first components.
3. Pairs of a bucket that lie in different components still are compared by
   their sketches, in blocks of bounded size, members of the leader's component
   only with outsiders.  What the sketches allow is confirmed on the full sets.
   So no link is lost to the choice of leaders, and no group of copies is
   expanded into its pairs.

A pair at the threshold shares no band with a chance of (1 - s^rows)^bands,
about 2e-6 at the production parameters; the sketches of level 0 lose none and
the others allow six standard deviations.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower
case; a text of fewer words than a shingle is one shingle; null and empty texts
have size 0 and stay alone.  Rows without an id are compared with nothing
(component_id null, kept true).  Rows that share an id share its component.
Repeated rows repeat their result.  Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import table, tidy, without_ids, words_of, write_shared
from souk.llm.components import components


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 85
    bands: int = 18
    rows: int = 4
    seed: int = 1
    #: Bits of an odd sketch and the sample it holds at most, on average.
    bits: int = 1024
    sample: int = 512
    #: Members of a bucket compared at a time.
    block: int = 512
    #: Nodes up to which their ids are broadcast to fetch the full sets (8 bytes each).
    broadcast_nodes: int = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, length: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = words_of((text or "").encode("utf-8", "surrogatepass"))
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxh64_intdigest(w) for w in words], np.uint64)
    width = min(length, len(words))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i]
    return np.unique(mix(acc))


def signer(p: Params):
    """shingle set -> (band keys, level, odd sketch, odd sketch of the next level)."""
    rng = np.random.default_rng(p.seed)
    k = p.bands * p.rows
    flip = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]
    times = rng.integers(0, 1 << 31, k, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
    weights = (rng.integers(0, 1 << 62, p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[None, :]
    number = mix(np.arange(1, p.bands + 1, dtype=np.uint64))

    def parity(sample: np.ndarray) -> bytes:
        at = (sample >> np.uint64(44)).astype(np.int64) % p.bits
        return np.packbits((np.bincount(at, minlength=p.bits) & 1).astype(np.uint8)).tobytes()

    def sign(s: np.ndarray) -> tuple[np.ndarray, int, bytes, bytes]:
        short = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(k, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(short), 4096):
            np.minimum(least, ((short[None, i:i + 4096] ^ flip) * times).min(axis=1), out=least)
        keys = mix((least.reshape(p.bands, p.rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) ^ number)
        level = max(0, int(np.ceil(np.log2(len(s) / p.sample))))
        spread = mix(s ^ np.uint64(0x5851F42D4C957F2D))
        here = spread[(spread & np.uint64((1 << level) - 1)) == 0]
        above = here[(here >> np.uint64(level)) & np.uint64(1) == 0]
        return keys.view(np.int64), level, parity(here), parity(above)

    return sign


def most_ones(n_a, n_b, level, percent: int):
    """XOR ones up to which two sets of these sizes may reach the threshold."""
    apart = (n_a + n_b) * (100 - percent) / (100 + percent) / 2.0 ** level
    return np.floor(np.where(level == 0, apart + 1e-6, apart + 6 * np.sqrt(apart) + 6))


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, set_key, keys, level, odd, odd_next of every row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        sign = signer(p)
        for batch in batches:
            n, set_key, keys, levels, odd, above = [], [], [], [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), p.words)
                n.append(len(s))
                if len(s):
                    k, lv, o, a = sign(s)
                    set_key.append(xxh3_128_digest(s.tobytes()))
                    keys.append(k)
                else:
                    lv = o = a = None
                    set_key.append(None)
                    keys.append(None)
                levels.append(lv)
                odd.append(o)
                above.append(a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(set_key, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(levels, pa.int32()),
                 pa.array(odd, pa.binary()), pa.array(above, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "keys", "level", "odd", "odd_next"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(run), "doc_id long, n_shingles long, set_key binary, keys array<long>, level int, odd binary, odd_next binary")


def _bits(col, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, bits // 64)


def sketch_filter(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose odd sketches allow the threshold."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            na, nb, la, lb = (t.column(c).to_numpy() for c in ("n_a", "n_b", "level_a", "level_b"))
            own_a, next_a, own_b, next_b = (_bits(t.column(c), p.bits) for c in ("odd_a", "next_a", "odd_b", "next_b"))
            level = np.maximum(la, lb)
            a = np.where((la == level)[:, None], own_a, next_a)
            b = np.where((lb == level)[:, None], own_b, next_b)
            ones = np.bitwise_count(a ^ b).sum(axis=1)
            ok = (abs(la - lb) <= 1) & (100 * np.minimum(na, nb) >= p.percent * np.maximum(na, nb))
            ok &= ones <= most_ones(na, nb, level, p.percent)
            yield t.select(["a", "b"]).filter(pa.array(ok))

    side = {x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("level").alias(f"level_{x}"),
                            F.col("odd").alias(f"odd_{x}"), F.col("odd_next").alias(f"next_{x}")) for x in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").mapInArrow(tidy(run), "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of ids that reach the threshold on their full shingle sets."""
    import pyarrow as pa

    pairs = write_shared(pairs.distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if (n := ids.count()) <= p.broadcast_nodes:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):  # a set is several times its text's words
                t = whole.slice(start, 500)
                sets = [shingle_set(x.as_py(), p.words) for x in t.column("text")]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays(
                    [t.column("id"), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sets).view(np.int64)))
                     .cast(pa.list_(pa.int64()))], ["id", "shingles"])

    if not n:
        return pairs
    sets = write_shared(texts.mapInArrow(tidy(cut), "id long, shingles array<long>").where(F.size("shingles") > 0), "sets")
    side = {x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"}
    # compared row by row in the JVM: Arrow batches of thousands of pairs would hold both sets of each
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")  # the sets are distinct; 100 both >= percent (a + b - both)
    near = (100 + p.percent) * both >= p.percent * (F.size("set_a") + F.size("set_b")).cast("long")
    return write_shared(pairs.join(side["a"], "a").join(side["b"], "b").where(near).select("a", "b").distinct(), "links")


def leftover_pairs(members: DataFrame, nodes: DataFrame, known: DataFrame, p: Params) -> DataFrame:
    """Pairs of a bucket in different components that the sketches allow.

    members: key, node, lead (a node of the bucket), other (another); known:
    node, component.  Pairs with either leader have been confirmed or refused.
    """
    import pyarrow as pa

    lead = known.select(F.col("node").alias("lead"), F.col("component").alias("lead_component"))
    placed = (members.join(known, "node", "left").join(lead, "lead", "left")
              .withColumn("component", F.coalesce("component", "node"))
              .withColumn("main", F.col("component") == F.coalesce("lead_component", "lead")))
    sizes = placed.groupBy("key").agg(F.sum(F.col("main").cast("long")).alias("n_main"),
                                      F.sum((~F.col("main")).cast("long")).alias("n_minor"))
    # nothing to do where all are in the leader's component, or one outsider meets the two leaders only
    sizes = sizes.where("n_minor > 0")
    per = F.lit(p.block)
    placed = (placed.join(sizes, "key").where((F.col("node") != F.col("lead")) & (F.col("node") != F.col("other")))
              .withColumn("minors", F.ceil(F.col("n_minor") / per).cast("int"))
              .withColumn("mains", F.ceil(F.col("n_main") / per).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("node", "key"),
                                          F.when(F.col("main"), F.col("mains")).otherwise(F.col("minors"))).cast("int")))
    placed = placed.select("key", "node", "component", "main", "block", "minors", "mains").join(
        nodes.select("node", "n_shingles", "level", "odd", "odd_next"), "node")
    # block pairs: a minor block with every minor block (p >= q) and with every main block (q < 0)
    minor = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda j: F.struct(
        F.greatest(j, F.col("block")).alias("p"), F.least(j, F.col("block")).alias("q")))
    minor_main = F.when(F.col("mains") > 0, F.transform(F.sequence(F.lit(1), F.col("mains")), lambda j: F.struct(
        F.col("block").alias("p"), (-j).alias("q"))))
    main = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: F.struct(
        i.alias("p"), (-1 - F.col("block")).alias("q")))
    at = F.when(F.col("main"), main).when(F.col("mains") > 0, F.concat(minor, minor_main)).otherwise(minor)
    dealt = (placed.withColumn("at", F.explode(at))
             .select("key", "at.p", "at.q", "node", "component", "main", "block", "n_shingles", "level", "odd", "odd_next"))
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    # an exact count over the mesh is not needed: the blocks' own sizes vary a little around the bound

    def near(x: dict, y: dict | None) -> tuple[list, list]:
        """Pairs within x, or between x and y."""
        a_ids, b_ids = [], []
        z = x if y is None else y
        for i in range(len(x["node"])):
            rest = slice(i + 1, None) if y is None else slice(None)
            n, lv = z["n"][rest], z["level"][rest]
            level = np.maximum(lv, x["level"][i])
            mine = np.where((level == x["level"][i])[:, None], x["odd"][i], x["next"][i])
            theirs = np.where((lv == level)[:, None], z["odd"][rest], z["next"][rest])
            ones = np.bitwise_count(mine ^ theirs).sum(axis=1)
            own = x["n"][i]
            ok = (ones <= most_ones(n, own, level, p.percent)) & (abs(lv - x["level"][i]) <= 1)
            ok &= (100 * np.minimum(n, own) >= p.percent * np.maximum(n, own)) & (z["component"][rest] != x["component"][i])
            hit = z["node"][rest][ok]
            a_ids += np.minimum(hit, x["node"][i]).tolist()
            b_ids += np.maximum(hit, x["node"][i]).tolist()
        return a_ids, b_ids

    def group(rows: pa.Table) -> tuple[list, list]:
        got = {"node": rows["node"].to_numpy(), "component": rows["component"].to_numpy(), "n": rows["n_shingles"].to_numpy(),
               "level": rows["level"].to_numpy(), "odd": _bits(rows["odd"], p.bits), "next": _bits(rows["odd_next"], p.bits)}
        at_p, at_q = rows["p"][0].as_py(), rows["q"][0].as_py()
        if at_q == at_p:
            return near(got, None)
        first = ~rows["main"].to_numpy(zero_copy_only=False) if at_q < 0 else rows["block"].to_numpy() == at_p
        return near({k: v[first] for k, v in got.items()}, {k: v[~first] for k, v in got.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            marks = np.stack([t[c].to_numpy() for c in ("key", "p", "q")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            starts = [0, *cuts.tolist()]
            a_ids, b_ids = [], []
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if j - i > 1:
                    a, b = group(t.slice(i, j - i))
                    a_ids += a
                    b_ids += b
            held = t.slice(starts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())], ["a", "b"])
        if held is not None and held.num_rows > 1:
            a, b = group(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    base = write_shared(signatures(docs, p), "signatures")
    live = base.where("n_shingles > 0 and doc_id is not null")
    nodes = write_shared(live.groupBy("set_key").agg(
        F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "keys", "level", "odd", "odd_next")]),
        "nodes")

    banded = nodes.select("node", F.explode("keys").alias("key")).withColumn("rank", F.xxhash64("node", "key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rank", "node")).alias("lo"),
                                        F.max(F.struct("rank", "node")).alias("hi")).where("n > 1")
    buckets = buckets.select("key", "n", F.col("lo.node").alias("lead"), F.col("hi.node").alias("other"))
    members = write_shared(banded.drop("rank").join(buckets, "key"), "buckets")
    stars = members.select("node", F.explode(F.array("lead", "other")).alias("to")).where("node <> to")
    stars = stars.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
    links = confirm(sketch_filter(stars, nodes, p), docs, p)
    known = write_shared(components(links), "components")

    more = confirm(leftover_pairs(members.where("n > 2").drop("n"), nodes.dropDuplicates(["node"]), known, p), docs, p)
    if not more.isEmpty():
        known = write_shared(components(links.unionByName(more)), "components")

    found = base.select("doc_id", "n_shingles", "set_key").join(nodes.select("set_key", "node"), "set_key", "left")
    # an id with several texts belongs where any of them belongs
    found = found.join(known, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return (found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` (all its columns) with one document of each group: the one of the smallest id.

    Of rows that repeat an id one stays, too; rows without an id all stay.
    """
    found = write_shared(near_duplicates(docs, p).select("doc_id", "kept"), "kept")
    kept = without_ids(docs, found.where("not kept"), p.broadcast_nodes)
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
