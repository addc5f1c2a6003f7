"""Operator 7: Lempel-Ziv phrase fingerprints.

A document is parsed by the LZ78 rule into dictionary phrases (the longest
phrase seen before plus one byte); the fingerprint is a MinHash signature of
the set of phrases.  Texts that compress alike share phrases, and the share of
equal signature places estimates the similarity of their phrase sets.

``fingerprints`` is the plain operator.  ``compare_with_next`` also holds every
document against an edited text, whose tail comes from the next document in
descending id order: documents are dealt into ranges of (id, text hash), each
range also gets the first document of the range that follows, and a range is
read in order as a stream, so every text is shuffled once and no task holds a
whole range.  The ranges are cut from the sorted keys, 16 bytes a row, at every
``range_rows``-th one, so an id of many texts and the rows without an id are
split like any others; only rows that are equal in id and text stay together.

Defined results: null counts as the empty text, whose phrase set is empty; two
empty texts are alike (1), an empty and another one are not (0).  Equal ids are
ordered by the text's hash and rows without an id come last.  A table of one
row follows itself; an empty table gives no rows.  Other input columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import table

PHRASE_BITS = (1 << 61) - 1


@dataclass(frozen=True)
class Params:
    #: Signature places, 16 bits each.
    places: int = 64
    seed: int = 5
    #: Documents per range, at least, and the bounds that travel to the driver and the tasks, about, at most (16 bytes each).
    range_rows: int = 400
    bounds: int = 1_000_000


def parse(data: bytes, state: int, base: set[int], own: set[int]) -> int:
    """LZ78 over ``data``: adds the hashes of new phrases to ``own``; returns the open phrase's hash.

    ``state`` is the hash of the phrase open at the start (0: none), ``base``
    the phrases known before.
    """
    add = own.add
    for b in data:
        longer = (state * 1_000_003 + b + 1) & PHRASE_BITS
        if longer in own or longer in base:
            state = longer
        else:
            add(longer)
            state = 0
    return state


class Signer:
    def __init__(self, p: Params) -> None:
        rng = np.random.default_rng(p.seed)
        self.flip = rng.integers(0, 1 << 32, p.places, dtype=np.uint32)[:, None]
        self.times = rng.integers(0, 1 << 31, p.places, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.empty = np.full(p.places, 0xFFFFFFFF, np.uint32)

    def least(self, phrases: set[int]) -> np.ndarray:
        h = np.fromiter(phrases, np.uint64, len(phrases))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        short = (h >> np.uint64(32)).astype(np.uint32)
        least = self.empty.copy()
        for i in range(0, len(short), 4096):
            np.minimum(least, ((short[None, i:i + 4096] ^ self.flip) * self.times).min(axis=1), out=least)
        return least

    def signature(self, least: np.ndarray) -> bytes:
        """16 bits a place; the least hash's own low bits, which its size does not bias."""
        folded = (least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)
        return folded.astype(">u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal places of two signatures, as they are published."""
    return float(np.mean(np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")))


def fingerprints(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, fingerprint of every row of ``docs``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(p)
        for batch in batches:
            out = []
            for t in batch.column("text"):
                own: set[int] = set()
                parse((t.as_py() or "").encode("utf-8", "surrogatepass"), 0, set(), own)
                out.append(signer.signature(signer.least(own)).hex())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the order: ``down`` rises as the id falls, null last; ``tie`` is the text's hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .withColumn("down", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))).withColumn("tie", F.xxhash64("text"))


def bounds_of(rows: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The first keys (down, tie) of the ranges, in order; the very first key of all is among them."""
    import pyarrow as pa

    step = max(p.range_rows, -(-rows.count() // p.bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-seen % step, batch.num_rows, step)))
            seen += batch.num_rows

    keys = rows.select("down", "tie").repartitionByRange("down", "tie").sortWithinPartitions("down", "tie")
    found = keys.mapInArrow(run, "down long, tie long").distinct().toArrow()
    down, tie = found["down"].to_numpy(), found["tie"].to_numpy()
    order = np.lexsort((tie, down))
    return down[order], tie[order]


def ranged(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, text, order keys, cell, ahead: rows of ``cell`` in order, then (``ahead``) the row that follows them."""
    rows = keyed(docs)
    bound_down, bound_tie = bounds_of(rows, p)
    cells = max(1, len(bound_down))
    shared = docs.sparkSession.sparkContext.broadcast((bound_down, bound_tie))

    @F.pandas_udf("cell int, head boolean")
    def place(down: pd.Series, tie: pd.Series) -> pd.DataFrame:
        own_down, own_tie = shared.value
        d, t = down.to_numpy(), tie.to_numpy()
        low, high = np.searchsorted(own_down, d, "left"), np.searchsorted(own_down, d, "right")
        at = high - 1
        for i in np.flatnonzero(high > low).tolist():  # bounds of this very id: the text's hash decides
            at[i] = low[i] + np.searchsorted(own_tie[low[i]:high[i]], t[i], "right") - 1
        return pd.DataFrame({"cell": at.astype("int32"), "head": (own_down[at] == d) & (own_tie[at] == t)})

    rows = rows.withColumn("place", place("down", "tie"))
    own = F.struct(F.col("place.cell").alias("cell"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.pmod(F.col("place.cell") - 1, F.lit(cells)).alias("cell"), F.lit(True).alias("ahead"))
    return rows.select("doc_id", "text", "down", "tie", F.explode(
        F.when(F.col("place.head"), F.array(own, ahead)).otherwise(F.array(own))).alias("at")).select(
        "doc_id", "text", "down", "tie", "at.cell", "at.ahead")


def compare_with_next(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(p)

        def own_side(text: str) -> tuple:
            """What can be said of a text alone; its first two thirds are parsed once for both texts."""
            cut = len(text) - len(text) // 3
            base: set[int] = set()
            state = parse(text[:cut].encode("utf-8", "surrogatepass"), 0, set(), base)
            tail: set[int] = set()
            parse(text[cut:].encode("utf-8", "surrogatepass"), state, base, tail)
            head_least = signer.least(base)
            return text, cut, base, state, head_least, np.minimum(head_least, signer.least(tail))

        def row(doc_id, this: tuple, following: tuple) -> tuple:
            text, cut, base, state, head_least, least = this
            new = following[0][:len(text) - cut]
            tail: set[int] = set()
            parse(new.encode("utf-8", "surrogatepass"), state, base, tail)
            edited = np.minimum(head_least, signer.least(tail))
            digest = hashlib.sha256((text[:cut] + new).encode("utf-8", "surrogatepass")).hexdigest()
            own, other = signer.signature(least), signer.signature(edited)
            return (doc_id, len(text), digest, own.hex(), other.hex(), likeness(own, other),
                    likeness(own, signer.signature(following[5])))

        held = None  # (cell, doc_id, side) of the last row that still waits for the next
        for batch in batches:
            out = []
            for doc_id, text, cell, ahead in zip(*(batch.column(c) for c in ("doc_id", "text", "cell", "ahead")), strict=True):
                doc_id, cell, ahead = doc_id.as_py(), cell.as_py(), ahead.as_py()
                if ahead and (held is None or held[0] != cell):
                    continue  # a repeat of the head that already served
                side = own_side(text.as_py() or "")
                if held is not None:
                    out.append(row(held[1], held[2], side))
                held = None if ahead else (cell, doc_id, side)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    dealt = ranged(docs, p).repartition("cell").sortWithinPartitions("cell", "ahead", "down", "tie")
    return dealt.select("doc_id", "text", "cell", "ahead").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
             " near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: fingerprints of every document and of its edited text."""
    return compare_with_next(table(spark, sf_dir, "documents"))
