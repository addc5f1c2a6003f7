"""Bounded samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import held_out, unit_hash, write_shared


def sample(docs: DataFrame, labels: DataFrame, column: str, bounds: dict[int, int], modulus: int, remainder: int,
           ) -> tuple[DataFrame, dict[int, float]]:
    """((text, label) of a sample of training documents, share of each label that was kept).

    Rows whose id CRC mod ``modulus`` is ``remainder`` are held out.  A label
    with more than ``bounds[label]`` documents is thinned by a hash coin to
    about that many, so the sample's size has a bound that the input does not
    move.  An id with several labels counts with the largest; null labels, ids
    and texts are left out.
    """
    marks = (labels.where(f"doc_id is not null and {column} is not null").where(~held_out(modulus, remainder))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column)).cast("int").alias("label")))
    counts = {r["label"]: r["n"] for r in marks.where(F.col("label").isin(list(bounds))).groupBy("label")
              .agg(F.count("*").alias("n")).collect()}
    kept = {k: min(1.0, bounds[k] / n) for k, n in counts.items()}
    if not kept:
        empty = docs.select("text", F.lit(0).alias("label")).where(F.lit(False))
        return write_shared(empty, "sample"), kept
    rate = F.create_map(*[F.lit(x) for k, r in kept.items() for x in (k, r)])
    chosen = marks.where(F.col("label").isin(list(kept)) & (unit_hash(F.col("doc_id"), F.lit(column)) < rate[F.col("label")]))
    # by the bounds at most a few tens of thousands of (long, int) rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id").select("text", "label")
    return write_shared(found, "sample"), kept
