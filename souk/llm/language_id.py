"""Operator 9: language identification by compression.

A text belongs to the language whose texts help most in compressing it.  For
each language a zstandard raw-content dictionary is made of a bounded sample of
whole labelled documents; every whole text is then compressed once per language,
in blocks, and the dictionary with the smallest total wins.  A narrow win is a
rejection.  Texts of all lengths go by this one rule.

Defined results: a null text, an empty one or one without any letter gives
``und``, score 0 and ``rejected``; with no labelled row at all every text gives
``und``.  Ties go to the language that sorts first and are rejected.  Repeated
rows give repeated results; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import held_out, keep_rows, table, tidy, unit_hash

SCHEMA = "doc_id long, lang_pred string, score double, margin_bytes long, rejected boolean"


@dataclass(frozen=True)
class Params:
    #: The sample's bounds per language: labelled documents and their characters together, and the longest
    #: document that may be in it.  Sampled documents are whole; longer ones are scored like all others.
    sample_docs: int = 64
    sample_chars: int = 256_000
    longest: int = 32_000
    #: Bytes compressed at a time; a text's size is the sum over its blocks.
    block_bytes: int = 1024
    level: int = 9
    #: Rejected if the runner-up needs less than so many bytes more, or so small a share more.
    min_margin_bytes: int = 1
    min_margin_share: float = 0.001


def fit(train: DataFrame, params: Params = Params()) -> dict[str, bytes]:
    """Dictionaries by language from ``train`` (text, lang).

    The sample is bounded by ``Params``; its documents are the first by text hash
    that fit, and copies of a text count once.  Only the sample reaches the driver.
    """
    rows = train.where("lang is not null and text is not null").select("lang", "text")
    # distinct texts (within a few percent), as the coin below is thrown once per text and copies share it
    counts = {r["lang"]: max(r["n"], 1) for r in
              rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return {}
    # a hash coin thins each language to a few times the sample before anything moves
    rates = F.create_map(*[F.lit(x) for k, n in counts.items()
                           for x in (k, min(1.0, 16.0 * params.sample_docs / n))])
    size = F.length("text")
    thin = (rows.where((size <= params.longest) & (unit_hash(F.col("text")) < rates[F.col("lang")]))
            .groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")))
    order = Window.partitionBy("lang").orderBy("h")
    first = thin.withColumn("k", F.row_number().over(order)).where(F.col("k") <= params.sample_docs)
    upto = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts: dict[str, list[str]] = {k: [] for k in counts}
    for r in first.withColumn("upto", upto).where(F.col("upto") <= params.sample_chars).orderBy("lang", "k").collect():
        parts[r["lang"]].append(r["text"])
    return {k: " ".join(v).lower().encode("utf-8", "surrogatepass") for k, v in sorted(parts.items())}


def scorer(dictionaries: dict[str, bytes], params: Params) -> Callable[[str | None], tuple]:
    """text -> (language, score, margin in bytes, rejected)."""
    import zstandard as zstd

    langs = sorted(dictionaries)
    makers = []
    for k in langs:
        d = zstd.ZstdCompressionDict(dictionaries[k], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=params.level)
        makers.append(zstd.ZstdCompressor(level=params.level, dict_data=d, write_content_size=False,
                                          write_checksum=False, write_dict_id=False).compress)

    def score(text: str | None) -> tuple:
        if not text or not langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        sizes = [0] * len(langs)
        for at in range(0, len(data), params.block_bytes):
            block = data[at:at + params.block_bytes]
            for i, compress in enumerate(makers):
                sizes[i] += len(compress(block))
        order = sorted(range(len(langs)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * best
        margin = second - best
        narrow = margin < params.min_margin_bytes or margin < params.min_margin_share * second
        return langs[order[0]], margin / max(second, 1), margin, narrow

    return score


def identify(docs: DataFrame, dictionaries: dict[str, bytes], params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, margin_bytes, rejected."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(dictionaries, params)
        for b in batches:
            out = [one(t.as_py()) for t in b.column("text")]
            cols = {"doc_id": b.column("doc_id")}
            for i, (name, kind) in enumerate((("lang_pred", pa.string()), ("score", pa.float64()),
                                              ("margin_bytes", pa.int64()), ("rejected", pa.bool_()))):
                cols[name] = pa.array([r[i] for r in out], kind)
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], params: Params = Params()) -> DataFrame:
    """``docs`` (all its columns) without the documents whose language is not clear."""

    def judge() -> Callable[[str | None], bool]:
        one = scorer(dictionaries, params)
        return lambda text: not one(text)[3]

    return keep_rows(docs, judge)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the language of every document, learned from rows whose id CRC mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = fit(docs.where(~held_out(4, 2)))
    return identify(docs, dictionaries).select(
        "doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "margin_bytes", "rejected")
