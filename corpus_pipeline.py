"""The corpus pipeline: documents through filtering stages to token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``docs`` as they are.
Models are learned from the stage's own input and the tables in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm import decontaminate, language_id, near_dedup, pieces, toxicity
from souk.llm.common import held_out, table, write_shared


#: Near copies from a Jaccard similarity of 0.8 on, in five-word shingles (op5's own contract says 0.85);
#: of the pairs at 0.8, (1 - 0.8^4)^27 = 6.6e-7 share no band.
NEAR_COPIES = near_dedup.Params(percent=80, bands=27)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear (a text without letters or with a narrow margin goes)."""
    return language_id.drop_rejected(docs, language_id.fit(docs.where(~held_out(4, 2))))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.keep_one(docs, NEAR_COPIES)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents."""
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("token_ids", token_ids),
]

#: SQL cannot express the stages; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return docs
