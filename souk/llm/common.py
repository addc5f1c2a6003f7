"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.store import run_folder

#: Unsigned 2^63, the range of the non-negative hash used for sampling.
HASH_RANGE = float(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    The folder is shared by the driver and all executors, so the table outlives
    any executor and cuts the lineage.  Only a session on one machine may go
    without the setting (tests); others raise an error.  ``store.release``
    deletes what the process wrote.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_crc(col: str = "doc_id") -> Column:
    """CRC-32 of the id written as text (unsigned)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int, col: str = "doc_id") -> Column:
    """True for rows no model may learn from; rows without an id count as held out."""
    return F.coalesce(id_crc(col) % modulus == remainder, F.lit(True))


def unit_hash(*cols: Column) -> Column:
    """Row hash as a double in [0, 1): a reproducible sampling coin."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1).cast("double") / F.lit(HASH_RANGE)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask (``lower`` changes other letters too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text with A-Z lower-cased."""
    return data.lower().split()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives memory back when its rows are done.

    Spark's Python workers live on from stage to stage, and what the allocators
    keep of one stage's batches and word memories adds up beside the next one's.
    """

    def with_release(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not the GNU C library
            pass

    return with_release


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the judge keeps.

    ``judge`` is called once per task and returns the test of a text.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = judge()
        for batch in batches:
            kept = batch.filter(pa.array([keeps(t.as_py()) for t in batch.column("text")], pa.bool_()))
            for start in range(0, kept.num_rows, 1000):  # the JVM holds a whole batch outside its heap
                yield kept.slice(start, 1000)

    return docs.mapInArrow(tidy(run), docs.schema)


def without_ids(docs: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (doc_id); broadcast only if few enough."""
    ids = write_shared(ids.select(F.col("doc_id").cast("long").alias("__gone")).distinct(), "gone")
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    return docs.join(ids, docs["doc_id"].cast("long") == ids["__gone"], "left_anti")
