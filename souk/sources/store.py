"""Materialising shared intermediates.

Tables that several outputs read (the item price table, the area means, the
basket, the survey statistics) are written once as Parquet under the shared
folder the cluster names in ``spark.checkpoint.dir`` and read back.  This
cuts the lineage -- later plans start from a scan, not from the whole join
chain -- and, unlike an in-memory cache, survives the loss of executors.

A session on one machine that names no folder (tests) gets a temporary one; a
cluster session without the setting is an error, because executors would not
see each other's local folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_released = 0


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session (``spark.checkpoint.dir``, or
    the context's checkpoint directory)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = spark.sparkContext
        d = sc.getCheckpointDir()
        if not d:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="souk-ckpt-"))
            d = sc.getCheckpointDir()
    return d.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This process's folder in the shared one."""
    return f"{checkpoint_root(spark)}/souk-{_RUN}"


def release(spark: SparkSession) -> bool:
    """Deletes every table this process wrote; call it when no result that reads
    them is needed any more.  False if there was nothing."""
    global _released
    _released += 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def releases() -> int:
    """How often written tables were deleted: what was read before is gone."""
    return _released


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Modification time and length of a file or folder; None if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    status = fs.getFileStatus(p)
    return status.getModificationTime(), status.getLen()


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once under the checkpoint folder and return a scan of it.

    ``partition_by`` lays the files out by those columns, so later filters on
    them prune whole directories.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    # the schema is known: no footer reading to infer it (partition columns
    # come back last, by name)
    return spark.read.schema(df.schema).parquet(path)
