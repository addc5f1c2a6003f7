"""Exports that are whole or not there.

Every table of an export is written to a folder of its own version; the list of
the tables, the manifest, is written last.  Readers go by the newest manifest, so
a run that is lost halfway leaves the export before it untouched, and a repeated
run only adds a version.  The manifest's number decides which is newest; it is
created under another name and renamed, and two writers cannot take one number.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from souk.functions import names as N

MANIFEST = re.compile(r"manifest-(\d{9})\.json$")
Writer = Callable[[DataFrame, str], None]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _read_text(spark: SparkSession, file: str) -> str:
    path, fs = _fs(spark, file)
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current(spark: SparkSession, base: str) -> dict | None:
    """The newest manifest under ``base``: ``number``, ``version`` and ``tables`` (name -> path, format, rows); None if there is none."""
    found = [n for n in _names(spark, base) if MANIFEST.match(n)]
    return json.loads(_read_text(spark, f"{base}/{found[-1]}")) if found else None


def _publish(spark: SparkSession, base: str, entry: dict) -> dict:
    """Writes the next manifest; tries the next number if another writer took it."""
    while True:
        now = current(spark, base)
        entry = entry | {"number": now["number"] + 1 if now else 0}
        draft, fs = _fs(spark, f"{base}/_draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        final, _ = _fs(spark, f"{base}/manifest-{entry['number']:09d}.json")
        if not fs.exists(final) and fs.rename(draft, final):
            return entry
        fs.delete(draft, False)


def publish(spark: SparkSession, base: str, tables: Mapping[str, DataFrame], writers: Mapping[str, tuple[str, Writer]] | None = None) -> dict:
    """Writes all tables as one export under ``base`` and returns its manifest.

    ``writers`` names the format and the writing function of tables that are not
    Parquet.  Rows are counted from what was written.
    """
    from souk.sources.files import write_table

    base = base.rstrip("/")
    version = uuid.uuid4().hex
    _, fs = _fs(spark, base)
    fs.mkdirs(_fs(spark, base)[0])
    out = {}
    for name, df in tables.items():
        path = f"{base}/v-{version}/{N.syntactic_name(name.replace(' ', '_')).lower()}"
        fmt, write = (writers or {}).get(name, ("parquet", write_table))
        write(df, path)
        back = spark.read.parquet(path) if fmt == "parquet" else spark.read.format(fmt).option("header", True).load(path)
        out[name] = {"path": path, "format": fmt, "rows": back.count()}
    return _publish(spark, base, {"version": version, "tables": out})


def read_export(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the newest export; a CSV table has text columns."""
    manifest = current(spark, base.rstrip("/"))
    if manifest is None:
        raise FileNotFoundError(f"no export under {base}")
    return {name: spark.read.parquet(t["path"]) if t["format"] == "parquet" else
            spark.read.format(t["format"]).option("header", True).option("nullValue", "n/a").load(t["path"])
            for name, t in manifest["tables"].items()}


def prune(spark: SparkSession, base: str) -> list[str]:
    """Deletes what the newest export does not use (older versions, unfinished ones); returns the names."""
    base = base.rstrip("/")
    now = current(spark, base)
    keep = {f"v-{now['version']}", f"manifest-{now['number']:09d}.json"} if now else set()
    gone = [n for n in _names(spark, base) if n not in keep and (n.startswith(("v-", "_draft-")) or MANIFEST.match(n))]
    for n in gone:
        path, fs = _fs(spark, f"{base}/{n}")
        fs.delete(path, True)
    return gone
