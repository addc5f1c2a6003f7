"""Reading files under a contract (S1-S5): rejected rows are kept with their
reason, and headers that drift from file to file are found and reported.

Files are grouped by their header line, read on the driver like any other file
metadata (one line a file); each group is one scan with its own column order, so
a moved or missing column never shifts values into another.  Values are text
until the contract's tokens, numbers and required columns have been checked.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from souk import config
from souk.functions import exprs as X
from souk.functions import names as N

TEXT, NUMBER, INTEGER = "text", "number", "integer"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = TEXT
    #: A row without a value is rejected.
    required: bool = False
    #: A row whose text is no number is rejected; else it only loses the value.
    strict: bool = False


@dataclass(frozen=True)
class Loaded:
    """Accepted rows, rejected rows (file, reason, line) and drift (file, column, issue)."""

    rows: DataFrame
    rejects: DataFrame
    drift: DataFrame


def files_of(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files themselves and those in folders, without hidden ones, sorted."""
    out = []
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if status.isFile() and not name.startswith(("_", ".")):
                out.append(status.getPath().toString())
    return sorted(out)


def header_of(spark: SparkSession, file: str, encoding: str = "utf-8") -> list[str] | None:
    """The column names in a file's first line; None for an empty file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding)).readLine()
    finally:
        stream.close()
    return None if line is None else next(csv.reader([line.removeprefix("﻿")]))


def unique_names(header: Sequence[str]) -> list[str]:
    """Syntactic names; a repeated one gets a number."""
    seen: dict[str, int] = {}
    out = []
    for c in header:
        name = N.syntactic_name(c)
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def header_issues(header: Sequence[str], fields: Sequence[Field]) -> list[tuple[str, str]]:
    """(column, issue): ``missing``, ``unexpected``, ``repeated`` and ``moved`` columns.

    Moved are the columns of the contract that do not follow the one that stands
    before them in the contract (among the columns both have).
    """
    wanted, own = [f.name for f in fields], [N.syntactic_name(c) for c in header]
    out = [(c, "missing") for c in wanted if c not in own]
    out += [(c, "unexpected") for c in dict.fromkeys(own) if c not in wanted]
    out += [(c, "repeated") for c in dict.fromkeys(own) if own.count(c) > 1]
    shared = [c for c in wanted if c in own]
    here = [c for c in dict.fromkeys(own) if c in shared]
    before = dict(zip(shared[1:], shared, strict=False))
    out += [(c, "moved") for prev, c in zip([None, *here], here, strict=False) if before.get(c) != prev]
    return out


def _value(raw: Column, field: Field) -> Column:
    number = X.to_number(raw)
    if field.kind == NUMBER:
        return number
    if field.kind == INTEGER:
        return F.when(number == F.floor(number), number).try_cast("int")
    return raw


def _checked(df: DataFrame, header: Sequence[str], fields: Sequence[Field], tokens: Sequence[str]) -> DataFrame:
    """The contract's columns and the others as text, ``__file``, ``__line`` and ``__reason``."""
    by_name = {f.name: f for f in fields}
    raw = {c: F.when(~F.col(c).isin(list(tokens)), F.col(c)) for c in header}
    value = {c: _value(raw[c], by_name.get(c, Field(c))) for c in header}
    reason = F.when(F.col("__bad").isNotNull(), F.lit("malformed"))
    for f in fields:
        given = raw.get(f.name, F.lit(None).cast("string"))
        if f.required:
            reason = reason.when(given.isNull(), F.lit(f"missing {f.name}"))
        if f.strict and f.kind != TEXT and f.name in raw:
            reason = reason.when(given.isNotNull() & value[f.name].isNull(), F.lit(f"no {f.kind} {f.name}"))
    line = F.coalesce(F.col("__bad"), F.to_json(F.struct(*[F.col(c) for c in header])))
    absent = [F.lit(None).cast({NUMBER: "double", INTEGER: "int"}.get(f.kind, "string")).alias(f.name) for f in fields if f.name not in raw]
    return df.select(*[value[c].alias(c) for c in header], *absent, F.col("__file"), line.alias("__line"), reason.alias("__reason"))


def read_contract(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[Field],
                  null_tokens: Sequence[str] = config.NULL_TOKENS) -> Loaded:
    """CSV files with headers, under a contract of fields.

    Every file is read by its own header.  ``rows`` holds the contract's columns
    (missing ones NULL), then unexpected ones as text.  A row is rejected, with the
    first reason that applies, if its number of values is not the header's
    (``malformed``), a required value is missing or a strict number is none; its
    line is kept.  No files, or empty ones, give no rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups: dict[tuple[str, ...], list[str]] = {}
    issues = []
    for file in files_of(spark, paths):
        header = header_of(spark, file)
        if header is None:
            issues.append((file, None, "empty"))
            continue
        groups.setdefault(tuple(unique_names(header)), []).append(file)
        issues += [(file, c, issue) for c, issue in header_issues(header, fields)]
    parts = []
    for header, files in groups.items():
        schema = StructType([StructField(c, StringType()) for c in (*header, "__bad")])
        df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", "__bad").option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).option("columnPruning", False).csv(files)
        parts.append(_checked(df.select("*", F.col("_metadata.file_path").alias("__file")), header, fields, null_tokens))
    kinds = {TEXT: "string", NUMBER: "double", INTEGER: "int"}
    if not parts:
        empty = ", ".join(f"`{f.name}` {kinds[f.kind]}" for f in fields) + ", __file string, __line string, __reason string"
        parts = [spark.createDataFrame([], empty)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    others = [c for c in every.columns if c not in {f.name for f in fields} and c not in ("__file", "__line", "__reason")]
    rows = every.where(F.col("__reason").isNull()).select(*[f.name for f in fields], *others)
    rejects = every.where(F.col("__reason").isNotNull()).select(
        F.col("__file").alias("file"), F.col("__reason").alias("reason"), F.col("__line").alias("line"))
    return Loaded(rows, rejects, spark.createDataFrame(issues, "file string, column string, issue string"))
