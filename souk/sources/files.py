"""Readers and writers (sources S1-S9).

Round files, dimension lists, plans, questionnaires and cleaning logs are all
plain CSV or Parquet here.  CSV is read with an all-string schema so that the
three null tokens can be mapped and numbers cast without inference (which
would scan the file twice and guess wrong on all-empty columns).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from souk import config
from souk.functions import exprs as X
from souk.functions import names as N


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    numeric: Iterable[str] = (),
    null_tokens: Sequence[str] = config.NULL_TOKENS,
) -> DataFrame:
    """CSV with header; ``null_tokens`` -> NULL; ``numeric`` columns -> double.

    Text keeps its whitespace.  With ``columns`` given the header is still
    skipped but no schema pass is needed.
    """
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).option("nullValue", None)
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    df = N.syntactic_names(reader.csv(path))  # before any use: headers may hold dots
    num = {N.syntactic_name(c) for c in numeric}
    tokens = list(null_tokens)
    out = []
    for c in df.columns:
        v = F.when(~F.col(c).isin(tokens), F.col(c))
        out.append((X.to_number(v) if c in num else v).alias(c))
    return df.select(*out)


def read_any(spark: SparkSession, path: str, fmt: str | None = None, **csv_kw) -> DataFrame:
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        return read_table(spark, path, **csv_kw)
    return N.syntactic_names(spark.read.format(fmt).load(path))


def read_round(
    spark_or_df,
    path: str | None = None,
    id_col: str = "uuid",
    settlement_fix: tuple[str, str] | None = ("rhino", "rhino camp"),
) -> DataFrame:
    """One survey round: month text -> number, id column renamed to ``uuid``,
    first-match name fix on settlement."""
    df = spark_or_df if isinstance(spark_or_df, DataFrame) else read_any(spark_or_df, path)
    if id_col != "uuid" and id_col in df.columns:
        df = df.withColumnRenamed(id_col, "uuid")
    if "month" in df.columns:
        df = df.withColumn("month", X.to_number(F.col("month").cast("string")).try_cast("int"))
    if settlement_fix and "settlement" in df.columns:
        df = df.withColumn("settlement", X.first_replace("settlement", *settlement_fix))
    return df


def read_baseline_meb(spark: SparkSession, path: str) -> DataFrame:
    """The precomputed basket of an earlier round; its lines and totals are numbers (S3)."""
    df = read_any(spark, path)
    return df.select(*[X.to_number(c).alias(c) if c.startswith("meb_") else
                       X.to_number(c).cast("int").alias(c) if c == "collection_order" else F.col(c) for c in df.columns])


def read_dimension(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Plan, questions, choices: small tables."""
    return read_any(spark, path, **kw)


def read_cleaning_log(spark: SparkSession, path: str, id_col: str = "uuid",
                      variable_col: str = "indicator", value_col: str = "new_value",
                      change_col: str = "change", seq_col: str | None = None) -> DataFrame:
    """Cleaning log with the sequence number that decides which write is last.

    ``seq_col`` names it if the log has one.  Without it the log has to be one
    file, whose row order is the log's; the order of several files is nobody's
    to guess, so that is an error.
    """
    df = read_any(spark, path)
    if seq_col is None and len(df.inputFiles()) > 1:
        raise ValueError("a cleaning log of several files needs a sequence column")
    # one file is read in ranges of rising position, so the id rises with the row
    seq = F.monotonically_increasing_id() if seq_col is None else F.col(seq_col).try_cast("long")
    return df.select(
        seq.alias("seq"),
        F.col(id_col).cast("string").alias("uuid"),
        F.col(variable_col).cast("string").alias("variable"),
        F.col(value_col).cast("string").alias("new_value"),
        F.col(change_col).cast("string").alias("change"),
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", na: str = "n/a",
                mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("nullValue", na).option("emptyValue", "").csv(path)
    else:
        w.format(fmt).save(path)


def write_tables(tables: Mapping[str, DataFrame], base: str, run_date: str,
                 fmt: str = "parquet") -> dict[str, str]:
    """Multi-table export: one directory per table, date-stamped."""
    paths = {}
    for name, df in tables.items():
        safe = N.syntactic_name(name.replace(" ", "_")).lower()
        p = f"{base.rstrip('/')}/{safe}_{run_date}"
        write_table(df, p, fmt=fmt)
        paths[name] = p
    return paths


def write_csv(df: DataFrame, path: str, na: str = "n/a") -> None:
    write_table(df, path, fmt="csv", na=na)


def write_summary(stats: DataFrame, path: str) -> None:
    write_csv(stats.drop("se", "min", "max"), path)


def write_clean(df: DataFrame, path: str) -> None:
    write_table(df, path, fmt="parquet")
