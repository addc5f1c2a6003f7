"""The one-row report from a declared template.

A template names every cell of the report with its kind and the key under which
the results hold it, in the order of the columns.  It is a table made before any
data is read, so the report's columns do not depend on the data: a key that the
results lack leaves its cell empty, and results without a cell are left out (and
listed by ``unused``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators.reshape import cell_text

NUMBER, TEXT = "number", "text"
#: (cell name, kind, key in the long report)
Cell = tuple[str, str, str]


def template_table(spark: SparkSession, cells: Sequence[Cell]) -> DataFrame:
    """pos, cell, kind, key."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "pos int, cell string, kind string, key string")


def report_from_template(long: DataFrame, cells: Sequence[Cell], digits: int = 0) -> DataFrame:
    """One row with a text column per cell of the template.

    A number is rounded half-even, a text is taken as it is; of several values of a
    key the largest counts.  The template is joined to the (key, num, str) cells and
    the values are gathered by position: as many as the template has cells.
    """
    if len({c[0] for c in cells}) < len(cells):
        raise ValueError("a cell is in the template twice")
    values = long.groupBy("key").agg(F.max("num").alias("num"), F.max("str").alias("str"))
    placed = template_table(long.sparkSession, cells).join(values, "key", "left")
    value = F.when(F.col("kind") == TEXT, F.col("str")).otherwise(cell_text(F.col("num"), F.lit(None).cast("string"), digits))
    row = placed.agg(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))).alias("a"))
    # one expression list handed over at once: per-column Column objects cost a round trip each
    quote = lambda c: "`" + c.replace("`", "``") + "`"
    return row.selectExpr(*[f"a[{i}].v AS {quote(c[0])}" for i, c in enumerate(cells)])


def unused(long: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """Keys of the results that the template does not show."""
    return long.select("key").distinct().join(template_table(long.sparkSession, cells), "key", "left_anti")
