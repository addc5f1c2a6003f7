"""A stored table of mergeable means that takes one round at a time (M1, M3).

A round leaves, per settlement and per market and for each measure, the sums and
counts that a mean is made of.  Rounds lie side by side; adding one reads only its
own prices, adding it again replaces it, and the five levels come from the sums of
all rounds, as exact as from all prices together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import names as N
from souk.operators import means as M
from souk.sources import export


class RoundStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _at(self, month: str) -> str:
        return f"{self.base}/round-{N.syntactic_name(month)}"

    def add(self, month: str, item_prices: DataFrame, measures: Sequence[str] | None = None) -> dict:
        """Stores a round's sums; only the rows of that month are read."""
        prices = item_prices.where(F.col("month") == month)
        sums = {"areas": M.cell_sums(prices, measures, M.AREA_KEYS), "markets": M.cell_sums(prices, measures, M.LEVELS["market"])}
        return export.publish(self.spark, self._at(month), sums)

    def rounds(self) -> list[str]:
        """The folders of the stored rounds."""
        return [n for n in export._names(self.spark, self.base) if n.startswith("round-")]

    def sums(self, table: str) -> DataFrame:
        """``areas`` or ``markets`` of all rounds (a round stored before there were two holds both in
        its ``cells``).  A measure that a round lacks has no values there."""
        stored = [export.read_export(self.spark, f"{self.base}/{n}") for n in self.rounds()
                  if export.current(self.spark, f"{self.base}/{n}")]
        parts = [tables[table if table in tables else "cells"] for tables in stored]
        if not parts:
            raise FileNotFoundError(f"no rounds under {self.base}")
        sums = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return sums.fillna(0, [c for c in sums.columns if c.startswith(("__n_", "__i_"))])

    def means(self) -> DataFrame:
        """All five levels over the stored rounds."""
        return M.levels_of_sums(self.sums("areas"), self.sums("markets"))
