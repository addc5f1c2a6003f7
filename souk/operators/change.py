"""Percent change between rounds.

Rounds are paired by area key, never by row position.  All periods are
read in one grouped pass: per area, each period's value is a conditional
aggregate, so current and baseline values meet without a self-join and the
input is shuffled once.  An area needs the current round and the
``required`` baselines to appear (the inner-join rule); other baselines are
optional (left-join rule).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk import config
from souk.functions import exprs as X

BASELINES = {"last_round": config.ORDER_LAST, "march": config.ORDER_OTHER}


def change_name(measure: str, suffix: str, strip: str = "price_") -> str:
    return f"{measure.replace(strip, '')}_perct_{suffix}"


def period_change(df: DataFrame, keys: Sequence[str], measures: Sequence[str],
                  baselines: Mapping[str, int] = BASELINES,
                  required: Sequence[str] | None = None,
                  current: int = config.ORDER_THIS, order_col: str = "collection_order",
                  strip: str = "price_", within: Sequence[str] = ()) -> DataFrame:
    """(current - baseline) / baseline * 100 for each measure and baseline.

    Output: keys + ``<measure without strip>_perct_<baseline name>``.
    ``within``: further columns that tell areas of the same name apart (a
    settlement's district and region); they are not part of the output.
    """
    extra = [w for w in within if w not in keys]
    required = list(baselines) if required is None else list(required)
    o = F.col(order_col)

    def at(period: int, m: str) -> Column:
        return F.max(F.when(o == period, F.col(m)))

    aggs = [F.count(F.when(o == current, 1)).alias("__has_cur")]
    aggs += [F.count(F.when(o == p, 1)).alias(f"__has_{name}") for name, p in baselines.items()]
    for name, p in baselines.items():
        for m in measures:
            aggs.append(X.pct_change(at(current, m), at(p, m)).alias(change_name(m, name, strip)))
    g = df.where(o.isin(current, *baselines.values())).groupBy(*keys, *extra).agg(*aggs)
    cond = reduce(lambda a, b: a & b, [F.col("__has_cur") > 0] +
                  [F.col(f"__has_{n}") > 0 for n in required])
    return g.where(cond).drop(*extra, "__has_cur", *[f"__has_{n}" for n in baselines])


def keep_present(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep rows whose key occurs in ``reference`` (J4, left semi-join)."""
    return df.join(reference.select(*keys), list(keys), "left_semi")


def merge_changes(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Fold of left joins on the area key only (J6); a NULL area meets a NULL area."""
    def left(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return a.join(b, same, "left").drop(*[f"__{k}" for k in keys])

    return reduce(left, tables)


#: A settlement's name is told apart by its district and region.
AREA_WITHIN = ("regions", "district")


def _within(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in AREA_WITHIN if "settlement" in keys and c in df.columns]


def item_change(area_means: DataFrame, keys: Sequence[str]) -> DataFrame:
    ms = [c for c in area_means.columns if c.startswith("price_")]
    return period_change(area_means, keys, ms, within=_within(area_means, keys))


def meb_change(meb_df: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Change of the food and full basket totals; the march baseline is optional."""
    ms = [f"{prefix}meb_food", f"{prefix}meb_full"]
    return period_change(meb_df, keys, ms, required=["last_round"], within=_within(meb_df, keys))


def with_lower_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.lower(F.col(key)))
