"""Name-level helpers: select columns by name pattern, by type, bulk renames.

These work on ``df.columns`` / ``df.schema`` only (driver-side metadata),
never on data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


def match_names(
    columns: Sequence[str],
    contains: Iterable[str] = (),
    starts_with: Iterable[str] = (),
    ends_with: Iterable[str] = (),
    exclude_contains: Iterable[str] = (),
    exclude_starts_with: Iterable[str] = (),
    exclude_ends_with: Iterable[str] = (),
    exclude: Iterable[str] = (),
) -> list[str]:
    """Columns matching any include pattern and no exclude pattern, case-insensitive,
    in their original order."""
    low = lambda s: s.lower()
    inc_c, inc_s, inc_e = [list(map(low, p)) for p in (contains, starts_with, ends_with)]
    exc_c, exc_s, exc_e = [list(map(low, p)) for p in (exclude_contains, exclude_starts_with,
                                                      exclude_ends_with)]
    exc = {e.lower() for e in exclude}
    out = []
    for name in columns:
        n = name.lower()
        hit = (any(p in n for p in inc_c) or any(n.startswith(p) for p in inc_s)
               or any(n.endswith(p) for p in inc_e))
        miss = (n in exc or any(p in n for p in exc_c) or any(n.startswith(p) for p in exc_s)
                or any(n.endswith(p) for p in exc_e))
        if hit and not miss:
            out.append(name)
    return out


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in ex]


def keys_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c not in keys])


def add_prefix(df: DataFrame, prefix: str, skip: Iterable[str] = ()) -> DataFrame:
    sk = set(skip)
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in sk})


def rename_with(df: DataFrame, fn, skip: Iterable[str] = ()) -> DataFrame:
    sk = set(skip)
    return df.withColumnsRenamed({c: fn(c) for c in df.columns if c not in sk and fn(c) != c})


def lower_names(df: DataFrame) -> DataFrame:
    return rename_with(df, str.lower)


def syntactic_name(name: str) -> str:
    """Make a name safe for unquoted use: invalid characters and dots -> '_',
    a leading digit or underscore gets an 'X' prefix."""
    n = re.sub(r"[^0-9A-Za-z_]", "_", name)
    if not n or n[0].isdigit() or n[0] == "_":
        n = "X" + n
    return n


def syntactic_names(df: DataFrame) -> DataFrame:
    return df.toDF(*map(syntactic_name, df.columns))
