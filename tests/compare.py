"""Spark result vs DuckDB oracle: row count, column names, order-insensitive
value hash (the same checks the correctness gate applies)."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "\x00"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def table_hash(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> dict:
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out = {"rows": (len(s_rows), len(d_rows)),
           "cols_match": sorted(s_cols) == sorted(d_cols),
           "hash_match": table_hash(s_cols, s_rows) == table_hash(d_cols, d_rows)}
    if not out["cols_match"]:
        out["cols_diff"] = (sorted(set(s_cols) - set(d_cols))[:10], sorted(set(d_cols) - set(s_cols))[:10])
    out["ok"] = out["rows"][0] == out["rows"][1] and out["cols_match"] and out["hash_match"]
    if out["cols_match"] and not out["hash_match"]:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ls = sorted("|".join(_norm(r[i]) for i in order_s) for r in s_rows)
        ld = sorted("|".join(_norm(r[i]) for i in order_d) for r in d_rows)
        diff_s = sorted(set(ls) - set(ld))[:3]
        diff_d = sorted(set(ld) - set(ls))[:3]
        out["sample"] = (sorted(s_cols), diff_s, diff_d)
    return out
