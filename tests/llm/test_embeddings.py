"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from souk.llm import embedding_dedup as E

SF = "/root/testdata/sf0.01"


def frame(spark, rows, kind=T.FloatType()):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind)),
                           *[T.StructField(c, T.StringType()) for c in ("label", "node", "cell", "cluster", "weight", "root", "n")]])
    return spark.createDataFrame([(i, v, *["x"] * 7) for i, v in rows], schema)


def brute(rows, kind=np.float32, least=0.9):
    n = len(rows)
    units = []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], kind).astype(float) if i is not None and v else np.array([])
        good = len(x) and np.isfinite(x).all() and x.any()
        units.append(x / abs(x).max() / np.linalg.norm(x / abs(x).max()) if good else None)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_id = None if vec_id is None else min(rows[j][0] for j in seen)
        out.append((vec_id, len(near[i]), least_id, vec_id is None or vec_id == least_id))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=str)


def groups(seed, sizes, noise, dim=16, others=200):
    """Groups of noisy copies, some with cosines around the threshold, and unrelated vectors."""
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.standard_normal(dim)
        out += [centre + noise * rng.standard_normal(dim) for _ in range(size)]
        out += [out[-1]] * 3
    out += list(rng.standard_normal((others, dim)))
    order = rng.permutation(len(out))
    return [(int(k), [float(c) for c in np.float32(out[j])]) for k, j in enumerate(order)]


@pytest.mark.parametrize("noise,block", [(0.05, 2048), (0.35, 2048), (0.05, 32), (0.3, 32)])
def test_groups(spark, noise, block):
    rows = groups(3, (60, 20, 5, 2), noise)
    # the bounds of misses are chosen so low that none of these pairs is lost
    p = E.Params(block=block, per_cell=32, miss=1e-7)
    assert got(E.near_vectors(frame(spark, rows), p)) == brute(rows)


def test_edges(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(5, v), (4, [2 * c for c in v]), (3, [-c for c in v]), (6, None), (7, []), (8, [0.0] * 4), (9, [1.0, None, 3.0, 4.0]),
            (10, [1.0, float("nan"), 3.0, 4.0]), (11, [float("inf"), 0.0, 0.0, 0.0]), (12, v[:3]), (12, v), (None, v), (None, None),
            (13, [1e30, 2e30, 3e30, 4e30]), (14, [1e-40, 2e-40, 3e-40, 4e-40]), (15, [5.0]), (16, [7.0]), (17, [-7.0]), (5, v)]
    assert got(E.near_vectors(frame(spark, rows))) == brute(rows)
    assert got(E.near_vectors(frame(spark, rows[:0]))) == []
    double = [(1, [1e300, 1e300]), (2, [1.0, 1.0000000001]), (3, [1.0, -1.0])]
    assert got(E.near_vectors(frame(spark, double, T.DoubleType()))) == brute(double, np.float64)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(E.query(spark, SF)) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at exactly the threshold's angle: at least 99 % are found, pairs a little below never."""
    rng = np.random.default_rng(5)
    x, y = (E.directions(rng.standard_normal((1500, 64))) for _ in range(2))
    y = E.directions(y - (x * y).sum(axis=1, keepdims=True) * x)
    sides = [0.9001, 0.8999]
    for cos in sides:
        z = cos * x + np.sqrt(1 - cos ** 2) * y
        rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate([x, z]))]
        links = {r[0]: r[1] for r in got(E.near_vectors(frame(spark, rows, T.DoubleType())))}
        found = sum(links[i] == 1 for i in range(1500))
        assert found >= 1485 if cos > 0.9 else found == 0


def test_layout():
    for rows in (10, 10_000, 10 ** 6, 10 ** 9):
        signs, tables = E.layout(rows, E.Params())
        assert rows / 2 ** signs <= 1024 and (1 - 0.8564 ** signs) ** tables < 0.0021
