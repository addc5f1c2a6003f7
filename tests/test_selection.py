"""Exact selection, hierarchical filling by carried sums and ranking by ranges, against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from souk.operators import basket as B
from souk.operators import impute as I
from souk.operators import selection as S
from test_plans import physical

INF, NAN = math.inf, math.nan


def brute_median(values):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    if not v:
        return None
    return 0.5 * v[(len(v) - 1) // 2] + 0.5 * v[len(v) // 2]


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def spread(kind, n, rng):
    if kind == "exponents":
        return [rng.choice([-1, 1]) * 2.0 ** rng.randint(-1074, 1023) for _ in range(n)]
    if kind == "neighbours":  # doubles that differ in the last bits only
        x, out = 1.0 + rng.random(), []
        for _ in range(n):
            x = math.nextafter(x, 2.0)
            out.append(x)
        return out
    if kind == "towards_an_end":
        return [1.0 + 2.0 ** -rng.randint(1, 52) for _ in range(n)]
    if kind == "ties":
        return [float(rng.randint(1, 3)) for _ in range(n)]
    if kind == "odd":
        return [rng.choice([INF, -INF, NAN, None, 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 1.0]) for _ in range(n)]
    return [round(rng.uniform(900, 105000), 2) for _ in range(n)]


@pytest.mark.parametrize("kind", ["prices", "exponents", "neighbours", "towards_an_end", "ties", "odd"])
def test_medians_of_any_distribution(spark, kind):
    rng = random.Random(kind)
    rows = []
    for g, n in enumerate([1, 2, 3, 4, 5, 50, 51, 400, 1001, 0]):
        a, b = spread(kind, n, rng), spread(kind, n, rng)
        rng.shuffle(a)
        rows += [(f"g{g}" if g != 4 else None, g % 2, x, y) for x, y in zip(a, b)]
    rows.append(("empty", 0, None, NAN))
    df = spark.createDataFrame(rows, "k string, h int, x double, y double").repartition(7)
    got = {(r.k, r.h): (r.x, r.y) for r in S.exact_medians(df, ["k", "h"], ["x", "y"]).collect()}
    want = {}
    for k, h, x, y in rows:
        want.setdefault((k, h), ([], []))
        want[k, h][0].append(x)
        want[k, h][1].append(y)
    assert got.keys() == want.keys()
    for key, (xs, ys) in want.items():
        assert same(got[key][0], brute_median(xs)) and same(got[key][1], brute_median(ys)), key


def test_medians_of_no_rows(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert S.exact_medians(df, ["k"], ["x"]).collect() == []


def test_median_shuffles_counts_not_values(spark, tmp_path):
    """A group of many distinct values leaves at most BUCKETS rows a task in every shuffle."""
    df = spark.range(200_000, numPartitions=4).select(F.lit("hot").alias("k"), (F.rand(1) * 1e6).alias("x"))
    state = spark.createDataFrame([(0, 0, 100_000, True, 0.0, 1e6)], "__g long, m int, t long, even boolean, lo double, hi double")
    values = df.select(F.lit(0).cast("long").alias("__g"), F.lit(0).alias("m"), F.col("x").alias("v")).join(state, ["__g", "m"])
    far = S._is_far(F.col("lo"), F.col("hi"))
    counts = values.groupBy("__g", "m", S._bucket(F.col("v"), F.col("lo"), F.col("hi"), far, S.BUCKETS).alias("b")).count()
    assert counts.count() <= S.BUCKETS
    exact = sorted(r.x for r in df.collect())
    assert S.exact_medians(df, ["k"], ["x"]).first().x == statistics.median(exact)


def test_medians_read_the_rows_three_times(spark, monkeypatch):
    """However many passes the values need: once for the ends, once for the first buckets, once for what is left."""
    rng = random.Random(11)
    rows = [(g, x) for g in ("a", "b") for x in spread("exponents", 3000, rng)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    reads, passes, values, write = [], [], S._values, S.materialize
    monkeypatch.setattr(S, "_values", lambda *a: reads.append(1) or values(*a))
    monkeypatch.setattr(S, "materialize", lambda d, name, *a: passes.append(name) or write(d, name, *a))
    got = {r.k: r.x for r in S.exact_medians(df, ["k"], ["x"]).collect()}
    assert got == {g: brute_median([x for k, x in rows if k == g]) for g in ("a", "b")}
    assert passes.count("median_pass") > 2 and len(reads) == 2


def brute_fill(rows, levels, n):
    """Rows as dicts with keys and the list ``v``: each level's mean over all its rows, NULLs filled in turn."""
    rows = [dict(r, v=list(r["v"])) for r in rows]
    for keys in levels:
        for i in range(n):
            groups = {}
            for r in rows:
                groups.setdefault(tuple(r[k] for k in keys), []).append(r)
            for group in groups.values():
                have = [r["v"][i] for r in group if r["v"][i] is not None and not math.isnan(r["v"][i])]
                mean = sum(have) / len(have) if have else None
                for r in group:
                    if r["v"][i] is None:
                        r["v"][i] = mean
    return rows


def test_filling_equals_the_row_by_row_rule(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        rows.append({"settlement": rng.choice([None, *(f"s{j}" for j in range(60))]), "district": rng.choice([None, "d1", "d2", "d3", "d4"]),
                     "regions": rng.choice(["r1", "r2", None]), "month": rng.choice(["Oct", "Sep"]), "id": i,
                     "v": [rng.choice([None, None, None, NAN, float(rng.randint(1, 50))]), None if i % 97 else 3.0,
                           rng.choice([None, INF, 2.0]) if i % 5 == 0 else None]})
    df = spark.createDataFrame([(r["id"], r["settlement"], r["district"], r["regions"], r["month"], *r["v"]) for r in rows],
                               "id int, settlement string, district string, regions string, month string, price_a double, "
                               "price_b double, price_c double")
    got = {r.id: (r.price_a, r.price_b, r.price_c) for r in I.impute_hierarchical(df).collect()}
    for r in brute_fill(rows, I.FILL_LEVELS, 3):
        for a, b in zip(got[r["id"]], r["v"]):
            assert same(a, b) or a == pytest.approx(b, rel=1e-12), (r, got[r["id"]])


def test_filling_has_no_window(spark):
    df = spark.createDataFrame([("s", "d", "r", "Oct", None)], "settlement string, district string, regions string, month string, price_x double")
    filled = I.impute_hierarchical(df)
    assert "Window" not in physical(filled)
    assert filled.first().price_x is None


def test_rank_all(spark):
    rng = random.Random(3)
    rows = [(f"s{i:04d}" if i % 50 else None, rng.choice([None, 1.0, 2.5, float(rng.randint(1, 400))]), "Oct") for i in range(1000)]
    df = spark.createDataFrame([*rows, ("other", 1.0, "Sep")], "settlement string, meb_full double, month string").repartition(6)
    ranks = B.rank_all(df, "Oct")
    assert "SinglePartition" not in physical(ranks) or "Window" not in physical(ranks)
    got = sorted((r.rank, r.meb_full, r.settlement) for r in ranks.collect())
    want = sorted(((v, s) for s, v, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, x[1] or ""))
    assert [(v, s) for _, v, s in got] == want and [r for r, *_ in got] == list(range(1, 1001))
    ends = {(r.rank, r.settlement) for r in B.rank_areas(df, "Oct", 3).collect()}
    assert ends <= {(r, s) for r, _, s in got}
    assert B.rank_all(df, "May").count() == 0
