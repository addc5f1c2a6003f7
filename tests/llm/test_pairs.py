"""Near-duplicates, decontamination and components against brute force."""

import random

import numpy as np
import pytest
from corpus import BASE, EDGE_ROWS, SF, docs_frame, edge_docs, no_docs, small, small_rows  # noqa: F401

from souk.llm import common, decontaminate, near_dedup
from souk.llm.components import components


def sets_of(rows, width=5):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute_components(rows, percent=85):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= percent * len(sets[i] | sets[j])
            if linked or rows[i][0] == rows[j][0]:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)]


def edited_copies(n, seed, edits):
    """Copies of a text with up to ``edits`` words changed: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
        rows.append((i + 100, " ".join(w)))
    return rows


def collected(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_near_duplicates_on_documents(small, small_rows):
    assert collected(near_dedup.near_duplicates(small)) == sorted(brute_components(small_rows), key=str)


@pytest.mark.parametrize("block", [512, 7])
def test_group_of_near_copies(spark, block):
    rows = edited_copies(150, 1, 6) + edited_copies(60, 2, 3)[:50]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = near_dedup.near_duplicates(docs_frame(spark, rows), near_dedup.Params(block=block))
    assert collected(got) == sorted(brute_components(rows), key=str)


def test_near_duplicates_edges(edge_docs, no_docs):
    # rows that share an id share a component, so the brute force joins them, too
    got = near_dedup.near_duplicates(edge_docs)
    want = brute_components(EDGE_ROWS)
    rows = collected(got)
    assert [(r[0], r[1]) for r in rows] == [(r[0], r[1]) for r in sorted(want, key=str)]
    by_id = {r[0]: r[2] for r in rows if r[0] in (1, 2, 3, 7, 4, 5, 6)}
    assert by_id == {1: 1, 2: 1, 3: 1, 7: 7, 4: 4, 5: 5, 6: 6}
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_keep_one(edge_docs):
    kept = near_dedup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and 2 not in ids and 3 not in ids and ids.count(1) == 1


def test_odd_sketch_bound_is_safe():
    """Level 0 never refuses a pair at the threshold."""
    p = near_dedup.Params()
    sign = near_dedup.signer(p)
    rng = np.random.default_rng(0)
    for n in (8, 60, 500):
        for _ in range(20):
            shared = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            extra = int(n * 15 / 85)
            a = np.unique(np.concatenate([shared, rng.integers(0, 1 << 62, extra // 2, dtype=np.uint64)]))
            b = np.unique(np.concatenate([shared, rng.integers(0, 1 << 62, extra - extra // 2, dtype=np.uint64)]))
            assert 100 * n >= 85 * len(np.union1d(a, b))
            (_, la, oa, _), (_, lb, ob, _) = sign(a), sign(b)
            if la == lb == 0:
                ones = sum((x ^ y).bit_count() for x, y in zip(oa, ob, strict=True))
                assert ones <= near_dedup.most_ones(len(a), len(b), 0, 85)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(200, 201 + i) for i in range(50)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in range(len(least)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


def item_words(text):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def shingles(words, n):
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute_items(docs, items):
    out = set()
    for d, t in docs:
        w = item_words(t)
        for i, x in items:
            q = item_words(x)
            if not q:
                continue
            n = min(5, len(q))
            own = shingles(q, n)
            share = len(own & shingles(w, n)) / len(own)
            if share >= 0.8:
                out.add((d, i, round(share, 9)))
    return out


def test_decontamination(spark, small, small_rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {(r["doc_id"], r["item_id"], round(r["containment"], 9)) for r in decontaminate.find_items(small, bench).collect()}
    assert got == brute_items(small_rows, items) and got


def test_decontamination_edges(spark, edge_docs, no_docs):
    long_item = " ".join(f"w{i}" for i in range(100, 900))
    items = [(1, "brown fox jumps over the lazy dog near"), (2, None), (3, ""), (4, "one"), (5, long_item), (6, "!!"),
             (1, "brown fox jumps over the lazy dog near"), (7, BASE + " extra words that no document has at all here"),
             (None, "old river bank while birds sing")]
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item", "'x' as shingle")
    got = {(r["doc_id"], r["item_id"], round(r["containment"], 9)) for r in decontaminate.find_items(edge_docs, frame).collect()}
    assert got == brute_items(EDGE_ROWS, items)
    clean = decontaminate.drop_contaminated(edge_docs, frame)
    assert clean.columns == edge_docs.columns
    bad = {d for d, _, _ in got}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(
        str(d) for d, t in EDGE_ROWS if d not in bad or (d is None and t is None) or (d == 12 and t[0] == "o"))
    assert decontaminate.find_items(no_docs, frame).count() == 0
    assert decontaminate.find_items(edge_docs, frame.limit(0)).count() == 0


def test_decontamination_beyond_the_broadcast_bound(spark, small, small_rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    few = decontaminate.find_items(small, bench, decontaminate.Params(broadcast_rows=0))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert {(r["doc_id"], r["item_id"]) for r in few.collect()} == {x[:2] for x in brute_items(small_rows, items)}


def test_needed_hits():
    assert decontaminate.needed_hits(24, 0.8, 1e-6) >= 5
    assert decontaminate.needed_hits(1, 0.8, 1e-6) == 1


def test_rows_leave_the_workers_in_small_batches(spark):
    """A batch that goes back to the JVM is held whole outside its heap."""
    import pyarrow as pa

    seen = []

    class Frame:
        schema = None

        def mapInArrow(self, run, _):  # noqa: N802 - Spark's name
            batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": ["x" if i % 5 else None for i in range(2500)]})
            seen.extend(run(iter([batch, batch.slice(0, 0)])))

    common.keep_rows(Frame(), lambda: lambda text: text is not None)
    assert [b.num_rows for b in seen] == [1000, 1000]
    assert [i for b in seen for i in b.column("doc_id").to_pylist()] == [i for i in range(2500) if i % 5]
