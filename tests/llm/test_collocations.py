"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import pytest
from corpus import EDGE_ROWS, docs_frame, edge_docs, no_docs, small  # noqa: F401

from souk.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, p):
    """rows: (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, p.longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i:i + size])] += 1
    around = Counter()
    for (lang, words), a in counts.items():
        for size in range(2, len(words) if a >= p.least else 0):  # only candidates push others out
            for i in range(len(words) - size + 1):
                key = lang, words[i:i + size]
                around[key] = max(around[key], a)
    by = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < p.least or 100 * around[lang, words] >= p.inside * a:
            continue
        cuts = [(p.scale * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        by.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    out = []
    for lang, found in by.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:p.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in df.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    return sorted(map(tuple, df.collect()))


def made(seed, docs=120, words=40):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('aäbC')}{i}" for i in range(words)]
    fixed = [[rng.choice(vocabulary) for _ in range(n)] for n in (2, 3, 4, 5, 6)]
    rows = []
    for i in range(docs):
        out = []
        for _ in range(rng.randrange(1, 60)):
            out += rng.choice(fixed) if rng.random() < 0.2 else [vocabulary[int(rng.random() ** 2 * words)]]
            out.append(rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", " "]))
        rows.append((rng.choice(["en", "de", None]), " ".join(out)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, "x", "x", 1) for lang, text in rows],
                                 "lang string, text string, phrase string, code string, n long")


#: Whole dictionaries; none at all; only a few words; many words but few phrases; small tiles and buffers.
BOUNDS = [{}, {"known": 0}, {"known": 25}, {"known": 90}, {"tile": 4, "dense": 8, "held": 50, "texts": 20, "chunk": 500},
          {"known": 25, "held": 50, "texts": 20, "chunk": 300}]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_made_texts(spark, bounds):
    p = C.Params(least=4, top=60, **bounds)
    rows = made(1)
    assert got(C.collocations(frame(spark, rows), p)) == brute(rows, p)


def test_documents(spark, small):
    p = C.Params(least=5, top=300)
    rows = [tuple(r) for r in small.select("lang", "text").collect()]
    assert got(C.collocations(small, p)) == brute(rows, p)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got(C.query(spark, sf)) == brute(rows, C.Params())


def test_edges(spark, edge_docs, no_docs):
    p = C.Params(least=2)
    rows = [(None if t is None else ("en" if (d or 0) % 2 else "de"), t) for d, t in EDGE_ROWS]
    assert got(C.collocations(edge_docs, p)) == brute(rows, p)
    assert got(C.collocations(no_docs, p)) == []
    ties = [("en", "b a. a b. c d. d c. " * 3), ("en", "x\x1cy x\x1cy \x00 z \x00 z"), (None, "b a b a b"), ("und", "b a")]
    assert got(C.collocations(frame(spark, ties), p)) == brute(ties, p)
