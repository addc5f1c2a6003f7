"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import EDGE_ROWS, docs_frame, edge_docs, no_docs, small, small_rows  # noqa: F401

from souk.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return b[i + 1:] == a[i:]


def brute_variants(counts):
    near = {w: [] for w in counts}
    by_rest = {}
    for w in counts:  # words one edit apart share a word with one code point less, or one is that word
        for r in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_rest.setdefault(r, []).append(w)
    for group in by_rest.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    form = {}
    for w, others in near.items():
        near[w] = set(others)
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def brute_variants_by_pairs(counts):
    out = []
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        out.append((w, form, form or w, n, len(near), counts[form] if form else None))  # no chains in the cases that use it
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


def words_frame(spark, counts):
    return spark.createDataFrame([(w, n, "x", "x") for w, n in counts.items()], "word string, n long, s string, head string").select("word", "n")


def random_words(seed, number, letters, longest):
    rng = random.Random(seed)
    out = {}
    while len(out) < number:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(7, longest)))
        for _ in range(rng.randrange(3)):  # a few neighbours
            out[w] = int(10 ** rng.uniform(0.4, 4))
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(["", rng.choice(letters), w[at] + rng.choice(letters)]) + w[at + 1:]
            if len(w) < 7:
                break
    return out


@pytest.mark.parametrize("letters,longest,block", [("ab", 11, 200_000), ("ab", 11, 300), ("abcé\U0001f600", 9, 120), ("abcdefgh", 20, 50)])
def test_random_words(spark, letters, longest, block):
    counts = random_words(1, 900, letters, longest)
    assert got(S.variants(words_frame(spark, counts), S.Params(block=block))) == brute_variants(counts)


def test_one_hot_prefix(spark):
    """All words share their first half: the list is cut again, the result stays whole."""
    rng = random.Random(2)
    counts = {"prefixes" + "".join(rng.choice("abc") for _ in range(8)): 2 + i % 50 for i in range(1500)}
    assert got(S.variants(words_frame(spark, counts), S.Params(block=1000))) == brute_variants(counts)


def test_very_long_words(spark):
    base = "".join(random.Random(8).choice("abcde") for _ in range(30_000))
    counts = {base: 500, base[:15_000] + base[15_001:]: 7, base + "a": 3, "b" + base[1:] + "c": 2, "shortword": 9, "shortwort": 2}
    assert got(S.variants(words_frame(spark, counts))) == brute_variants_by_pairs(counts)


def test_chain_of_forms(spark):
    counts = {"aaaaaaaa" + "b" * i: 10 ** (9 - i) * 3 for i in range(9)}
    want = brute_variants(counts)
    assert {r[2] for r in want} == {"aaaaaaaa"}
    assert got(S.variants(words_frame(spark, counts))) == want


def test_scan_finds_what_brute_force_finds():
    rng = random.Random(4)
    lists = [sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))) for _ in range(n)}) for n in (150, 1, 40, 2)]
    lists.append(sorted({"same" + "".join(rng.choice("abc\U0001f600") for _ in range(rng.randrange(0, 5))) for _ in range(80)}))
    words = [w for own in lists for w in own]
    marks = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
    depth = np.where(marks == 4, 4, 0)
    entries = S.SortedLists(words, marks)
    got = set(zip(*(x.tolist() for x in entries.one_edit(np.arange(len(words)), depth))))
    want = {(i, j) for i, q in enumerate(words) for j, w in enumerate(words) if marks[i] == marks[j] and one_edit(q, w)}
    assert got == want
    a, b = np.array(sorted(want)).T
    for back in (False, True):
        ends = entries.common_ends(a, b, np.full(len(a), back))
        for i, j, k in zip(a, b, ends):
            x, y = (words[i][::-1], words[j][::-1]) if back else (words[i], words[j])
            assert x[:k] == y[:k] and x[k:k + 1] != y[k:k + 1] or (k == min(len(x), len(y)) and x[:k] == y[:k])


def test_documents(spark, small, small_rows):
    counts = brute_words(small_rows)
    assert dict(map(tuple, S.vocabulary(small).collect())) == counts
    assert got(S.query(spark, "/root/testdata/sf0.001")) == brute_variants(counts)


def test_edges(spark, edge_docs, no_docs):
    assert dict(map(tuple, S.vocabulary(edge_docs).collect())) == brute_words(EDGE_ROWS)
    assert got(S.variants(S.vocabulary(edge_docs))) == brute_variants(brute_words(EDGE_ROWS))
    assert got(S.variants(S.vocabulary(no_docs))) == []
    odd = [(None, "Wörterbuch WÖRTERBUCH wörterbuch x÷yzabcde×f x÷yzabcde×f"), (3, "İstanbulK Kelvinnnn " * 3), (3, "İstanbulK Kelvinnnn " * 3)]
    assert dict(map(tuple, S.vocabulary(docs_frame(spark, odd)).collect())) == brute_words(odd)
