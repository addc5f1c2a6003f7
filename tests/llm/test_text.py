"""Sharding, SentencePiece, fingerprints and license scan against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from corpus import EDGE_ROWS, docs_frame, edge_docs, no_docs, small, small_rows  # noqa: F401
from pyspark.sql import functions as F

from souk.llm import fingerprints, license_scan, pieces, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 101, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    got = sorted(r["p"] for r in spark.range(n).select(sharding.feistel(F.col("id"), n, 7, 4).alias("p")).collect())
    assert got == list(range(n))


def check_shards(rows, got, shards=24):
    size = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) if d is not None else
                  (-1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == size
    slots = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)]
    assert all(s == list(range(len(s))) for s in slots)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1


def test_shards(spark, small, small_rows, edge_docs, no_docs):
    first = sharding.shuffle_into_shards(small).collect()
    check_shards(small_rows, first)
    again = sharding.shuffle_into_shards(small.repartition(7), sharding.Params(bucket_rows=20_000)).collect()
    place = {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in first}
    assert place == {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in again}  # reproducible
    check_shards(small_rows, sharding.shuffle_into_shards(small, sharding.Params(bucket_rows=16)).collect())
    check_shards(EDGE_ROWS, sharding.shuffle_into_shards(edge_docs).collect())
    assert sharding.shuffle_into_shards(no_docs).count() == 0
    copies = docs_frame(spark, [(5, "same")] * 100 + [(6, "other")])
    check_shards([(5, "same")] * 100 + [(6, "other")], sharding.shuffle_into_shards(copies).collect())


TINY = pieces.Model({" a": (300, -1.0), "a": (301, -2.0), "b": (302, -2.0), "ab": (303, -2.5), "bab": (304, -3.0),
                     " ": (305, -4.0), "abab": (306, -9.0), " ab": (307, -2.0)}, tuple(range(256)),
                    tuple([bytes([i]) for i in range(256)] + [b""] * 44 + [b" a", b"a", b"b", b"ab", b"bab", b" ", b"abab", b" ab"]))


def best_score(model, text, unknown):
    """Score of the best segmentation by the plain dynamic programme over all substrings."""
    best = [0.0] + [-math.inf] * len(text)
    longest = max(map(len, model.pieces))
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + unknown
        for start in range(max(0, end - longest), end):
            if text[start:end] in model.pieces:
                best[end] = max(best[end], best[start] + model.pieces[text[start:end]][1])
    return best[-1]


def path_score(model, encoder, ids):
    by_id = {i: s for i, s in model.pieces.values()}
    data, total = b"", 0.0
    for i in ids:
        if i in by_id:
            total += by_id[i]
        else:
            data += model.surface[i]
    return total + encoder.unknown * len(data.decode("utf-8"))


def test_viterbi_is_optimal():
    encoder = pieces.Encoder(TINY)
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(rng.choice(list("ab c\nü"), rng.integers(1, 14)))
        ids = encoder.encode(text).tolist()
        assert pieces.decode_ids(TINY, ids) == text
        assert abs(path_score(TINY, encoder, ids) - best_score(TINY, " " + text, encoder.unknown)) < 1e-9


def test_real_model_is_optimal(small_rows):
    """Whole texts; and no more pieces than the model's own library makes of them."""
    import sentencepiece

    model, library = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(model)
    own = theirs = 0
    for _, text in sorted(small_rows, key=lambda r: len(r[1] or ""))[::8]:
        text = text or ""
        ids = encoder.encode(text).tolist()
        own, theirs = own + len(ids), theirs + len(library.encode(text))
        if text:
            assert abs(path_score(model, encoder, ids) - best_score(model, " " + text, encoder.unknown)) < 1e-6 * (len(text) + 1)
    assert own <= theirs


def test_encode_and_decode(small, small_rows, edge_docs, no_docs):
    model = pieces.load()
    for frame, rows in ((small, small_rows), (edge_docs, EDGE_ROWS)):
        got = pieces.encode(frame, model)
        out = got.collect()
        assert len(out) == len(rows) and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in out)
        back = sorted((str(r["doc_id"]), r["text"]) for r in pieces.decode(got, model).collect())
        assert back == sorted((str(d), t or "") for d, t in rows)
    assert pieces.encode(no_docs, model).count() == 0


def phrases(data: bytes) -> set[bytes]:
    """LZ78 phrases by their bytes."""
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_fingerprints_estimate_phrase_similarity(small_rows):
    signer = fingerprints.Signer(fingerprints.Params(places=1024))
    for (_, x), (_, y) in zip(small_rows[:8], small_rows[1:9], strict=True):
        y = x[:len(x) // 2] + y[:len(x) // 2]
        sides = []
        for t in (x, y):
            own = set()
            fingerprints.parse(t.encode(), 0, set(), own)
            assert len(own) == len(phrases(t.encode()))
            sides.append((signer.least(own), phrases(t.encode())))
        (a, pa), (b, pb) = sides
        assert abs(fingerprints.likeness(signer.signature(a), signer.signature(b)) - len(pa & pb) / max(1, len(pa | pb))) < 0.08


def brute_next(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    order = sorted(rows, key=key)
    out = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[:len(t) - k] + following[:k]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts(spark, small, small_rows):
    p = fingerprints.Params(range_rows=9)
    got = fingerprints.compare_with_next(small.repartition(3), p).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == brute_next(small_rows)
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(small).collect()}
    text = {d: t for d, t in small_rows}
    order = sorted(text, reverse=True)
    follow = dict(zip(order, order[1:] + order[:1], strict=True))
    signer = fingerprints.Signer(p)
    for r in got:
        assert r["fingerprint"] == plain[r["doc_id"]] and 0 <= r["near_edited"] <= 1
        edited = text[r["doc_id"]]
        k = len(edited) // 3
        edited = edited[:len(edited) - k] + text[follow[r["doc_id"]]][:k]
        own = set()
        fingerprints.parse(edited.encode(), 0, set(), own)
        assert signer.signature(signer.least(own)).hex() == r["edited_fingerprint"]


def test_edited_texts_edges(spark, edge_docs, no_docs):
    rows = [r for r in EDGE_ROWS if r[0] not in (12, None)] + [(None, None)]
    got = fingerprints.compare_with_next(docs_frame(spark, rows), fingerprints.Params(range_rows=3)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == brute_next(rows)
    assert fingerprints.compare_with_next(edge_docs).count() == len(EDGE_ROWS)
    assert fingerprints.compare_with_next(no_docs).count() == 0
    one = fingerprints.compare_with_next(docs_frame(spark, [(1, "abc")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_one_id_of_many_texts_is_split(spark):
    """Many texts of one id, and of rows without an id, are ranges of their own, in the order of the texts' hashes."""
    from xxhash import xxh64_intdigest

    rows = [(5, f"text {i} " * (i % 4 + 1)) for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(9, "nine"), (1, "one")]
    frame, p = docs_frame(spark, rows), fingerprints.Params(range_rows=20)
    sizes = fingerprints.ranged(frame, p).groupBy("cell").count().collect()
    assert len(sizes) >= 25 and max(r["count"] for r in sizes) <= 21
    signed = lambda t: (xxh64_intdigest(t, 42) ^ (1 << 63)) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = []
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        want.append((d, hashlib.sha256((t[:len(t) - k] + following[:k]).encode()).hexdigest()))
    got = fingerprints.compare_with_next(frame, p).collect()
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    places = lambda h: [h[i:i + 4] for i in range(0, len(h), 4)]
    for r in got:  # the likeness follows from the published strings
        a, b = places(r["fingerprint"]), places(r["edited_fingerprint"])
        assert r["near_edited"] == sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def brute_scan(rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = []
    for d, t in rows:
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for p in [phrase.split()]
              for i in range(len(w)) if w[i:i + len(p)] == p]
        out.append((d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=str)


NOTICE = license_scan.NOTICES["gpl-notice"].split()
LICENSED = [
    (1, "mit license MIT-License cc by, CC BY apache license. mit"), (2, "Apache  License apache-license"),
    (3, " ".join(NOTICE).title()), (4, "intro " + " ".join(NOTICE[:9] + ["really"] + NOTICE[9:])),
    (5, " ".join(NOTICE[::2])), (6, "the the the of the and the software the"), (7, "gnu general public"),
    (8, "GNU General Public License gnu general public license"), (9, " ".join(NOTICE[:12]) + " cut " + " ".join(NOTICE[13:])),
]


def test_license_scan(spark, small, small_rows, edge_docs, no_docs):
    for frame, rows in ((small, small_rows), (edge_docs, EDGE_ROWS), (docs_frame(spark, LICENSED), LICENSED)):
        got = license_scan.scan(frame).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                       for r in got), key=str) == brute_scan(rows)
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    labels = {r["doc_id"]: r["labels"].split(",") for r in got}
    for d in (3, 4, 9):
        assert "gpl-notice" in labels[d] and "gpl" in labels[d], d
    assert all("gpl-notice" not in labels[d] for d in (1, 2, 5, 6, 7, 8))
    assert license_scan.scan(no_docs).count() == 0


def test_license_letters_are_lowered_in_ascii_only(spark):
    """A Kelvin sign is no k: a notice with one in a word is judged like a notice with any other word there."""
    notice = license_scan.NOTICES["cc-by-4.0"]
    rows = [(i, notice.replace("work", w).upper() if i == 9 else notice.replace("work", w)) for i, w in ((1, "wor\u212a"), (2, "worq"), (9, "work"))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs_frame(spark, rows)).collect()}
    assert got[1] == got[2] != got[9] and got[9] == ("cc-by-4.0", 1.0)


def filled(text, rng, change):
    """The words of a text with some replaced, left out or added."""
    out = []
    for w in license_scan.words_in(text):
        x = rng.random()
        out += [] if x < change / 3 else ["other"] if x < 2 * change / 3 else [w, "more"] if x < change else [w]
    return " ".join(out)


def test_printed_licenses(spark):
    """Whole texts, longer than one mask, with a few words changed, in upper case, cut short or mixed up."""
    rng = random.Random(5)
    longest = max(len(license_scan.words_in(t)) for t in license_scan.TEXTS.values())
    assert longest > 2 * license_scan.MASK
    rows, want = [], {}
    for i, (label, text) in enumerate(license_scan.TEXTS.items()):
        words = license_scan.words_in(text)
        mixed = list(words)
        rng.shuffle(mixed)
        for k, (t, hit) in enumerate([(text, True), (text.upper(), True), ("intro words " * 9 + filled(text, rng, 0.04), True),
                                      (" ".join(words[: len(words) // 2]), False), (" ".join(mixed), False)]):
            rows.append((10 * i + k, t))
            want[10 * i + k] = (label, hit)
    for r in license_scan.scan(docs_frame(spark, rows)).collect():
        label, hit = want[r["doc_id"]]
        assert (label in r["labels"].split(",")) == hit, (r["doc_id"], label, r["labels"])
        if hit:
            span = max(x["coverage"] for x in r["spans"] if x["label"] == label)
            assert span >= 0.75 and r["score"] >= span and (r["doc_id"] % 10 > 1 or span == 1.0)


def brute_coverage(words, template, near=2):
    """Spans of a template by plain loops: hits by words, diagonals merged, the share of places covered."""
    hits = sorted((i - j, j) for i in range(len(words) - 1) for j in range(len(template) - 1) if words[i:i + 2] == template[j:j + 2])
    spans, last = [], None
    for d, j in hits:
        if last is None or d - last > near:
            spans.append(set())
        spans[-1].add(j)
        last = d
    return max((len(s) / (len(template) - 1) for s in spans), default=0.0)


def test_coverage_against_plain_loops(spark, small_rows):
    rng = random.Random(9)
    rows = [(i, filled(rng.choice(list(license_scan.TEXTS.values())), rng, 0.35)) for i in range(30)] + [(100 + d, t) for d, t in small_rows[:20]]
    got = {r["doc_id"]: {x["label"]: x["coverage"] for x in sorted(r["spans"], key=lambda x: x["coverage"])} for r in
           license_scan.scan(docs_frame(spark, rows), license_scan.Params(coverage=0.2)).collect()}
    for d, text in rows:
        words = license_scan.words_in(text)
        for _, label, base, template in license_scan.templates():
            if not base:
                cover = brute_coverage(words, template)
                assert got[d].get(label) == (pytest.approx(cover) if cover >= 0.2 else None), (d, label)
