"""Language ID, toxicity, quality, the language model and the pipeline."""

import collections
import math
import random
import zlib

import numpy as np
from corpus import EDGE_ROWS, SF, SF_LABELLED, docs_frame, edge_docs, no_docs, small, small_rows  # noqa: F401
from test_pairs import brute_components, brute_items, edited_copies
from pyspark.sql import functions as F

import corpus_pipeline
from souk.llm import language_id, language_model, pieces, quality, toxicity


def crc(d):
    return zlib.crc32(str(d).encode())


def area(good, bad):
    """Chance that a row of ``good`` scores above one of ``bad``."""
    bad = np.sort(bad)
    return float(np.mean([(np.searchsorted(bad, x) + np.searchsorted(bad, x, "right")) / 2 / len(bad) for x in good]))


def one_per_row(frame, rows):
    got = frame.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    return got


def test_language_held_out(spark):
    got = language_id.query(spark, SF_LABELLED).join(
        spark.read.parquet(f"{SF_LABELLED}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in got)
    own = [r["lang"] == r["lang_pred"] for r in got if r["held_out"] and r["lang"]]
    assert np.mean(own) > 0.95 and np.mean([r["rejected"] for r in got]) < 0.03


def test_language_against_plain_compression(spark):
    """The query's rows from a dictionary of the first texts by hash and one compressed size per block and language."""
    import zstandard as zstd
    from xxhash import xxh64_intdigest

    p = language_id.Params()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    signed = lambda t: (xxh64_intdigest(t, 42) ^ (1 << 63)) - (1 << 63)
    books = {}
    for lang in sorted({r["lang"] for r in rows} - {None}):
        own = {r["text"] for r in rows if r["lang"] == lang and r["text"] is not None and crc(r["doc_id"]) % 4 != 2}
        sample, size = [], 0
        for t in sorted((t for t in own if len(t) <= p.longest), key=signed)[:p.sample_docs]:
            size += len(t)
            if size <= p.sample_chars:
                sample.append(t)
        books[lang] = " ".join(sample).lower().encode()
    want = {}
    for r in rows:
        text = (r["text"] or "").lower()
        if not any(c.isalpha() for c in text):
            want[r["doc_id"]] = ("und", 0.0)
            continue
        data, sizes = text.encode(), []
        for lang, book in books.items():
            d = zstd.ZstdCompressionDict(book, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=p.level)
            one = zstd.ZstdCompressor(level=p.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(one.compress(data[i:i + p.block_bytes])) for i in range(0, len(data), p.block_bytes)), lang))
        (best, lang), (second, _) = sorted(sizes)[:2]
        want[r["doc_id"]] = (lang, (second - best) / second)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.query(spark, SF).collect()} == want


def test_language_edges(small, edge_docs, no_docs):
    known = language_id.fit(small)
    got = one_per_row(language_id.identify(edge_docs, known), EDGE_ROWS)
    for r in got:
        if r["doc_id"] in (4, 5, 6, 8):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert language_id.identify(no_docs, known).count() == 0
    nothing = language_id.fit(no_docs)
    assert nothing == {} and {r["lang_pred"] for r in language_id.identify(edge_docs, nothing).collect()} == {"und"}
    kept = language_id.drop_rejected(edge_docs, known)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if not r["rejected"])


def test_language_of_many_copies_keeps_its_sample(spark):
    """A language whose rows are nearly all copies of one text still gives all its texts to the sample."""
    copies = spark.range(100_000).select(F.lit("copied text again").alias("text"), F.lit("xx").alias("lang"))
    others = spark.createDataFrame([(f"own text {i} of few", "xx") for i in range(40)], "text string, lang string")
    got = language_id.fit(copies.unionByName(others))["xx"].decode()
    assert "copied text again" in got and all(f"own text {i} of few" in got for i in range(40))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    p = toxicity.Params(states=200)  # also forgets its states on the way
    terms = ["scum", "idiot", "moron", "loser", "worthless", "worthily", "pathetic", "disgusting", "idiots"]
    lexicon = toxicity.FuzzyLexicon({t: 1.0 + i for i, t in enumerate(terms)}, p)
    rng = random.Random(0)
    words = list(terms)
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randrange(2)] = rng.choice(["", "x", "i", "s", "o"])
        words.append("".join(w))
    for w in words:
        near = [(distance(w, t), -lexicon.weights[t], t) for t in terms
                if distance(w, t) <= (len(t) >= p.one_off) + (len(t) >= p.two_off)]
        got = lexicon.find(w)
        assert (got and (got[0], lexicon.terms[got[1]])) == (min(near)[::2] if near else None), w


def test_quotation_counts_less():
    scorer = toxicity.Scorer({"idiot": 4.0}, toxicity.Params())
    abuse, quote, report = (scorer.features(t)[0][0] for t in (
        "you are an idiot today", 'the play has "what an idiot" in it', "a novel wrote idiot on its cover"))
    assert abuse > 4.0 > quote and quote == report == 1.0
    assert scorer.features("an idoit or idiiot")[1] == 1 and scorer.features(None)[1] == 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF_LABELLED}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.where("lang = 'en'").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{SF_LABELLED}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_frame(spark, rows), model).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(got[d], marks[d]) for d in got if d in marks and crc(d) % 5 == 0]
    assert area([s for s, t in held if t], [s for s, t in held if not t]) > 0.95


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 1), (7, 0, 1), (99, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    for use in (labels, labels.limit(0)):
        for module in (toxicity, quality):
            model = module.fit(edge_docs, use)
            one_per_row(module.score(edge_docs, model), EDGE_ROWS)
            assert module.score(no_docs, model).count() == 0
    kept = toxicity.drop_toxic(edge_docs, toxicity.fit(edge_docs, labels.limit(0)))
    assert kept.columns == edge_docs.columns and kept.count() == len(EDGE_ROWS)


def test_quality_held_out(spark):
    got = quality.query(spark, SF_LABELLED).join(spark.read.parquet(f"{SF_LABELLED}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert area([r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]) > 0.9


def test_chunks_cover_every_byte():
    p = quality.Params()
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        chunks = quality.chunks_of(data, p)
        step = p.chunk - p.overlap
        back = np.concatenate([c[:step] for c in chunks[:-1]] + [chunks[-1]]).tobytes()
        assert back[:n] == data and not any(back[n:])


def test_pooling_matches_a_plain_convolution():
    p = quality.Params(chunk=40, overlap=8, filters=5, embedding=3, width=4)
    net = quality.Network.start(p)
    chunks = quality.chunks_of(b"some bytes of text that fill several chunks, all told " * 3, p)
    kernel = net.kernel.reshape(p.width, p.embedding, p.filters)
    for chunk, z in zip(chunks, net.chunk_scores(chunks, p), strict=True):
        best = np.full(p.filters, -np.inf)
        for at in range(0, p.chunk - p.width + 1, p.stride):
            best = np.maximum(best, sum(net.embedding[chunk[at + k]] @ kernel[k] for k in range(p.width)))
        assert abs(np.maximum(best + net.bias, 0) @ net.out + net.out_bias[0] - z) < 1e-4


SMALL_MODEL = language_model.Params(classes=4, class_words=8, class_rows=64, word_rows=64, rounds=2, batch=256, head_words=200)


def brute_base(rows, train):
    counts = collections.Counter(w for _, t in train for w in language_model.tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        words = language_model.tokens(t)
        out.append((str(d), len(words), sum(counts[w] > 0 for w in words), n,
                    round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 5)))
    return sorted(out)


def test_language_model_base_and_gain(spark, small, small_rows):
    train = small.where(F.col("doc_id") % 5 != 0)
    got = language_model.score(small, train, SMALL_MODEL).collect()
    mine = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    assert mine == brute_base(small_rows, [r for r in small_rows if r[0] % 5])
    held = [r for r in got if r["doc_id"] % 5 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_edges(edge_docs, no_docs):
    got = language_model.score(edge_docs, edge_docs, SMALL_MODEL).collect()
    mine = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    assert mine == brute_base(EDGE_ROWS, EDGE_ROWS)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    bare = language_model.score(edge_docs, no_docs, SMALL_MODEL).collect()
    assert {r["train_tokens"] for r in bare} == {0} and {r["base_score"] for r in bare} == {0.0} and len(bare) == len(EDGE_ROWS)
    assert language_model.score(no_docs, edge_docs, SMALL_MODEL).count() == 0


def test_model_probabilities_sum_to_one(spark, small):
    p = SMALL_MODEL
    counts = language_model.count_words(small)
    v = language_model.vocabulary(counts, p)
    w = language_model.train_weights(small, v, p)
    reader = language_model.Reader(v, p)
    _, codes = reader.read(language_model.tokens("and the of zzzunknown in the"))
    f = language_model.features([codes])
    total = np.zeros(len(f))
    for s in range(p.symbols):
        total += np.exp(language_model.log_probability(w, f, np.full(len(f), s), p))
    assert np.allclose(total, 1, atol=1e-4)
    # TAIL's share: known tail words by count, and one unknown word
    tail = [r["c"] for r in counts.orderBy(F.desc("c"), "word").collect()][p.symbols - 1:]
    unseen = v.tail_share_unseen()
    assert sum(tail) == v.tail_total and abs(sum(c / v.tail_total for c in tail) * (1 - unseen) + unseen - 1) < 1e-9


def test_pipeline_against_its_parts(spark, small):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language" and len(corpus_pipeline.STAGES) == 5

    one = language_id.scorer(language_id.fit(small.where(~language_id.held_out(4, 2))), language_id.Params())
    rows = [r for r in rows if not one(r[1])[3]]
    left = small.join(spark.createDataFrame([(r[0],) for r in rows], "doc_id long"), "doc_id")
    p = toxicity.Params()
    model = toxicity.fit(left, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model.weights, p)
    rows = [r for r in rows if model.logistic.probability(np.array([scorer.features(r[1])[0]]))[0] < 0.5]
    rows = [r for r, (d, _, c) in zip(rows, brute_components(rows, 80), strict=True) if d == c]  # the stage's threshold
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _, _ in brute_items(rows, items)}
    rows = [r for r in rows if r[0] not in bad]
    assert set(got) == {d for d, _ in rows} and bad
    encoder = pieces.Encoder(pieces.load())
    assert all(got[d]["token_ids"] == encoder.encode(t).tolist() and got[d]["round_trip"] for d, t in rows)


def test_pipeline_drops_near_copies_from_80_percent_on(spark, small):
    """Pairs between 0.80 and 0.85 go, too; each base text stands beside one edited copy."""
    rows = []
    for seed in range(40):
        words = [f"{seed}-{i}" for i in range(60)]
        base = " ".join(words)
        for at in range(seed % 4):
            words[8 + 14 * at] = "other"
        rows += [(2 * seed, base), (2 * seed + 1, " ".join(words))]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(edited_copies(40, 1, 6))]
    got = corpus_pipeline.near_duplicates(spark, docs_frame(spark, rows), SF)
    want = {d for d, _, c in brute_components(rows, 80) if d == c}
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == want
    assert want != {d for d, _, c in brute_components(rows) if d == c}
    own = corpus_pipeline.near_duplicates(spark, small.select("doc_id", "text"), SF)
    texts = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in own.collect()} == {d for d, _, c in brute_components(texts, 80) if d == c}


def test_history_tells_tail_words_apart(spark):
    """Two equally frequent rare words, each after its own word; the whole vocabulary sums to 1 after either."""
    rng = random.Random(3)
    fill = [f"f{i}" for i in range(35)]
    lines = []
    for i in range(1500):
        pair = [("left", "zebra"), ("right", "quartz")][i % 2]
        lines.append(" ".join([*(rng.choice(fill) for _ in range(45)), *pair, *(rng.choice(fill) for _ in range(5)), f"once{i // 2}"]))
    train = docs_frame(spark, list(enumerate(lines)))
    p = language_model.Params(classes=4, class_words=8, class_rows=256, word_rows=1024, rounds=2, batch=256, head_words=200, levels=4)
    probes = [(1, "left zebra"), (2, "left quartz"), (3, "right quartz"), (4, "right zebra")]
    # more frequent fillers fill the 31 head symbols, so both words are in the tail
    counts = language_model.count_words(train)
    v = language_model.vocabulary(counts, p)
    assert v.ranks[b"zebra"] >= p.symbols - 1 and v.ranks[b"quartz"] >= p.symbols - 1 and v.depth >= 3
    got = {r["doc_id"]: r["score"] for r in language_model.score(docs_frame(spark, probes), train, p).collect()}
    assert got[1] > got[2] + 0.3 and got[3] > got[4] + 0.3

    w = language_model.train_weights(train, v, p)
    reader = language_model.Reader(v, p)
    words = sorted({x for t in lines for x in language_model.tokens(t)} - set(list(v.ranks)[:p.symbols - 1]))
    ranks, codes = reader.read(words)
    paths = reader.paths(words, ranks, codes)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    own = np.array([c[x] for x in words], float)
    assert np.allclose(np.bincount(paths, own, len(v.leaf_mass)), v.leaf_mass)
    _, before = reader.read([b"left", b"zebra"])
    f = np.repeat(language_model.features([before])[1:], len(words), axis=0)
    share = np.exp(language_model.tail_log_probability(w, f, paths, v.depth, p)) * own / v.leaf_mass[paths]
    assert abs(share.sum() - 1) < 1e-4


def test_runs_are_summed_whatever_their_length():
    rng = np.random.default_rng(5)
    for widths in (4, 3):
        x = rng.normal(size=(50, widths)).astype(np.float32)
        lengths = rng.permutation([1] * 30 + [2] * 9 + [15, 16, 17, 18, 40, 700])
        of = rng.integers(0, len(x), lengths.sum())
        starts = np.cumsum(lengths) - lengths
        order, got = language_model.run_sums(x, of, starts)
        assert sorted(order.tolist()) == list(range(len(lengths))) and (np.diff(lengths[order]) <= 0).all()
        want = np.array([x[of[i:i + n]].astype(float).sum(axis=0) for i, n in zip(starts, lengths, strict=True)])
        assert np.allclose(got, want[order], atol=1e-3)
    order, got = language_model.run_sums(x, np.array([7]), np.array([0]))
    assert order.tolist() == [0] and (got == x[7]).all()


def test_documents_do_not_see_each_other():
    """Read one behind the other, documents have the features that each has alone."""
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 1000, n) for n in (1, 1, 2, 3, 1, 40)]
    apart = np.concatenate([language_model.features([d]) for d in docs])
    together = language_model.features_of(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert (apart == together).all()


def test_language_model_reads_equal_words_once():
    """Tokens from Arrow are those of ``tokens``; a rare word is hashed once for a part of the texts, however often it occurs."""
    import pyarrow as pa

    lm = language_model
    texts = ["", " ", None, " The  rare\tRARE \n", "É x\x0bY\x0cz\x1cq\x85", "rare a\xa0b the", "\n", "the " * 300 + "rare " * 300]
    for part in (texts, texts[2:5], []):
        words, lengths = lm.tokens_in(pa.array(["x", *part], pa.string()).slice(1))
        assert words.to_pylist() == [w for t in part for w in lm.tokens(t)] and lengths.tolist() == [len(lm.tokens(t)) for t in part]
    p = lm.Params(classes=2, class_words=2)
    ranks = {b"the": 0, b"": 1, b"x": 2, b"y": 3}
    vocabulary = lm.Vocabulary(ranks, np.array([9, 8, 2, 1]), 30, 8, 10, 3, 1, np.ones(2))
    reader, plain, asked = lm.Reader(vocabulary, p), lm.Reader(vocabulary, p), []
    reader.read = lambda words: asked.extend(words) or plain.read(words)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = list(lm.batches_of_tokens(iter([batch]), reader, 8))
    assert sorted(asked) == sorted({w for t in texts for w in lm.tokens(t)} - set(ranks))
    want, held = [], []
    for t in texts:
        held.append(lm.tokens(t))
        if sum(map(len, held)) >= 8 or t is texts[-1]:
            words = [w for d in held for w in d]
            own, codes = plain.read(words)
            want.append((lm.features_of(codes, np.array([len(d) for d in held])), plain.symbol[own], plain.paths(words, own, codes)))
            held = []
    assert len(got) == len(want) and all(np.array_equal(a, b) for x, y in zip(got, want) for a, b in zip(x, y))
