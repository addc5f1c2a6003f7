"""Operator 12: phrases of words that stand together, by direct-address tiling.

1. Words are counted per language.  Those of at least ``least`` occurrences are
   ranked by frequency: a word's rank is its id.
2. A pair of ids is the address of a counter.  Ids are cut into ranges of
   ``tile`` ranks; the tiles of the ``dense`` most frequent ids hold most
   occurrences and are dense tables counted with ``bincount``, all other tiles
   are sorted lists of (address, count).  Every task counts its own part; the
   counts are then summed by address.
3. Pairs of at least ``least`` occurrences are ranked in turn, and such a rank
   and the id of the word behind it are the address of a phrase of three words;
   phrases of three give those of four.  A phrase can only reach ``least`` if
   both its shorter phrases do, so all other places are passed over.
4. Counts of the parts of a phrase are joined to it; the scores, the dropping of
   phrases inside longer ones and the ranking are joins, aggregations and one
   window with a limit per language.

The ranked words and phrases travel to the tasks, at most ``known`` of each kind.
What has no rank beyond that bound is counted as text in the same pass, so the
result is whole at any size; only the shuffle grows.

Defined results: the language of a null lang is ``und``; a null or empty text has
no words; repeated rows count as often as they are there; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import table, write_shared


@dataclass(frozen=True)
class Params:
    least: int = 30
    longest: int = 4
    scale: int = 2_000_000
    #: A phrase goes if a longer one around it has this percentage of its occurrences.
    inside: int = 80
    top: int = 2000
    #: Ranked words, and ranked phrases of a length, that travel to the tasks at most.
    known: int = 1_000_000
    #: Ids in a range, and the most frequent ids whose tiles are dense tables.
    tile: int = 512
    dense: int = 1024
    #: Addresses, texts and bytes of text that a task holds at a time, over all languages.
    held: int = 1_500_000
    texts: int = 400_000
    chunk: int = 2 << 20


#: Rows sent on at a time.
BATCH = 65_536

#: Ends of a piece become full stops, which no word can hold.
STOPS = bytes(46 if chr(i) in ".,;:!?\x0a\x0b\x0c\x0d" else i for i in range(256))


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of the texts with A-Z lower-cased, and a full stop between two pieces."""
    return b".".join(texts).lower().translate(STOPS).replace(b".", b" . ").split()


def chunks(batches: Iterator, p: Params) -> Iterator[tuple[str, list[bytes]]]:
    """(language, tokens) of texts of about ``chunk`` bytes together."""
    held, size = defaultdict(list), Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if text.is_valid:
                data = text.as_buffer().to_pybytes()
                held[lang].append(data)
                size[lang] += len(data)
                if size[lang] >= p.chunk:
                    size[lang] = 0
                    yield lang, tokens(held.pop(lang))
    for lang, texts in held.items():
        yield lang, tokens(texts)


def word_counts(docs: DataFrame, p: Params) -> DataFrame:
    """lang, phrase, n: every word and its occurrences."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(b".", None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()),
                     pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "n"])
            counts.clear()

        for lang, words in chunks(batches, p):
            counts[lang].update(words)
            if sum(map(len, counts.values())) >= p.texts:
                yield from out()
        yield from out()

    found = docs.mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


class Tiles:
    """Counts of addresses (a, b): dense tables for the most frequent ids, sorted lists for the rest."""

    def __init__(self, words: int, p: Params):
        self.words, self.p = words, p
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        self.codes, self.counts = [], []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        t = self.p.tile
        frequent = (a < self.p.dense) & (b < self.p.dense)
        da, db = a[frequent], b[frequent]
        place = (da // t) * (self.p.dense // t) + db // t
        for at in np.unique(place).tolist():
            here = place == at
            cell = np.bincount((da[here] % t) * t + db[here] % t, minlength=t * t)
            key = divmod(at, self.p.dense // t)
            self.tables[key] = self.tables[key] + cell if key in self.tables else cell
        code, n = np.unique(a[~frequent].astype(np.int64) * self.words + b[~frequent], return_counts=True)
        self.codes.append(code)
        self.counts.append(n)
        if sum(map(len, self.codes[1:])) > self.p.held // 4:
            self._merge()

    def _merge(self) -> None:
        if len(self.codes) > 1:
            code = np.concatenate(self.codes)
            order = np.argsort(code, kind="stable")
            code, n = code[order], np.concatenate(self.counts)[order]
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
            self.codes, self.counts = [code[starts]], [np.add.reduceat(n, starts) if len(starts) else n]

    def __len__(self) -> int:
        return sum(map(len, self.codes))

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(addresses a * words + b, counts) of everything counted so far."""
        self._merge()
        yield from zip(self.codes, self.counts, strict=True)
        for (i, j), cell in self.tables.items():
            at = np.flatnonzero(cell)
            yield (at // self.p.tile + i * self.p.tile) * self.words + at % self.p.tile + j * self.p.tile, cell[at]
        self.codes, self.counts, self.tables = [], [], {}


@dataclass
class Known:
    """Ranked words of the languages, and per phrase length the addresses of ranked phrases."""

    words: dict[str, list[bytes]]
    all_words: bool
    #: Per length from 2 on: language -> (sorted addresses, their ranks).
    codes: list[dict[str, tuple[np.ndarray, np.ndarray]]]
    #: Whether all frequent phrases of that length are ranked.
    all_codes: list[bool]

    def phrase(self, lang: str, length: int, code: int) -> bytes:
        words = self.words[lang]
        head, last = divmod(code, len(words))
        if length == 2:
            return words[head] + b" " + words[last]
        own, ranks = self.codes[length - 3][lang]
        return self.phrase(lang, length - 1, int(own[self._by_rank(lang, length - 3)[head]])) + b" " + words[last]

    def _by_rank(self, lang: str, at: int) -> np.ndarray:
        orders = self.__dict__.setdefault("orders", {})
        if (lang, at) not in orders:
            orders[lang, at] = np.argsort(self.codes[at][lang][1])
        return orders[lang, at]


def ranked(known: Known, at: int, lang: str, code: np.ndarray) -> np.ndarray:
    """Ranks of phrase addresses; -1 for what is not ranked."""
    own, ranks = known.codes[at].get(lang, (np.empty(0, np.int64), np.empty(0, np.int64)))
    if not len(own):
        return np.full(len(code), -1, np.int64)
    place = np.minimum(np.searchsorted(own, code), len(own) - 1)
    return np.where((own[place] == code) & (code >= 0), ranks[place], -1)


def places(known: Known, lang: str, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(heads, words, text places): addresses of the phrases counted by rank, and starts of those counted as text.

    ids: a word's rank, -1 at ends of pieces and for words that cannot belong to a phrase, -2 for words without a rank.
    """
    words = max(1, len(known.words.get(lang, ())))
    head, alive = ids.astype(np.int64), ids != -1
    for at in range(length - 1):
        last = ids[at + 1:]
        n = len(last)
        head, alive = head[:n], alive[:n] & (last != -1) & alive[1:n + 1]
        if at == length - 2:
            break
        ranks = ranked(known, at, lang, np.where((head >= 0) & (last >= 0), head * words + last, -1))
        head = np.where(ranks >= 0, ranks, -2)
        if known.all_codes[at]:
            alive &= ranks >= 0
    by_rank = alive & (head >= 0) & (last >= 0)
    return head[by_rank], last[by_rank].astype(np.int64), np.flatnonzero(alive & ~by_rank)


def phrase_counts(docs: DataFrame, known: Known, length: int, p: Params) -> DataFrame:
    """lang, code, phrase, n of the phrases of ``length`` words with at least ``least`` occurrences (code null if counted as text)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = shared.value, {}
        tiles: dict[str, Tiles] = {}
        texts: dict[str, Counter] = defaultdict(Counter)

        def rows(lang: str, codes, phrases, n) -> Iterator[pa.RecordBatch]:
            whole = pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), codes, phrases, pa.array(n, pa.int64())],
                                               ["lang", "code", "phrase", "n"])
            yield from (whole.slice(i, BATCH) for i in range(0, len(n), BATCH))

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            for code, n in tiles[lang].take():
                yield from rows(lang, pa.array(code, pa.int64()), pa.nulls(len(code), pa.string()), n)
            if found := texts.pop(lang, None):
                yield from rows(lang, pa.nulls(len(found), pa.int64()), pa.array(list(found), pa.binary()).cast(pa.string()), list(found.values()))

        for lang, words in chunks(batches, p):
            if lang not in ids:
                ids[lang] = {w: i for i, w in enumerate(own.words.get(lang, ()))} | {b".": -1}
                tiles[lang] = Tiles(len(own.words.get(lang, ())), p)
            none, get = -1 if own.all_words else -2, ids[lang].get
            a, b, raw = places(own, lang, np.fromiter((get(w, none) for w in words), np.int32, len(words)), length)
            tiles[lang].add(a, b)
            texts[lang].update(b" ".join(words[i:i + length]) for i in raw.tolist())
            if sum(map(len, tiles.values())) > p.held or sum(map(len, texts.values())) > p.texts:
                for each in tiles:
                    yield from out(each)
        for lang in tiles:
            yield from out(lang)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for t in batches:
            phrases = [x if c is None else own.phrase(lang, length, c).decode()
                       for lang, c, x in zip(*(t.column(k).to_pylist() for k in ("lang", "code", "phrase")), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("lang"), t.column("code"), pa.array(phrases, pa.string()), t.column("n")],
                                             ["lang", "code", "phrase", "n"])

    kind = "lang string, code long, phrase string, n long"
    # every task has added up its own part: the rows go to their sums as they are, not through a table of the task's rows
    parts = docs.mapInArrow(run, kind).repartition("lang", "code", "phrase")
    found = parts.groupBy("lang", "code", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least)
    return write_shared(found.mapInArrow(read, kind), f"phrases{length}")


def _most_frequent(counts: DataFrame, column: str, p: Params):
    """Up to ``known`` rows, most frequent first, and whether that is all."""
    top = counts.orderBy(F.desc("n"), "lang", column).limit(p.known).select("lang", column).toArrow()
    return top["lang"].to_pylist(), top[column], counts.count() <= p.known


def frequent_phrases(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all words and phrases of at least ``least`` occurrences, and (lang, n) of all words."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = write_shared(word_counts(docs, p), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= p.least)
    langs, top, complete = _most_frequent(frequent, "phrase", p)
    known = Known(defaultdict(list), complete, [], [])
    for lang, word in zip(langs, top.to_pylist(), strict=True):
        known.words[lang].append(word.encode())
    known.words = dict(known.words)
    out = frequent.select("lang", "phrase", F.lit(1).alias("size"), "n")
    for length in range(2, p.longest + 1):
        found = phrase_counts(docs, known, length, p)
        out = out.unionByName(found.select("lang", "phrase", F.lit(length).alias("size"), "n"))
        coded = found.where("code is not null")
        langs, codes, complete = _most_frequent(coded, "code", p)
        by = {}
        langs, codes = np.array(langs, object), codes.to_numpy()
        for lang in set(langs.tolist()):
            own = codes[langs == lang]
            order = np.argsort(own)
            by[lang] = own[order], order.astype(np.int64)
        known = Known(known.words, known.all_words, [*known.codes, by],
                      [*known.all_codes, complete and known.all_words and all(known.all_codes)])
    return out, totals


def collocations(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language of ``docs`` (lang, text)."""
    parts, totals = frequent_phrases(docs, p)
    words = F.split("phrase", " ")

    def run_of(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    phrases = parts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))) \
        .select("lang", "phrase", "a", "k", run_of(F.lit(1), F.col("k")).alias("first"),
                run_of(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]) \
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(20,0)) * cast({p.scale} as decimal(10,0)) div cast(l + r as decimal(20,0))")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("cut")) \
        .select("lang", "phrase", "cut.*")

    longer = phrases.where("size > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1))) \
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    around = longer.groupBy("lang", run_of(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("a").alias("around"))
    stays = F.coalesce(F.col("around").cast("decimal(20,0)") * F.lit(100).cast("decimal(10,0)")
                       < F.col("a").cast("decimal(20,0)") * F.lit(p.inside).cast("decimal(10,0)"), F.lit(True))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranks = scored.join(around, ["lang", "phrase"], "left").where(stays).withColumn("rank", F.row_number().over(best)) \
        .where(F.col("rank") <= p.top)
    return ranks.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"),
        F.col("score").cast("long").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the best phrases of every language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))
