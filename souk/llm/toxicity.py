"""Operator 1: toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned: words that stand in far more toxic than other labelled
documents, each weighted by its log odds.  Levenshtein automata of the terms
are intersected with the lexicon's trie into one automaton that reads a word
and knows all terms within their allowed distance; its deterministic states are
built as words need them.  So misspelled and inflected terms are caught.

Hits are scored in context windows: weights of hits near each other add up, a
hit inside quotation marks or after a word of reporting counts little (the
document speaks about abuse), and one next to a form of "you" counts more.
A logistic function of the window scores gives the probability.

Defined results: null and empty texts and texts without letters have no hits
and get the score of a document without hits.  Without labels of both kinds
there is no lexicon and the score is a constant.  One row per input row;
repeated rows repeat their result; other input columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import labelled, logistic
from souk.llm.common import held_out, keep_rows, table, tidy

#: Words that report somebody's speech, by which a hit is a quotation.
REPORTING = frozenset("said says wrote writes quoted quote quotes called calling word words term terms "
                      "sagte schrieb zitat wort dit écrit mot dijo escribió palabra".split())
#: Forms of address, by which a hit is aimed at somebody.
ADDRESS = frozenset("you your you're u du dich dir ihr euch tu te toi vous eres usted ustedes".split())

TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]|\n")
SCHEMA = "doc_id long, score double, hits long, quoted_hits long, terms array<string>"


@dataclass(frozen=True)
class Params:
    #: Bounds of the labelled sample: toxic and other documents.
    toxic_docs: int = 8_000
    other_docs: int = 16_000
    #: Evidence (natural log of the odds against chance) that makes a word a term.
    evidence: float = 14.0
    #: Terms in the lexicon at most, strongest first (a model size).
    terms: int = 4_000
    #: Shortest terms that may be off by one and by two letters.
    one_off: int = 5
    two_off: int = 9
    #: Words on each side of a hit that make its window.
    window: int = 10
    #: What is left of a hit in a quotation, and of one per letter it is off.
    quoted: float = 0.25
    off: float = 0.6
    address: float = 1.25
    #: Words and automaton states remembered per task.
    remembered: int = 300_000
    states: int = 30_000


class FuzzyLexicon:
    """The automaton: which term is nearest to a word, within the term's allowed distance."""

    def __init__(self, weights: dict[str, float], p: Params) -> None:
        self.p, self.weights = p, weights
        self.terms = sorted(weights)
        self.child: list[dict[str, int]] = [{}]
        self.term, self.limit = [-1], [0]
        for i, term in enumerate(self.terms):
            allowed = (len(term) >= p.one_off) + (len(term) >= p.two_off)
            node = 0
            self.limit[0] = max(self.limit[0], allowed)
            for ch in term:
                node = self.child[node].setdefault(ch, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.term.append(-1)
                    self.limit.append(0)
                self.limit[node] = max(self.limit[node], allowed)
            self.term[node] = i
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.dead = self.state({})
        self.start = self.state({0: 0})
        self.memo: dict[str, tuple[int, int] | None] = {}

    def state(self, reached: dict[int, int]) -> int:
        """The state of trie nodes with their edits so far, after letters of terms were left out."""
        queue = list(reached)
        for node in queue:
            e = reached[node] + 1
            for child in self.child[node].values():
                if e <= self.limit[child] and e < reached.get(child, 99):
                    reached[child] = e
                    queue.append(child)
        key = tuple(sorted(reached.items()))
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= self.allowed(self.term[n])]
            self.accepts.append(min(ends, key=lambda x: (x[0], -self.weights[self.terms[x[1]]], x[1])) if ends else None)
        return found

    def allowed(self, term: int) -> int:
        n = len(self.terms[term])
        return (n >= self.p.one_off) + (n >= self.p.two_off)

    def step(self, state: int, ch: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.members[state]:
            for letter, child in self.child[node].items():
                cost = e + (letter != ch)
                if cost <= self.limit[child] and cost < reached.get(child, 99):
                    reached[child] = cost
            if e + 1 <= self.limit[node] and e + 1 < reached.get(node, 99):  # a letter too many
                reached[node] = e + 1
        found = self.moves[state][ch] = self.state(reached)
        return found

    def find(self, word: str) -> tuple[int, int] | None:
        """(distance, term) of the nearest term, or None."""
        memo = self.memo
        if word in memo:
            return memo[word]
        if len(memo) >= self.p.remembered or len(self.members) >= self.p.states:
            self.forget()
            memo = self.memo
        state, dead, moves = self.start, self.dead, self.moves
        for ch in word:
            nxt = moves[state].get(ch)
            state = self.step(state, ch) if nxt is None else nxt
            if state == dead:
                break
        found = memo[word] = self.accepts[state]
        return found


class Scorer:
    """Text -> window features."""

    def __init__(self, weights: dict[str, float], p: Params) -> None:
        self.p, self.lexicon = p, FuzzyLexicon(weights, p)

    def features(self, text: str | None) -> tuple[list[float], int, int, list[str]]:
        """(features, hits, hits in quotations, terms)."""
        p, lex = self.p, self.lexicon
        none = [0.0] * 5
        lowered = (text or "").lower()
        find = lex.find
        hit_words = {w: f for w in set(WORDS(lowered)) if (f := find(w))}
        if not hit_words:
            return none, 0, 0, []
        at, inside, last_report, last_address = 0, False, -99, -99
        hits: list[list] = []  # [place, weight, quoted, distance, term]
        for token in TOKEN.findall(lowered):
            if token == "\n":
                inside = False  # quotations end with their line
            elif not token[0].isalpha():
                inside = token in "“„«" or (token == '"' and not inside)
            else:
                at += 1
                if token in REPORTING:
                    last_report = at
                elif token in ADDRESS:
                    last_address = at
                    for h in reversed(hits):
                        if at - h[0] > 3:
                            break
                        h[1] *= p.address
                elif token in hit_words:
                    distance, term = hit_words[token]
                    name = lex.terms[term]
                    weight = lex.weights[name] * p.off ** distance
                    quoted = inside or at - last_report <= 3
                    weight *= p.quoted if quoted else 1.0
                    weight *= p.address if at - last_address <= 3 else 1.0
                    hits.append([at, weight, quoted, distance, name])
        best, total, low = 0.0, 0.0, 0
        for high, h in enumerate(hits):
            total += h[1]
            while h[0] - hits[low][0] > 2 * p.window:
                total -= hits[low][1]
                low += 1
            best = max(best, total)
        exact = sum(h[1] for h in hits if h[3] == 0)
        fuzzy = sum(h[1] for h in hits if h[3])
        quoted = sum(h[2] for h in hits)
        features = [best, max(h[1] for h in hits), math.log1p(exact), math.log1p(fuzzy),
                    math.log1p(len({h[4] for h in hits}))]
        return features, len(hits), quoted, sorted({h[4] for h in hits})


WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    logistic: logistic.Logistic


def learn_lexicon(rows: DataFrame, p: Params) -> dict[str, float]:
    """Terms and weights from (text, label), counted by Spark.

    A document counts once for each word, and documents in which the word
    follows the same word count once together: copies of a toxic document
    would otherwise make terms of all its rare words.
    """
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[set, set] = (set(), set())
            for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
                words = WORDS(text.as_py().lower())
                before = dict(zip(reversed(words), reversed(["", *words[:-1]]), strict=True))  # at the first place
                seen[label.as_py()].update(before.items())
            pairs = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in pairs], pa.string()), pa.array([x[1] for x in pairs], pa.string()),
                 *[pa.array([x in s for x in pairs], pa.bool_()) for s in seen]], ["word", "before", "other", "toxic"])

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}
    places = rows.mapInArrow(tidy(count), "word string, before string, other boolean, toxic boolean")
    counts = (places.groupBy("word", "before").agg(F.max("other").alias("other"), F.max("toxic").alias("toxic"))
              .groupBy("word").agg(F.sum(F.col("other").cast("long")).alias("c"), F.sum(F.col("toxic").cast("long")).alias("t")))
    share, base = F.col("t") / (F.col("t") + F.col("c")), toxic / (toxic + other)
    rest = F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    counts = counts.where("t > 0").withColumn("evidence", F.col("t") * F.log(share / base) + rest)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (other + 1.0))
    terms = (counts.where((share > base) & (F.col("evidence") >= p.evidence)).withColumn("weight", odds)
             .where("weight >= 2").orderBy(F.desc("evidence"), "word").limit(p.terms))
    return {r["word"]: r["weight"] for r in terms.select("word", "weight").collect()}


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), modulus: int = 5, remainder: int = 0) -> Model:
    """Lexicon and logistic function from the training rows of ``labels`` (doc_id, toxic)."""
    import pyarrow as pa

    rows, kept = labelled.sample(docs, labels, "toxic", {1: p.toxic_docs, 0: p.other_docs}, modulus, remainder)
    weights = learn_lexicon(rows, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, p)
        for batch in batches:
            found = [scorer.features(t.as_py())[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

    table_ = rows.mapInArrow(tidy(run), "label int, x array<double>").toPandas()  # bounded by the sample
    y = table_["label"].to_numpy(float)
    x = np.array(table_["x"].tolist(), float).reshape(len(y), 5)
    # thinned labels count for those left out, so the score keeps the input's balance
    weight = np.array([1.0 / kept[int(v)] for v in y])
    return Model(weights, logistic.fit(x, y, weight / max(weight.mean(), 1e-9) if len(y) else weight))


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, score, hits, quoted_hits, terms of every row of ``docs``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.weights, p)
        for batch in batches:
            found = [scorer.features(t.as_py()) for t in batch.column("text")]
            x = np.array([f[0] for f in found], float).reshape(len(found), 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.logistic.probability(x), pa.float64()),
                 *[pa.array([f[i] for f in found], pa.int64()) for i in (1, 2)],
                 pa.array([f[3] for f in found], pa.list_(pa.string()))],
                ["doc_id", "score", "hits", "quoted_hits", "terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)


def drop_toxic(docs: DataFrame, model: Model, p: Params = Params(), threshold: float = 0.5) -> DataFrame:
    """``docs`` (all its columns) without the documents whose score reaches the threshold."""

    def judge():
        scorer = Scorer(model.weights, p)

        def keeps(text: str | None) -> bool:
            x = np.array([scorer.features(text)[0]], float)
            return bool(model.logistic.probability(x)[0] < threshold)

        return keeps

    return keep_rows(docs, judge)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the toxicity of every document, learned from labels whose id CRC mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "hits", "quoted_hits", "terms")
