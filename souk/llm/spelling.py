"""Operator 13: words one edit apart, by dynamic programming over sorted lists.

Two words are near if one inserted, deleted or replaced code point turns one into
the other.  Near words share all code points before the edit and all behind it,
so they share either the first half of the shorter one or the rest of it:

1. Every word is dealt into the lists of its first half and of its second half
   (the latter with all words reversed); ``s``, the length of the shorter word of
   a pair, and the range [lo, hi) in which the pair's common prefix ends make the
   lists disjoint, so each pair is found once.  A list above ``block`` letters is
   cut again by halving its range, down to one place of the edit.
2. A list is sorted.  For each word the list is scanned once: the edit matrix
   against the entries is banded (three cells a row), the rows of a prefix that
   neighbouring entries share are computed once for all of them, and where a row
   exceeds one edit, all entries that share that prefix are skipped.  The rows of
   many words are extended together, as numpy arrays.

Words: maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of the whole text with
A-Z lower-cased; one run in 31 of a document, by its crc32, is misspelled on
purpose by one deleted code point, as the contract of the query asks.

Defined results: null and empty texts have no words; a null id counts as an empty
text in the crc; repeated rows count as often as they are there.  A word without
near words has n_near 0 and no form and is its own root.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import table, write_shared


@dataclass(frozen=True)
class Params:
    #: Shortest word in code points, and the occurrences it needs.
    length: int = 7
    least: int = 2
    #: A form occurs at least so many times as often as its variant.
    ratio: int = 10
    #: One run in so many is misspelled (0: none).
    every: int = 31
    #: Letters of a list scanned in one task (its number of words times their length).
    block: int = 200_000
    #: Distinct words counted in a task at a time.
    held: int = 500_000


def vocabulary(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """word, n: the distinct words of ``docs`` (doc_id, text) and their occurrences."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from zlib import crc32

        runs = re.compile(f"[a-zÀ-ÿ]{{{p.length},}}").findall
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                               ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes.lower changes A-Z only
                for word, n in Counter(runs(text.as_buffer().to_pybytes().lower().decode())).items():
                    if p.every:
                        h = crc32(word.encode(), start)
                        if h % p.every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < p.length:
                                continue
                    counts[word] += n
                if len(counts) >= p.held:
                    yield out()
        yield out()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least)


KEY = ["s", "lo", "hi", "head", "tail"]


def halved(words: DataFrame) -> DataFrame:
    """word, n, s, lo, hi with the range [lo, hi) cut in two, and the ends that the words of a list then share."""
    mid = F.col("lo") + F.expr("(hi - lo) div 2").cast("int")
    cut = words.withColumn("at", F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")),
                                                   F.struct(F.col("lo").alias("lo"), mid.alias("hi")))))
    cut = cut.select("word", "n", "s", "at.lo", "at.hi")
    rest = F.greatest(F.lit(0), F.col("s") - F.col("hi"))
    return cut.withColumn("head", F.substring("word", F.lit(1), F.col("lo"))).withColumn("tail", F.right("word", rest))


def lists(words: DataFrame, p: Params) -> DataFrame:
    """word, n and the key of every list that the word belongs to."""
    size = F.char_length("word")
    live = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("s")).where(F.col("s") >= p.length)
    live = halved(live.withColumn("lo", F.lit(0)).withColumn("hi", F.col("s") + 1))
    while True:
        large = write_shared(live.where("hi - lo > 1").groupBy(*KEY).agg(F.count("*").alias("size")).where(F.col("size") * F.col("s") > p.block)
                             .select(*KEY), "large_lists")
        if large.isEmpty():
            return live
        again = halved(live.join(large, KEY, "left_semi").select("word", "n", "s", "lo", "hi"))
        live = write_shared(live.join(large, KEY, "left_anti").unionByName(again.select(*live.columns)), "lists")


class SortedLists:
    """Sorted lists of words, end to end, scanned with edit matrices that share their rows.

    A node stands for all entries [start, end) that share ``depth`` letters: the
    matrix rows of those letters are computed once for all of them, at the places
    where the common prefix of neighbours (``lcp``) says that a new letter begins.
    All queries of a step are extended by one letter together.
    """

    def __init__(self, words: list[str], lists: np.ndarray):
        n, self.size = len(words), np.array([len(w) for w in words], np.int64)
        width = int(self.size.max(initial=0)) + 2
        self.letters = np.zeros((n, width), np.uint32)  # code points + 1; 0 behind the end
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        row = np.repeat(np.arange(n), self.size)
        self.letters[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = flat
        first = np.concatenate([[True], lists[1:] != lists[:-1]]) if n else np.empty(0, bool)
        self.start = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.empty(0, np.int64)
        ends = np.append(np.flatnonzero(first)[1:], n) if n else np.empty(0, np.int64)
        self.end = ends[np.cumsum(first) - 1] if n else ends
        lcp = np.full(n, -1, np.int64)
        if n > 1:
            differ = self.letters[1:] != self.letters[:-1]
            lcp[1:] = np.where(first[1:], -1, differ.argmax(axis=1))
        # places by the letters shared with the entry before: children of a node of that depth
        self.step = n + 1
        self.places = np.sort(np.where(lcp >= 0, lcp * self.step + np.arange(n), -1))

    def one_edit(self, query: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of all pairs in one list that are exactly one edit apart.

        query: entries to look for in their own lists; depth: letters that all
        entries of the list share, which may be 0.
        """
        q, d = query, depth
        s, e = self.start[q], self.end[q]
        # edits of the first d letters against the query's first d - 1, d and d + 1; 2 stands for more than one
        a, b, c = np.where(d > 0, 1, 2).astype(np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        found_q, found_s = [], []
        while len(q):
            off = self.size[q] - d
            edits = np.where(off == 0, b, np.where(off == -1, a, np.where(off == 1, c, 2)))
            hit = (self.size[s] == d) & (edits == 1)
            found_q.append(q[hit])
            found_s.append(s[hit])
            # the node's children: its first entry and every place where just d letters are shared
            low = np.searchsorted(self.places, d * self.step + s + 1)
            number = np.searchsorted(self.places, d * self.step + e) - low + 1
            parent = np.repeat(np.arange(len(q)), number)
            at = np.arange(len(parent)) - np.repeat(np.cumsum(number) - number, number)
            begin = np.where(at == 0, s[parent], self.places[np.maximum(low[parent] + at - 1, 0)] % self.step)
            last = at == number[parent] - 1
            stop = np.where(last, e[parent], np.append(begin[1:], 0))
            keep = self.size[begin] > d[parent]
            parent, begin, stop = parent[keep], begin[keep], stop[keep]
            q, d = q[parent], d[parent]
            a, b, c = a[parent], b[parent], c[parent]
            letter = self.letters[begin, d]
            limit = self.letters.shape[1] - 1
            x = np.minimum(a + (self.letters[q, np.maximum(d - 1, 0)] != letter), b + 1)
            y = np.minimum(np.minimum(b + (self.letters[q, np.minimum(d, limit)] != letter), c + 1), x + 1)
            z = np.minimum(c + (self.letters[q, np.minimum(d + 1, limit)] != letter), y + 1)
            # a row without a cell of at most one edit ends the whole node
            alive = np.minimum(np.minimum(x, y), z) <= 1
            q, s, e, d = q[alive], begin[alive], stop[alive], d[alive] + 1
            a, b, c = (np.minimum(v[alive], 2).astype(np.int8) for v in (x, y, z))
        return np.concatenate(found_q or [query[:0]]), np.concatenate(found_s or [query[:0]])

    def common_ends(self, a: np.ndarray, b: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Letters that two entries share at their beginning, or at their end where ``back`` holds."""
        out, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        least = np.minimum(self.size[a], self.size[b])
        for k in range(int(least.max(initial=0))):
            at_a, at_b = np.where(back, self.size[a] - 1 - k, k), np.where(back, self.size[b] - 1 - k, k)
            going &= (k < least) & (self.letters[a, np.maximum(at_a, 0)] == self.letters[b, np.maximum(at_b, 0)])
            out += going
        return out


#: Entries looked for at a time, which bounds the nodes in hand, and letters in hand.
TOGETHER, LETTERS = 4096, 2_000_000


def parts(marks: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole lists of up to about ``LETTERS`` letters together, or of one list."""
    starts = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])).tolist() + [len(marks)]
    begin, most = 0, 0
    for i, j in zip(starts[:-1], starts[1:], strict=True):
        most = max(most, int(size[i]))
        if i > begin and (j - begin) * most > LETTERS:
            yield begin, i
            begin, most = i, int(size[i])
    yield begin, len(marks)


def near_words(words: DataFrame, p: Params = Params()) -> DataFrame:
    """word, n_near, form, form_n: how many near words a word of ``words`` (word, n) has, and the most frequent of them."""
    import pyarrow as pa

    back = F.col("s") - F.col("hi") > F.col("lo")
    rows = lists(words, p).withColumn("scan", F.when(back, F.reverse("word")).otherwise(F.col("word")))
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "scan").select("scan", "n", *KEY)

    def scanned(t: pa.Table, marks: np.ndarray) -> pa.RecordBatch:
        s, lo, hi, n = (t[c].to_numpy() for c in ("s", "lo", "hi", "n"))
        s, lo, hi = (v.astype(np.int64) for v in (s, lo, hi))
        reverse = s - hi > lo
        entries = SortedLists(scan := t["scan"].to_pylist(), marks)
        shared = np.where(reverse, np.maximum(s - hi, 0), lo)
        query = np.flatnonzero(entries.end - entries.start > 1)
        pairs = [entries.one_edit(query[i:i + TOGETHER], shared[query[i:i + TOGETHER]]) for i in range(0, len(query), TOGETHER)]
        a, b = (np.concatenate([x[k] for x in pairs] or [query]) for k in (0, 1))
        # of two words of s + 1 letters another list takes care
        first = entries.common_ends(a, b, reverse[a])
        ok = ((entries.size[a] == s[a]) | (entries.size[b] == s[a])) & (lo[a] <= first) & (first < hi[a])
        number: dict[int, int] = Counter(a[ok].tolist())
        own = [w[::-1] if r else w for w, r in zip(scan, reverse.tolist(), strict=True)]
        best: dict[int, tuple[int, str]] = {}
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            form = (-int(n[j]), own[j])
            if i not in best or form < best[i]:
                best[i] = form
        return pa.RecordBatch.from_arrays(
            [pa.array([own[i] for i in best], pa.string()), pa.array([number[i] for i in best], pa.int64()),
             pa.array([f for _, f in best.values()], pa.string()), pa.array([-m for m, _ in best.values()], pa.int64())],
            ["word", "n_near", "form", "form_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def marked(t: pa.Table) -> np.ndarray:
            """The number of the list that each row belongs to, rising."""
            changed = np.zeros(t.num_rows, bool)
            for c in KEY:
                column = t[c].combine_chunks()
                codes = column.dictionary_encode().indices.to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
                changed[1:] |= codes[1:] != codes[:-1]
            return np.cumsum(changed)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            marks = marked(t)
            whole = int(np.searchsorted(marks, marks[-1]))  # the last list may go on
            if whole:
                yield from (scanned(t.slice(i, j - i), marks[i:j]) for i, j in parts(marks[:whole], t["s"].to_numpy()[:whole]))
            held = t.slice(whole)
        if held is not None and held.num_rows > 1:
            yield scanned(held, marked(held))

    found = rows.mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")) \
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form), by pointer doubling.

    A form occurs several times as often as its variant, so chains have no cycle
    and their length grows with the logarithm of the largest count.
    """
    steps = write_shared(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = write_shared(steps.join(further, "root", "left")
                           .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        steps = new.select("word", "root")
        if new.where("moved").isEmpty():
            return steps


def variants(words: DataFrame, p: Params = Params()) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (word, n)."""
    words = write_shared(words, "vocabulary")
    near = words.join(near_words(words, p), "word", "left")
    is_form = F.col("form_n") >= p.ratio * F.col("n")
    near = write_shared(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"),
                                    F.when(is_form, F.col("form_n")).alias("form_n")), "near")
    roots = last_forms(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: spelling variants among all words of the documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
