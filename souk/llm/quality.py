"""Operator 4: quality by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Each byte
is a learned vector; learned filters slide over the chunk; each filter keeps
its largest answer in the chunk (max pooling), and a weighted sum of these is
the chunk's junk score.  A document's chunk scores are combined (their largest,
their mean, the share above zero) into one probability.

The network is trained by gradient descent on a bounded sample of labelled
documents: a document's loss is that of its worst chunk, so that the chunks of
a junk document need not all be junk.

Defined results: null and empty texts are one chunk of padding.  Without labels
of both kinds the score is a constant.  One row per input row; repeated rows
repeat their result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import labelled, logistic
from souk.llm.common import held_out, table


@dataclass(frozen=True)
class Params:
    #: Bounds of the labelled sample: documents of low and of high quality.
    junk_docs: int = 2_000
    good_docs: int = 2_000
    chunk: int = 512
    overlap: int = 64
    embedding: int = 6
    width: int = 10
    stride: int = 2
    filters: int = 24
    #: Training: chunks taken from a document at most, documents per step, steps, learning rate.
    train_chunks: int = 8
    batch: int = 48
    steps: int = 700
    rate: float = 0.01
    seed: int = 3
    #: Chunks convolved at a time.
    at_once: int = 64


def chunks_of(data: bytes, p: Params) -> np.ndarray:
    """All overlapping chunks of ``data`` (rows), the last one padded with zero bytes."""
    step = p.chunk - p.overlap
    n = 1 if len(data) <= p.chunk else 1 + -(-(len(data) - p.chunk) // step)
    padded = np.zeros((n - 1) * step + p.chunk, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, p.chunk)[::step]


@dataclass
class Network:
    embedding: np.ndarray  # 256 x e
    kernel: np.ndarray  # (width * e) x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(p: Params) -> "Network":
        rng = np.random.default_rng(p.seed)
        f = np.float32
        return Network(rng.normal(0, 0.5, (256, p.embedding)).astype(f),
                       rng.normal(0, (p.width * p.embedding) ** -0.5, (p.width * p.embedding, p.filters)).astype(f),
                       np.zeros(p.filters, f), rng.normal(0, p.filters ** -0.5, p.filters).astype(f), np.zeros(1, f))

    def windows(self, chunks: np.ndarray, p: Params) -> np.ndarray:
        """Byte windows under the filters: chunks x places x width."""
        return np.lib.stride_tricks.sliding_window_view(chunks, p.width, axis=1)[:, ::p.stride]

    def pooled(self, chunks: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
        """(largest answer, its place) of each filter in each chunk."""
        win = self.windows(chunks, p)
        n, places, _ = win.shape
        seen = self.embedding[win].reshape(n * places, -1) @ self.kernel
        seen = seen.reshape(n, places, -1)
        at = seen.argmax(axis=1)
        return np.take_along_axis(seen, at[:, None], axis=1)[:, 0] + self.bias, at

    def chunk_scores(self, chunks: np.ndarray, p: Params) -> np.ndarray:
        # whole batches of chunks, largest answers only
        out = []
        for i in range(0, len(chunks), p.at_once):
            win = self.windows(chunks[i:i + p.at_once], p)
            n, places, _ = win.shape
            seen = (self.embedding[win].reshape(n * places, -1) @ self.kernel).reshape(n, places, -1).max(axis=1)
            out.append(np.maximum(seen + self.bias, 0) @ self.out)
        return np.concatenate(out) + self.out_bias[0]


def train(docs: list[np.ndarray], junk: np.ndarray, p: Params) -> Network:
    """The network, from chunk arrays and labels (1: junk), by Adam on the worst chunk's logistic loss."""
    net = Network.start(p)
    names = ["embedding", "kernel", "bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    rng = np.random.default_rng(p.seed + 1)
    kinds = [np.flatnonzero(junk == k) for k in (0, 1)]
    for step in range(1, p.steps + 1):
        picked = np.concatenate([rng.choice(k, p.batch // 2) for k in kinds])
        own = [docs[i] for i in picked]
        own = [d if len(d) <= p.train_chunks else d[rng.choice(len(d), p.train_chunks, replace=False)] for d in own]
        ends = np.cumsum([len(d) for d in own])
        chunks = np.concatenate(own)
        best, at = net.pooled(chunks, p)
        z = np.maximum(best, 0) @ net.out + net.out_bias[0]
        worst = np.array([e - len(d) + int(np.argmax(z[e - len(d):e])) for d, e in zip(own, ends, strict=True)])
        error = (1 / (1 + np.exp(-z[worst])) - junk[picked]).astype(np.float32) / len(picked)
        live = (best[worst] > 0) * net.out * error[:, None]  # docs x filters
        win = net.windows(chunks, p)
        seen = win[worst[:, None], at[worst]]  # docs x filters x width bytes
        vec = net.embedding[seen].reshape(len(worst), p.filters, -1)
        grad = {"out": np.maximum(best[worst], 0).T @ error, "out_bias": error.sum(keepdims=True),
                "bias": live.sum(axis=0), "kernel": np.einsum("df,dfk->kf", live, vec)}
        back = (live[:, :, None] * net.kernel.T[None]).reshape(-1, p.embedding)
        grad["embedding"] = np.zeros_like(net.embedding)
        np.add.at(grad["embedding"], seen.reshape(-1), back)
        rate = p.rate * min(1.0, 2 * (1 - step / (p.steps + 1)))
        for k in names:
            first[k] += 0.1 * (grad[k] - first[k])
            second[k] += 0.001 * (grad[k] ** 2 - second[k])
            move = (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def document_features(z: np.ndarray) -> list[float]:
    """What the chunk scores of a document say together."""
    top = np.sort(z)[::-1]
    return [float(top[0]), float(top[:3].mean()), float(z.mean()), float((z > 0).mean())]


@dataclass(frozen=True)
class Model:
    network: Network
    logistic: logistic.Logistic

    def quality(self, texts: list[str | None], p: Params) -> np.ndarray:
        """Probability of high quality of each text; every byte is under a filter."""
        chunks = [chunks_of((t or "").encode("utf-8", "surrogatepass"), p) for t in texts]
        ends = np.cumsum([len(c) for c in chunks])
        features = []
        group: list[np.ndarray] = []
        held = 0
        scores: list[np.ndarray] = []
        for c in chunks:  # neighbouring documents share a matrix product
            group.append(c)
            held += len(c)
            if held >= p.at_once:
                scores.append(self.network.chunk_scores(np.concatenate(group), p))
                group, held = [], 0
        if group:
            scores.append(self.network.chunk_scores(np.concatenate(group), p))
        z = np.concatenate(scores) if scores else np.empty(0)
        for c, e in zip(chunks, ends, strict=True):
            features.append(document_features(z[e - len(c):e]))
        return 1 - self.logistic.probability(np.array(features, float).reshape(len(texts), 4))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), modulus: int = 5, remainder: int = 0) -> Model:
    """The network and its combination from the training rows of ``labels`` (doc_id, quality)."""
    rows, _ = labelled.sample(docs, labels, "quality", {0: p.junk_docs, 1: p.good_docs}, modulus, remainder)
    got = rows.orderBy(F.xxhash64("text"), "text").toPandas()  # bounded by the sample
    junk = 1 - got["label"].to_numpy(np.int64)
    data = [chunks_of(t.encode("utf-8", "surrogatepass"), p) for t in got["text"]]
    if not 0 < junk.sum() < len(junk):
        return Model(Network.start(p), logistic.fit(np.zeros((len(junk), 4)), junk.astype(float)))
    net = train(data, junk, p)
    x = np.array([document_features(net.chunk_scores(d, p)) for d in data])
    # both kinds weigh the same, however rare junk is in the labels
    weight = np.where(junk == 1, len(junk) / junk.sum(), len(junk) / (len(junk) - junk.sum()))
    return Model(net, logistic.fit(x, junk.astype(float), weight / weight.mean()))


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                found = model.quality(batch.column("text").to_pylist(), p)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the quality of every document, learned from labels whose id CRC mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))
