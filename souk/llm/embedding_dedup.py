"""Operator 11: near-duplicate embeddings by collision-counting projections.

Two vectors are linked if their cosine in double precision is at least
``similarity``; a group is a connected component of the links.

1. Equal vectors become one class with a weight.  Every class gets, for each of
   ``tables`` hash tables, the cell of its direction: the signs of a few random
   one-dimensional projections.  The number of signs follows the number of rows,
   so a cell holds about ``per_cell`` vectors at any size, and the number of
   tables follows from the chance that a pair at the threshold shares no cell.
2. Inside a cell, many further one-dimensional projections are sorted.  Around
   each vector a window of fixed width is opened on every sorted list, and the
   lists on which another vector falls into the window are counted.  Pairs that
   reach a count calibrated on simulated pairs at the threshold are verified by
   their exact cosine.  A pair that meets in several tables belongs to the first.
3. A cell above ``block`` vectors is dealt into pairs of blocks.  Before that its
   members within half the threshold's angle of one leader become a cluster: by
   the triangle inequality all of them are linked, so they are counted, not
   compared, and only the other pairs are left.  No pair is ever a row: a block
   returns one count and one root per vector, so hot groups stay small, too.

A pair at the threshold is missed with a chance of at most ``miss`` in the cells
and 1e-4 in the count; closer pairs are missed far less often.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing; so do rows without an id (component_id null, kept
true) and vectors of different lengths.  Every row is a vector of its own: rows
that repeat an id or a vector count as others.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import table, write_shared
from souk.llm.components import components


@dataclass(frozen=True)
class Params:
    similarity: float = 0.9
    #: Chance that a pair at the threshold shares no cell.
    miss: float = 0.002
    #: Vectors a cell holds on average, and at most without being dealt into blocks.
    per_cell: int = 512
    block: int = 2048
    #: Sorted projections, and half the width of a window in spreads of a pair at the threshold.
    lists: int = 32
    half_width: float = 2.0
    #: Parts of a group that meet their smallest id apart.
    salts: int = 32
    seed: int = 11


def layout(rows: int, p: Params) -> tuple[int, int]:
    """(signs per cell, tables) for so many rows."""
    signs = min(24, max(1, round(log2(max(2, rows / p.per_cell)))))
    together = (1 - acos(p.similarity) / pi) ** signs
    return signs, ceil(log(p.miss) / log(1 - together))


def directions(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, whatever the lengths of the rows."""
    x = raw.astype(np.float64) + 0.0
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def planes(dim: int, number: int, p: Params, part: int) -> np.ndarray:
    return np.random.default_rng([p.seed, part, dim]).standard_normal((dim, number))


def least_count(dim: int, p: Params) -> int:
    """The collisions that all but 1e-4 of the pairs at the threshold reach, by simulation."""
    if dim < 2:
        return 0
    rng = np.random.default_rng([p.seed, 2, dim])
    counts = []
    for _ in range(20):
        x, y = (directions(rng.standard_normal((1000, dim))) for _ in range(2))
        y = directions(y - (x * y).sum(axis=1, keepdims=True) * x)
        y = p.similarity * x + sqrt(1 - p.similarity ** 2) * y
        counts.append((np.abs((x - y) @ planes(dim, p.lists, p, 1)) <= window(p)).sum(axis=1))
    return int(np.sort(np.concatenate(counts))[2])


def window(p: Params) -> float:
    return p.half_width * sqrt(2 - 2 * p.similarity)


def signed(vectors: DataFrame, signs: int, tables: int, p: Params) -> DataFrame:
    """vec_id, node (128-bit hash of the direction), vec (its bytes), cells: null for vectors that link with nothing."""
    import pyarrow as pa

    item = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = np.float32 if item == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            n = batch.num_rows
            nodes, vecs, cells = [None] * n, [None] * n, [None] * n
            column = batch.column("embedding")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dim in set(sizes.tolist()) - {0}:
                at = np.flatnonzero(sizes == dim)
                flat = column.take(pa.array(at)).flatten()
                raw = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind)
                ok = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
                at, raw = at[ok], raw[ok]
                if not len(at):
                    continue
                x = directions(raw)
                bits = (x @ planes(dim, signs * tables, p, 0) >= 0).reshape(-1, tables, signs)
                cell = (bits * (1 << np.arange(signs))).sum(axis=2).astype(np.int32)
                for i, row in enumerate(at.tolist()):
                    nodes[row], vecs[row], cells[row] = xxh3_128_digest(x[i].tobytes()), raw[i].tobytes(), cell[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary()), pa.array(cells, pa.list_(pa.int32()))],
                ["vec_id", "node", "vec", "cells"])

    item = "double" if item != "float" else item
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{item}>").alias("embedding")) \
        .mapInArrow(run, "vec_id long, node binary, vec binary, cells array<int>")


def unpack(column, kind) -> np.ndarray:
    return directions(np.stack([np.frombuffer(v.as_buffer(), kind) for v in column]))


def clusters(classes: DataFrame, hot: DataFrame, kind, p: Params) -> DataFrame:
    """node, cluster: vectors within half the threshold's angle of a leader of one of their large cells.

    hot: g, cell, size, lead.  Of several leaders a vector takes the one of the
    smallest rank, so a group of copies that is split over cells meets again.
    """
    import pyarrow as pa

    near = sqrt((1 + p.similarity) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                cos = (unpack(t.column("vec"), kind) * unpack(t.column("lead_vec"), kind)).sum(axis=1)
                yield t.select(["node", "lead"]).filter(pa.array(cos >= near))

    leads = hot.join(classes.select(F.col("node").alias("lead"), F.col("vec").alias("lead_vec")), "lead")
    met = (classes.select("node", "vec", F.length("vec").alias("size"), F.posexplode("cells").alias("g", "cell"))
           .join(leads, ["size", "g", "cell"]).select("node", "lead", "vec", "lead_vec"))
    own = met.mapInArrow(run, "node binary, lead binary")
    return own.groupBy("node").agg(F.min(F.struct(F.xxhash64("lead").alias("rank"), "lead")).alias("best")) \
        .select("node", F.col("best.lead").alias("cluster"))


def units(classes: DataFrame, hot: DataFrame, p: Params) -> DataFrame:
    """The members of all cells, dealt out: a cell is one unit (p = q = 0), a large one is pairs of blocks.

    Of a large cell's largest cluster (main) no two are compared with each other,
    so its blocks only meet the blocks of the other members.
    """
    placed = classes.select(F.length("vec").alias("size"), F.posexplode("cells").alias("g", "cell"), "node", "cluster", "weight",
                            "vec", "cells")
    parts = placed.select("size", "g", "cell", "cluster").join(hot.select("size", "g", "cell"), ["size", "g", "cell"]) \
        .groupBy("size", "g", "cell", "cluster").agg(F.count("*").alias("n"))
    parts = parts.groupBy("size", "g", "cell").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("cluster").isNotNull(), F.struct("n", "cluster"))).alias("top"))
    half = F.lit(p.block // 2)
    parts = write_shared(parts.select(
        "size", "g", "cell", F.col("top.cluster").alias("top"), F.ceil(F.coalesce("top.n", F.lit(0)) / half).cast("int").alias("mains"),
        F.ceil((F.col("n") - F.coalesce("top.n", F.lit(0))) / half).cast("int").alias("minors")), "large_cells")
    placed = placed.join(parts, ["size", "g", "cell"], "left") \
        .withColumn("main", F.coalesce(F.col("cluster") == F.col("top"), F.lit(False))) \
        .withColumn("block", F.pmod(F.xxhash64("node", "g"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("minors"))).cast("int"))
    minors = F.when(F.col("minors") > 0, F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.array().cast("array<int>"))
    mains = F.when(F.col("mains") > 0, F.sequence(F.lit(1), F.col("mains"))).otherwise(F.array().cast("array<int>"))
    minor = F.concat(
        F.transform(minors, lambda j: F.struct(F.greatest(j, F.col("block")).alias("p"), F.least(j, F.col("block")).alias("q"))),
        F.transform(mains, lambda j: F.struct(F.col("block").alias("p"), (-j).alias("q"))))
    main = F.transform(minors, lambda j: F.struct(j.alias("p"), (-1 - F.col("block")).alias("q")))
    whole = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    at = F.when(F.col("minors").isNull(), whole).when(F.col("main"), main).otherwise(minor)
    return placed.withColumn("at", F.explode(at)).select(
        "size", "g", "cell", F.col("at.p").alias("p"), F.col("at.q").alias("q"), F.coalesce("block", F.lit(0)).alias("block"),
        "main", "node", "cluster", "weight", "vec", "cells")


class Cell:
    """Compares the vectors of a unit."""

    def __init__(self, dim: int, p: Params):
        self.p, self.lines, self.least, self.width = p, planes(dim, p.lists, p, 1), least_count(dim, p), window(p)

    def links(self, x: np.ndarray, z: np.ndarray, cells_x, cells_z, cluster_x, cluster_z, g: int, within: bool):
        """Index arrays (of x, of z) of the pairs that are linked and belong to this unit's table."""
        count = np.zeros((len(x), len(z)), np.uint8)
        own, other = x @ self.lines, z @ self.lines
        for i in range(self.p.lists):
            order = np.argsort(other[:, i], kind="stable")
            line = other[order, i]
            rank = np.empty(len(z), np.uint16)
            rank[order] = np.arange(len(z), dtype=np.uint16)
            low = np.searchsorted(line, own[:, i] - self.width, "left").astype(np.uint16)
            high = np.searchsorted(line, own[:, i] + self.width, "right").astype(np.uint16)
            # ranks lie in a window [low, high): one comparison of unsigned differences
            count += (rank[None, :] - low[:, None]) < (high - low)[:, None]
        passed = count >= self.least
        if within:
            passed = np.triu(passed, 1)
        a, b = np.nonzero(passed)
        a, b = self._keep(a, b, ~((cluster_x[a] == cluster_z[b]) & (cluster_x[a] != b"")))
        a, b = self._keep(a, b, ~(cells_x[a, :g] == cells_z[b, :g]).any(axis=1))
        near = np.concatenate([np.zeros(0, bool)] + [
            np.einsum("ij,ij->i", x[a[i:i + 65536]], z[b[i:i + 65536]]) >= self.p.similarity for i in range(0, len(a), 65536)])
        return self._keep(a, b, near)

    @staticmethod
    def _keep(a, b, ok):
        return a[ok], b[ok]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n by the links (a, b)."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[a], at[b])
        new = at.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def counted(dealt: DataFrame, kind, p: Params) -> DataFrame:
    """node, links, root: per unit and linked vector, the weight of its partners and a vector of its component."""
    import pyarrow as pa

    marks = ("size", "g", "cell", "p", "q")
    rows = dealt.repartition(*marks).sortWithinPartitions(*marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Cell] = {}

        def unit(t: pa.Table):
            x = unpack(t["vec"].combine_chunks(), kind)
            at_p, at_q, g = t["p"][0].as_py(), t["q"][0].as_py(), t["g"][0].as_py()
            cells = t["cells"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
            cluster = np.array([c or b"" for c in t["cluster"].to_pylist()], object)
            if x.shape[1] not in known:
                known[x.shape[1]] = Cell(x.shape[1], p)
            cell = known[x.shape[1]]
            if at_p == at_q:
                a, b = cell.links(x, x, cells, cells, cluster, cluster, g, True)
            else:
                first = ~t["main"].to_numpy() if at_q < 0 else t["block"].to_numpy() == at_p
                i, j = np.flatnonzero(first), np.flatnonzero(~first)
                a, b = cell.links(x[i], x[j], cells[i], cells[j], cluster[i], cluster[j], g, False)
                a, b = i[a], j[b]
            if not len(a):
                return None
            weight = t["weight"].to_numpy()
            links = np.zeros(len(x), np.int64)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            root, node = roots(len(x), a, b), t["node"].combine_chunks()
            linked = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays(
                [node.take(pa.array(linked)), pa.array(links[linked]), node.take(pa.array(root[linked]))], ["node", "links", "root"])

        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            seen = np.stack([t[c].to_numpy() for c in marks])
            starts = [0, *(np.flatnonzero((seen[:, 1:] != seen[:, :-1]).any(axis=0)) + 1).tolist()]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if j - i > 1 and (out := unit(t.slice(i, j - i))):
                    yield out
            held = t.slice(starts[-1])
        if held is not None and held.num_rows > 1 and (out := unit(held)):
            yield out

    return rows.mapInArrow(run, "node binary, links long, root binary")


def near_vectors(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    signs, tables = layout(vectors.count(), p)
    base = write_shared(signed(vectors, signs, tables, p), "vectors")
    live = base.where("vec_id is not null and node is not null")
    classes = write_shared(live.groupBy("node").agg(F.count("*").alias("weight"), F.first("vec").alias("vec"),
                                                    F.first("cells").alias("cells")), "classes")

    filled = classes.select("node", F.length("vec").alias("size"), F.posexplode("cells").alias("g", "cell"))
    hot = write_shared(filled.groupBy("size", "g", "cell").agg(
        F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("rank"), "node")).alias("lead"))
        .where(F.col("n") > p.block).select("size", "g", "cell", F.col("lead.node").alias("lead")), "hot_cells")
    own = write_shared(clusters(classes, hot, kind, p), "clusters")
    totals = write_shared(own.join(classes.select("node", "weight"), "node").groupBy("cluster").agg(F.sum("weight").alias("total")),
                          "cluster_sizes")
    classes = classes.join(own, "node", "left")
    found = write_shared(counted(units(classes, hot, p), kind, p), "links")

    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(
        own.select(F.col("node").alias("a"), F.col("cluster").alias("b")))
    known = components(edges)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    state = (classes.select("node", "weight", "cluster").join(totals, "cluster", "left").join(links, "node", "left")
             .join(known, "node", "left")
             .select("node", F.coalesce("component", "node").alias("component"),
                     (F.col("weight") - 1 + F.coalesce(F.col("total") - F.col("weight"), F.lit(0))
                      + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows = write_shared(base.select("vec_id", "node").join(state, "node", "left"), "states")
    # a large group's rows meet their smallest id in several tasks
    salts = F.lit(p.salts)
    least = rows.where("n_links > 0 and vec_id is not null").groupBy("component").agg(F.min("vec_id").alias("least")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1).cast("array<long>")))
    out = rows.withColumn("component", F.when(F.col("vec_id").isNotNull() & (F.col("n_links") > 0), F.col("component"))) \
        .withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts)).join(least, ["component", "salt"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: links and near-duplicate group of every embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
