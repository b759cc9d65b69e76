"""Centroid clustering: Lloyd's rounds by two trees.

Vectors, as whole numbers, are gathered into cover trees of at most ``TREE`` vectors where they are read, without a shuffle, and the
trees are written once. A node has a vector of its own as centre and a radius that covers its vectors; its children's centres
cover it with a radius ``BASE`` times smaller and lie further apart than that. Every round builds a cover tree over the centroids and
walks both trees: a pair of nodes whose least possible distance is more than another centroid's largest is left out, a node
of vectors with one centroid left goes to it as a whole, by its count and sum, and the vectors of a leaf are compared with the
centroids left exactly, in whole numbers. A task yields one sum for each centroid and component, so what the driver sees of a round is bounded by
the number of centroids, which is a parameter. Rounds end early once no centroid changes, as the rest would change nothing.

Defined cases: vectors that are null, of another length, or hold null, NaN or infinite components are left out. A row with a null
``vec_id`` is clustered but never an initial centroid; rows that share a ``vec_id`` are vectors each, and as initial centroids come in the
order of their components. Fewer vectors than centroids give fewer centroids. Equal centroids: the smallest number takes
all. Components beyond 2**62 are held there, distances and their sums to 64 bits; vectors beyond 2**21 are
compared one by one in whole numbers of any size. An empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch

WIDTH, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Vectors of a tree, vectors of a leaf, how much smaller a child's cover is, and pairs of vectors compared at once.
TREE, LEAF, BASE, PAIRS = 2048, 16, 1.5, 32_768
#: Components up to here have exact distances in doubles; larger ones are held to MOST.
PLAIN, MOST = 2**21, 2**62
LONG = 2**63 - 1
TREES = "ids array<long>, vectors array<long>, begin array<int>, end array<int>, centre array<int>, radius array<double>, first array<int>, children array<int>"
SUMS = "cluster int, part int, total decimal(38,0)"
PLACED = "vec_id long, cluster int, distance long"


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    q = np.floor(np.nan_to_num(scale * x.astype(np.float64)))
    return np.where(np.abs(q) < MOST, q, np.sign(q) * MOST).astype(np.int64)


def plain(x: np.ndarray) -> bool:
    return not len(x) or bool(np.abs(x).max() <= PLAIN)


class Tree:
    """A cover tree; ``rows`` are the vectors so ordered that a node's are rows begin to end, children of a node follow each other."""

    def __init__(self, rows: np.ndarray, begin, end, centre, radius, first, children):
        self.rows, self.begin, self.end, self.centre, self.radius, self.first, self.children = rows, begin, end, centre, radius, first, children

    def nodes(self) -> tuple:
        return self.begin, self.end, self.centre, self.radius, self.first, self.children


def lone_leaf(rows: np.ndarray) -> Tree:
    zero = np.zeros(1, np.int32)
    return Tree(rows, zero, zero + len(rows), zero, np.full(1, np.inf), zero, zero)


def cover_tree(rows: np.ndarray, leaf: int = LEAF, base: float = BASE) -> tuple[Tree, np.ndarray]:
    """The tree over integer rows, at least one, that are ``plain``, and the order in which it takes them."""
    x = rows.astype(np.float64)
    norm = (x * x).sum(axis=1)
    order = np.arange(len(x))
    begin, end, centre, first, children, radius = [0], [len(x)], [0], [0], [0], []
    near = np.sqrt(norm + norm[0] - 2 * (x @ x[0]))
    at = 0
    while at < len(begin):
        b, e = begin[at], end[at]
        own = order[b:e]
        d = near[own]
        radius.append(float(d.max()))
        if e - b > leaf and radius[at] > 0:
            points, sizes, centres, child = x[own], norm[own], [centre[at]], np.zeros(e - b, np.int64)
            while d[far := int(d.argmax())] > radius[at] / base:
                new = np.sqrt(sizes + sizes[far] - 2 * (points @ points[far]))
                closer = new < d
                child[closer], d[closer] = len(centres), new[closer]
                centres.append(int(own[far]))
            near[own], order[b:e] = d, own[np.argsort(child, kind="stable")]
            first[at], children[at] = len(begin), len(centres)
            ends = b + np.cumsum(np.bincount(child, minlength=len(centres)))
            begin += [b, *ends[:-1].tolist()]
            end += ends.tolist()
            centre += centres
            first += [0] * len(centres)
            children += [0] * len(centres)
        at += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    whole = [np.array(a, np.int32) for a in (begin, end, place[centre], first, children)]
    return Tree(rows[order], *whole[:3], np.array(radius), *whole[3:]), order


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows that are plain, pair by pair: whole numbers in doubles."""
    out = np.empty(len(a))
    for k in range(0, len(a), PAIRS):
        out[k : k + PAIRS] = ((a[k : k + PAIRS] - b[k : k + PAIRS]) ** 2).sum(axis=1)
    return out


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each of several ranges, one after another."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())


class Centroids:
    """The centroids of a round, with a tree over the different ones; of equal ones the smallest number stands for all."""

    def __init__(self, rows: list[list[int]]):
        self.numbers = [rows.index(r) for r in rows]
        self.numbers = np.array([k for k, n in enumerate(self.numbers) if k == n], np.int64)
        self.exact = [rows[k] for k in self.numbers]
        self.plain = all(abs(v) <= PLAIN for r in self.exact for v in r)
        if self.plain:
            self.tree, order = cover_tree(np.array(self.exact, np.int64), leaf=1)
            self.numbers = self.numbers[order]

    def nearest(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and centroid of runs of rows that cover the tree's."""
        if not self.plain or not plain(tree.rows):
            own = [min((sum((int(v) - w) ** 2 for v, w in zip(row, c, strict=True)), k) for k, c in enumerate(self.exact))[1] for row in tree.rows.tolist()]
            every = np.arange(len(own))
            return every, every + 1, np.sort(self.numbers)[own]
        c = self.tree
        x, y = tree.rows.astype(np.float64), c.rows.astype(np.float64)
        done: list[tuple] = []
        left: list[tuple[np.ndarray, np.ndarray]] = []
        v, w = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(v):
            d = np.sqrt(_squared(x[tree.centre[v]], y[c.centre[w]]))
            edge = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            size = np.diff(edge, append=len(v))
            most = np.repeat(np.minimum.reduceat(d + tree.radius[v], edge), size)
            keep = d - tree.radius[v] - c.radius[w] <= most * (1 + 1e-9) + 1e-6
            v, w = v[keep], w[keep]
            edge = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            size = np.diff(edge, append=len(v))
            inner = c.children[w] > 0
            widest = np.maximum.reduceat(np.where(inner, c.radius[w], -1.0), edge)
            node = v[edge]
            leaf = tree.children[node] == 0
            alone = (size == 1) & (widest < 0)
            done.append((tree.begin[node[alone]], tree.end[node[alone]], c.begin[w[edge[alone]]]))
            split_w = ~alone & (widest >= 0) & (leaf | (widest >= tree.radius[node]))
            compare = ~alone & ~split_w & leaf
            split_v = ~alone & ~split_w & ~leaf
            each = np.repeat(compare, size)
            left.append((v[each], c.begin[w[each]]))
            each = np.repeat(split_w, size)
            a, b, n = v[each], w[each], np.maximum(1, np.where(inner[each], c.children[w[each]], 1))
            new_v, new_w = [np.repeat(a, n)], [_spread(np.where(inner[each], c.first[b], b), n)]
            each = np.repeat(split_v, size)
            a, b = v[each], w[each]
            n = tree.children[a]
            new_v.append(_spread(tree.first[a], n))
            new_w.append(np.repeat(b, n))
            v, w = np.concatenate(new_v), np.concatenate(new_w)
            order = np.lexsort((w, v))
            v, w = v[order], w[order]
        v, w = (np.concatenate(a) for a in zip(*left, strict=True))
        if len(v):
            n = (tree.end - tree.begin)[v]
            row, to = _spread(tree.begin[v], n), np.repeat(w, n)
            # exact distances in blocks of pairs, the nearest of each row first, ties to the smaller number
            d = np.empty(len(row))
            for k in range(0, len(row), PAIRS):
                d[k : k + PAIRS] = _squared(x[row[k : k + PAIRS]], y[to[k : k + PAIRS]])
            order = np.lexsort((self.numbers[to], d, row))
            row, to = row[order], to[order]
            best = np.r_[True, row[1:] != row[:-1]]
            done.append((row[best], row[best] + 1, to[best]))
        begin, end, to = (np.concatenate(a) for a in zip(*done, strict=True))
        return begin.astype(np.int64), end.astype(np.int64), self.numbers[to]


def _build(width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        rows: list[np.ndarray] = []

        def trees() -> Iterator[pa.RecordBatch]:
            x, names = np.concatenate(rows), pa.concat_arrays(ids)
            small = np.abs(x).max(axis=1) <= PLAIN
            for part in (np.flatnonzero(small), np.flatnonzero(~small)):
                if len(part):
                    tree, order = cover_tree(x[part]) if small[part[0]] else (lone_leaf(x[part]), np.arange(len(part)))
                    found = [names.take(pa.array(part[order])), pa.array(tree.rows.ravel()), *map(pa.array, tree.nodes())]
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in found], names=[c.split()[0] for c in TREES.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                ids.append(part.column(0))
                rows.append(quantised(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale))
                if sum(map(len, rows)) >= TREE:
                    yield from trees()
                    ids, rows = [], []
        if rows:
            yield from trees()

    return run


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, rows, *nodes = (batch.column(c).slice(k, 1).flatten() for c in range(batch.num_columns))
            yield ids, Tree(rows.to_numpy().reshape(-1, width), *(a.to_numpy() for a in nodes))


def _sums(centroids: list[list[int]], width: int):
    """Of every centroid, in this task: the number of its vectors (part -1) and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, total = Centroids(centroids), [[0] * (width + 1) for _ in centroids]
        for _, tree in _read(batches, width):
            begin, end, number = to.nearest(tree)
            rows = tree.rows if plain(tree.rows) else tree.rows.astype(object)
            upto = np.concatenate([np.zeros((1, width), rows.dtype), np.cumsum(rows, axis=0)])
            sums = np.zeros((len(centroids), width + 1), rows.dtype)
            np.add.at(sums, number, np.column_stack([end - begin, upto[end] - upto[begin]]))
            for own, more in zip(total, sums.tolist(), strict=True):
                own[:] = map(sum, zip(own, more, strict=True))
        kept = [(k, p - 1, Decimal(v)) for k, own in enumerate(total) if own[0] for p, v in enumerate(own)]
        if kept:
            k, p, v = zip(*kept, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(v, pa.decimal128(38))], names=["cluster", "part", "total"])

    return run


def _place(centroids: list[list[int]], width: int):
    """Every vector's centroid and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Centroids(centroids)
        exact = np.array(centroids, object)
        for ids, tree in _read(batches, width):
            begin, end, number = to.nearest(tree)
            own = np.empty(len(tree.rows), np.int64)
            own[_spread(begin, end - begin)] = np.repeat(number, end - begin)
            if to.plain and plain(tree.rows):
                distance = _squared(tree.rows.astype(np.float64), exact.astype(np.float64)[own]).astype(np.int64)
            else:
                distance = np.array([min(LONG, sum((a - b) ** 2 for a, b in zip(r, centroids[k], strict=True))) for r, k in zip(tree.rows.tolist(), own, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector (vec_id, embedding) that is kept."""
    spark = table.sparkSession
    scratch = Scratch(spark, "clusters")
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(name, "embedding").limit(k).select("embedding").collect()
    if not first:
        first = [[[0.0] * width]]
    centroids = quantised(np.array([r[0] for r in first], np.float64), scale).tolist()
    trees = scratch.save(kept.mapInArrow(_build(width, scale), TREES), "trees")
    for _ in range(rounds):
        found = trees.mapInArrow(_sums(centroids, width), SUMS).groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
        total = {(r.cluster, r.part): int(r.total) for r in found}
        new = [[total[c, p] // total[c, -1] for p in range(width)] if (c, -1) in total else own for c, own in enumerate(centroids)]
        if new == centroids:
            break
        centroids = new
    placed = scratch.save(trees.mapInArrow(_place(centroids, width), PLACED), "placed")
    inertia = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    every = min(LONG, sum(inertia.values()))
    facts = [(c, min(LONG, inertia.get(c, 0)), every, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()) for c, own in enumerate(centroids)]
    return placed.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, scale: int = SCALE) -> str:
    """The same in SQL: every round compares every vector with every centroid."""
    ctes = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT n, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT v.n, c.cluster, list_sum(list_transform(range(1, {width + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d FROM v, c{r} c
  ) GROUP BY n
)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM (
      SELECT a.cluster, i, sum(v.q[i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN v USING (n), range(1, {width + 1}) t(i) GROUP BY a.cluster, i
    ) GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""WITH {", ".join(ctes)}
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
  sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (n) JOIN c{rounds} c ON c.cluster = a.cluster"""
