"""Embedding near-duplicates by lattice hashing.

A vector is turned by random rotations; each table takes ``8 * BLOCKS`` of the turned coordinates and decodes every 8 of
them to the nearest point of a scaled E8 lattice. A vector is entered in the cells of its nearest points and of the
next nearest ones (every combination over the blocks), in every table; vectors of one label that share a cell of any
table are compared by cosine in double precision. Coordinates are computed on whole numbers, exactly, so
that a cell is the same wherever it is worked out; a pair found in several cells counts in the least of them alone.

Equal vectors of one label are one class with a multiplicity, so copies are never paired with each other row by row.
At cosine 0.93 a pair shares a cell with probability about 0.999 (see the README for measured recall); closer
pairs nearly always do, and no pair below the threshold is ever linked.

Defined cases: a null label, or a vector that is null, empty, zero or holds null, NaN or infinite components, links with
nothing (n_links 0, its own component); vectors of different length never link; a row with a null ``vec_id`` links with
nothing, has a null component and is not kept; rows that share a ``vec_id`` are vectors of their own, and count as links of
each other if close enough; of equal least ids there is nothing to choose. An empty table gives an empty result. Extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.links import by_tile, components, map_runs, roots, tiles
from bindery.llm.scratch import Scratch
from bindery.llm.words import mixed, released

THRESHOLD = 0.93
TABLES, BLOCKS = 12, 2
#: Lattice scale as a share of the root mean square norm of 8 coordinates of a turned unit vector.
SCALE = 0.72
SEED = 42
#: Whole-number grids of vectors and rotations: products of up to 2**20 components stay below 2**53.
GRID, TURN = 1 << 17, 1 << 15


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: whole coordinates with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, which is D8 and D8 moved by one half in every coordinate."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def neighbour(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The lattice point next to ``point``, one shortest vector away, that x leans to most."""
    rest = x - point
    sign = np.where(rest >= 0, 1.0, -1.0)
    order = np.argsort(-np.abs(rest), axis=1, kind="stable")
    two = np.zeros_like(rest)
    np.put_along_axis(two, order[:, :2], 1.0, axis=1)
    two *= sign
    half = 0.5 * sign
    odd = np.flatnonzero((sign < 0).sum(axis=1) % 2)
    half[odd, order[odd, 7]] *= -1
    best = (rest * two).sum(axis=1) >= (rest * half).sum(axis=1)
    return point + np.where(best[:, None], two, half)


class Cells:
    """Cell keys of unit vectors of one length."""

    def __init__(self, length: int, tables: int = TABLES, blocks: int = BLOCKS, seed: int = SEED):
        wide = 8 * blocks
        self.length, self.tables, self.blocks = length, tables, blocks
        self.padded = -(-length // wide) * wide
        rng = np.random.default_rng((seed, length))
        turns = [np.linalg.qr(rng.normal(size=(self.padded, self.padded)))[0] for _ in range(-(-tables * wide // self.padded))]
        self.turn = np.rint(np.hstack(turns)[:length, : tables * wide] * TURN)
        self.step = SCALE * np.sqrt(8 / self.padded) * GRID * TURN

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Keys (unsigned 64-bit) of shape (vectors, tables * 2**blocks)."""
        n = len(unit)
        turned = (np.rint(unit * GRID) @ self.turn) / self.step
        x = turned.reshape(-1, 8)
        first = decode(x)
        second = neighbour(x, first)
        hashed = []
        for point in (first, second):
            cell = (2 * point).astype(np.int64).astype(np.uint64)
            h = np.zeros(len(cell), np.uint64)
            for k in range(8):
                h = mixed(h + cell[:, k] + np.uint64(k + 1))
            hashed.append(h.reshape(n, self.tables, self.blocks))
        out = np.zeros((n, self.tables, 1 << self.blocks), np.uint64)
        table = mixed(np.arange(self.tables).astype(np.uint64) + np.uint64(self.length << 20))[None, :]
        for combination in range(1 << self.blocks):
            h = np.broadcast_to(table, (n, self.tables)).copy()
            for b in range(self.blocks):
                h = mixed(h * np.uint64(31) + hashed[combination >> b & 1][:, :, b])
            out[:, :, combination] = h
        return out.reshape(n, -1)


_cells: dict[tuple, Cells] = {}


def cells(length: int, tables: int, blocks: int) -> Cells:
    if (length, tables, blocks) not in _cells:
        _cells[length, tables, blocks] = Cells(length, tables, blocks)
    return _cells[length, tables, blocks]


def unit(raw: list[bytes], kind: str = "f8") -> np.ndarray:
    """Vectors of one length, of doubles (or floats), scaled to length 1 in double precision without overflow."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(kind: str):
    """vec_id, label, vector as bytes and their two 64-bit hashes, or nulls if the vector takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, column = (batch.column(k) for k in range(3))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            size = np.where(np.asarray(column.is_null()), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            ends = np.cumsum(size)
            fine = ~np.asarray(ids.is_null()) & ~np.asarray(labels.is_null()) & (size > 0)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            nonzero = np.concatenate([[0], np.cumsum(flat != 0)])
            fine &= (bad[ends] == bad[ends - size]) & (nonzero[ends] > nonzero[ends - size])
            raw = [flat[b - n : b].tobytes() if f else None for b, n, f in zip(ends.tolist(), size.tolist(), fine.tolist(), strict=True)]
            hashes = np.array([xxhash.xxh3_128_intdigest(r).to_bytes(16) if r is not None else bytes(16) for r in raw]).view("<i8").reshape(-1, 2) if raw else np.zeros((0, 2), np.int64)
            one, two = (pa.array(hashes[:, k], pa.int64(), mask=~fine) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(raw, pa.binary()), one, two], names=["vec_id", "label", "raw", "h1", "h2"])

    return run


def _by_length(raw: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, unit([raw[k] for k in rows.tolist()], kind)


def _entries(tables: int, blocks: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                for rows, x in _by_length(some.column(2).to_pylist(), kind):
                    keys = np.sort(cells(x.shape[1], tables, blocks).keys(x), axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row = np.repeat(rows, new.sum(axis=1))
                    yield pa.RecordBatch.from_arrays([some.column(1).take(pa.array(row)), pa.array(keys[new].view(np.int64)), some.column(0).take(pa.array(row))], names=["label", "cell", "cid"])

    return run


def _links(threshold: float, tables: int, blocks: int, kind: str):
    """Verified links of each tile: for every member its linked multiplicity and the least member it is joined to."""

    def pairs(x: np.ndarray, side: np.ndarray, tile: tuple[int, int], key: int) -> tuple[np.ndarray, np.ndarray]:
        score = x @ x.T
        hit = np.triu(score >= threshold, 1)
        if tile[0] != tile[1]:
            hit &= side[:, None] != side[None, :]
        a, b = np.nonzero(hit)
        return _own(x, a, b, key)

    def _own(x: np.ndarray, a: np.ndarray, b: np.ndarray, key: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs whose least common cell is this one."""
        if not len(a):
            return a, b
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        keys = cells(x.shape[1], tables, blocks).keys(x[used])
        p, q = place[: len(a)], place[len(a) :]
        n, groups = keys.shape[1], 1 << blocks
        own = np.zeros(len(a), bool)
        for at in range(0, len(a), 4096):
            s = slice(at, at + 4096)
            u, v = (keys[i].reshape(-1, n // groups, groups) for i in (p[s], q[s]))
            # cells of different tables differ, so only those of one table are compared
            same = (u[:, :, :, None] == v[:, :, None, :]).any(axis=3)
            least = np.where(same, u, np.uint64(2**64 - 1)).reshape(len(u), -1).min(axis=1)
            own[s] = least == (key if np.isscalar(key) or isinstance(key, np.uint64) else key[s])
        return a[own], b[own]

    def work(batch: pa.RecordBatch, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell = batch.column(1).to_numpy().view(np.uint64)
        ti, tj, side = (batch.column(k).to_numpy() for k in (2, 3, 4))
        cid, many = batch.column(5).to_numpy(), batch.column(6).to_numpy()
        raw = batch.column(7).to_pylist()
        size = np.diff(edges)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        a_all, b_all = [], []
        for n in np.unique(size).tolist():
            if n < 2:
                continue
            starts = edges[:-1][size == n]
            if n > 24:
                for s in starts.tolist():
                    rows = np.arange(s, s + n)
                    for width in np.unique(lengths[rows]):
                        few = rows[lengths[rows] == width]
                        a, b = pairs(unit([raw[k] for k in few.tolist()], kind), side[few], (ti[s], tj[s]), cell[s])
                        a_all.append(few[a])
                        b_all.append(few[b])
                continue
            # small tiles of one size are multiplied together
            step = max(1, 40_000 // (n * n))
            for at in range(0, len(starts), step):
                rows = starts[at : at + step][:, None] + np.arange(n)
                one = (lengths[rows] == lengths[rows][:, :1]).all(axis=1)
                for r in rows[~one]:
                    for width in np.unique(lengths[r]):
                        few = r[lengths[r] == width]
                        a, b = pairs(unit([raw[k] for k in few.tolist()], kind), side[few], (ti[r[0]], tj[r[0]]), cell[r[0]])
                        a_all.append(few[a])
                        b_all.append(few[b])
                rows = rows[one]
                for width in np.unique(lengths[rows[:, 0]]) if len(rows) else ():
                    some = rows[lengths[rows[:, 0]] == width]
                    x = unit([raw[k] for k in some.ravel().tolist()], kind)
                    cube = x.reshape(len(some), n, -1)
                    hit = np.triu(np.matmul(cube, cube.transpose(0, 2, 1)) >= threshold, 1)
                    apart = (ti[some[:, 0]] == tj[some[:, 0]])[:, None, None] | (side[some][:, :, None] != side[some][:, None, :])
                    t, a, b = np.nonzero(hit & apart)
                    a, b = t * n + a, t * n + b
                    a, b = _own(x, a, b, cell[some[:, 0]][t])
                    flat = some.ravel()
                    a_all.append(flat[a])
                    b_all.append(flat[b])
        if not a_all or not sum(map(len, a_all)):
            return
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        both = np.concatenate([a, b])
        linked = np.bincount(both, np.concatenate([many[b], many[a]]), len(cid)).astype(np.int64)
        used = np.unique(both)
        root = roots(len(cid), a, b)
        yield pa.RecordBatch.from_arrays([pa.array(cid[used]), pa.array(linked[used]), pa.array(cid[root[used]])], names=["cid", "linked", "root"])

    return work


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, n_tables: int = TABLES, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    spark = table.sparkSession
    scratch = Scratch(spark, "lattice")
    # floats stay floats as they travel; every use is in double precision
    kind, element = ("f4", "float") if table.schema["embedding"].dataType.simpleString() == "array<float>" else ("f8", "double")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    label = rows.schema["label"].dataType.simpleString()
    packed = scratch.save(rows.mapInArrow(released(_packed(kind)), f"vec_id long, label {label}, raw binary, h1 long, h2 long"), "packed")
    same = ["label", "h1", "h2"]
    classes = packed.where("raw is not null").groupBy(*same).agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("least"), F.min("raw").alias("raw"))
    # written once, so that the numbers stay
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    entries = scratch.save(classes.select("cid", "label", "raw").mapInArrow(released(_entries(n_tables, blocks, kind)), f"label {label}, cell long, cid long"), "entries")
    members = tiles(entries, ["label", "cell"], "cid").join(classes.select("cid", "many", "raw"), "cid")
    members = by_tile(members.select("label", "cell", "tile_i", "tile_j", "side", "cid", "many", "raw"), ["label", "cell"])
    linked = scratch.save(map_runs(members, 4, _links(threshold, n_tables, blocks, kind), "cid long, linked long, root long"), "linked")
    scratch.drop("entries")
    group = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")), "lattice-components")
    # a component's least id is that of its classes; a class without links has its own
    first = group.join(classes.select(F.col("cid").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("of_component"))
    linked = group.join(first, "component").join(linked.groupBy(F.col("cid").alias("node")).agg(F.sum("linked").alias("linked")), "node", "left")
    found = classes.select("cid", *same, "many", "least").join(linked.withColumnRenamed("node", "cid"), "cid", "left")
    found = found.select(*same, F.coalesce("of_component", "least").alias("component_id"), (F.col("many") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = packed.select("vec_id", *same).join(found, same, "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def oracle() -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings
),
f AS (SELECT * FROM v WHERE fine),
l AS (
  SELECT a.r AS a, b.r AS b FROM f a JOIN f b
    ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
),
g(r, m) AS (SELECT r, r FROM v UNION SELECT l.b, g.m FROM g JOIN l ON l.a = g.r),
c AS (SELECT g.r AS r, min(w.vec_id) AS component_id FROM g JOIN v w ON w.r = g.m GROUP BY g.r),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
