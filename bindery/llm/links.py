"""What the similarity joins share: tiles of candidate buckets, runs of sorted rows, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch
from bindery.llm.words import released

#: Members of a bucket that one side of a tile may hold, and the salts that a hot bucket's members are dealt to.
CHUNK = 512
SALTS = 8


def tiles(entries: DataFrame, bucket: list[str], member: str, chunk: int = CHUNK, salts: int = SALTS, weight: str | None = None, most: int = 0) -> DataFrame:
    """Members of every bucket of two or more, once for each tile they take part in: bucket, tile_i, tile_j, side.

    A bucket of up to ``chunk`` members is one tile. A larger one is dealt into chunks by hash, and every pair of chunks is
    a tile of its own, so no task holds a bucket: a tile has at most about two chunks. With a ``weight`` column, a chunk also
    holds about ``most`` of it, or one member. Bucket sizes are
    counted with partial sums and joined to salted entries, so a hot bucket's rows are spread before its size is known.
    """
    weighs = F.sum(weight) / most if weight else F.lit(0.0)
    sizes = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_size"), weighs.alias("_weighs")).where("_size > 1")
    salted = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = F.pmod(F.xxhash64(member), F.lit(salts)).cast("int")
    found = entries.withColumn("_salt", own).join(salted, [*bucket, "_salt"]).drop("_salt")
    n = F.greatest(F.ceil(F.col("_size") / chunk), F.least(F.ceil("_weighs"), F.col("_size"))).cast("int")
    found = found.withColumn("_n", n).withColumn("side", F.pmod(F.xxhash64(member, F.lit(1)), F.col("_n")).cast("int"))
    found = found.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return found.withColumn("tile_i", F.least("side", "_other")).withColumn("tile_j", F.greatest("side", "_other")).drop("_size", "_weighs", "_n", "_other")


TILE = ["tile_i", "tile_j"]


def by_tile(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """The rows of a tile one after another in one partition."""
    return rows.repartition(*bucket, *TILE).sortWithinPartitions(*bucket, *TILE)


def run_edges(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where each run of equal first n_keys columns begins (the first row included)."""
    new = np.zeros(batch.num_rows, bool)
    if batch.num_rows:
        new[0] = True
    for k in range(n_keys):
        x = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut at the ends of runs, with the start of each run and the number of rows at the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = run_edges(batch, n_keys)
        if held:
            last, first = held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)
            same = all(last.column(k)[0].equals(first.column(k)[0]) for k in range(n_keys))
            cut = int(edges[1]) if same and len(edges) > 1 else batch.num_rows if same else 0
        else:
            same, cut = True, 0
        if held and cut < batch.num_rows:
            ready = joined([*held, batch.slice(0, cut)])
            yield ready, np.append(run_edges(ready, n_keys), ready.num_rows)
            held = []
        elif held:
            held.append(batch)
            continue
        start = int(edges[-1])
        if start > cut:
            ready = batch.slice(cut, start - cut)
            yield ready, np.append(run_edges(ready, n_keys), ready.num_rows)
        held = [batch.slice(max(start, cut))]
    if held:
        ready = joined(held)
        yield ready, np.append(run_edges(ready, n_keys), ready.num_rows)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    found = table.to_batches()
    return found[0] if found else batches[0]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches by the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of the edges (a, b: long; a written table, as it is read again).

    Alternating large-star and small-star steps, each a group minimum joined back to the edges and written to the
    shared folder, until every edge leads to a node that none leads on from; the number of rounds grows with the
    logarithm of the longest path.
    """
    scratch = Scratch(edges.sparkSession, name)
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    held, step = edges.where("a <> b").select(a, b).distinct(), 0
    while True:
        # large star: the larger neighbours of a node are linked to the smallest of its neighbours and itself
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        linked = large.join(least, "a")
        small = linked.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select("a", F.col("_m").alias("b")))
        step += 1
        held = scratch.save(small.select(a, b).where("a <> b").distinct(), f"edges{step}", few=True)
        if step > 1:
            scratch.drop(f"edges{step - 1}")
        # a node with two edges, or one that is led to and leads on, is not settled
        open_ends = held.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("of")).union(held.select(F.col("b").alias("a"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("of")).distinct())
        if not open_ends.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").limit(1).count():
            break
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def map_runs(rows: DataFrame, n_keys: int, work: Callable, schema: str) -> DataFrame:
    """mapInArrow over whole runs: work(batch, edges) yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_runs(batches, n_keys):
            yield from work(batch, edges)

    return rows.mapInArrow(released(run), schema)
