"""Exact top-k inner-product search: tiled matrix products, partial selection per tile, tree merging.

Queries are dealt into blocks and candidates into shards, by hash; every shard meets every block in one job, as a cell: the
block's rows first, then the shard's, which are multiplied tile by tile. A tile's best candidates are selected
from its score matrix, whose size is a parameter, and joined with the best so far; a cell yields at most k rows a query. These
partial lists are merged in a tree whose fan-in is fixed, so that no task sees more than ``FAN_IN * k`` rows a query however
many shards there are. Numbers of blocks and shards follow from the numbers of rows, so a block, a shard and a tile are bounded at
every size; each candidate travels once for each block, each query once for each shard.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, as queries or as
candidates; rows with a null ``vec_id`` neither. Empty vectors have inner product 0 with each other. Only vectors of one
length are compared. Ties go to the smaller id. A query is left out of its own candidates by its id, so all rows that
share its ``vec_id`` are; repeated rows of another id are candidates each; queries that repeat in id and vector are one. Fewer
than k candidates give fewer rows. A score beyond 64 bits is the largest 64-bit integer or
its negative (plus 1). An empty table gives
an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch

K = 10
SCALE = 1024
#: Queries of a block, candidates of a shard, and scores that a tile may have.
QUERY_BLOCK, SHARD = 4096, 16_384
TILE_SCORES = 2_000_000
FAN_IN = 32
CELL = "shard int, block int, candidate boolean, vec_id long, embedding array<double>"
PARTIAL = "query_id long, vec_id long, score long, part int"
_MOST = np.iinfo(np.int64).max
_LEAST = -_MOST


def quantised(column: pa.Array, ids: pa.Array, scale: int = SCALE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer matrix as doubles) per vector length, without rows that take no part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    keep = np.flatnonzero(~np.asarray(column.is_null()) & ~np.asarray(ids.is_null()))
    out = []
    if not len(keep):
        return out
    column, number = column.take(pa.array(keep)), ids.take(pa.array(keep)).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        matrix = flat[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            out.append((number[rows[fine]], np.nan_to_num(np.floor(scale * matrix[fine]))))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles where no sum can pass 2**53, else, for the few vectors that are so large, in
    whole numbers of any size, held to 64 bits."""
    large = [np.abs(x).max(axis=1, initial=0) for x in (a, b)]
    most = 2.0**53 / max(1, a.shape[1])
    if float(large[0].max(initial=0)) * float(large[1].max(initial=0)) < most:
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    # vectors that fit with all of ordinary size, and the others one after another
    plain = [x < np.sqrt(most) for x in large]
    out[np.ix_(*plain)] = (a[plain[0]] @ b[plain[1]].T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in x] for x in (a, b)]
    for i, j in zip(*np.nonzero(~(plain[0][:, None] & plain[1][None, :])), strict=True):
        out[i, j] = min(max(sum(x * y for x, y in zip(whole[0][i], whole[1][j], strict=True)), _LEAST + 1), _MOST)
    return out


def select(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and column numbers of each row's k best, ties to the smaller id; ids must rise along columns."""
    if score.shape[1] > k:
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        above = score > kth
        level = score == kth
        room = k - above.sum(axis=1, keepdims=True)
        return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))
    return tuple(x.ravel() for x in np.indices(score.shape))


def _cells(k: int, scale: int):
    """mapInArrow function over rows sorted by shard and block, queries first: the best k candidates of each cell's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple[int, int] | None = None
        queries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        best: dict[int, tuple] = {}

        def end() -> Iterator[pa.RecordBatch]:
            for row, ids, score in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids), pa.array(score), pa.array(np.full(len(ids), cell[0], np.int32))], names=["query_id", "vec_id", "score", "part"])

        for batch in batches:
            shard, block, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                if (here := (int(shard[s]), int(block[s]))) != cell:
                    yield from end()
                    cell, queries, best = here, {}, {}
                for ids, matrix in quantised(batch.column(4).slice(s, e - s), batch.column(3).slice(s, e - s), scale):
                    width = matrix.shape[1]
                    if not side[s]:
                        queries.setdefault(width, []).append((ids, matrix))
                        continue
                    if width not in queries:
                        continue
                    if len(queries[width]) > 1:
                        queries[width] = [tuple(np.concatenate(x) for x in zip(*queries[width], strict=True))]
                    asked, rows = queries[width][0]
                    order = np.argsort(ids, kind="stable")
                    step = max(k, TILE_SCORES // len(asked))
                    for at in range(0, len(ids), step):
                        tile = ids[order[at : at + step]]
                        score = products(rows, matrix[order[at : at + step]])
                        own = asked[:, None] == tile[None, :]
                        score[own] = _LEAST
                        row, col = select(score, tile, k)
                        fine = ~own[row, col]
                        got = (asked[row[fine]], tile[col[fine]], score[row, col][fine])
                        best[width] = _merge([best[width], got] if width in best else [got], k)
        yield from end()

    return run


def _merge(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, ids, score = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    fine = rank < k
    return row[fine], ids[fine], score[fine]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query (both: vec_id, embedding)."""
    spark = candidates.sparkSession
    scratch = Scratch(spark, "topk")
    vec = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    table = candidates.select(*vec).where("vec_id is not null and embedding is not null")
    asked = scratch.save(queries.select(*vec).where("vec_id is not null and embedding is not null").dropDuplicates(["vec_id", "embedding"]), "queries")
    n_blocks, n_shards = max(1, -(-asked.count() // query_block)), max(1, -(-table.count() // shard))

    def dealt(n: int):
        return F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.select(every(n_shards).alias("shard"), dealt(n_blocks).alias("block"), F.lit(False).alias("candidate"), "vec_id", "embedding")
    right = table.select(dealt(n_shards).alias("shard"), every(n_blocks).alias("block"), F.lit(True).alias("candidate"), "vec_id", "embedding")
    cells = left.unionByName(right).repartition("shard", "block").sortWithinPartitions("shard", "block", "candidate")
    merged = scratch.save(cells.mapInArrow(_cells(k, scale), PARTIAL), "partial")
    best, n_parts = Window.orderBy(F.col("score").desc(), F.col("vec_id")), n_shards
    while n_parts > FAN_IN:
        merged = merged.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        merged = merged.withColumn("_n", F.row_number().over(best.partitionBy("query_id", "part"))).where(F.col("_n") <= k).drop("_n")
        n_parts = -(-n_parts // FAN_IN)
    return (
        merged.withColumn("rank", F.row_number().over(best.partitionBy("query_id")))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
