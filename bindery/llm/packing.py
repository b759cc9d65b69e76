"""Best-fit packing of token sequences, in bulk-synchronous sweeps.

Documents are tokenised and cut into pieces of at most ``SEQUENCE`` tokens; pieces are range-sorted by falling
length over the cluster, which gives each its rank. The open gaps of the sequences are a table too, range-sorted by size. Pieces
are placed in rounds, each a band of lengths (over a half of a sequence, over a quarter, ...). A round's sweep gives
every length, the longest first, the successor of its length among the gap sizes, and where pieces of one length meet gaps of one
size, conflicts are resolved by rank: the first piece takes the first gap. Sizes are at most ``SEQUENCE``, so what is decided once for
all pieces of a length, the runs (length, first rank, gap size, first gap, count), is a list of bounded size, made from the counts
of lengths and gap sizes. Pieces find their run by their rank and so the number of their gap where they are, are joined with the gaps
on it, and what they take is subtracted from the gaps, which are sorted again for the next round.

Gaps of one size are alike, so the result is that of best-fit decreasing over all pieces at once, with a fixed number of rounds.

Defined cases: a null text is empty (one piece of the end id); null and repeated ``doc_id`` are kept as they are, each row
a document of its own; rows equal in id and text have equal pieces, which take neighbouring ranks; pieces of one length and gaps of one size
are ranked by their other columns; a text of any length is tokenised whole; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch
from bindery.llm.tokens import encoder, vocabulary_path
from bindery.llm.words import released, slices

SEQUENCE = 1024
#: Rounds: lengths over a half, over a quarter, ... of a sequence, and the rest.
ROUNDS = 5
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
RANKED = f"{PIECE}, part int, place long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece numbers, starts and lengths of documents of the given lengths: the first takes what full pieces leave over."""
    parts = -(-n // most)
    piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(n - (parts - 1) * most, parts)
    return piece, np.where(piece == 0, 0, first + (piece - 1) * most), np.where(piece == 0, first, most)


def _pieces(vocabulary: str, most: int, with_ids: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for some in slices(batch, 1):
                ids, n = encode.batch(some.column(1).to_pylist())
                piece, start, length = cut(n, most)
                ends = np.cumsum(length)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
                number = some.column(0).take(pa.array(np.repeat(np.arange(len(n)), -(-n // most))))
                arrays = [number, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, most: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(released(_pieces(vocabulary or vocabulary_path(), most, with_ids)), PIECE + (", ids array<int>" if with_ids else ""))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n))], names=[*batch.schema.names, "part", "place"])
        seen += n


class Sweeps:
    """The sweeps of one round: runs of gaps by size, and for each run of ranks which gaps its pieces take.

    ``first``: first rank of a placement; ``number``: the gap of that rank, the next rank having the next one; ``offset``: the
    place in its sequence. New sequences are gaps numbered on from those there are.
    """

    def __init__(self, most: int, rank: int = 0, gaps: dict[int, int] | None = None):
        """gaps: how many there are of each size, numbered by rising size."""
        self.most, self.rank, self.opened = most, rank, 0
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.n_gaps = 0
        for size, n in sorted((gaps or {}).items()):
            self.runs[size] = [(self.n_gaps, n)]
            self.n_gaps += n
        self.sizes = sorted(self.runs)
        self.first: list[int] = []
        self.number: list[int] = []
        self.offset: list[int] = []

    def _gap(self, size: int, number: int, count: int) -> None:
        if size > 0 and count > 0:
            if size not in self.runs:
                bisect.insort(self.sizes, size)
            self.runs.setdefault(size, []).append((number, count))

    def _fill(self, gap: int, number: int, room: int, length: int, count: int) -> int:
        """Put up to ``count`` pieces into ``room`` equal gaps, each filled before the next; returns how many went in."""
        deep = gap // length
        count = min(count, room * deep)
        full, rest = divmod(count, deep)
        for layer in range(deep):
            if here := full + (layer < rest):
                self.first.append(self.rank)
                self.number.append(number)
                self.offset.append(self.most - gap + layer * length)
                self.rank += here
        self._gap(gap - deep * length, number, full)
        self._gap(gap - rest * length, number + full, 1 if rest else 0)
        self._gap(gap, number + full + (rest > 0), room - full - (rest > 0))
        return count

    def place(self, length: int, count: int) -> None:
        """One sweep: the next ``count`` ranks are pieces of this length; lengths come falling."""
        while count:
            at = bisect.bisect_left(self.sizes, length)
            if at == len(self.sizes):
                new = -(-count // (self.most // length))
                number = self.n_gaps + self.opened
                self.opened += new
                count -= self._fill(self.most, number, new, length, count)
                continue
            size = self.sizes[at]
            number, room = self.runs[size].pop(0)
            if not self.runs[size]:
                del self.runs[size], self.sizes[at]
            count -= self._fill(size, number, room, length, count)


def bands(most: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(least, most) lengths of each round."""
    ends = [most >> k for k in range(rounds)] + [0]
    return [(low + 1, high) for high, low in zip(ends, ends[1:], strict=False) if high > low]


def _global(base: dict[int, int], part: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers over all partitions of rows numbered within each."""
    known = {p: base[p] for p in np.unique(part).tolist()}
    return place + np.array([known[p] for p in part.tolist()], np.int64)


def _assign(base: dict[int, int], sweeps: Sweeps):
    first, number, offset = (np.array(x, np.int64) for x in (sweeps.first, sweeps.number, sweeps.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = _global(base, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (5, 6)))
            at = np.searchsorted(first, rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), batch.column(3).cast(pa.int64()), batch.column(4), pa.array(number[at] + rank - first[at]), pa.array(offset[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "number", "offset"],
            )

    return run


def _gap_numbers(base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = _global(base, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0), batch.column(1)], names=["number", "sequence_id", "gap"])

    return run


def _counted(rows: DataFrame, size: str) -> tuple[dict[int, int], dict[int, int]]:
    """The number of rows before each range partition, and of each size: a row for each partition and each size in it."""
    found = rows.groupBy("part", size).count().collect()
    by_part: dict[int, int] = {}
    by_size: dict[int, int] = {}
    for r in found:
        by_part[r["part"]] = by_part.get(r["part"], 0) + r["count"]
        by_size[r[size]] = by_size.get(r[size], 0) + r["count"]
    parts = sorted(by_part)
    return dict(zip(parts, np.cumsum([0, *(by_part[p] for p in parts)]).tolist(), strict=False)), by_size


def pack(docs: DataFrame, vocabulary: str | None = None, most: int = SEQUENCE, rounds: int = ROUNDS) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut_up = scratch.save(pieces(docs, vocabulary, most), "pieces")
    key = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = scratch.save(cut_up.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(released(_numbered), RANKED), "ranked")
    scratch.drop("pieces")
    base, lengths = _counted(ranked, "length")
    rank, n_sequences, left = 0, 0, sum(lengths.values())
    out: DataFrame | None = None
    gaps: DataFrame | None = None
    sizes: dict[int, int] = {}
    for low, high in bands(most, rounds):
        own = {n: c for n, c in lengths.items() if low <= n <= high}
        if not own:
            continue
        sweeps = Sweeps(most, rank, sizes)
        for n in sorted(own, reverse=True):
            sweeps.place(n, own[n])
        rank, left = sweeps.rank, left - sum(own.values())
        placed = ranked.where(F.col("length").between(low, high)).mapInArrow(released(_assign(base, sweeps)), PLACED.replace("sequence_id", "number"))
        new = F.col("number") - (sweeps.n_gaps - n_sequences)
        found = placed.withColumn("sequence_id", new) if gaps is None else placed.join(gaps.select("number", F.col("sequence_id").alias("_held")), "number", "left").withColumn("sequence_id", F.coalesce("_held", new))
        found = found.select(*(c.split()[0] for c in PLACED.split(", ")))
        out = found if out is None else out.union(found)
        if left:
            # what a sequence holds is what its last piece ends at; sequences without new pieces stay as they are
            filled = found.groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("end"))
            open_now = filled.select("sequence_id", (most - F.col("end")).cast("int").alias("gap"))
            if gaps is not None:
                open_now = open_now.union(gaps.join(filled, "sequence_id", "left_anti").select("sequence_id", "gap"))
            order = ["gap", "sequence_id"]
            open_now = open_now.where("gap > 0").repartitionByRange(*order).sortWithinPartitions(*order)
            table = scratch.save(open_now.mapInArrow(released(_numbered), "sequence_id long, gap int, part int, place long"), f"gaps{low}")
            before, sizes = _counted(table, "gap")
            gaps = table.mapInArrow(released(_gap_numbers(before)), "number long, sequence_id long, gap int")
        n_sequences += sweeps.opened
    return spark.createDataFrame([], PLACED) if out is None else out


def assemble(docs: DataFrame, placed: DataFrame, vocabulary: str | None = None, most: int = SEQUENCE) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, each bounded by ``most`` ids."""
    found = pieces(docs, vocabulary, most, with_ids=True).dropDuplicates(["doc_id", "piece", "ids_crc32"])
    on = (found.doc_id.eqNullSafe(placed.doc_id)) & (found.piece == placed.piece) & (found.ids_crc32 == placed.ids_crc32)
    rows = placed.join(found.select("doc_id", "piece", "ids_crc32", "ids"), on).select("sequence_id", "offset", "ids")
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
