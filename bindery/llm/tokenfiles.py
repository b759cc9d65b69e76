"""Token-id output: whole texts as ids in Simple-8b segments, written in rising doc_id order and read back.

Rows are range-partitioned by doc_id and sorted, so the segments in the order of part and number hold all documents in order. A
segment is a whole Simple-8b file of about ``SEGMENT_IDS`` ids (see ``simple8b``): header, document numbers and lengths, offsets
of its blocks, packed words. Segments are written as binary values of a table, by Spark's own writer and committers, to any
folder that Spark can write to; a lost task leaves nothing behind. Each can be decoded alone, and so can each of its blocks.

Defined cases: a null text is empty (its only id is the end id); a null doc_id sorts first and stays null; rows of one
doc_id are ordered by their text's checksum and length; a text of any length is encoded whole, in one segment; an empty table gives
no segments and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch
from bindery.llm.simple8b import Reader, pack_file
from bindery.llm.tokens import encoder, vocabulary_path
from bindery.llm.words import SOME_ROWS, released, slices

SEGMENT_IDS = 1_000_000
SEGMENT = "part int, segment int, n_docs long, n_ids long, first_id long, data binary"
DOCUMENT = "part int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long"


def _segments(vocabulary: str, segment_ids: int, some_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, first = TaskContext.get().partitionId(), 0, 0
        encode = encoder(vocabulary)
        numbers: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal segment, first
            ids = np.concatenate(held)
            data = pack_file(numbers, np.concatenate(lengths), ids)
            row = [[part], [segment], [len(numbers)], [len(ids)], [first], [data]]
            segment, first = segment + 1, first + len(ids)
            numbers.clear(), lengths.clear(), held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in SEGMENT.split(", ")])

        for rows in (s for batch in batches for s in slices(batch, 1, some_rows)):
            ids, n = encode.batch(rows.column(1).to_pylist())
            numbers += rows.column(0).to_pylist()
            lengths.append(n)
            held.append(ids)
            if sum(map(len, held)) >= segment_ids:
                yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, segment_ids: int = SEGMENT_IDS, some: int = SOME_ROWS) -> DataFrame:
    """Write the segments into a folder; returns their table."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.coalesce("text", F.lit(""))).alias("_crc"), F.coalesce(F.length("text"), F.lit(0)).alias("_n"))
    ordered = ordered.repartitionByRange("doc_id", "_crc", "_n").sortWithinPartitions("doc_id", "_crc", "_n").select("doc_id", "text")
    # packed words don't compress further
    ordered.mapInArrow(released(_segments(vocabulary or vocabulary_path(), segment_ids, some)), SEGMENT).write.option("compression", "none").parquet(folder)
    return token_segments(docs.sparkSession, folder)


def token_segments(spark, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, segment, data = (batch.column(c)[k].as_py() for c in range(3))
            reader = Reader(data)
            numbers, crcs = [], []
            for number, ids in reader.documents():
                numbers.append(number)
                crcs.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
            n = len(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, segment, np.int32)), pa.array(numbers, pa.int64()), pa.array(reader.starts[:-1]), pa.array(reader.lengths), pa.array(crcs, pa.int64())],
                names=["part", "segment", "doc_id", "place", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark, folder: str) -> DataFrame:
    """One row per document of the segments of a folder: its place there, its number of ids and their checksum."""
    return token_segments(spark, folder).select("part", "segment", "data").mapInArrow(released(_documents), DOCUMENT)


def round_trip(docs: DataFrame, vocabulary: str | None = None, segment_ids: int = SEGMENT_IDS, some: int = SOME_ROWS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, segment: what the segments hold once written."""
    spark = docs.sparkSession
    folder = Scratch(spark, "token-files").at("ids")
    segments = write_token_files(docs, folder, vocabulary, segment_ids, some)
    # ids before each segment: sums over the parts before it, one row a range partition, and its own place in its part
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, rows = 0, []
    for r in sorted(parts, key=lambda r: r["part"]):
        rows.append((r["part"], before))
        before += r["n"]
    starts = segments.select("part", "segment", "first_id").join(F.broadcast(spark.createDataFrame(rows, "part int, before long")), "part")
    starts = starts.select("part", "segment", (F.col("before") + F.col("first_id")).alias("first"))
    found = read_token_files(spark, folder).join(starts, ["part", "segment"])
    return found.select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "part", "segment")
