"""A library of book files as DataFrames: listing, records, warnings, texts.

Listing is the ``library`` data source (``bindery.sources.listing``), and a record is read where its file is listed. Texts and images
come through Spark's binaryFile source, whose name filter keeps only the extensions asked for, so that no other file's bytes are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import fb2
from bindery.functions.identifiers import path_id
from bindery.schema import LISTS, NAMES
from bindery.sources.formats import epub_images, read_record, read_text
from bindery.sources.listing import LibrarySource

#: Extensions of files that have a text to match by.
TEXTS = ["epub", "fb2", "txt", "html", "htm", "xhtml"]
RECORD = "struct<" + ",".join(f"{n}:{'array<string>' if n in LISTS else 'string'}" for n in NAMES) + ">"
_RECORD = pa.struct([(n, pa.list_(pa.string()) if n in LISTS else pa.string()) for n in NAMES])


def _named(extensions: list[str]) -> str:
    """A name pattern for the extensions in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def _listed(spark: SparkSession, root: str, recursive: bool, hidden: bool) -> DataFrame:
    spark.dataSource.register(LibrarySource)
    return spark.read.format("library").option("recursive", str(recursive).lower()).option("hidden", str(hidden).lower()).load(root)


def list_books(spark: SparkSession, root: str, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """id, path, name, size, modified, modified_ns of the book files under a folder; their content is not read."""
    files = _listed(spark, root, recursive, hidden).where("warning is null")
    return files.select(path_id(F.col("path")).alias("id"), "path", "name", "size", F.timestamp_micros(F.expr("modified_ns div 1000")).alias("modified"), "modified_ns")


def scan(spark: SparkSession, root: str, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """id, path, metadata, read_error, fingerprint, warning of every book file, and a row with nothing but path and warning for what could not be looked at.

    A damaged file is a row with its error, which is a warning too. The fingerprint changes with size, time (to the nanosecond) and metadata.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records, errors, warnings = [], [], []
            for path, warning in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                record = error = None
                if warning is None:
                    try:
                        with open(path, "rb") as f:
                            raw = f.read()
                        record, error = read_record(raw, path)
                    except OSError as failed:
                        name = os.path.basename(path)
                        record, error = {"title": name.rpartition(".")[0] or name, "authors": []}, f"{type(failed).__name__}: {failed.strerror}"
                    warning = f"{path}: {error}" if error else None
                records.append(None if record is None else {n: record.get(n) for n in NAMES})
                errors.append(error)
                warnings.append(warning)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3)), pa.array(records, _RECORD), pa.array(errors, pa.string()), pa.array(warnings, pa.string())], names=["path", "size", "modified_ns", "metadata", "read_error", "warning"])

    rows = _listed(spark, root, recursive, hidden).mapInArrow(run, f"path string, size long, modified_ns long, metadata {RECORD}, read_error string, warning string")
    stamp = F.sha2(F.concat_ws(":", "path", F.col("size").cast("string"), F.col("modified_ns").cast("string"), F.to_json("metadata")), 256)
    found = F.col("metadata").isNotNull()
    return rows.select(F.when(found, path_id(F.col("path"))).alias("id"), "path", "metadata", "read_error", F.when(found, stamp).alias("fingerprint"), "warning")


def read_books(spark: SparkSession, root: str, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """id, path, metadata, read_error, fingerprint of every book file; a damaged file is a row with its error."""
    return scan(spark, root, recursive, hidden).where("id is not null").drop("warning")


def scan_outcome(scanned: DataFrame) -> DataFrame:
    """books and warnings of a scan: how many books it has, and how many things it could not look at or read."""
    return scanned.agg(F.count("id").alias("books"), F.count("warning").alias("warnings"))


def read_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, position and image: the members of EPUB files that their outer documents refer to as images, in reading order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", _named(["epub"])).load(root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    found = epub_images(batch.column(1)[k].as_py())
                except Exception:  # a damaged file has no images; its record holds the error
                    found = []
                path = batch.column(0).slice(k, 1).take(pa.array([0] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([path, pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=["path", "position", "image"])

    return files.mapInArrow(run, "path string, position int, image string")


def read_fb2(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, record, text, damaged of the FB2 files under a folder, read by built-in XML functions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", _named(["fb2"])).load(root)
    books = files.select("path", fb2.parsed(fb2.decoded(F.col("content"))).alias("book"))
    return books.select("path", fb2.record(F.col("book"), F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("record"), fb2.body_text(F.col("book")).alias("text"), F.col("book._damage").isNotNull().alias("damaged"))


def read_texts(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path and text to match by, of EPUB, FB2, text and HTML files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", _named(TEXTS)).load(root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    text = read_text(batch.column(1)[k].as_py(), batch.column(0)[k].as_py())
                except Exception:  # a damaged file has no text; its record holds the error
                    text = ""
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([text])], names=["path", "text"])

    return files.mapInArrow(run, "path string, text string")
