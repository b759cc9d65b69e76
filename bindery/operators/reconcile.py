"""The editor's rows: proposals with what is changed, supported and suggested, and edits by hand over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.operators.state import meaningful
from bindery.schema import CBZ_FIELDS


def supported(filename: Column, field: Column) -> Column:
    """Whether a format keeps a field: covers in EPUB only, no date in PDF, CBZ its own fields."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    return (
        F.when(field == "cover_url", ext == "epub")
        .when(ext == "cbz", field.isin(CBZ_FIELDS))
        .when(ext == "pdf", field != "pubdate")
        .otherwise(F.lit(True))
    )


def editor_rows(proposed: DataFrame, filename: Column, edits: DataFrame | None = None) -> DataFrame:
    """Proposals with changed, supported and suggested; an edit (book, field, value) replaces the value and clears the review."""
    rows = proposed.withColumn("edited", F.lit(False))
    if edits is not None:
        e = edits.select("book", "field", F.col("value").alias("_value"), F.lit(True).alias("_edited"))
        rows = rows.join(e, ["book", "field"], "left").withColumn("edited", F.coalesce("_edited", F.lit(False)))
        rows = rows.withColumn("value", F.when(F.col("edited"), F.col("_value")).otherwise(F.col("value"))).withColumn("review", F.col("review") & ~F.col("edited"))
        rows = rows.withColumn("evidence", F.when(F.col("edited"), F.lit("Edited by hand")).otherwise(F.col("evidence"))).drop("_value", "_edited")
    changed = ~meaningful(F.col("current")).eqNullSafe(meaningful(F.col("value")))
    rows = rows.withColumn("changed", changed).withColumn("supported", supported(filename, F.col("field")))
    told = F.col("edited") | (F.size("value") > 0) | ((F.col("field") == "subtitle") & (F.col("evidence") != ""))
    return rows.withColumn("suggested", F.col("changed") & F.col("supported") & ~F.col("review") & told)
