"""Library views: text filter, folders, counts, shelf order and natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.formats import natural_key


def matches(needle: str, *columns: Column) -> Column:
    """The trimmed lower-case needle stands in the columns joined by blanks; an empty needle is everywhere."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.strip().lower()))


def inside(path: Column, folder: str) -> Column:
    """The path is the folder or below it."""
    return (path == folder) | F.startswith(path, F.lit(folder.rstrip("/") + "/"))


def required_inside(folder: Column, root: str) -> Column:
    """The folder, or an error where it is not in the root."""
    return F.when(inside(folder, root), folder).otherwise(F.raise_error(F.concat(F.lit("not in the library: "), folder)))


def counts(books: DataFrame, folder: str, needle: str, *columns: Column) -> DataFrame:
    """folder_count (before the text filter) and total (after it)."""
    here = inside(F.col("path"), folder)
    return books.agg(F.count_if(here).alias("folder_count"), F.count_if(here & matches(needle, *columns)).alias("total"))


def folders(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Every folder from the root down to each path's own: folder, name relative to the root (the root is .), depth, books below."""
    base = root.rstrip("/")
    parts = F.split(F.substring(F.col(path), len(base) + 2, 1 << 30), "/")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = paths.where(inside(F.col(path), base)).select(F.explode(upto).alias("name"))
    found = rows.groupBy("name").agg(F.count(F.lit(1)).alias("books"))
    return found.select(
        F.when(F.col("name") == "", F.lit(base)).otherwise(F.concat(F.lit(base + "/"), F.col("name"))).alias("folder"),
        F.when(F.col("name") == "", F.lit(".")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("name") == "", F.lit(0)).otherwise(F.size(F.split("name", "/"))).alias("depth"),
        "books",
    )


def loose_key(value: Column) -> Column:
    """Sort key of a name: numbers by value, case and accents aside."""
    return F.collate(natural_key(value), "UNICODE_CI_AI")


def shelf_order(series: Column, volume: Column, title: Column, name: Column, path: Column) -> list[Column]:
    """Sort columns: books of a series first, by series and volume (numbers, then other text, blank last), then title, name, path."""
    s, v = F.trim(F.coalesce(series, F.lit(""))), F.trim(F.coalesce(volume, F.lit("")))
    inseries = s != ""
    number = F.when(v.rlike(r"^[+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)$"), F.translate(v, ",", ".").try_cast("double"))
    kind = F.when(~inseries, 0).when(v == "", 2).when(number.isNull(), 1).otherwise(0)
    return [
        (~inseries).asc(), loose_key(s).asc(), kind.asc(), F.when(inseries, number).asc_nulls_first(),
        loose_key(F.when(inseries & number.isNull(), v).otherwise(F.lit(""))).asc(),
        loose_key(title).asc(), loose_key(name).asc(), loose_key(path).asc(), path.asc(),
    ]


def browse(paths: DataFrame, folder: str, hidden: bool = False) -> DataFrame:
    """Child folders of a folder by lower-cased name."""
    base = folder.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(base) + 1, 1 << 30)
    child = F.split(rest, "/")
    found = paths.where(F.startswith(F.col("path"), F.lit(base)) & (F.size(child) > 1)).select(child[0].alias("name")).distinct()
    found = found if hidden else found.where(~F.startswith("name", F.lit(".")))
    return found.select("name", F.concat(F.lit(base), F.col("name")).alias("path")).orderBy(F.lower("name"))


def parent(folder: Column) -> Column:
    """The folder above, or the empty string at the root."""
    above = F.regexp_replace(F.regexp_replace(folder, "/+$", ""), "/[^/]*$", "")
    return F.when(folder.rlike("^/+$"), F.lit("")).when(above == "", F.lit("/")).otherwise(above)
