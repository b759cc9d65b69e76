"""Books as the library shows them: titles, lookup terms, provenance, pages, clues, review of drafts, cache policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.formats import looks_like_body, natural_key
from bindery.functions.identifiers import extract_isbns, path_id
from bindery.operators.state import meaningful
from bindery.schema import NAMES

#: Fields whose values a catalog record supplies, and extensions of page images.
SUPPLIED = ["title", "authors", "publisher", "pubdate", "isbn", "languages", "tags", "comments", "catalog_url", "cover_url"]
IMAGES = ["jpg", "jpeg", "png", "webp", "gif", "tif", "tiff", "bmp"]


def display_title(title: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit("")), name)


def default_query(titles: Column, authors: Column) -> Column:
    """The first title and all authors."""
    return F.trim(F.concat_ws(" ", F.try_element_at(titles, F.lit(1)), F.array_join(authors, " ")))


def shown_books(books: DataFrame) -> DataFrame:
    """books: path, title, titles, authors, staged. One row a book as a list shows it."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return books.select(path_id(F.col("path")).alias("id"), "path", name.alias("name"), display_title(F.col("title"), name).alias("title"), "staged", default_query(F.col("titles"), F.col("authors")).alias("query"), F.endswith(F.lower("path"), F.lit(".epub")).alias("cover_editable"))


def provenance(source: Column) -> Column:
    """Map of each field a record supplies to its source."""
    return F.map_from_arrays(F.array(*map(F.lit, SUPPLIED)), F.array_repeat(source, len(SUPPLIED)))


def search_isbns(stored: Column, identifiers: Column, terms: Column, clues: Column, custom: Column) -> Column:
    """Distinct ISBNs of the stored fields, the query and the content's clues; of the query alone if it is a custom one."""
    every = F.array_distinct(F.concat(*map(extract_isbns, (stored, identifiers, terms, clues))))
    return F.when(custom, extract_isbns(terms)).otherwise(every)


def outer_pages(pages: DataFrame, book: str, order: list[Column], front: int, back: int) -> DataFrame:
    """The first and last pages of every book, with their position from 0."""
    w = Window.partitionBy(book)
    placed = pages.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.where((F.col("position") < front) | (F.col("position") >= F.col("_n") - back)).drop("_n")


def page_images(members: DataFrame, book: str, name: str, front: int = 20, back: int = 10) -> DataFrame:
    """The outer image members of every archive, in natural order."""
    images = members.where(F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(IMAGES))
    return outer_pages(images, book, [natural_key(F.col(name)), F.col(name)], front, back)


def page_text(pages: DataFrame, book: str, front: int = 20, back: int = 10) -> DataFrame:
    """The text of the outer pages of every book (book, page, text), in order; a book has at most front + back of them here."""
    kept = outer_pages(pages, book, [F.col("page")], front, back)
    rows = kept.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("t"))
    return rows.select(book, F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def clues(scans: DataFrame, book: str, position: str = "position") -> DataFrame:
    """What is looked at of scanned pages (book, position, text): up to the first page of body text, that one included."""
    before = Window.partitionBy(book).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.bool_or(looks_like_body(F.col("text"))).over(before), F.lit(False))
    return scans.withColumn("_seen", seen).where("not _seen").drop("_seen")


def image_positions(n: Column, opening: Column, closing: Column, first: int = 12, last: int = 5) -> Column:
    """Positions of a document's n images that are looked at.

    An opening document is bounded to its first ones; a closing one begins ``last`` before its bound and goes to its end.
    """
    bound = F.when(opening, F.least(n, F.lit(first))).otherwise(n)
    tail = closing & (bound > last)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda k: F.when(tail, k >= bound - last).otherwise(k < bound))


def review(current: DataFrame, staged: DataFrame, readable: DataFrame) -> DataFrame:
    """Drafts for review: path, place, field, current, value, unavailable.

    current and staged are long (path, field, values), readable is (path, error). A field that still differs is a row in the
    order of display; a draft whose file can't be read is one row without a field, with the error.
    """
    place = F.array_position(F.array(*map(F.lit, NAMES)), F.col("field"))
    status = staged.select("path").distinct().join(readable, "path", "left").select("path", F.coalesce("error", F.lit("file is missing")).alias("error"))
    old = current.select("path", "field", F.col("values").alias("_old"))
    rows = staged.join(status.where("error = ''"), "path").join(old, ["path", "field"], "left")
    rows = rows.where(~meaningful(F.col("values")).eqNullSafe(meaningful(F.col("_old"))))
    text = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ") for c in ("_old", "values")]
    shown = rows.select("path", place.cast("int").alias("place"), "field", text[0].alias("current"), text[1].alias("value"), F.lit("").alias("unavailable"))
    gone = status.where("error <> ''").select("path", F.lit(0).alias("place"), F.lit(None).cast("string").alias("field"), F.lit("").alias("current"), F.lit("").alias("value"), F.col("error").alias("unavailable"))
    return shown.unionByName(gone)


def migrate(full: DataFrame, current: DataFrame) -> DataFrame:
    """Whole drafts of an older version (path, field, values) as patches: known fields that differ from the file."""
    from bindery.operators.state import changes

    return changes(current, full.where(F.col("field").isin(NAMES)), ["path", "field"])


def migrate_json(drafts: DataFrame, current: DataFrame) -> DataFrame:
    """As ``migrate``, of drafts that are (path, json: an object of field to list of values); a malformed one fails it all."""
    fields = F.from_json("json", "map<string,array<string>>", {"mode": "FAILFAST"})
    return migrate(drafts.select("path", F.explode(fields).alias("field", "values")), current)


def search_guard(query: Column, known: Column, catalogs: Column, cache_only: Column) -> Column:
    """struct<error, warning>: why a search does not run, or that it can find nothing; both empty where it runs."""
    error = F.when(~known, F.lit("book is not in the library")).when(F.trim(F.coalesce(query, F.lit(""))) == "", F.lit("search text is empty")).otherwise(F.lit(""))
    none = (catalogs == 0) & ~cache_only & (error == "")
    return F.struct(error.alias("error"), F.when(none, F.lit("no catalog is enabled")).otherwise(F.lit("")).alias("warning"))


def lookup_outcomes(lookups: DataFrame, book: str) -> DataFrame:
    """Of each book's lookups (provider, pos, error, canceled, found): candidates kept, providers that failed, and warnings in order.

    What a failed lookup has found is kept; one that was canceled is no failure and says nothing. A book has at most as many
    warnings as lookups of its plan.
    """
    told = (F.coalesce("error", F.lit("")) != "") & ~F.col("canceled")
    said = F.when(told, F.struct("provider", "pos", F.concat_ws(": ", "provider", "error").alias("text")))
    rows = lookups.groupBy(book).agg(F.sum("found").alias("candidates"), F.array_sort(F.collect_set(F.when(told, F.col("provider")))).alias("failed"), F.array_sort(F.collect_list(said)).alias("said"))
    return rows.select(book, "candidates", "failed", F.transform("said", lambda x: x["text"]).alias("warnings"))


def export_json(rows: DataFrame) -> DataFrame:
    """Every row as one JSON object."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def cache_action(hit: Column, candidates: Column, ignore: Column, cache_only: Column, background: Column) -> Column:
    """use, miss or retry: an empty hit serves a background or cache-only search, and an explicit one looks again."""
    return F.when(ignore | ~hit, F.lit("miss")).when(cache_only | background | (candidates > 0), F.lit("use")).otherwise(F.lit("retry"))


def cacheable(candidates: Column, warnings: Column, canceled: Column, days: Column) -> Column:
    return ((candidates > 0) | (warnings == 0)) & ~canceled & (days > 0)


def outcome_lists(results: DataFrame, commit: str) -> DataFrame:
    """The saved paths of each commit, and its failures as "path: error", in the order of paths; a commit is what a user selected."""
    lists = {"saved": F.when(F.col("saved"), F.col("path")), "failures": F.when(~F.col("saved"), F.concat_ws(": ", "path", "error"))}
    return results.groupBy(commit).agg(*(F.array_sort(F.collect_list(c)).alias(n) for n, c in lists.items()))


def outcome(results: DataFrame) -> DataFrame:
    """saved and failed counts of a commit's rows (path, saved, error)."""
    return results.agg(F.count_if("saved").alias("saved"), F.count_if(~F.col("saved")).alias("failed"))
