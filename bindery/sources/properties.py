"""Records out of tables of properties, where the files themselves can't be read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document properties and the fields they hold; media types of covers.
PDF_TEXT = {
    "Subtitle": "subtitle", "Publisher": "publisher", "Subject": "comments", "ISBN": "isbn", "Series": "series", "SeriesIndex": "series_index", "OriginalTitle": "original_title",
    "Edition": "edition", "Collection": "collection", "Rights": "rights", "Rating": "rating", "Identifiers": "identifiers", "CatalogURL": "catalog_url",
}
COVER_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}


def _parts(value: Column, separator: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(value, separator))


def pdf_records(properties: DataFrame, path: str = "path", values: str = "properties") -> DataFrame:
    """path and fields of PDF files given as (path, map of properties); without a title, the file's name is it.

    Absent keywords are no tags, where a single empty tag would say the same.
    """
    get = lambda name: F.try_element_at(F.col(values), F.lit(name))
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif(get("Title"), F.lit("")), stem)
    lists = {"authors": _parts(get("Author"), " & "), "translators": _parts(get("Translator"), " & "), "tags": _parts(get("Keywords"), ", ")}
    language = F.when(F.trim(F.coalesce(get("Language"), F.lit(""))) != "", F.array(get("Language"))).otherwise(F.array().cast("array<string>"))
    return properties.select(path, title.alias("title"), *(c.alias(n) for n, c in lists.items()), language.alias("languages"), *(F.coalesce(get(p), F.lit("")).alias(f) for p, f in PDF_TEXT.items()))


def cover_type(extension: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in COVER_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(extension)), F.lit("application/octet-stream"))


def data_url(extension: Column, raw: Column) -> Column:
    return F.concat(F.lit("data:"), cover_type(extension), F.lit(";base64,"), F.base64(raw))


def path_of_href(href: Column) -> Column:
    """A link's path: query and fragment dropped, percent signs decoded where they can be."""
    bare = F.regexp_replace(href, "[?#].*$", "")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
