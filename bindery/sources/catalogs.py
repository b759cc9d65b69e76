"""Catalog responses as candidate rows: JSON bodies in, one row for each record, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.identifiers import canonical_isbn

#: The parts of the responses that are read.
GOOGLE = "struct<items:array<struct<id:string,volumeInfo:struct<title:string,subtitle:string,authors:array<string>,publisher:string,publishedDate:string,description:string,industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:map<string,string>,language:string,categories:array<string>>>>>"
OPEN_LIBRARY = "struct<docs:array<struct<key:string,title:string,author_name:array<string>,first_publish_year:int,language:array<string>,isbn:array<string>,publisher:array<string>,cover_i:int,subject:array<string>>>>"
EDITION = "struct<key:string,title:string,subtitle:string,publishers:array<string>,publish_date:string,isbn_10:array<string>,isbn_13:array<string>,series:array<string>,covers:array<int>,by_statement:string,languages:array<struct<key:string>>,contributors:array<struct<name:string,role:string>>>"
#: The catalogs in their order of arrival.
ARRIVAL = ["Google Books", "Open Library", "Internet Archive"]
#: Roles of translators, and how a statement names one.
TRANSLATOR_ROLES = ["trl", "translator", "translation", "traducteur", "traductrice"]
BY_STATEMENT = r"(?i)(?:translated\s+(?:from.*?\s+)?by|traduite?\s+(?:de.*?\s+)?par|traduct(?:eur|rice)\s*:)\s+([^\];]*)"
FIELDS = "title subtitle authors translators isbn isbns language languages publisher pubdate description categories series_labels cover url catalog_url source work_record".split()
_LISTS = {"authors", "translators", "isbns", "languages", "categories", "series_labels"}


def _row(**columns: Column) -> list[Column]:
    """Candidate columns in order: absent text is empty, absent lists are empty."""
    none = F.array().cast("array<string>")
    out = []
    for name in FIELDS:
        if name == "work_record":
            out.append(F.coalesce(columns.get(name, F.lit(False)), F.lit(False)).alias(name))
        elif name in _LISTS:
            out.append(F.coalesce(columns.get(name, none), none).alias(name))
        else:
            out.append(F.coalesce(columns.get(name, F.lit("")), F.lit("")).alias(name))
    return out


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def google_books(responses: DataFrame, keep: list[str]) -> DataFrame:
    """responses: keep, body."""
    items = responses.select(*keep, F.explode(F.from_json("body", GOOGLE)["items"]).alias("r"))
    v = F.col("r.volumeInfo")
    named = F.filter(v["industryIdentifiers"], lambda i: i["type"].isin("ISBN_13", "ISBN_10"))
    thirteen = F.filter(named, lambda i: i["type"] == "ISBN_13")
    best = F.coalesce(F.try_element_at(thirteen, F.lit(-1)), _first(named))["identifier"]
    url = F.concat(F.lit("https://books.google.com/books?id="), F.url_encode("r.id"))
    cover = F.regexp_replace(F.try_element_at(v["imageLinks"], F.lit("thumbnail")), "^(.*?)http://", "$1https://")
    return items.select(*keep, *_row(title=v["title"], subtitle=v["subtitle"], authors=v["authors"], publisher=v["publisher"], pubdate=v["publishedDate"], description=v["description"], language=v["language"], categories=v["categories"], isbn=best, isbns=F.transform(named, lambda i: i["identifier"]), cover=cover, url=url, catalog_url=url, source=F.lit(ARRIVAL[0])))


def open_library(responses: DataFrame, keep: list[str], isbn: Column | None = None) -> DataFrame:
    """responses: keep, body; ``isbn`` is the one asked for, whose spelling in a record is preferred."""
    asked = F.lit("") if isbn is None else F.coalesce(isbn, F.lit(""))
    docs = responses.select(*keep, asked.alias("_asked"), F.explode(F.from_json("body", OPEN_LIBRARY)["docs"]).alias("r"))
    r = {n: F.col(f"r.{n}") for n in ("key", "title", "author_name", "first_publish_year", "language", "isbn", "publisher", "cover_i", "subject")}
    same = F.filter(r["isbn"], lambda i: (F.col("_asked") != "") & (canonical_isbn(i) == canonical_isbn(F.col("_asked"))))
    url = F.concat(F.lit("https://openlibrary.org"), F.coalesce(r["key"], F.lit("")))
    cover = F.when(r["cover_i"] > 0, F.format_string("https://covers.openlibrary.org/b/id/%d-M.jpg", r["cover_i"]))
    year = F.when(r["first_publish_year"] > 0, r["first_publish_year"].cast("string"))
    return docs.select(*keep, *_row(title=r["title"], authors=r["author_name"], publisher=_first(r["publisher"]), pubdate=year, language=_first(r["language"]), languages=r["language"], isbn=F.coalesce(_first(same), _first(r["isbn"])), isbns=r["isbn"], categories=r["subject"], cover=cover, url=url, catalog_url=url, source=F.lit(ARRIVAL[1]), work_record=F.lit(True)))


def open_library_edition(responses: DataFrame, keep: list[str], isbn: str, works: DataFrame | None = None) -> DataFrame:
    """responses: keep, ``isbn`` (asked for), body of an edition; authors come from the first work of that canonical ISBN.

    works: isbn and authors of work records, in the order of ``position``.
    """
    rows = responses.where(canonical_isbn(F.col(isbn)) != "").select(*keep, F.col(isbn).alias("_asked"), F.from_json("body", EDITION).alias("r"))
    rows = rows.where(F.startswith(F.col("r.key"), F.lit("/books/")) & (F.coalesce(F.col("r.title"), F.lit("")) != ""))
    rows = rows.withColumn("_key", canonical_isbn(F.col("_asked")))
    if works is not None:
        first = works.select(canonical_isbn(F.col("isbn")).alias("_key"), "position", "authors").where("_key <> ''").groupBy("_key").agg(F.min_by("authors", "position").alias("_authors"))
        rows = rows.join(first, "_key", "left")
    else:
        rows = rows.withColumn("_authors", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    isbns = F.concat(F.coalesce("r.isbn_13", none), F.coalesce("r.isbn_10", none))
    confirmed = F.exists(isbns, lambda i: canonical_isbn(i) == F.col("_key"))
    languages = F.transform("r.languages", lambda x: F.regexp_extract(x["key"], "([^/]*)$", 1))
    by_role = F.transform(F.filter("r.contributors", lambda c: F.lower(F.trim(c["role"])).isin(TRANSLATOR_ROLES)), lambda c: c["name"])
    stated = F.trim(F.regexp_extract(F.coalesce("r.by_statement", F.lit("")), BY_STATEMENT, 1))
    translators = F.concat(F.coalesce(by_role, none), F.when(stated != "", F.array(stated)).otherwise(none))
    cover = F.when(_first(F.col("r.covers")) > 0, F.format_string("https://covers.openlibrary.org/b/id/%d-M.jpg", _first(F.col("r.covers"))))
    url = F.concat(F.lit("https://openlibrary.org"), F.col("r.key"))
    return rows.select(*keep, *_row(title=F.col("r.title"), subtitle=F.col("r.subtitle"), authors=F.col("_authors"), translators=translators, publisher=_first(F.col("r.publishers")), pubdate=F.col("r.publish_date"), isbn=F.when(confirmed, F.col("_asked")).otherwise(_first(isbns)), isbns=isbns, language=_first(languages), languages=languages, series_labels=F.col("r.series"), cover=cover, url=url, catalog_url=url, source=F.lit(ARRIVAL[1])))


def _strings(value: Column) -> Column:
    """A JSON list's trimmed nonblank items, or a nonblank scalar as a list of one: what a variant holds decides."""
    listed, scalar = F.try_variant_get(value, "$", "array<string>"), F.try_variant_get(value, "$", "string")
    items = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(listed.isNotNull(), items).when(F.trim(scalar) != "", F.array(scalar)).otherwise(F.array().cast("array<string>"))


def internet_archive(responses: DataFrame, keep: list[str]) -> DataFrame:
    """responses: keep, body; records without an id or title are left out, and so is a body that is no JSON.

    A field may be a string or a list of strings; a string stays one, whatever it begins with.
    """
    docs = F.try_variant_get(F.try_parse_json("body"), "$.response.docs", "array<variant>")
    docs = responses.select(*keep, F.explode(docs).alias("r"))
    docs = docs.select(*keep, *(F.coalesce(F.try_variant_get("r", f"$.{n}", "string"), F.lit("")).alias(f"_{n}") for n in ("identifier", "title", "year")), *(_strings(F.try_variant_get("r", f"$.{n}", "variant")).alias(f"_{n}") for n in ("creator", "isbn", "language", "description")))
    docs = docs.where("_identifier <> '' and _title <> ''")
    url = F.concat(F.lit("https://archive.org/details/"), F.replace(F.url_encode("_identifier"), F.lit("+"), F.lit("%20")))
    return docs.select(*keep, *_row(title=F.col("_title"), authors=F.col("_creator"), isbn=_first(F.col("_isbn")), isbns=F.col("_isbn"), languages=F.col("_language"), language=_first(F.col("_language")), pubdate=F.col("_year"), description=F.array_join("_description", ", "), url=url, catalog_url=url, source=F.lit(ARRIVAL[2])))


def all_candidates(parts: list[DataFrame]) -> DataFrame:
    """The bag of all providers' records, with their order of arrival."""
    order = F.array_position(F.array(*map(F.lit, ARRIVAL)), F.col("source"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("arrival", order)
