"""FB2 books from their XML as built-in expressions: ``from_xml`` reads what is declared here, whatever the namespaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.schema import NAMES

_PERSON = "array<struct<`first-name`:array<string>,`middle-name`:array<string>,`last-name`:array<string>>>"
#: The elements that are read; text that may hold markup is read as it stands.
_PARTS = {
    "description": "array<struct<`title-info`:array<struct<genre:array<string>,author:" + _PERSON + ",`book-title`:array<string>,annotation:array<string>,lang:array<string>,"
    "translator:" + _PERSON + ",sequence:array<struct<_name:string,_number:string>>>>,`src-title-info`:array<struct<`book-title`:array<string>>>,"
    "`publish-info`:array<struct<`publisher-name`:array<string>,year:array<string>,isbn:array<string>>>,`custom-info`:array<struct<`_info-type`:string,_VALUE:string>>>>",
    "body": "array<string>",
    "_damage": "string",
}
RECORD = "struct<title:string,authors:array<string>,translators:array<string>,tags:array<string>,languages:array<string>,comments:string,original_title:string,publisher:string,pubdate:string,isbn:string,series:string,series_index:string,custom:map<string,string>>"


#: What stands for a reference to "<" while markup is told from text; encodings of one byte a character that are known.
LESS = "\ue000"
ONE_BYTE = ["windows-1251", "windows-1252", "koi8-r", "koi8-u", "iso-8859-5", "iso-8859-15"]


def decoded(content: Column) -> Column:
    """The text of a file's bytes, in the encoding that its XML declaration names, else UTF-8."""
    latin = F.decode(content, "ISO-8859-1")
    named = F.lower(F.regexp_extract(F.left(latin, F.lit(200)), r"""^<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", 1))
    marked = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    out = F.when(marked, F.decode(F.when(marked, content), "UTF-16")).when(named == "iso-8859-1", latin)
    upper = "".join(map(chr, range(128, 256)))
    for name in ONE_BYTE:
        signs = "".join(bytes([b]).decode(name, "replace") for b in range(128, 256))
        out = out.when(named == name, F.translate(latin, upper, signs))
    other = marked | (named == "iso-8859-1") | named.isin(ONE_BYTE)
    return F.regexp_replace(out.otherwise(F.decode(F.when(~other, content), "UTF-8")), "^\ufeff", "")


def _signs(value: Column) -> Column:
    return F.translate(value, LESS, "<")


def plain(markup: Column) -> Column:
    """Text of an element with markup: nodes joined by blanks, white space collapsed."""
    text = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?s)<!--.*?-->|<[^>]*>", " ")
    return _signs(F.trim(F.regexp_replace(text, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")))


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _trimmed(value: Column) -> Column:
    return _signs(F.coalesce(F.trim(value), F.lit("")))


def _filled(values: Column) -> Column:
    return F.coalesce(F.filter(F.transform(values, _trimmed), lambda v: v != ""), F.array().cast("array<string>"))


def _people(people: Column) -> Column:
    return _filled(F.transform(people, lambda p: plain(F.concat_ws(" ", _first(p["first-name"]), _first(p["middle-name"]), _first(p["last-name"])))))


def parsed(xml: Column) -> Column:
    """The declared parts of a book; ``_damage`` holds XML that is malformed. A "<" in a CDATA section counts as markup."""
    safe = F.regexp_replace(xml, "(?i)&(?:lt|#0*60|#x0*3c);", LESS)
    schema = ", ".join(f"{name} {kind}" for name, kind in _PARTS.items())
    return F.from_xml(safe, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damage"})


def record(book: Column, filename: Column) -> Column:
    """The record of a parsed book; a book without title information has its file's name for a title."""
    about = _first(book["description"])
    info, published = _first(about["title-info"]), _first(about["publish-info"])
    name = F.regexp_replace(F.regexp_extract(filename, "([^/]*)$", 1), r"\.[^.]*$", "")
    text = lambda v: _trimmed(_first(v))
    kinds = F.transform(about["custom-info"], lambda c: F.struct(F.coalesce(c["_info-type"], F.lit("")).alias("kind"), _signs(F.coalesce(c["_VALUE"], F.lit(""))).alias("value")))
    fields = F.filter(F.transform(kinds, lambda c: F.struct(F.when(c["kind"].isin(NAMES), c["kind"]).otherwise(F.regexp_extract(c["kind"], "^[^-]*-(.*)$", 1)).alias("key"), c["value"])), lambda c: c["key"].isin(NAMES))
    # of a field that is there twice the last counts
    last = F.filter(fields, lambda c, k: ~F.exists(F.slice(fields, k + 2, F.size(fields)), lambda d: d["key"] == c["key"]))
    known = F.struct(
        text(info["book-title"]).alias("title"), _people(info["author"]).alias("authors"), _people(info["translator"]).alias("translators"), _filled(info["genre"]).alias("tags"),
        F.slice(_filled(F.slice(info["lang"], 1, 1)), 1, 1).alias("languages"), plain(_first(info["annotation"])).alias("comments"), text(_first(about["src-title-info"])["book-title"]).alias("original_title"),
        text(published["publisher-name"]).alias("publisher"), text(published["year"]).alias("pubdate"), text(published["isbn"]).alias("isbn"),
        F.coalesce(_first(info["sequence"])["_name"], F.lit("")).alias("series"), F.coalesce(_first(info["sequence"])["_number"], F.lit("")).alias("series_index"),
        F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>")).alias("custom"),
    )
    named = F.from_json(F.to_json(F.struct(name.alias("title"))), RECORD)
    return F.when(info.isNull(), named).otherwise(known.cast(RECORD))


def body_text(book: Column) -> Column:
    """The text of a parsed book's bodies, one line each."""
    return F.array_join(F.transform(book["body"], plain), "\n")
