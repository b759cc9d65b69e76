"""The field registry and the schemas of the engine's tables."""

from __future__ import annotations

#: Field names in order of display, and whether a field holds a list.
FIELDS = [
    ("title", False), ("subtitle", False), ("original_title", False), ("authors", True), ("translators", True),
    ("series", False), ("series_index", False), ("publisher", False), ("pubdate", False), ("edition", False),
    ("collection", False), ("isbn", False), ("identifiers", False), ("catalog_url", False), ("rating", False),
    ("languages", True), ("tags", True), ("comments", False), ("rights", False), ("cover_url", False),
]
NAMES = [name for name, _ in FIELDS]
LISTS = {name for name, is_list in FIELDS if is_list}
#: Fields that a CBZ keeps.
CBZ_FIELDS = ["title", "series", "series_index", "publisher", "pubdate", "authors", "comments", "languages", "tags", "catalog_url", "rating", "edition", "collection"]

#: A patch, one row for each changed field: an empty list of values clears the field, an absent row leaves it.
PATCH = "path string, field string, values array<string>"
BOOK_STATE = "path string, fingerprint string, metadata array<struct<field:string,values:array<string>>>, staged array<struct<field:string,values:array<string>>>, updated_at long"
CACHE = "cache_key string, result_json string, updated_at long"
CANDIDATE = (
    "title string, subtitle string, original_title string, authors array<string>, translators array<string>, isbn string, isbns array<string>, "
    "language string, languages array<string>, publisher string, pubdate string, description string, categories array<string>, "
    "series string, series_index string, series_labels array<string>, cover string, url string, source string, work_record boolean, confidence double"
)
EXTENSIONS = ["epub", "fb2", "cbz", "pdf"]
