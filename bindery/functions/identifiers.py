"""ISBNs, language keys, content identifiers: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an optional label and prefix, then a run of 10 to 21 digits, X, blanks and hyphens.
ISBN_RUN = r"(?i)(?:ISBN(?:-1[03])?[\t\n\f\r ]*[:#]?[\t\n\f\r ]*)?((?:97[89][\t\n\f\r -]?)?[0-9][0-9Xx\t\n\f\r -]{8,19}[0-9Xx])"
#: Other names of a language's key.
LANGUAGE_NAMES = {
    "fre": "fr", "fra": "fr", "french": "fr", "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de",
    "spa": "es", "spanish": "es", "ita": "it", "italian": "it", "por": "pt", "portuguese": "pt", "dut": "nl", "nld": "nl", "dutch": "nl",
}


def digits_and_x(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, "[^0-9Xx]", ""))


def _weighted(value: Column, n: int, weight) -> Column:
    """Sum of the first n digits times their weights; an X counts 10, anything else 0."""
    weights = F.array(*(F.lit(weight(k)) for k in range(n)))
    # a character's place in this string is its worth
    terms = F.zip_with(F.split(F.left(value, F.lit(n)), ""), weights, lambda c, w: F.greatest(F.instr(F.lit("0123456789X"), c) - 1, F.lit(0)) * w)
    return F.aggregate(terms, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def valid_isbn10(value: Column) -> Column:
    return value.rlike("^[0-9]{9}[0-9X]$") & (_weighted(value, 10, lambda k: 10 - k) % 11 == 0)


def valid_isbn13(value: Column) -> Column:
    return value.rlike("^97[89][0-9]{10}$") & (_weighted(value, 13, lambda k: 1 + 2 * (k % 2)) % 10 == 0)


def canonical_isbn(value: Column) -> Column:
    """The 13-digit form of a valid ISBN of either length, else the empty string."""
    clean = digits_and_x(F.coalesce(value, F.lit("")))
    body = F.concat(F.lit("978"), F.substring(clean, 1, 9))
    check = F.pmod(F.lit(10) - _weighted(body, 12, lambda k: 1 + 2 * (k % 2)) % 10, F.lit(10))
    return F.when(valid_isbn10(clean), F.concat(body, check.cast("string"))).when(valid_isbn13(clean), clean).otherwise(F.lit(""))


def extract_isbns(value: Column) -> Column:
    """Distinct valid ISBNs of a text, in order, as they are written but for separators."""
    runs = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(ISBN_RUN), F.lit(1))
    clean = F.transform(runs, digits_and_x)
    return F.array_distinct(F.filter(clean, lambda x: valid_isbn10(x) | valid_isbn13(x)))


def isbn_match(local: Column, remote: Column) -> Column:
    """A canonical ISBN stands in both arrays."""
    left, right = (F.filter(F.transform(x, canonical_isbn), lambda i: i != "") for x in (local, remote))
    return F.arrays_overlap(left, right)


def language_key(value: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, name), F.split(F.translate(name, "_", "-"), "-")[0])


def language_conflict(local: Column, remote: Column) -> Column:
    """There are local languages and a remote one, and it is none of them."""
    keys = F.transform(local, language_key)
    return (F.size(local) > 0) & (F.coalesce(remote, F.lit("")) != "") & ~F.array_contains(keys, language_key(remote))


def language_match(local: Column, remote: Column) -> Column:
    left, right = (F.filter(F.transform(x, language_key), lambda k: k != "") for x in (local, remote))
    return F.arrays_overlap(left, right)


def path_id(path: Column) -> Column:
    """24 hex digits of the path's hash."""
    return F.left(F.sha2(path, 256), F.lit(24))


def cache_key(revision: str, fingerprint: Column, query: Column) -> Column:
    zero = F.lit("\0")
    return F.sha2(F.concat(F.lit(revision), zero, fingerprint, zero, F.lower(F.trim(query))), 256)


def draft_version(fields: Column) -> Column:
    """Hash of a draft's fields (map of name to value) in the order of their names."""
    ordered = F.array_sort(F.map_entries(fields))
    return F.sha2(F.to_json(ordered), 256)
