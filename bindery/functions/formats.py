"""Dates, ratings, lists, samples and body text: what the book formats' fields are checked and cut by."""

from __future__ import annotations

import csv
import html.entities
import io
import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.text import bound


def partial_date(value: Column) -> Column:
    """struct<year, month, day> of YYYY, YYYY-MM or YYYY-MM-DD; null if it is none of them or no date."""
    text = F.trim(F.coalesce(value, F.lit("")))
    full = F.when(text.rlike("^[0-9]{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(text, F.lit("-01")))
    day = F.try_to_date(F.coalesce(full, F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)), "yyyy-MM-dd")
    return F.when(day.isNotNull(), F.struct(F.year(day).alias("year"), F.when(F.length(text) > 4, F.month(day)).alias("month"), F.when(F.length(text) > 7, F.dayofmonth(day)).alias("day")))


def best_date(year: Column, month: Column, day: Column) -> Column:
    """The most precise valid date of three strings: YYYY-MM-DD, else YYYY-MM, else the year as it stands."""
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    whole = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    valid = F.try_to_date(F.when(y.between(1, 9999) & m.isNotNull() & d.isNotNull(), whole), "yyyy-MM-dd").isNotNull()
    return F.when(y.isNull() | ~y.between(1, 9999), F.lit("")).when(valid, whole).when(m.between(1, 12), F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"))).otherwise(y.cast("string"))


def rating_valid(value: Column) -> Column:
    """Empty, or a decimal from 0 to 5 with at most two places."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return (text == "") | (text.rlike(r"^[0-9]+(?:\.[0-9]{1,2})?$") & (F.coalesce(text.try_cast("double"), F.lit(99.0)) <= 5))


def same_volume(a: Column, b: Column) -> Column:
    """Both are plain numbers (decimal comma or point) and equal."""
    number = [F.when(x.rlike(r"^[+-]?(?:[0-9]+[.,]?[0-9]*|[.,][0-9]+)$"), F.translate(x, ",", ".").try_cast("double")) for x in (a, b)]
    return F.coalesce(number[0] == number[1], F.lit(False))


def comic_list(value: Column) -> Column:
    """Items between commas, trimmed; blanks stay."""
    return F.transform(F.split(value, ","), lambda x: F.trim(x))


#: A quoted item of a list with the blanks before it, which a separator or an end must follow.
_QUOTED = r'(?:^|(?<=[,\n\r])) *"[^"]*+(?:""[^"]*+)*+"(?=$|[,\n\r])'


def parse_list(text: str | None) -> list[str] | None:
    """Items of comma-separated text with quotes, trimmed, without blanks; None if a quote is left open or misplaced."""
    if text is None or not text.strip():
        return []
    try:
        rows = list(csv.reader(io.StringIO(text.strip()), strict=True, skipinitialspace=True))
    except csv.Error:
        return None
    if '"' in re.sub(_QUOTED, "", text.strip()):
        return None
    return [item.strip() for row in rows for item in row if item.strip()]


#: White space that is trimmed.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_SPACE}|{_SPACE}$", "")


def list_items(value: Column) -> Column:
    """Items of comma-separated text with quotes, trimmed, without blanks; null if a quote is left open or misplaced. Null text has none."""
    text = _stripped(F.coalesce(value, F.lit("")))
    found = F.regexp_extract_all(text, F.lit(f'{_QUOTED}|[^",\\n\\r]+'), F.lit(0))
    bare = F.transform(found, lambda x: F.when(x.rlike('^ *"'), F.replace(F.regexp_replace(x, '^ *"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    items = F.filter(F.transform(bare, _stripped), lambda x: x != "")
    return F.when(~F.contains(F.regexp_replace(text, _QUOTED, ""), F.lit('"')), items)


def list_text(items: Column) -> Column:
    """The comma-separated form of a list; items with commas, quotes, line ends or outer blanks are quoted."""
    quoted = F.transform(items, lambda x: F.when(x.rlike(r'[",\n\r]|^[ \t]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
    return F.array_join(quoted, ",")


def _boundary(raw: Column, at: Column) -> Column:
    """The first place from ``at`` on (from 0) where a UTF-8 sequence begins, or the end."""
    for _ in range(3):
        byte = F.hex(F.substring(raw, at + 1, F.lit(1)))
        at = F.when(byte.rlike("^[89AB]"), at + 1).otherwise(at)
    return at


def front_back(text: Column, front: int = 200_000, back: int = 50_000) -> Column:
    """A text, or if it is longer than both its first and last bytes, cut where characters begin and joined by a line end."""
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    head = _boundary(raw, F.lit(front))
    tail = _boundary(raw, n - back)
    cut = F.concat_ws("\n", F.decode(F.substring(raw, F.lit(1), head), "UTF-8"), F.decode(F.substring(raw, tail + 1, n - tail), "UTF-8"))
    return F.when(n <= front + back, text).when(n > front + back, cut)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def text_of_html(html: str | None) -> str | None:
    """Text nodes joined by blanks, scripts and styles left out, white space collapsed."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.found).split())


#: What is no text of a page, and tags; an attribute may hold a closing bracket in quotes.
_NO_TEXT = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_TAG = r"""(?s)</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[A-Za-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)"""
#: Names of characters, from Python's own table; those that need no semicolon, longest first.
_NAMED = {k.removesuffix(";"): v for k, v in html.entities.html5.items() if k.endswith(";")}
_LOOSE = "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))


def _character(code: Column) -> Column:
    """The character of a number; the replacement character for what is none."""
    fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code)), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def unescaped(text: Column) -> Column:
    """Text with its character references resolved, as browsers do, those without a semicolon too."""
    # a map is searched from its beginning, so names are kept by their first letter
    letters = sorted({k[0] for k in _NAMED})
    names = F.create_map(*(c for x in letters for c in (F.lit(x), F.create_map(*(F.lit(v) for kv in _NAMED.items() if kv[0][0] == x for v in kv)))))

    def character(name: Column) -> Column:
        return F.when(name == "amp", F.lit("&")).otherwise(F.try_element_at(F.try_element_at(names, F.left(name, F.lit(1))), name))

    def resolved(piece: Column) -> Column:
        # a piece begins behind an ampersand
        rest = lambda n: F.substring(piece, n + 1, F.length(piece))

        def by_number(number: Column) -> Column:
            code = F.when(F.lower(F.left(number, F.lit(1))) == "x", F.conv(F.substring(number, F.lit(2), F.length(number)), 16, 10)).otherwise(number).try_cast("long")
            return F.when(number == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(_character(code), F.regexp_replace(rest(F.length(number) + 1), "^;", "")))

        def by_name(name: Column) -> Column:
            return bound(F.when(name != "", character(name)), lambda c: F.when(c.isNotNull(), F.concat(c, rest(F.length(name) + 1))).otherwise(bound(F.regexp_extract(piece, f"^({_LOOSE})", 1), by_start)))

        def by_start(name: Column) -> Column:
            return F.when(name == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(character(name), rest(F.length(name))))

        return (
            F.when(F.startswith(piece, F.lit("amp;")), F.concat(F.lit("&"), rest(F.lit(4))))
            .when(F.startswith(piece, F.lit("#")), bound(F.regexp_extract(piece, "^#([0-9]{1,9}|[xX][0-9A-Fa-f]{1,8})", 1), by_number))
            .otherwise(bound(F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1), by_name))
        )

    def joined(pieces: Column) -> Column:
        return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), resolved), ""))

    return bound(F.split(text, "&"), joined)


def html_text(page: Column) -> Column:
    """Text nodes joined by blanks, scripts and styles left out, references resolved, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(page, _NO_TEXT, " "), _TAG, " ")
    return _stripped(F.regexp_replace(unescaped(bare), _SPACE, " "))


#: How a chapter begins, words of front matter, and where one sentence ends and the next begins.
CHAPTER = r"(?iu)(?:^|[^0-9A-Za-z_])(?:chapter|chapitre) (?:[0-9]+|[ivxlcdm]+|one|two|three|four|five|premier|première|deux|trois|quatre|cinq)(?:$|[^0-9A-Za-z_])"
FRONT_MATTER = r"(?iu)(?:^|[^0-9A-Za-z_])(?:dedication|dédicace|acknowledg(?:e)?ments|remerciements|copyright|table of contents|sommaire)(?:$|[^0-9A-Za-z_])"
SENTENCE = "[.!?…][”’\"')\\]]? [A-ZÀ-Þ]"


def looks_like_body(text: Column, least: int = 1300, sentences: int = 4) -> Column:
    """A chapter heading, or a long text without words of front matter that has several sentence ends."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t\\n\\x0B\\f\\r \u0085\u00a0]+", " "))
    return (t != "") & (t.rlike(CHAPTER) | ((F.octet_length(t) >= least) & ~t.rlike(FRONT_MATTER) & (F.regexp_count(t, F.lit(SENTENCE)) >= sentences)))


def natural_key(value: Column) -> Column:
    """A string that sorts as a name does whose numbers compare by value, however long: the number of digits stands before them."""
    runs = F.regexp_extract_all(F.lower(value), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, lambda r: key(r)), "")
