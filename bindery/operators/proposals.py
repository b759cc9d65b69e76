"""Identity of a book, and what a catalog record proposes for each of its fields.

Both are built-in expressions over one row a book: first the facts about the names involved (labels of titles and of the file name, normalised
forms), then for each field a list of rules, the first of which that holds gives the value, the reason and whether someone should look at
it. What the rules say comes out as long rows, one for each book and field. Only strings that are not ASCII go to
Python, to be normalised, some of each row at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import identifiers as ids
from bindery.functions import labels
from bindery.functions import text as tx
from bindery.functions.formats import same_volume
from bindery.schema import LISTS, NAMES

#: Format words that are no title, and extensions that a file name may end with.
FORMAT_WORDS = ["epub", "pdf", "cbz", "cbr", "mobi", "azw3", "retail", "ebook", "scan", "ocr"]
FILE_EXTENSION = r"(?i)\.(?:epub|pdf|cbz|cbr|mobi|azw|azw3|fb2)$"
#: A volume mark anywhere in a file name, and the mark of a translator's role after a name.
VOLUME_MARK = r"(?i)(?<![0-9A-Za-z_])(?:t(?:ome)?|vol(?:ume)?\.?|book|livre|part|partie)\s*[-_. ]*[0-9]+(?:[.,][0-9]+)?(?![0-9A-Za-z_])"
ROLE_MARK = r"(?i)\s*(?:\(translator\)|\[translator\]|\(traducteur\)|\(traductrice\)|\(translation\))$"
#: The texts of evidence.
KEPT_EDITION = "Existing edition value preserved; catalog record does not identify this edition reliably"
KEPT_LANGUAGE = "Existing book language preserved; selected record describes another language"
ROLES_RECONCILED = "; contributor roles reconciled with existing metadata"
PROMOTED = "Existing subtitle promoted; main title was a series/volume label"
PROMOTED_DUPLICATE = "Removed duplicate subtitle after promoting it to the main title"
KEPT_TITLE = "Existing specific title preserved; catalog title is a series/volume label"
KEPT_IN_LANGUAGE = "Existing title preserved in the book's language"
SEPARATED = "; book title separated from series/volume"
INFERRED = "Specific title inferred from filename; verify spelling"
NO_TITLE = "No specific title could be established; existing value retained for review"
NUMBERED_SERIES = "; numbered series label"
EDITION_SERIES = "; edition series label"
FROM_FILE = "Filename series/volume label"
FROM_TITLE = "Existing numbered main title"
CORROBORATED = "Corroborated by %s: %s"
NO_DUPLICATE = "Removed duplicate of the proposed main title"
WORK_NOTE = "; work-level data, verify the edition"
EDITION_FIELDS = ["publisher", "pubdate", "isbn"]
CORROBORATED_FIELDS = ["title", "subtitle", "original_title", "series", "series_index"]
SAME_PERSON, SAME_TITLE = 0.9, 0.65

PROPOSAL = "book string, field string, current array<string>, value array<string>, evidence string, review boolean"


def _empty() -> Column:
    return F.lit("")


def _nothing() -> Column:
    return F.expr("cast(array() as array<string>)")


def _text(c: Column) -> Column:
    return F.coalesce(c, _empty())


def _blank(c: Column) -> Column:
    return F.trim(c) == ""


def _edges(c: Column, signs: str = r" _.\[\]()-") -> Column:
    return F.regexp_replace(c, f"^[{signs}]+|[{signs}]+$", "")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _spaced(name: Column) -> Column:
    """A file name with blanks for underscores and one kind of dash between its parts."""
    return F.regexp_replace(F.translate(name, "_", " "), " [–—] ", " - ")


def _clean_parts(name: Column) -> Column:
    """The parts between dashes of a file name without extension, volume marks and release words."""
    base = F.translate(F.regexp_replace(F.regexp_replace(name, FILE_EXTENSION, ""), "^.*/", ""), "_", " ")
    plain = F.regexp_replace(F.regexp_replace(base, VOLUME_MARK, " "), labels.FILE_NOISE, " ")
    return F.transform(F.split(_spaced(plain), " - "), lambda p: _edges(p))


def _label_strings(value: Column) -> Column:
    """Every string whose normalised form classifying a label, or comparing what comes out, may ask for; none of ASCII text."""
    text, bare = "trim(coalesce(_t, ''))", r"regexp_replace(trim(coalesce(_t, '')), r'\.+$', '')"
    series = f"regexp_replace(regexp_extract({text}, r'{labels.NUMBERED}', 1), r'^[ :-]+|[ :-]+$', '')"
    every = f"coalesce(_t, ''), {text}, {series}, trim(regexp_extract({text}, r'{labels.NUMBERED}', 3)), regexp_extract({bare}, r'{labels.BARE}', 1), trim(regexp_extract({bare}, r'{labels.BARE}', 3))"
    return tx.applied(value, "_t", f"if(coalesce(octet_length(_t) > length(_t), false), array({every}), cast(array() as array<string>))")


def _first(*options: tuple[Column, Column], default: Column) -> Column:
    """The value of the first option that holds."""
    out = default
    for holds, value in reversed(options):
        out = F.when(holds, value).otherwise(out)
    return out


def _placeholder(norm: Column) -> Column:
    return tx.placeholder(norm)


class Names:
    """The normalised forms known so far of a table's rows; ``learn`` adds those of more strings."""

    def __init__(self, rows: DataFrame):
        self.rows, self.times = rows, 0

    def learn(self, *arrays: Column) -> None:
        strings = F.concat(*arrays)
        if self.times:
            known = F.col(f"_norms{self.times}")
            more = self.rows.withColumn("_more", tx.norm_lookup(F.filter(strings, lambda s: ~F.map_contains_key(known, s))))
            self.rows = more.withColumn(f"_norms{self.times + 1}", F.map_concat(known, "_more")).drop(f"_norms{self.times}", "_more")
        else:
            self.rows = self.rows.withColumn("_norms1", tx.norm_lookup(strings))
        self.times += 1
        self.settle()

    def add(self, **columns: Column) -> None:
        self.rows = self.rows.withColumns(columns)

    def settle(self) -> None:
        """Work the columns out here: the optimizer would else write each into every later one that uses it, over and over."""
        self.rows = self.rows.withColumn("_once", F.explode(F.array(F.lit(0)))).drop("_once")

    def norm(self, value: Column) -> Column:
        return tx.looked_up(value, f"_norms{self.times}")

    def all(self, values: Column) -> Column:
        return F.transform(values, self.norm)

    def classify(self, value: Column, known: Column) -> Column:
        lookup = f"_norms{self.times}"
        return labels.classify(value, known, lambda v: tx.looked_up_sql(v, lookup))

    def distinct(self, names: Column) -> Column:
        """The first of names that are alike when normalised, trimmed, without blank ones."""
        pairs = F.transform(names, lambda v: tx.bound(F.trim(v), lambda t: F.struct(t.alias("name"), self.norm(t).alias("norm"))))

        def kept(found: Column) -> Column:
            return F.filter(found, lambda x, k: (x["norm"] != "") & (F.array_position(found["norm"], x["norm"]) == k + 1))

        return F.transform(tx.bound(pairs, kept), lambda x: x["name"])

    def titles(self, options: Column) -> Column:
        """Options that may be titles, the first of those that are alike."""
        return self.distinct(F.filter(options, lambda t: tx.bound(self.norm(t), lambda v: ~_placeholder(v) & ~v.isin(FORMAT_WORDS))))

    def cleaned(self, parts: Column, authors: Column, series: Column) -> Column:
        """What cleaned parts of a file name say of the title: those that are neither an author nor the series."""
        known = F.concat(self.all(authors), F.array(self.norm(series), _empty()))
        others = tx.bound(known, lambda names: F.filter(parts, lambda p: ~F.array_contains(names, self.norm(p))))

        def after_series(kept: Column) -> Column:
            led = (series != "") & F.startswith(F.lower(kept), F.lower(series)) & F.substring(kept, F.length(series) + 1, F.lit(1)).rlike(r"^\s$")
            return F.when(led, F.substring(kept, F.length(series) + 1, F.length(kept))).otherwise(kept)

        return F.trim(F.regexp_replace(_edges(tx.bound(F.array_join(others, " "), after_series)), r"\s+", " "))


def _field(rows: DataFrame, struct: str, name: str, many: bool = False) -> Column:
    """A field of a struct column, whether or not the struct has it: never null."""
    has = name in rows.schema[struct].dataType.fieldNames()
    value, kind, none = f"{struct}.`{name}`" if has else "null", "array<string>" if many else "string", "array()" if many else "''"
    return F.expr(f"coalesce(cast({value} as {kind}), cast({none} as {kind}))")


def _identified(rows: DataFrame, strings: list[Column] | None = None) -> Names:
    """rows: book, filename, current. Adds the book's own names, what its file name says, and its titles.

    own_title, own_subtitle, original, own_series, own_volume, own_authors, own_languages; last_clean and file_clean; titles.
    With ``strings``, other arrays of strings to be normalised, also label_parts, what a label is read from in the file name.
    """
    n = Names(rows)
    n.add(
        name=F.regexp_extract(_text(F.col("filename")), "([^/]*)$", 1),
        **{c: F.trim(_field(rows, "current", f)) for c, f in (("own_title", "title"), ("own_subtitle", "subtitle"), ("original", "original_title"), ("own_series", "series"), ("own_volume", "series_index"))},
        own_authors=_field(rows, "current", "authors", True), own_languages=_field(rows, "current", "languages", True),
    )
    last = F.element_at(F.split(_spaced(F.col("name")), " - "), -1)
    n.add(file_parts=_clean_parts(F.col("name")), last_parts=_clean_parts(last), several=F.size(F.split(_spaced(F.col("name")), " - ")) > 1)
    first = [F.array("own_series", _stem(F.col("name"))), F.col("own_authors"), F.col("file_parts"), F.col("last_parts"), *map(_label_strings, map(F.col, ("own_title", "own_subtitle", "original")))]
    if strings is not None:
        first += [F.split(_spaced(_stem(F.col("name"))), " - "), *strings]
    n.learn(*first)
    n.add(**{c: n.cleaned(F.col(p), F.col("own_authors"), F.col("own_series")) for c, p in (("file_clean", "file_parts"), ("last_clean", "last_parts"))})
    second = [F.array("last_clean", F.concat_ws(" ", "own_title", "own_subtitle"), F.concat_ws(" ", "file_clean", "own_subtitle")), _label_strings(F.col("file_clean"))]
    if strings is not None:
        n.add(label_parts=labels.file_parts(F.col("name"), n.all(F.col("own_authors")), n.norm))
        second += [_label_strings(F.array_join("label_parts", " - ")), F.transform("label_parts", lambda v: F.trim(v))]
    n.learn(*second)
    is_file = (F.col("name") != "") & (n.norm(F.col("own_title")) == n.norm(_stem(F.col("name"))))
    n.add(shown_title=F.when(is_file, F.col("file_clean")).otherwise(F.col("own_title")))
    title, subtitle = F.col("shown_title"), F.col("own_subtitle")
    n.add(says_nothing=_placeholder(n.norm(title)) | (n.classify(title, F.col("own_series"))["title"] == ""))
    vague = F.col("says_nothing")
    options = F.concat(
        F.array(F.when(vague, subtitle).otherwise(F.trim(F.concat_ws(" ", title, subtitle))), F.col("original")),
        F.when(vague, _nothing()).otherwise(F.array(title, subtitle)),
        F.when(vague | (F.size("own_authors") == 0), F.concat(F.when(F.col("several"), F.array("last_clean")).otherwise(_nothing()), F.array("file_clean"))).otherwise(_nothing()),
        F.array(title),
    )
    n.add(titles=n.titles(options))
    return n


def identities(books: DataFrame) -> DataFrame:
    """books: book, filename, current. book, titles (most specific first), authors, series, series_index, languages."""
    rows = _identified(books.select(F.col("book").cast("string").alias("book"), "filename", "current")).rows
    return rows.select("book", "titles", F.col("own_authors").alias("authors"), F.col("own_series").alias("series"), F.col("own_volume").alias("series_index"), F.col("own_languages").alias("languages"))


@dataclass
class Rule:
    """Where it holds, a field's value (a list), the reason, and whether to look at it. An empty value never replaces another."""

    holds: Column
    value: Column | None
    evidence: Column | str
    review: Column | bool = False
    clears: bool = False


def _said(value: Column, evidence: Column | str, review: Column | bool) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value.alias("value"), as_column(evidence).alias("evidence"), as_column(review).alias("review"))


def _single(c: Column) -> Column:
    return F.call_function("filter", F.array(c), F.expr("x -> x <> ''"))


def _ruled(rules: list[Rule], held: Column) -> Column:
    """struct<value, evidence, review> of the first rule that holds, else what was held."""
    options = []
    for r in rules:
        value = held["value"] if r.value is None else r.value
        filled = F.lit(True) if r.value is None or r.clears else F.array_join(value, "") != ""
        options.append((r.holds & filled, _said(value, r.evidence, r.review)))
    return _first(*options, default=held)


def _file_label(n: Names) -> None:
    """Adds file_label: struct<title, series, volume> of the file name, and guess: the title that it may stand for."""
    n.add(file_label=labels.file_label(F.col("label_parts"), n.classify(F.array_join("label_parts", " - "), F.col("own_series"))))
    n.add(guess_parts=_clean_parts(F.concat("file_label.title", F.lit(".epub"))), guess_last=_clean_parts(F.concat(F.element_at(F.split(_spaced(F.col("file_label.title")), " - "), -1), F.lit(".epub"))))
    n.learn(_label_strings(F.col("file_label.series")), F.array("file_label.title"), F.col("guess_parts"), F.col("guess_last"))
    n.add(guesses=F.array(*(n.cleaned(F.col(c), F.col("own_authors"), F.col("own_series")) for c in ("guess_last", "guess_parts"))))
    n.learn(F.col("guesses"))
    n.add(guess=F.coalesce(F.try_element_at(n.titles(F.col("guesses")), F.lit(1)), F.trim("file_label.title")))


def _roles(rows: DataFrame) -> dict[str, Column]:
    """The record's authors and translators, those marked as translators among the latter, and the book's translators."""
    authors, translators = (F.transform(_field(rows, "record", f, True), lambda v: F.trim(v)) for f in ("authors", "translators"))
    marked = F.transform(F.filter(authors, lambda a: a.rlike(ROLE_MARK)), lambda a: F.trim(F.regexp_replace(a, ROLE_MARK, "")))
    return {"all_authors": F.filter(authors, lambda a: ~a.rlike(ROLE_MARK)), "all_translators": F.concat(translators, marked), "own_translators": _field(rows, "current", "translators", True)}


def _people(n: Names) -> None:
    """Adds new_authors and new_translators of the record, and whether the authors are the book's."""
    known = n.all(F.col("own_translators"))
    n.add(all_authors=n.distinct(F.col("all_authors")), all_translators=n.distinct(F.col("all_translators")))
    n.add(known_translators=known)
    n.add(moved=F.filter("all_authors", lambda a: tx.bound(n.norm(a), lambda v: F.exists("known_translators", lambda t: tx.author_similarity(t, v) >= SAME_PERSON))))
    n.add(new_authors=F.filter("all_authors", lambda a: ~F.array_contains("moved", a)))
    found = F.concat("all_translators", "moved")
    n.add(new_translators=F.when(F.size(found) > 0, n.distinct(F.concat("own_translators", found))).otherwise(_nothing()))
    n.add(remote_norms=n.all(F.col("new_authors")), local_norms=n.all(F.col("own_authors")))
    n.add(author_hits=F.transform("local_norms", lambda a: F.array_position(F.transform("remote_norms", lambda r: tx.author_similarity(a, r) >= SAME_PERSON), F.lit(True))))
    n.add(same_people=(F.size("own_authors") == F.size("new_authors")) & ~F.array_contains("author_hits", F.lit(0).cast("long")) & (F.size(F.array_distinct("author_hits")) == F.size("author_hits")))


def _specific(n: Names, title: Column, subtitle: Column, known: Column) -> Column:
    """The title of a title's label if it says anything, else the subtitle if that does, else the empty string."""
    own, sub = n.classify(title, known)["title"], F.trim(subtitle)
    sub_fits = ~_placeholder(n.norm(sub)) & (n.classify(sub, known)["title"] != "")
    return _first((~_placeholder(n.norm(own)), own), (sub_fits, sub), default=_empty())


def _series(n: Names, rows: DataFrame) -> None:
    """Adds new_series, new_volume with their reasons, and whether series or volume go against what is known."""
    series_labels = _field(rows, "record", "series_labels", True)
    found = F.transform(series_labels, lambda v: n.classify(v, F.col("known_series")))
    numbered = F.try_element_at(F.filter(found, lambda x: (x["series"] != "") & (x["volume"] != "")), F.lit(1))
    plain = F.coalesce(F.try_element_at(F.filter(F.transform(series_labels, lambda v: F.trim(v)), lambda v: v != ""), F.lit(1)), _empty())
    n.add(numbered_label=numbered)
    given, index, source = _field(rows, "record", "series"), _field(rows, "record", "series_index"), F.col("source")
    one = lambda s, v, why: F.struct(s.alias("series"), v.alias("volume"), why.alias("why"))
    remote, file, local = (F.col(c) for c in ("remote", "file_label", "local"))
    volume_so_far = F.when(remote["series"] != "", remote["volume"]).otherwise(index)
    n.add(chosen=_first(
        (F.col("numbered_label").isNotNull(), one(F.col("numbered_label.series"), F.col("numbered_label.volume"), F.concat(source, F.lit(EDITION_SERIES)))),
        (remote["series"] != "", one(remote["series"], remote["volume"], F.concat(source, F.lit(NUMBERED_SERIES)))),
        (given != "", one(given, index, source)),
        (plain != "", one(plain, volume_so_far, F.concat(source, F.lit(EDITION_SERIES)))),
        (file["series"] != "", one(file["series"], file["volume"], F.lit(FROM_FILE))),
        (local["series"] != "", one(local["series"], local["volume"], F.lit(FROM_TITLE))),
        default=one(_empty(), index, source),
    ))
    n.settle()
    series = F.col("chosen.series")
    n.add(file_agrees=(file["volume"] != "") & (n.classify(file["series"], series)["series"] != ""))
    by_file = (F.col("chosen.volume") == "") & F.col("file_agrees")
    n.add(new_volume=F.when(by_file, file["volume"]).otherwise(F.col("chosen.volume")), volume_why=F.when(by_file, F.lit(FROM_FILE)).otherwise(F.col("chosen.why")))
    n.add(clash=(F.col("own_series") != "") & (series != "") & (n.classify(series, F.col("own_series"))["series"] == ""))
    volume = F.col("new_volume")
    n.add(other_volume=(F.col("own_volume") != "") & ~same_volume(F.col("own_volume"), volume) | F.col("file_agrees") & ~same_volume(file["volume"], volume))


def _hints(rows: DataFrame) -> Callable[[str, bool], Column]:
    """Of a field's corroborating evidence that has a value, the first or the last: struct<field, value, source, url>."""
    if "evidence" not in rows.schema["record"].dataType.fieldNames():
        none = F.lit(None).cast("struct<field:string,value:string,source:string,url:string>")
        return lambda name, last: none
    held = F.coalesce(F.col("record.evidence"), F.array().cast(rows.schema["record"].dataType["evidence"].dataType))
    return lambda name, last: F.try_element_at(F.filter(held, lambda h: (h["field"] == name) & (_text(h["value"]) != "")), F.lit(-1 if last else 1))


def _rules(n: Names, rows: DataFrame) -> dict[str, list[Rule]]:
    """For each field its rules, by what the record, the book and its file name say."""
    given = lambda f: _field(rows, "record", f)
    source, foreign, work, yes = F.col("source"), F.col("foreign"), F.col("work"), F.lit(True)
    doubtful = work | foreign
    out = {name: [Rule(doubtful & (F.col("held")[name]["text"] != ""), None, KEPT_EDITION), Rule(yes, _single(given(name)), source, doubtful)] for name in EDITION_FIELDS}
    for name, key in (("comments", "description"), ("identifiers", "identifiers")):
        out[name] = [Rule(yes, _single(given(key)), source)]
    out["tags"] = [Rule(yes, _field(rows, "record", "categories", True), source)]
    out["catalog_url"] = [Rule(yes, _single(given("catalog_url")), source), Rule(yes, _single(given("url")), source)]
    own_language = F.size("own_languages") > 0
    out["languages"] = [Rule(~own_language, _single(ids.language_key(given("language"))), source, work), Rule(own_language & foreign, None, KEPT_LANGUAGE)]
    out["authors"] = [Rule(yes, F.col("new_authors"), source, (F.size("own_authors") > 0) & ~F.col("same_people"))]
    out["translators"] = [Rule(yes, F.col("new_translators"), F.concat(source, F.lit(ROLES_RECONCILED)), True)]

    title, remote, vague = F.col("local_title"), F.col("remote_title"), F.col("vague")
    unlike = tx.text_similarity(n.norm(title), n.norm(remote)) < SAME_TITLE
    out["title"] = [
        Rule(F.col("promotes"), _single(F.col("own_subtitle")), PROMOTED),
        Rule(~vague & (remote == ""), _single(title), KEPT_TITLE),
        Rule(~vague & foreign, _single(title), KEPT_IN_LANGUAGE),
        Rule(remote != "", _single(remote), F.concat(source, F.lit(SEPARATED)), ~vague & unlike),
        Rule(vague & (F.col("file_label.title") != ""), _single(F.col("guess")), INFERRED, True),
        Rule(yes, None, NO_TITLE),
    ]
    by_file, clash = F.col("chosen.why") == FROM_FILE, F.col("clash")
    out["series"] = [Rule((F.col("own_series") == "") | clash, _single(F.col("chosen.series")), F.col("chosen.why"), clash | by_file)]
    out["series_index"] = [Rule(yes, _single(F.col("new_volume")), F.col("volume_why"), F.col("other_volume") | clash | (F.col("volume_why") == FROM_FILE))]
    other = tx.text_similarity(n.norm(F.col("original")), n.norm(F.trim(given("original_title")))) < SAME_TITLE
    out["original_title"] = [Rule(yes, _single(given("original_title")), source, (F.col("original") != "") & other)]
    return out


def proposals(rows: DataFrame) -> DataFrame:
    """rows: book, filename, current (struct of fields), record (struct of a candidate). One row for each book and field."""
    rows = rows.select(F.col("book").cast("string").alias("book"), "filename", "current", "record")
    given = lambda f: _field(rows, "record", f)
    hints = _hints(rows)
    first_of = {f: hints(f, f == "title") for f in CORROBORATED_FIELDS}
    series_labels = F.flatten(F.transform(_field(rows, "record", "series_labels", True), _label_strings))
    read = [*map(given, ("title", "subtitle", "original_title")), _field(rows, "current", "title")]
    # a series that a label names may look like a label itself
    named = F.concat(series_labels, *map(_label_strings, read), F.array(given("series")))
    rows = rows.withColumns(_roles(rows))
    trimmed = F.transform("own_translators", lambda v: F.trim(v))
    n = _identified(rows, [named, F.flatten(F.transform(named, lambda v: _label_strings(v))), F.array(*(_text(h["value"]) for h in first_of.values())), F.col("all_authors"), F.col("all_translators"), F.col("own_translators"), trimmed])
    _file_label(n)
    # what each field holds now, as a list and as text
    now = [_field(rows, "current", f, True) if f in LISTS else _single(_field(rows, "current", f)) for f in NAMES]
    n.add(
        source=F.coalesce(F.nullif(given("source"), _empty()), F.lit("Catalog record")), work=F.coalesce(given("work_record").try_cast("boolean"), F.lit(False)),
        foreign=ids.language_conflict(F.col("own_languages"), given("language")),
        held=F.struct(*(F.struct(v.alias("value"), F.array_join(v, ", ").alias("text")).alias(f) for f, v in zip(NAMES, now, strict=True))),
        known_series=F.when(F.col("own_series") != "", F.col("own_series")).otherwise(F.col("file_label.series")),
    )
    _people(n)
    known, file = F.col("known_series"), F.col("file_label")
    by_file = n.classify(given("title"), file["series"])
    n.add(local=n.classify(F.col("own_title"), known), remote=n.classify(given("title"), known))
    n.add(remote=F.when((F.col("remote.series") == "") & (file["series"] != "") & (by_file["series"] != ""), by_file).otherwise(F.col("remote")), local_title=F.trim("local.title"))
    n.add(vague=_placeholder(n.norm(F.col("local_title"))), remote_title=_specific(n, given("title"), given("subtitle"), F.when(F.col("remote.series") != "", F.col("remote.series")).otherwise(known)))
    n.add(promotes=F.col("vague") & ~_placeholder(n.norm(F.col("own_subtitle"))) & (n.classify(F.col("own_subtitle"), known)["title"] != ""))
    n.settle()
    _series(n, rows)

    held = {f: _said(F.col("held")[f]["value"], "", False) for f in NAMES}
    rules = _rules(n, rows)
    n.add(**{f"new_{f}": _ruled(rules[f], held[f]) for f in rules})
    n.settle()
    said = {f: F.col(f"new_{f}") if f in rules else held[f] for f in NAMES}

    # the subtitle follows the title
    title_text = lambda: F.array_join(F.col("new_title.value"), ", ")
    subtitle, remote, source = given("subtitle"), F.col("remote_title"), F.col("source")
    taken = ~F.col("promotes") & (remote != "") & (F.col("vague") | ~F.col("foreign"))
    unchanged = title_text() == F.col("held.title.text")
    n.add(new_subtitle=_ruled([
        Rule(F.col("promotes"), _nothing(), PROMOTED_DUPLICATE, clears=True),
        Rule(unchanged & (subtitle != "") & (n.norm(subtitle) != n.norm(title_text())), _single(subtitle), source, F.col("foreign")),
        Rule(taken & (subtitle != "") & (n.norm(subtitle) != n.norm(remote)), _single(subtitle), source),
        Rule(taken & (n.norm(F.col("own_subtitle")) == n.norm(remote)), _nothing(), NO_DUPLICATE, clears=True),
    ], held["subtitle"]))
    # other records' evidence fills what is empty, and a title that is not settled
    settled = F.col("promotes") | ~F.col("vague") & ((remote == "") | F.col("foreign"))
    more = {}
    for f in CORROBORATED_FIELDS:
        now_said, hint = F.col(f"new_{f}"), first_of[f]
        open_field = ~settled if f == "title" else F.array_join(now_said["value"], ", ") == ""
        why = F.format_string(CORROBORATED, _text(hint["source"]), _text(hint["url"]))
        more[f"new_{f}"] = _ruled([Rule(hint.isNotNull() & open_field, _single(_text(hint["value"])), why, True)], now_said)
    n.add(**more)
    n.settle()
    doubled = (title_text() != F.col("held.title.text")) & (n.norm(F.array_join(F.col("new_subtitle.value"), ", ")) == n.norm(title_text()))
    n.add(new_subtitle=_ruled([Rule(doubled, _nothing(), NO_DUPLICATE, F.col("new_title.review"), clears=True)], F.col("new_subtitle")))
    said = {f: F.col(f"new_{f}") if f in rules or f == "subtitle" else held[f] for f in NAMES}
    for f in (*EDITION_FIELDS, "languages"):
        noted = F.when(F.col("work") & said[f]["review"], F.concat(said[f]["evidence"], F.lit(WORK_NOTE))).otherwise(said[f]["evidence"])
        said[f] = _said(said[f]["value"], noted, said[f]["review"])
    listed = [F.struct(F.lit(f).alias("field"), F.col("held")[f]["value"].alias("current"), said[f]["value"].alias("value"), said[f]["evidence"].alias("evidence"), said[f]["review"].alias("review")) for f in NAMES]
    return n.rows.select("book", F.explode(F.array(*listed)).alias("p")).select("book", "p.*")
