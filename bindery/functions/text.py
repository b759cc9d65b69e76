"""Normalised text and the similarities built on it.

Normalising needs Unicode decomposition, which Spark lacks, so it is the one vectorised UDF here, and it sees only what is not
ASCII: ``normalised`` of a column, ``norm_dimension`` of distinct strings to join, ``norm_lookup`` of the strings of a row.
Everything else, and everything on normalised text, is built-in expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters and digits that a normalised text keeps at most.
NORM_CAP = 512

#: Titles that say nothing, in normalised form.
PLACEHOLDER_TITLES = ["", "unknown", "untitled", "unknown title", "sans titre", "book", "ebook", "title", "titre"]


class _Letters(dict):
    """What each character becomes: its letters and digits decomposed, without marks, in lower case; a blank for what is neither."""

    def __missing__(self, code: int) -> str:
        out = ""
        for char in unicodedata.normalize("NFKD", chr(code)):
            kind = unicodedata.category(char)
            if kind[0] != "M":
                out += char.lower() if kind[0] == "L" or kind == "Nd" else " "
        self[code] = out
        return out


_LETTERS = _Letters({0: "\0"})
#: Characters of each string that are looked at first: enough for nearly all.
_HEAD = 2 * NORM_CAP


def _capped(spaced: str) -> str:
    """Words with one blank between them, as far as the cap goes."""
    text = " ".join(spaced.split())
    if len(text) <= NORM_CAP or len(text) - text.count(" ") <= NORM_CAP:
        return text
    room, kept = NORM_CAP, []
    for word in text.split(" "):
        kept.append(word[:room])
        room -= len(kept[-1])
        if not room:
            break
    return " ".join(kept)


def normalise(value: str | None) -> str:
    """Decomposed, without marks, lower case; runs of other than letters and decimal digits are one space."""
    return normalise_all([value])[0]


def normalise_all(values: list[str | None]) -> list[str]:
    """The normalised forms of many strings: each distinct character is looked up once, and all strings are translated as one."""
    texts = [(v or "").replace("\0", " ") for v in values]
    found = "\0".join(t[:_HEAD] for t in texts).translate(_LETTERS).split("\0") if texts else []
    for k, t in enumerate(texts):
        at = _HEAD
        while at < len(t) and len(found[k]) - found[k].count(" ") < NORM_CAP:
            found[k] += t[at : 4 * at].translate(_LETTERS)
            at *= 4
    return [_capped(f) for f in found]


@F.pandas_udf(T.StringType())
def norm(values: pd.Series) -> pd.Series:
    return pd.Series(normalise_all(values.tolist()), dtype=object)


def ascii_norm(value: Column) -> Column:
    """The normalised form of ASCII text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))
    return F.rtrim(F.regexp_extract(plain, f"^(?: ?[^ ]){{0,{NORM_CAP}}}", 0))


def beyond_ascii(value: Column) -> Column:
    return F.coalesce(F.octet_length(value) > F.length(value), F.lit(False))


def normalised(value: Column) -> Column:
    """The normalised form of any text; what is ASCII stays in the JVM."""
    beyond = beyond_ascii(value)
    return F.when(beyond, norm(F.when(beyond, value))).otherwise(ascii_norm(value))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _norm_map(values: pd.Series) -> pd.Series:
    every = list(dict.fromkeys(v for found in values if found is not None for v in found))
    known = dict(zip(every, normalise_all(every), strict=True))
    return pd.Series([{} if found is None else {v: known[v] for v in found} for found in values], dtype=object)


def norm_lookup(strings: Column) -> Column:
    """Map of those strings of an array that are not ASCII to their normalised forms, for ``looked_up``."""
    return _norm_map(F.array_distinct(F.filter(strings, lambda v: beyond_ascii(v))))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def applied(value: Column, parameter: str, body: str) -> Column:
    """A SQL expression over a parameter, applied to a value that is worked out once; the text is parsed by Spark, at once."""
    return F.call_function("transform", F.array(value), F.expr(f"{parameter} -> {body}"))[0]


def ascii_norm_sql(value: str) -> str:
    return f"rtrim(regexp_extract(trim(regexp_replace(lower(coalesce({value}, '')), '[^a-z0-9]+', ' ')), '^(?: ?[^ ]){{0,{NORM_CAP}}}', 0))"


def looked_up_sql(value: str, lookup: str) -> str:
    """SQL of the normalised form of a string that is ASCII or in the lookup (its column's name)."""
    return f"transform(array({value}), _v -> if(_v = '', _v, coalesce(try_element_at({lookup}, _v), {ascii_norm_sql('_v')})))[0]"


def looked_up(value: Column, lookup: str) -> Column:
    """The normalised form of a string that is ASCII or in the lookup; usable within lambdas."""
    return applied(value, "_w", looked_up_sql("_w", lookup))


def norm_dimension(strings: DataFrame, column: str) -> DataFrame:
    """``column`` and its ``<column>_norm`` for every distinct value: normalising runs once a value."""
    return strings.select(column).distinct().withColumn(f"{column}_norm", normalised(F.col(column)))


def words(normalised: Column) -> Column:
    """Words of a normalised text; none for the empty text."""
    return F.filter(F.split(normalised, " "), lambda w: w != "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in code points; 0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def _overlap(a: Column, b: Column) -> Column:
    left, right = F.array_distinct(words(a)), F.array_distinct(words(b))
    return 2.0 * F.size(F.array_intersect(left, right)) / F.greatest(F.size(left) + F.size(right), F.lit(1))


def similarity_bound(a: Column, b: Column) -> Column:
    """What the text similarity of two normalised texts can't pass, by their lengths and common words; no edit distance is worked out."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.lit(0.6) * shorter / longer + F.lit(0.4) * _overlap(a, b)


def text_similarity(a: Column, b: Column) -> Column:
    """Of normalised texts: 1 if equal, 0 if one is empty, else 0.6 edit similarity + 0.4 Dice overlap of words."""
    mixed = F.lit(0.6) * edit_similarity(a, b) + F.lit(0.4) * _overlap(a, b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(mixed)


def name_word_similarity(a: Column, b: Column) -> Column:
    """0.9 where one is the other's initial, else the edit similarity."""
    initial = (F.least(F.length(a), F.length(b)) == 1) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return F.when(initial, F.lit(0.9)).otherwise(edit_similarity(a, b))


def greedy_total(left: Column, right: Column, score, least: float = 0.0) -> Column:
    """Sum of best scores when each of ``left`` in turn takes the best free one of ``right``.

    A pair counts from a score of ``least`` on and above 0; among equal scores the earlier of ``right`` is taken.
    """
    start = F.struct(F.lit(0.0).cast("double").alias("total"), F.array().cast("array<int>").alias("used"))

    def step(state: Column, item: Column) -> Column:
        scored = F.transform(right, lambda other, k: F.struct(score(item, other).cast("double").alias("s"), (-k).alias("k")))
        free = F.filter(scored, lambda x: (x["s"] > 0) & (x["s"] >= least) & ~F.array_contains(state["used"], -x["k"]))
        best = F.array_max(free)
        return F.when(best.isNull(), state).otherwise(
            F.struct((state["total"] + best["s"]).alias("total"), F.concat(state["used"], F.array(-best["k"])).alias("used"))
        )

    return F.aggregate(left, start, step, lambda state: state["total"])


def author_similarity(a: Column, b: Column) -> Column:
    """Of normalised names: the text similarity, or the share of words matched one to one if that is higher."""
    left, right = words(a), words(b)
    n = F.size(left) + F.size(right)
    matched = F.when(n > 0, 2.0 * greedy_total(left, right, name_word_similarity, 0.75) / n).otherwise(F.lit(0.0))
    return F.greatest(text_similarity(a, b), matched)


def author_score(local: Column, remote: Column) -> Column:
    """Mean over local (normalised) authors of the best free remote author's similarity; 0 without local authors."""
    return F.when(F.size(local) > 0, greedy_total(local, remote, author_similarity) / F.size(local)).otherwise(F.lit(0.0))


def _numbers(normalised: Column) -> Column:
    return F.array_sort(F.filter(words(normalised), lambda w: w.rlike("^[0-9]+$")))


def number_words(normalised: Column) -> Column:
    """The words of digits of a normalised text in order, one blank between them; the empty text if it has none."""
    return F.array_join(_numbers(normalised), " ")


def numbers_differ(a: Column, b: Column) -> Column:
    """``different_numbers`` of two texts by their number words, for rows that meet many others."""
    return (a != "") & (b != "") & (a != b)


def different_numbers(a: Column, b: Column) -> Column:
    """Both normalised texts hold words of digits, and not the same ones."""
    numbers = [_numbers(x) for x in (a, b)]
    return (F.size(numbers[0]) > 0) & (F.size(numbers[1]) > 0) & (numbers[0] != numbers[1])


def placeholder(normalised: Column) -> Column:
    return normalised.isin(PLACEHOLDER_TITLES)


def series_key_sql(normalised: str) -> str:
    """SQL of a normalised series name without one leading article, if more than that is left."""
    return f"regexp_replace({normalised}, '^(?:the|a|an|les|le|la|l|un|une) (?=[^ ])', '')"


def truncated(value: Column, n: int) -> Column:
    return F.left(value, F.lit(n))
