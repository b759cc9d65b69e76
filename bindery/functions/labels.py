"""Title, series and volume out of titles and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.text import applied, series_key_sql

#: A numbered label with a marker, one without, and a volume between the parts of a file name.
NUMBERED = r"(?iu)^(.+?)[\t\n\f\r ]+(?:[-:][\t\n\f\r ]*)?(?:t(?:ome)?|vol(?:ume)?\.?|book|livre|#)[\t\n\f\r ]*([0-9]+(?:[.,][0-9]+)?)[\t\n\f\r ]*(?:[-:–—][\t\n\f\r ]*)?(.*)$"
BARE = r"^(.+?)[\t\n\f\r ]+(?:[-:#]+[\t\n\f\r ]*)?([0-9]+(?:[.,][0-9]+)?)(?:[\t\n\f\r ]*[-:–—][\t\n\f\r ]*(.*))?$"
FILE_VOLUME = r"^[0-9]{1,3}(?:[.,][0-9]+)?$"
#: Fixed value: words of release that a file name may carry.
FILE_NOISE = r"(?i)(?:\[(?:epub|pdf|cbz|cbr|mobi|azw3?|fb2|retail|ebook|scan|ocr|fr|en)\]|\((?:epub|pdf|cbz|cbr|mobi|azw3?|fb2|retail|ebook|scan|ocr|fr|en)\)|[\t\n\f\r ]+(?:epub|cbz|cbr|mobi|azw3?|fb2|retail|ebook|scan|ocr)$)"


def _label(title: Column, series: Column, volume: Column) -> Column:
    return F.struct(F.trim(title).alias("title"), series.alias("series"), F.translate(volume, ",", ".").alias("volume"))


def _label_sql(title: str, series: str, volume: str) -> str:
    return f"named_struct('title', trim({title}), 'series', {series}, 'volume', translate({volume}, ',', '.'))"


def classify_sql(value: str, known_series: str, norm_of: Callable[[str], str]) -> str:
    """SQL of ``classify``: one expression, however often its parts are used."""

    def key(text: str) -> str:
        return series_key_sql(norm_of(text))

    series = f"regexp_replace(regexp_extract(_c.text, r'{NUMBERED}', 1), r'^[ :-]+|[ :-]+$', '')"
    numbered = _label_sql(f"regexp_extract(_c.text, r'{NUMBERED}', 3)", series, f"regexp_extract(_c.text, r'{NUMBERED}', 2)")
    bare = _label_sql(f"regexp_extract(_c.bare, r'{BARE}', 3)", "_c.known", f"regexp_extract(_c.bare, r'{BARE}', 2)")
    before = f"regexp_extract(_c.bare, r'{BARE}', 1)"
    parts = rf"named_struct('text', trim(coalesce({value}, '')), 'bare', regexp_replace(trim(coalesce({value}, '')), r'\.+$', ''), 'known', coalesce({known_series}, ''))"
    return (
        f"transform(array({parts}), _c -> case when _c.text rlike r'{NUMBERED}' then {numbered} "
        f"when _c.known <> '' and _c.bare rlike r'{BARE}' and {key(before)} = {key('_c.known')} then {bare} "
        f"when _c.known <> '' and {key('_c.text')} = {key('_c.known')} then {_label_sql("''", '_c.known', "''")} "
        f"else {_label_sql('_c.text', "''", "''")} end)[0]"
    )


def classify(value: Column, known_series: Column, norm_of: Callable[[str], str]) -> Column:
    """struct<title, series, volume> of a label; ``norm_of`` gives the SQL of a text's normalised form.

    A marked number splits title and series; a bare one does if what is before it is the known series; a value that is the
    known series is no title; all else is one.
    """
    return applied(F.struct(value.alias("v"), known_series.alias("k")), "_l", classify_sql("_l.v", "_l.k", norm_of))


def file_parts(filename: Column, author_norms: Column, norm_of_part) -> Column:
    """The parts of a file name between dashes, without its extension, release words and authors.

    ``norm_of_part`` maps a part to its normalised form.
    """
    stem = F.regexp_replace(filename, r"\.[^./]*$", "")
    stem = F.regexp_replace(F.translate(stem, "_", " "), " [–—] ", " - ")
    parts = F.filter(F.split(stem, " - "), lambda p: ~F.array_contains(author_norms, norm_of_part(p)))
    return F.split(F.regexp_replace(F.array_join(parts, " - "), FILE_NOISE, " "), " - ")


def file_label(parts: Column, fallback: Column) -> Column:
    """struct<title, series, volume> of a file name of the form series - volume - title, else ``fallback``."""
    volume = F.trim(F.try_element_at(parts, F.lit(2)))
    series = F.trim(F.try_element_at(parts, F.lit(1)))
    title = F.regexp_replace(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(3))), " - "), r"^[ :–—-]+|[ :–—-]+$", "")
    number = F.translate(volume, ",", ".")
    plain = F.regexp_replace(F.regexp_replace(number, r"^0+(?=[0-9])", ""), r"(\.[0-9]*?)0+$", "$1")
    fits = (F.size(parts) >= 3) & volume.rlike(FILE_VOLUME) & (series != "") & (title != "")
    return F.when(fits, _label(title, series, F.regexp_replace(plain, r"\.$", ""))).otherwise(fallback)
