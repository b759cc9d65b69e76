"""Properties that hold for any input: built-in expressions against plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from bindery.functions import formats, identifiers, text
from bindery.functions.text import normalise


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_normalised_text_is_settled(value):
    once = normalise(value)
    assert normalise(once) == once
    assert once == once.strip() and "  " not in once and len(once.replace(" ", "")) <= 512


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcé 1", max_size=12), st.text(alphabet="abcé 1", max_size=12))
def test_similarity_is_symmetric_and_bounded(a, b):
    s = plain.text_similarity(a, b)
    assert 0 <= s <= 1 and abs(s - plain.text_similarity(b, a)) < 1e-12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab ",\n', min_size=1, max_size=6).filter(lambda x: x.strip() and x == x.strip()), max_size=5))
def test_lists_come_back(items):
    written = ",".join('"' + x.replace('"', '""') + '"' if any(c in x for c in '",\n') else x for x in items)
    assert formats.parse_list(written) == items


def brute_isbn(code):
    if len(code) == 10:
        return sum((10 - k) * (10 if c == "X" else int(c)) for k, c in enumerate(code)) % 11 == 0 if "X" not in code[:9] else False
    return code[:3] in ("978", "979") and sum((1 + 2 * (k % 2)) * int(c) for k, c in enumerate(code)) % 10 == 0


def test_isbns_against_brute_force(spark):
    draw = random.Random(1)
    codes = ["".join(draw.choice("0123456789") for _ in range(9)) + draw.choice("0123456789X") for _ in range(400)]
    codes += ["97" + draw.choice("789") + "".join(draw.choice("0123456789") for _ in range(10)) for _ in range(400)]
    rows = spark.createDataFrame([(c,) for c in codes], ["c"]).select("c", identifiers.valid_isbn10(F.col("c")).alias("ten"), identifiers.valid_isbn13(F.col("c")).alias("thirteen"), identifiers.canonical_isbn(F.col("c")).alias("canonical")).collect()
    for r in rows:
        assert (r.ten if len(r.c) == 10 else r.thirteen) == brute_isbn(r.c)
        assert bool(r.canonical) == brute_isbn(r.c) and (not r.canonical or brute_isbn(r.canonical))


def test_similarities_of_random_names(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdj") for _ in range(draw.randint(1, 6)))
    pairs = [(" ".join(word() for _ in range(draw.randint(0, 4))), " ".join(word() for _ in range(draw.randint(0, 4)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, ["a", "b"])
    rows = df.select("a", "b", text.text_similarity(F.col("a"), F.col("b")).alias("t"), text.author_similarity(F.col("a"), F.col("b")).alias("s"), text.edit_similarity(F.col("a"), F.col("b")).alias("e")).collect()
    for r in rows:
        assert abs(r.t - plain.text_similarity(r.a, r.b)) < 1e-9
        assert abs(r.s - plain.author_similarity(r.a, r.b)) < 1e-9
        assert abs(r.e - plain.edit_similarity(r.a, r.b)) < 1e-9


def test_no_similarity_passes_its_bound(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abé1") for _ in range(draw.randint(1, 5)))
    pairs = [(" ".join(word() for _ in range(draw.randint(0, 4))), " ".join(word() for _ in range(draw.randint(0, 4)))) for _ in range(400)]
    df = spark.createDataFrame([(normalise(a), normalise(b)) for a, b in pairs], ["a", "b"])
    for r in df.select(text.text_similarity(F.col("a"), F.col("b")).alias("s"), text.similarity_bound(F.col("a"), F.col("b")).alias("m")).collect():
        assert r.s <= r.m + 1e-9


def test_samples_against_plain_python(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("aé中😀 ") for _ in range(draw.randint(0, 40))) for _ in range(200)]
    for r in spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", formats.front_back(F.col("t"), 9, 7).alias("s")).collect():
        data = r.t.encode()
        if len(data) <= 16:
            assert r.s == r.t
            continue
        a, b = 9, len(data) - 7
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        assert r.s == data[:a].decode() + "\n" + data[b:].decode()


def slow_normalise(value):
    """Character by character."""
    import unicodedata

    out, gap, kept = "", False, 0
    for char in unicodedata.normalize("NFKD", value):
        kind = unicodedata.category(char)
        if kind[0] == "M":
            continue
        if kept == 512:
            break
        if kind[0] == "L" or kind == "Nd":
            out += (" " if gap and out else "") + char.lower()
            gap, kept = False, kept + 1
        else:
            gap = True
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aÉ́ßﬁ٣Ⅷ한 -\0İς", min_size=0, max_size=40).map(lambda t: t * 60)), max_size=6))
def test_strings_are_normalised_together_as_alone(values):
    assert text.normalise_all(values) == [slow_normalise(v) for v in values]


def test_long_strings_are_read_until_the_cap():
    for value in ("-" * 5000 + "é" * 700, ("é" + "-" * 40) * 600, "a" * 511 + " bc", "\0" * 3000 + "x"):
        assert normalise(value) == slow_normalise(value)


LISTS = [None, "", " ", "a", "a,b", ' a , "b, c", ', '"a ""q"" b",c', '"open', 'a"b', '"a"b', '"a" ,b', "a\nb,c\r\nd", '"a\nb",c', ",,", '" "', '""', "é ,  x", 'x,"y', '"a","b","c"', ' "a"', 'a, "b"', "'a,b'"]


def test_lists_as_the_csv_reader_reads_them(spark):
    draw = random.Random(5)
    texts = LISTS + ["".join(draw.choice('ab ",\n') for _ in range(draw.randint(0, 14))) for _ in range(1500)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", formats.list_items(F.col("t")).alias("l")).collect():
        assert r.l == formats.parse_list(r.t), repr(r.t)


PAGES = [
    "<p>a<b>b</b> c</p><script>if (a < b) x('</p>')</script><style>p{}</style>d", "a &amp; b &lt;c&gt; &eacute;&#233;&#xE9;&#x1F600; &nbsp;x &copy y &ampz &unknown; &", "<p title='a > b'>t</p><!-- <p>no</p> -->u", "x < y and 3 > 2",
    "<script>never closed <p>x</p>", "<SCRIPT src=x></SCRIPT >t", "<!DOCTYPE html><html><body>t</body></html>", "", "<p>one two\n\n three</p>", "&notin; &notit; &not; &#0; &#xD800; &#128512 z", "a<br/>b<br>c", "<a href=x>l</a>m",
]


def test_text_of_pages_as_the_parser_gives_it(spark):
    for r in spark.createDataFrame([(p,) for p in PAGES], "p string").select("p", formats.html_text(F.col("p")).alias("t")).collect():
        assert r.t == formats.text_of_html(r.p), repr(r.p)
    assert spark.createDataFrame([(None,)], "p string").select(formats.html_text(F.col("p")).alias("t")).first().t is None
