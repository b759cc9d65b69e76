"""Cases with known results."""

import pytest
from pyspark.sql import functions as F

import plain
from bindery.functions import formats, identifiers, labels, text
from bindery.operators import proposals

CURRENT = "struct<title:string,subtitle:string,original_title:string,authors:array<string>,translators:array<string>,series:string,publisher:string,pubdate:string,isbn:string,languages:array<string>>"
RECORD = "struct<title:string,subtitle:string,source:string,authors:array<string>,translators:array<string>,publisher:string,pubdate:string,isbn:string,language:string,work_record:boolean,evidence:array<struct<field:string,value:string,source:string,url:string>>>"


def proposed(spark, book, record, filename):
    rows = spark.createDataFrame([("b", filename, book, record)], f"book string, filename string, current {CURRENT}, record {RECORD}")
    return {r.field: r for r in proposals.proposals(rows).collect()}


def identified(spark, book, filename):
    rows = spark.createDataFrame([("b", filename, book)], f"book string, filename string, current {CURRENT}")
    return proposals.identities(rows).first()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("r")).first()
    return row["r"]


@pytest.mark.parametrize(
    "raw, want",
    [("  L'Été — Tome 2! ", "l ete tome 2"), ("Catch-22, Part 1.5", "catch 22 part 1 5"), ("a" * 520, "a" * 512), ("ﬁn", "fin"), (None, ""), ("a b" * 400, None)],
)
def test_normalise(raw, want):
    got = text.normalise(raw)
    assert got == want if want is not None else len(got.replace(" ", "")) == 512


@pytest.mark.parametrize(
    "value, series, want",
    [
        ("Discworld #3 - Equal Rites", "", ("Equal Rites", "Discworld", "3")),
        ("The Expanse 2", "Expanse", ("", "Expanse", "2")),
        ("The Expanse", "Expanse", ("", "Expanse", "")),
        ("Catch 22", "Discworld", ("Catch 22", "", "")),
    ],
)
def test_labels(spark, value, series, want):
    got = spark.createDataFrame([(value, series)], ["v", "s"]).select(labels.classify(F.col("v"), F.col("s"), text.ascii_norm_sql).alias("l")).first()["l"]
    assert tuple(got) == want


@pytest.mark.parametrize(
    "name, authors, want",
    [
        ("Ursula Le Guin - Earthsea - 2,5 - Tehanu (epub).epub", ["ursula le guin"], ("Tehanu", "Earthsea", "2.5")),
        ("Earthsea - 2 - Tehanu - [retail].epub", ["x"], ("Tehanu", "Earthsea", "2")),
        ("Saga - 12.3456789 - Name.epub", ["x"], ("Name", "Saga", "12.3456789")),
        ("Catch 22 (1961).epub", ["x"], ("Catch 22 (1961)", "", "")),
    ],
)
def test_file_labels(spark, name, authors, want):
    rows = spark.createDataFrame([(name, authors)], ["name", "authors"]).select(labels.file_parts(F.col("name"), F.col("authors"), text.ascii_norm).alias("parts"))
    other = labels.classify(F.array_join("parts", " - "), F.lit(""), text.ascii_norm_sql)
    assert tuple(rows.select(labels.file_label(F.col("parts"), other).alias("l")).first()["l"]) == want


def test_identity(spark):
    book = {"title": "Dune", "subtitle": "A Novel", "original_title": "Dune Messiah", "authors": ["Frank Herbert"]}
    assert identified(spark, book, "").titles == ["Dune A Novel", "Dune Messiah", "Dune", "A Novel"]
    book = {"title": "Unknown", "series": "Earthsea", "authors": ["Ursula Le Guin"]}
    assert identified(spark, book, "Ursula Le Guin - Earthsea - Tehanu [epub].epub").titles == ["Tehanu"]
    # a file name may repeat the title; what is not ASCII is normalised too
    book = {"title": "Zoe - L ete", "authors": ["Zoë"]}
    assert identified(spark, book, "lib/Zoë - L'Été.epub").titles == ["L'Été"]
    assert identified(spark, None, None).titles == []


@pytest.mark.parametrize("value", ["", None, "a" * 520, "a b" * 400, " x! ", "L'Été — Tome 2", "ﬁn", "É" * 600, "A" * 511 + " é b"])
def test_normalised_columns(spark, value):
    df = spark.createDataFrame([(value,)], "v string")
    df = df.withColumn("known", text.norm_lookup(F.array("v")))
    got = df.select(text.normalised(F.col("v")).alias("n"), text.looked_up(F.col("v"), "known").alias("m")).first()
    assert got.n == got.m == text.normalise(value)


@pytest.mark.parametrize(
    "raw, want",
    [("0-306-40615-2", "9780306406157"), ("0-8044-2957-X", "9780804429573"), ("9791090636071", "9791090636071"), ("0306406153", ""), ("9780306406158", ""), ("X306406152", ""), ("306406152", ""), (None, "")],
)
def test_canonical_isbn(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "v string").select(identifiers.canonical_isbn(F.col("v")).alias("r")).first()["r"]
    assert got == want


def test_extract_isbns(spark):
    line = "ISBN-10: 0-306-40615-2; ISBN-13: 978-0-306-40615-7; ISBN 0-306-40615-2; invalid 9780306406158"
    assert one(spark, identifiers.extract_isbns(F.col("v")), v=line) == ["0306406152", "9780306406157"]
    assert one(spark, identifiers.extract_isbns(F.col("v")), v="0306406152 9780306406157") == []


def test_lists():
    assert formats.parse_list(' Ada Lovelace, "Martin Luther King, Jr." ') == ["Ada Lovelace", "Martin Luther King, Jr."]
    assert formats.parse_list('a, "b') is None
    assert formats.parse_list('a "b" c') is None or formats.parse_list('a"b') is None
    assert formats.parse_list("  ") == []


def test_roles(spark):
    record = {"authors": ["A B", "C D (translator)", "E F [translator]", "G H (Traductrice)", "a b"], "translators": ["C. D"], "source": "S"}
    p = proposed(spark, {}, record, "")
    assert (p["authors"].value, p["translators"].value) == (["A B"], ["C. D", "E F", "G H"]) and p["translators"].review
    # an author of the record whom the book has as translator stays one
    p = proposed(spark, {"translators": ["Émile Roux"], "authors": ["A B"]}, {"authors": ["A. B", "Emile Roux"]}, "")
    assert (p["authors"].value, p["translators"].value) == (["A. B"], ["Émile Roux"])


def test_similarities_agree(spark):
    pairs = [("Frank Herbert", "F. Herbert"), ("Herbert Frank", "Frank Herbert"), ("J R R Tolkien", "John Tolkien"), ("", "x"), ("Été", "ete"), ("kitten", "sitting")]
    df = spark.createDataFrame(pairs, ["a", "b"]).select("a", "b", text.norm("a").alias("x"), text.norm("b").alias("y"))
    for r in df.select("a", "b", text.text_similarity(F.col("x"), F.col("y")).alias("t"), text.author_similarity(F.col("x"), F.col("y")).alias("s")).collect():
        assert r["t"] == pytest.approx(plain.text_similarity(r["a"], r["b"]))
        assert r["s"] == pytest.approx(plain.author_similarity(r["a"], r["b"]))


def test_front_back_keeps_characters_whole(spark):
    got = one(spark, formats.front_back(F.col("v"), 5, 4), v="aaaaéééééééé")
    assert got == "aaaaé\néé"


def test_front_back_of_all_documents(spark, sf_dir):
    from bindery.plans import catalog

    def brute(text):
        raw = text.encode()
        if len(raw) <= 150:
            return text
        starts = [k for k, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]
        return raw[: min(k for k in starts if k >= 100)].decode() + "\n" + raw[min(k for k in starts if k >= len(raw) - 50) :].decode()

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert any(not t.isascii() for t in docs.values())
    assert {r.doc_id: r["sample"] for r in catalog.queries()["front_back"](spark, sf_dir).collect()} == {k: brute(t) for k, t in docs.items()}
    assert one(spark, formats.front_back(F.lit(None).cast("string"), 5, 4)) is None


def test_body(spark):
    assert one(spark, formats.looks_like_body(F.col("v")), v="x\nChapter  one\n") is True
    assert one(spark, formats.looks_like_body(F.col("v")), v="Copyright. " + "It is so. Then it was. " * 90) is False
    assert one(spark, formats.looks_like_body(F.col("v")), v="It is so. Then it was. " * 90) is True


def test_natural_key(spark):
    names = ["v10", "v2", "V1 b", "v02a"]
    got = [r["v"] for r in spark.createDataFrame([(n,) for n in names], ["v"]).orderBy(formats.natural_key(F.col("v"))).collect()]
    assert got == ["V1 b", "v2", "v02a", "v10"]


def test_html():
    assert formats.text_of_html("<p>a<b>b</b>&amp;\n c<script>var x</script><style>p{}</style></p>") == "a b & c"


def test_series_is_taken_from_a_numbered_record(spark):
    p = proposed(spark, {"title": "Discworld 3", "series": "Discworld", "authors": ["Terry Pratchett"]}, {"title": "Discworld #3 - Equal Rites", "source": "S"}, "x.epub")
    assert p["title"].value == ["Equal Rites"] and not p["title"].review and p["series"].value == ["Discworld"]


def test_work_record_in_another_language_changes_no_edition_field(spark):
    book = {"title": "Le Titre", "publisher": "P", "pubdate": "1999", "isbn": "1", "languages": ["fr"], "authors": ["A B"]}
    record = {"title": "The Title", "publisher": "Q", "pubdate": "2000", "isbn": "2", "language": "eng", "work_record": True, "source": "S", "authors": ["A B"]}
    p = proposed(spark, book, record, "x.epub")
    assert [p[k].value for k in ("title", "publisher", "pubdate", "isbn", "languages")] == [["Le Titre"], ["P"], ["1999"], ["1"], ["fr"]]


def test_corroborated_title_is_for_review(spark):
    record = {"title": "Unknown", "source": "S", "evidence": [{"field": "title", "value": "Real", "source": "D", "url": "u"}, {"field": "isbn", "value": "9", "source": "D", "url": "u"}]}
    p = proposed(spark, {"title": "Unknown"}, record, "x.epub")
    assert p["title"].value == ["Real"] and p["title"].review and not p["isbn"].value
    assert p["title"].evidence == "Corroborated by D: u"


def test_titles_out_of_file_names(spark):
    p = proposed(spark, {"title": "Saga 2", "series": "Saga", "authors": ["A B"]}, {"title": "Saga", "source": "S"}, "A B - Saga - 2 - The Real Name.epub")
    assert p["title"].value == ["The Real Name"] and p["title"].review and p["title"].evidence == proposals.INFERRED
    p = proposed(spark, {"title": "Unknown"}, {}, "")
    assert p["title"].value == ["Unknown"] and p["title"].evidence == proposals.NO_TITLE
    assert all(r.value == r.current for f, r in proposed(spark, None, None, None).items())


def test_image_positions(spark):
    from bindery.operators.library import image_positions

    cases = [(3, True, False), (20, True, False), (20, False, True), (3, False, True), (20, True, True), (0, True, True), (9, False, False)]
    df = spark.createDataFrame(cases, "n int, o boolean, c boolean").select(image_positions(F.col("n"), F.col("o"), F.col("c")).alias("p"))
    want = [[0, 1, 2], list(range(12)), list(range(15, 20)), [0, 1, 2], list(range(7, 20)), [], list(range(9))]
    assert [r.p for r in df.collect()] == want


def test_preferences():
    from bindery import settings

    p = settings.load('{"cache_days": 3, "gone": 1}')
    assert p.cache_days == 3 and p.sources() == ["Google Books", "Open Library", "Internet Archive"]
    assert settings.load(settings.dump(p.changed({"google_books": False}))).sources() == ["Open Library", "Internet Archive"]
    assert settings.load("", {"last_folder": "/x", "other": "y"}).last_folder == "/x" and settings.load(settings.dump(p), {"last_folder": "/x"}).last_folder == p.last_folder
    assert p.changed({"google_books_api_key": "k"}).shown()["google_books_api_key"] == "set"
    for bad in ({"max_candidates": 51}, {"cache_days": -1}, {"background_delay_seconds": 0}, {"log_level": "loud"}, {"other": 1}, {"google_books_api_key": "a\nb"}):
        with pytest.raises(ValueError):
            p.changed(bad)


def test_long_numbers_in_names(spark):
    names = ["v" + "1" + "0" * 25, "v" + "9" * 25, "v" + "0" * 30 + "5", "v1" + "0" * 24 + "1"]
    got = [r["v"] for r in spark.createDataFrame([(n,) for n in names], ["v"]).orderBy(formats.natural_key(F.col("v"))).collect()]
    assert got == sorted(names, key=lambda n: int(n[1:]))


def test_missing_rows_newer_schemas_and_malformed_drafts(spark, tmp_path):
    from bindery.operators import library, state

    rows = spark.createDataFrame([("a", 1)], ["path", "n"])
    assert state.row_of(rows, "a").first().n == 1
    with pytest.raises(Exception, match="no such book: b"):
        state.row_of(rows, "b").collect()
    newer = state.Versions(spark, f"file://{tmp_path}/t", schema=3)
    newer.commit(rows, 0)
    assert newer.read().count() == 1
    with pytest.raises(RuntimeError, match="newer"):
        state.Versions(spark, f"file://{tmp_path}/t", schema=2).read()
    current = spark.createDataFrame([("a", "title", ["x"])], "path string, field string, values array<string>")
    drafts = spark.createDataFrame([("a", '{"title": ["y"]}')], ["path", "json"])
    assert [tuple(r) for r in library.migrate_json(drafts, current).collect()] == [("a", "title", ["y"])]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        library.migrate_json(drafts.union(spark.createDataFrame([("b", '{"title": [')], ["path", "json"])), current).collect()


def test_only_book_files_are_read(spark, tmp_path):
    from bindery.sources import books

    for name in ("a.EPUB", "b.pdf", "c.txt", "d.epub.bak", "e.Cbz"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.name for r in books.list_books(spark, f"file://{tmp_path}").collect()) == ["a.EPUB", "b.pdf", "e.Cbz"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", books._named(books.TEXTS)).load(f"file://{tmp_path}")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["a.EPUB", "c.txt"]


def test_jobs_wait_for_searches_by_hand_and_between_batches(spark, tmp_path):
    import threading
    import time

    from bindery.streaming import jobs

    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 50).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    searching = threading.Event()
    searching.set()
    work = lambda df: df.select("id", (F.col("id") % 2 == 0).alias("failed"))
    at = (f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    job = jobs.start(stream, work, *at, busy=searching.is_set)
    time.sleep(3)
    assert job.status() == "running" and not (tmp_path / "out").exists()
    job.stop()
    assert not (tmp_path / "out").exists()
    # the next run takes up the batch once the search is over
    job = jobs.start(stream, work, *at, delay=0.2, busy=searching.is_set)
    searching.clear()
    job.join()
    done = jobs.progress(spark.read.schema("id long, failed boolean").parquet(at[0])).first()
    assert (done.completed, done.failures, job.status()) == (30, 15, "completed")


def test_number_words_say_which_numbers_differ(spark):
    texts = ["", "ring", "ring 7", "7 old ring", "ring 07", "ring 1 12", "12 ring 1", "ring 11 2", "ring 1 1 2", "v2", "1 v2 12", None]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    by_row = text.numbers_differ(text.number_words(a), text.number_words(b))
    assert rows.where(~by_row.eqNullSafe(text.different_numbers(a, b))).count() == 0
    assert rows.where(by_row).count() == 48
