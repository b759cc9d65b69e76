"""Book files and catalog responses: read, patched, read again."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from bindery.operators.state import Versions
from bindery.sinks import books as sink
from bindery.sources import books, catalogs, formats


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", compress_type=zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/content.opf",
            """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:o="http://www.idpf.org/2007/opf" unique-identifier="id">
<metadata><dc:title>Title</dc:title><dc:identifier id="id">urn:uuid:1</dc:identifier><dc:identifier>ISBN 978-0-306-40615-7</dc:identifier><dc:language>en</dc:language>
<dc:creator>Ann Author</dc:creator><dc:contributor o:role="trl">Tom Translator</dc:contributor><dc:contributor id="c">Ed Editor</dc:contributor><meta refines="#c" property="role">edt</meta>
<dc:subject>One</dc:subject><dc:subject>Two</dc:subject><meta name="calibre:series" content="Series"/><meta name="cover" content="img"/></metadata>
<manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="img" href="c.png" media-type="image/png"/></manifest><spine><itemref idref="a"/></spine></package>""",
        )
        z.writestr("OEBPS/a.xhtml", "<html><body><p>Hello <b>there</b></p><script>no()</script></body></html>")
        z.writestr("OEBPS/c.png", b"PNG")
    return out.getvalue()


FB2 = """<?xml version="1.0"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info><genre>g</genre><author><first-name>A</first-name><last-name>B C</last-name></author>
<book-title>T</book-title><lang>fr</lang><sequence name="S" number="2"/></title-info><publish-info><publisher>x</publisher><publisher-name>P</publisher-name><year>2001</year></publish-info>
<custom-info info-type="any-subtitle">Sub</custom-info></description><body><p>Body  text</p></body></FictionBook>""".encode()


def cbz() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("pages/010.jpg", b"ten")
        z.writestr("pages/2.jpg", b"two")
        z.writestr("ComicInfo.xml", "<ComicInfo><Title>C</Title><Year>2025</Year><Month>4</Month><Writer>A, B</Writer><LanguageISO>en</LanguageISO></ComicInfo>")
    return out.getvalue()


def test_epub():
    got = formats.read_epub(epub())
    assert got["title"] == "Title" and got["isbn"] == "9780306406157" and got["series"] == "Series"
    assert got["authors"] == ["Ann Author"] and got["translators"] == ["Tom Translator"] and got["tags"] == ["One", "Two"]
    assert formats.read_text(epub(), "x.epub") == "Hello there" and formats.read_cover(epub(), "x.epub") == b"PNG"


def test_fb2():
    got = formats.read_fb2(FB2)
    assert (got["title"], got["authors"], got["series"], got["series_index"], got["publisher"], got["pubdate"], got["subtitle"]) == ("T", ["A B C"], "S", "2", "P", "2001", "Sub")
    assert formats.read_text(FB2, "x.fb2") == "Body text"


def test_cbz():
    got = formats.read_cbz(cbz(), "/lib/Saga [Intégrale]/Tome 3 - Name.cbz")
    assert (got["title"], got["series"], got["series_index"], got["authors"], got["pubdate"], got["languages"]) == ("C", "Saga", "3", ["A", "B"], "2025-04", ["en"])
    assert formats.read_cover(cbz(), "x.cbz") == b"two"


@pytest.mark.parametrize("make, name", [(epub, "b.epub"), (lambda: FB2, "b.fb2"), (cbz, "b.cbz")])
def test_patches_change_only_their_fields(tmp_path, make, name):
    path = tmp_path / name
    path.write_bytes(make())
    before = formats.read_record(make(), str(path))[0]
    after = sink.write(str(path), {"title": "New & better", "authors": ["X Y", "Z"], "series": ""})
    assert after["title"] == "New & better" and after["authors"] == ["X Y", "Z"] and not after.get("series")
    keep = {k: v for k, v in before.items() if k not in ("title", "authors", "series")}
    assert {k: after.get(k) for k in keep} == keep
    if name != "b.fb2":
        with zipfile.ZipFile(io.BytesIO(make())) as a, zipfile.ZipFile(path) as b:
            assert a.namelist() == b.namelist()
            assert all(a.read(n) == b.read(n) for n in a.namelist() if not n.endswith((".opf", "ComicInfo.xml")))


@pytest.mark.parametrize("name, patch", [("a.cbz", {"isbn": "1"}), ("a.cbz", {"subtitle": "s"}), ("a.pdf", {"pubdate": "2000"}), ("a.cbz", {"rating": "5.01"}), ("a.cbz", {"languages": ["en", "fr"]}), ("a.fb2", {"cover_url": "x"}), ("a.epub", {"other": "x"}), ("a.epub", {"authors": "x"})])
def test_patches_that_are_refused(name, patch):
    with pytest.raises(ValueError):
        sink.check(name, patch)


def test_images_of_outer_documents(spark, tmp_path):
    def book(counts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
            items = "".join(f'<item id="d{k}" href="t/{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(counts)))
            refs = "".join(f'<itemref idref="d{k}"/>' for k in range(len(counts)))
            z.writestr("O/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest>{items}</manifest><spine>{refs}</spine></package>')
            for k, n in enumerate(counts):
                tags = [f'<img src="../i/{k}-{j}.png?x#y"/>' if j % 2 else f'<svg><image xlink:href="../i/{k}-{j}.png"/></svg>' for j in range(n)]
                z.writestr(f"O/t/{k}.xhtml", "<html><body>" + "".join(tags) + '<img src="../i/same%20one.png"/><img src="gone.png"/></body></html>')
                for j in range(n):
                    z.writestr(f"O/i/{k}-{j}.png", b"x")
            z.writestr("O/i/same one.png", b"x")
        return out.getvalue()

    got = formats.epub_images(book([14, 0] + [1] * 8 + [9]))
    first = [f"O/i/0-{j}.png" for j in range(12)]
    # of the closing document's eleven the last five, of which two are the repeated and the missing one
    assert got == [*first, "O/i/same one.png", *(f"O/i/{k}-0.png" for k in (2, 3, 4, 5, 6, 7, 8, 9)), *(f"O/i/10-{j}.png" for j in (6, 7, 8))]
    (tmp_path / "a.EPUB").write_bytes(book([2, 1]))
    (tmp_path / "b.epub").write_bytes(b"damaged")
    rows = books.read_images(spark, f"file://{tmp_path}").orderBy("position").collect()
    assert [(r.position, r.image) for r in rows] == [(0, "O/i/0-0.png"), (1, "O/i/0-1.png"), (2, "O/i/same one.png"), (3, "O/i/1-0.png")]


def test_library_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "in" / "b.FB2").write_bytes(FB2)
    (tmp_path / "bad.cbz").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in books.read_books(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"a.epub", "b.FB2", "bad.cbz"}
    assert rows["a.epub"].metadata.title == "Title" and rows["b.FB2"].metadata.authors == ["A B C"]
    assert rows["bad.cbz"].metadata.title == "bad" and rows["bad.cbz"].read_error and len(rows["a.epub"].id) == 24
    assert books.list_books(spark, f"file://{tmp_path}").count() == 3
    assert books.read_texts(spark, f"file://{tmp_path}").where("text <> ''").count() == 3
    patch = spark.createDataFrame([(f"file:{tmp_path}/a.epub", "title", ["Patched"]), (f"file:{tmp_path}/bad.cbz", "title", ["x"])], "path string, field string, values array<string>")
    assert {r.saved for r in sink.write_patches(patch).collect()} == {True, False}
    assert formats.read_epub((tmp_path / "a.epub").read_bytes())["title"] == "Patched"


def rows(spark, body, **more):
    return spark.createDataFrame([("b", json.dumps(body), *more.values())], ["book", "body", *more])


def test_google_books(spark):
    body = {"items": [{"id": "v/1", "volumeInfo": {"title": "T", "authors": ["A"], "industryIdentifiers": [{"type": "ISBN_10", "identifier": "0306406152"}, {"type": "ISBN_13", "identifier": "9780306406157"}, {"type": "OTHER", "identifier": "x"}], "imageLinks": {"thumbnail": "http://x/y"}}}, {"id": "2", "volumeInfo": {"title": "U"}}]}
    a, b = catalogs.google_books(rows(spark, body), ["book"]).collect()
    assert (a.isbn, a.isbns, a.cover, a.url) == ("9780306406157", ["0306406152", "9780306406157"], "https://x/y", "https://books.google.com/books?id=v%2F1")
    assert b.authors == [] and b.isbn == "" and not b.work_record


def test_open_library(spark):
    body = {"docs": [{"key": "/works/W", "title": "T", "author_name": ["A"], "first_publish_year": 1965, "isbn": ["x", "9780306406157"], "language": ["eng", "fre"], "cover_i": 7}]}
    (got,) = catalogs.open_library(rows(spark, body, asked="0306406152"), ["book"], F.col("asked")).collect()
    assert (got.isbn, got.pubdate, got.language, got.work_record, got.cover) == ("9780306406157", "1965", "eng", True, "https://covers.openlibrary.org/b/id/7-M.jpg")


def test_open_library_edition(spark):
    body = {"key": "/books/B", "title": "T", "isbn_13": ["9780306406157"], "by_statement": "Translated from the French by Jane Doe; more", "languages": [{"key": "/languages/eng"}], "contributors": [{"name": "J. Smith", "role": "trl"}], "series": ["S #3"]}
    works = spark.createDataFrame([("9780306406157", 2, ["Late"]), ("0306406152", 1, ["Early"])], "isbn string, position int, authors array<string>")
    (got,) = catalogs.open_library_edition(rows(spark, body, asked="0306406152"), ["book"], "asked", works).collect()
    assert (got.authors, got.translators, got.language, got.isbn, got.series_labels) == (["Early"], ["J. Smith", "Jane Doe"], "eng", "0306406152", ["S #3"])
    assert catalogs.open_library_edition(rows(spark, {"key": "/works/W", "title": "T"}, asked="0306406152"), ["book"], "asked").count() == 0


def test_internet_archive(spark):
    body = {"response": {"docs": [{"identifier": "i d", "title": "T", "creator": ["A ", ""], "isbn": "1", "language": "eng", "year": "1999"}, {"identifier": "", "title": "x"}]}}
    (got,) = catalogs.internet_archive(rows(spark, body), ["book"]).collect()
    assert (got.authors, got.isbns, got.languages, got.pubdate, got.url) == (["A"], ["1"], ["eng"], "1999", "https://archive.org/details/i%20d")
    assert catalogs.all_candidates([catalogs.internet_archive(rows(spark, body), ["book"])]).first().arrival == 3


def test_versions(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/state")
    assert table.current() == 0 and table.read() is None
    assert table.commit(spark.range(3), 0) == 1 and table.read().count() == 3
    assert table.commit(spark.range(5), 1) == 2 and table.read().count() == 5
    with pytest.raises(RuntimeError):
        table.commit(spark.range(9), 1)
    assert table.read().count() == 5
