"""Queries on what sources deliver: catalog responses and book files made of the tables' rows, read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import fb2
from bindery.operators import reconcile, state, view
from bindery.plans.catalog import query, table
from bindery.sources import catalogs


def _text(c: Column) -> Column:
    """A JSON string."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _object(**members: Column) -> Column:
    """A JSON object of members that are JSON texts; absent ones are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in members.items())), F.lit("}"))


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


@query("""
SELECT p_partkey, p_name AS title, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_type || '|B' WHEN 2 THEN '[Anonymous]' WHEN 3 THEN '' ELSE '["A"]' END AS authors,
  CASE WHEN p_partkey % 2 = 0 THEN '[Illustrated] ' || p_name ELSE p_name || ', second' END AS description, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'eng' END AS language,
  CASE WHEN p_partkey % 3 = 0 THEN '19' || p_size ELSE '' END AS pubdate, 'https://archive.org/details/id%20' || p_partkey || '%2Fx' AS url FROM part
""")
def archive_records(spark, sf_dir):
    """Responses whose fields are strings, lists, strings that look like lists, or absent; records without a title are no candidates."""
    k, name = F.col("p_partkey"), F.col("p_name")
    creator = F.when(k % 5 == 0, _text(F.col("p_brand"))).when(k % 5 == 1, _list(_text(F.concat(F.lit(" "), F.col("p_type"))), F.lit('" "'), F.lit('"B"'))).when(k % 5 == 2, F.lit('"[Anonymous]"')).when(k % 5 == 4, F.lit(r'"[\"A\"]"'))
    description = F.when(k % 2 == 0, _text(F.concat(F.lit("[Illustrated] "), name))).otherwise(_list(_text(name), F.lit('"second"')))
    doc = _object(identifier=_text(F.concat(F.lit("id "), k.cast("string"), F.lit("/x"))), title=_text(name), creator=creator, description=description, language=F.when(k % 3 != 0, F.lit('["eng","fre"]')), year=F.when(k % 3 == 0, _text(F.concat(F.lit("19"), F.col("p_size").cast("string")))))
    body = _object(response=_object(docs=_list(doc, _object(identifier=F.lit('"none"')), _object(title=F.lit('"no id"')))))
    broken = table(spark, sf_dir, "part").select("p_partkey", F.lit("{no json").alias("body"))
    responses = table(spark, sf_dir, "part").select("p_partkey", body.alias("body")).unionByName(broken)
    found = catalogs.internet_archive(responses, ["p_partkey"])
    return found.select("p_partkey", "title", F.array_join("authors", "|").alias("authors"), "description", "language", "pubdate", "url")


@query("""
SELECT p_partkey, p_name AS title, p_type || '|B' AS authors, CASE p_partkey % 3 WHEN 0 THEN '978' || p_partkey WHEN 1 THEN '97' || p_partkey ELSE '' END AS isbn,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://x/' || p_partkey ELSE '' END AS cover, 'https://books.google.com/books?id=v%2F' || p_partkey AS url FROM part
""")
def google_records(spark, sf_dir):
    k = F.col("p_partkey")
    number = k.cast("string")
    kinds = F.when(k % 3 == 0, _list(_object(type=F.lit('"ISBN_10"'), identifier=_text(F.concat(F.lit("97"), number))), _object(type=F.lit('"ISBN_13"'), identifier=_text(F.concat(F.lit("978"), number))))).when(k % 3 == 1, _list(_object(type=F.lit('"ISBN_10"'), identifier=_text(F.concat(F.lit("97"), number))), _object(type=F.lit('"OTHER"'), identifier=F.lit('"1"'))))
    info = _object(title=_text(F.col("p_name")), authors=_list(_text(F.col("p_type")), F.lit('"B"')), industryIdentifiers=kinds, imageLinks=F.when(k % 2 == 0, _object(thumbnail=_text(F.concat(F.lit("http://x/"), number)))))
    body = _object(items=_list(_object(id=_text(F.concat(F.lit("v/"), number)), volumeInfo=info)))
    found = catalogs.google_books(table(spark, sf_dir, "part").select("p_partkey", body.alias("body")), ["p_partkey"])
    return found.select("p_partkey", "title", F.array_join("authors", "|").alias("authors"), "isbn", "cover", "url")


@query("""
WITH i AS (SELECT *, '97803064' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '15' AS b FROM part),
c AS (SELECT *, b || ((10 - list_sum(list_transform(range(1, 13), lambda x: (CASE WHEN x % 2 = 0 THEN 3 ELSE 1 END) * substr(b, x::INT, 1)::INT)) % 10) % 10)::INT AS isbn FROM i),
w AS (SELECT isbn, p_name, p_partkey, row_number() OVER (PARTITION BY isbn ORDER BY p_size, p_partkey) AS n FROM c WHERE p_partkey % 3 = 0)
SELECT c.p_partkey AS p_partkey, c.p_name AS title, coalesce('by ' || w.p_name, '') AS authors, CASE WHEN c.p_partkey % 2 = 0 THEN 'Jo|Jane Doe' ELSE 'Jo' END AS translators, c.isbn AS isbn, 'eng' AS language, false AS work_record
FROM c LEFT JOIN w ON w.isbn = c.isbn AND w.n = 1 WHERE c.p_partkey % 7 <> 0
""")
def edition_records(spark, sf_dir):
    """Editions with the authors of the first work of their ISBN; bodies of works are no editions."""
    from bindery.functions import identifiers as ids

    k = F.col("p_partkey")
    code = F.concat(F.lit("97803064"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("15"))
    parts = table(spark, sf_dir, "part").withColumn("isbn", F.concat(code, F.pmod(F.lit(10) - ids._weighted(code, 12, lambda x: 1 + 2 * (x % 2)) % 10, F.lit(10)).cast("string")))
    works = parts.where("p_partkey % 3 = 0").select("isbn", F.struct("p_size", "p_partkey").alias("position"), F.array(F.concat(F.lit("by "), F.col("p_name"))).alias("authors"))
    stated = F.when(k % 2 == 0, F.lit('"by A; translated from the French by Jane Doe; more"'))
    body = _object(key=F.when(k % 7 == 0, F.lit('"/works/W"')).otherwise(F.lit('"/books/B"')), title=_text(F.col("p_name")), isbn_13=_list(_text(F.col("isbn"))), by_statement=stated, contributors=F.lit('[{"name":"Jo","role":" Translator"},{"name":"Ed","role":"editor"}]'), languages=F.lit('[{"key":"/languages/eng"}]'))
    found = catalogs.open_library_edition(parts.select("p_partkey", "isbn", body.alias("body")), ["p_partkey"], "isbn", works)
    return found.select("p_partkey", "title", F.array_join("authors", "|").alias("authors"), F.array_join("translators", "|").alias("translators"), "isbn", "language", "work_record")


@query("""
SELECT p_partkey, p_name AS title, p_type AS authors, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE (1900 + p_size)::VARCHAR END AS pubdate, 'eng|fre' AS languages, CASE WHEN p_partkey % 2 = 0 THEN '0306406152' ELSE 'x' END AS isbn,
  'https://openlibrary.org/works/W' || p_partkey AS url, true AS work_record FROM part
""")
def work_records(spark, sf_dir):
    k = F.col("p_partkey")
    doc = _object(key=_text(F.concat(F.lit("/works/W"), k.cast("string"))), title=_text(F.col("p_name")), author_name=_list(_text(F.col("p_type"))), first_publish_year=F.when(k % 3 != 0, (F.lit(1900) + F.col("p_size")).cast("string")), isbn=F.lit('["x","0306406152"]'), language=F.lit('["eng","fre"]'))
    rows = table(spark, sf_dir, "part").select("p_partkey", _object(docs=_list(doc)).alias("body"), F.when(k % 2 == 0, F.lit("978-0-306-40615-7")).alias("asked"))
    found = catalogs.open_library(rows, ["p_partkey"], F.col("asked"))
    return found.select("p_partkey", "title", F.array_join("authors", "|").alias("authors"), "pubdate", F.array_join("languages", "|").alias("languages"), "isbn", "url", "work_record")


def _xml(c: Column) -> Column:
    """Text of an element: what XML has no sign for becomes a blank."""
    out = F.regexp_replace(c, r"[^\t\n\r\x{20}-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]", " ")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


_SQL_FB2 = r"regexp_replace({0}, '[^\x09\x0a\x0d\x20-\x{{d7ff}}\x{{e000}}-\x{{fffd}}\x{{10000}}-\x{{10ffff}}]', ' ', 'g')"
_SQL_FLAT = r"trim(regexp_replace({0}, '[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


@query(rf"""
SELECT doc_id, 'About ' || source || ' & <more>' AS title, 'Ann B ' || lang || CASE WHEN doc_id % 2 = 0 THEN '|Cy D' ELSE '' END AS authors, lang AS languages, source AS series, (doc_id % 9)::VARCHAR AS series_index,
  CASE WHEN doc_id % 3 = 0 THEN 'P' ELSE '' END AS publisher, CASE WHEN doc_id % 4 = 0 THEN '5' ELSE '' END AS rating, {_SQL_FLAT.format(_SQL_FB2.format("text"))} AS text FROM documents WHERE text IS NOT NULL
UNION ALL SELECT -1 - doc_id, 'f' || doc_id, '', '', '', '', '', '', '' FROM documents WHERE text IS NOT NULL
""")
def fb2_records(spark, sf_dir):
    """Every document as an FB2 book and, cut off within its body, as a damaged one whose record has the file's name."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    even, third, fourth = (F.col("doc_id") % n == 0 for n in (2, 3, 4))
    person = "<{0}><first-name>{1}</first-name><middle-name>{2}</middle-name><last-name>%s</last-name></{0}>"
    xml = F.concat(
        F.lit('<?xml version="1.0"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info>'),
        F.format_string(person.format("author", "Ann", "B"), "lang"), F.when(even, F.lit(person.format("author", "Cy", "") % "D")).otherwise(F.lit("")),
        F.format_string("<book-title>About %s &amp; &lt;more&gt;</book-title><lang>%s</lang><sequence name='%s' number='%d'/></title-info>", "source", "lang", "source", (F.col("doc_id") % 9).cast("int")),
        F.when(third, F.lit("<publish-info><publisher-name> P </publisher-name></publish-info>")).otherwise(F.lit("")), F.when(fourth, F.lit('<custom-info info-type="any-rating">5</custom-info>')).otherwise(F.lit("")),
        F.lit("</description><body><section l:href='x'><!-- no text --><p>"), _xml(F.col("text")), F.lit("</p></section></body><binary>QUJD</binary></FictionBook>"),
    )
    whole = d.select("doc_id", xml.alias("xml"))
    cut = d.select((-1 - F.col("doc_id")).alias("doc_id"), F.concat(F.lit("<FictionBook><description><title-info><book-title>x</book-title></title-info></description><body><p>"), F.col("source")).alias("xml"))
    books = whole.unionByName(cut).select("doc_id", fb2.parsed(F.col("xml")).alias("book"))
    r = fb2.record(F.col("book"), F.concat(F.lit("/lib/f"), (-1 - F.col("doc_id")).cast("string"), F.lit(".fb2")))
    none = F.lit("")
    rows = books.select("doc_id", r.alias("r"), fb2.body_text(F.col("book")).alias("text"))
    return rows.select(
        "doc_id", "r.title", *(F.coalesce(F.array_join(f"r.{c}", "|"), none).alias(c) for c in ("authors", "languages")), *(F.coalesce(f"r.{c}", none).alias(c) for c in ("series", "series_index", "publisher")),
        F.coalesce(F.try_element_at("r.custom", F.lit("rating")), none).alias("rating"), F.coalesce("text", none).alias("text"),
    )


@query("SELECT count(*) AS staged FROM orders WHERE o_orderkey % 3 <> 0")
def staged_total(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return state.staged_count(o.select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("staged")))


@query("""
WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 5 = 0 AS e FROM orders)
SELECT k, 'title' AS field, CASE WHEN e THEN 'By hand' ELSE p END AS value, CASE WHEN e THEN 'Edited by hand' ELSE 'Catalog' END AS evidence, NOT e AND k % 4 = 0 AS review, e AS edited,
  CASE WHEN e THEN 'By hand' ELSE p END <> s AS changed, CASE WHEN e THEN true ELSE p <> s AND k % 4 <> 0 END AS suggested FROM b
UNION ALL SELECT k, 'isbn', CASE WHEN e THEN '' ELSE p END, CASE WHEN e THEN 'Edited by hand' ELSE 'Catalog' END, false, e, true, k % 2 <> 0 FROM b
""")
def editor_edits(spark, sf_dir):
    """Proposals with edits by hand over a fifth of them; every second book is of a format that keeps no ISBN."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    as_list = lambda c: F.array(c)
    fields = F.array(
        F.struct(F.lit("title").alias("field"), as_list(F.col("o_orderstatus")).alias("current"), as_list(F.col("o_orderpriority")).alias("value"), F.lit("Catalog").alias("evidence"), (k % 4 == 0).alias("review")),
        F.struct(F.lit("isbn").alias("field"), as_list(F.lit("1")).alias("current"), as_list(F.col("o_orderpriority")).alias("value"), F.lit("Catalog").alias("evidence"), F.lit(False).alias("review")),
    )
    proposed = o.select(k.cast("string").alias("book"), F.explode(fields).alias("p")).select("book", "p.*")
    hand = o.where(k % 5 == 0).select(k.cast("string").alias("book"), F.explode(F.array(F.struct(F.lit("title").alias("field"), F.array(F.lit("By hand")).alias("value")), F.struct(F.lit("isbn").alias("field"), F.array().cast("array<string>").alias("value")))).alias("p")).select("book", "p.*")
    filename = F.when(F.col("book").cast("long") % 2 == 0, F.lit("x.cbz")).otherwise(F.lit("x.epub"))
    rows = reconcile.editor_rows(proposed, filename, hand)
    return rows.select(F.col("book").cast("long").alias("k"), "field", F.array_join("value", ", ").alias("value"), "evidence", "review", "edited", "changed", "suggested")


@query("""
WITH p AS (SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, path, CASE WHEN path = '/' THEN '' WHEN regexp_extract(path, '^(.*)/[^/]+/*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]+/*$', 1) END AS parent FROM p
""")
def parent_folders(spark, sf_dir):
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), view.parent(path).alias("parent"))
