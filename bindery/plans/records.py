"""Queries on whole records: identity, reconciliation, background matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.operators import held, library, match, proposals, reconcile, state
from bindery.plans.catalog import query, table
from bindery.schema import NAMES
from bindery.sources import properties
from bindery.streaming import jobs
from bindery.streaming import state as streams


def _books(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    current = F.struct(
        F.when(k % 4 == 0, F.concat_ws(" ", F.col("p_brand"), F.col("p_size").cast("string"))).when(k % 4 == 1, F.lit("Unknown")).otherwise(F.col("p_name")).alias("title"),
        F.when(k % 8 == 0, F.concat(F.lit("The "), F.col("p_name"))).alias("subtitle"),
        F.array("p_type").alias("authors"),
        F.when(k % 4 == 0, F.col("p_brand")).alias("series"),
        F.when(k % 3 == 0, F.lit("Old")).alias("publisher"),
        F.when(k % 2 == 0, F.array(F.lit("en"))).otherwise(none).alias("languages"),
        F.when(k % 9 == 0, F.array(F.lit("Someone Else"))).alias("translators"),
    )
    record = F.struct(
        F.concat(F.col("p_brand"), F.lit(" #"), F.col("p_size").cast("string"), F.lit(" - "), F.col("p_name")).alias("title"),
        F.when(k % 4 == 0, F.array(F.lit("Someone Else"))).otherwise(F.array("p_type")).alias("authors"),
        F.lit("New").alias("publisher"),
        F.lit("2001-02-03").alias("pubdate"),
        F.col("p_type").alias("description"),
        F.array("p_brand").alias("categories"),
        F.when(k % 10 == 0, F.col("p_name")).alias("original_title"),
        F.when(k % 7 == 0, F.lit("fr")).otherwise(F.lit("eng")).alias("language"),
        (k % 5 == 0).alias("work_record"),
        F.lit("Catalog").alias("source"),
        F.concat(F.lit("https://c/"), k.cast("string")).alias("url"),
    )
    name = F.concat(F.col("p_type"), F.lit(" - "), F.col("p_name"), F.lit(" [epub].epub"))
    return table(spark, sf_dir, "part").select(k.cast("string").alias("book"), name.alias("filename"), current.alias("current"), record.alias("record"))


@query("""
WITH b AS (
  SELECT p_partkey::VARCHAR AS book, p_brand || ' ' || p_size AS label, p_name AS name, p_partkey % 4 AS k, p_partkey % 8 = 0 AS sub FROM part
)
SELECT book, CASE WHEN k = 0 AND sub THEN 'The ' || name || '|' || name || '|' || label WHEN k = 0 THEN name || '|' || label ELSE name END AS titles FROM b
""")
def identity(spark, sf_dir):
    found = proposals.identities(_books(spark, sf_dir).select("book", "filename", "current"))
    return found.select("book", F.array_join("titles", "|").alias("titles"))


#: What SQL says of each field: value, evidence, review, changed; w: the record is of a work, o: in another language.
_FIELD_SQL = {
    "title": ("CASE WHEN k % 8 = 0 THEN 'The ' || p_name ELSE p_name END", f"CASE WHEN k % 8 = 0 THEN '{proposals.PROMOTED}' WHEN k % 4 = 2 AND o THEN '{proposals.KEPT_IN_LANGUAGE.replace("'", "''")}' ELSE 'Catalog{proposals.SEPARATED}' END", "false", "k % 4 < 2"),
    "subtitle": ("''", f"CASE WHEN k % 8 = 0 THEN '{proposals.PROMOTED_DUPLICATE}' ELSE '' END", "false", "k % 8 = 0"),
    "series": ("p_brand", f"CASE WHEN k % 4 = 0 THEN '' ELSE 'Catalog{proposals.NUMBERED_SERIES}' END", "false", "k % 4 <> 0"),
    "series_index": ("p_size::VARCHAR", f"'Catalog{proposals.NUMBERED_SERIES}'", "false", "true"),
    "publisher": ("CASE WHEN k % 3 = 0 AND (w OR o) THEN 'Old' ELSE 'New' END", f"CASE WHEN k % 3 = 0 AND (w OR o) THEN '{proposals.KEPT_EDITION}' WHEN w THEN 'Catalog{proposals.WORK_NOTE}' ELSE 'Catalog' END", "k % 3 <> 0 AND (w OR o)", "NOT (k % 3 = 0 AND (w OR o))"),
    "pubdate": ("'2001-02-03'", f"CASE WHEN w THEN 'Catalog{proposals.WORK_NOTE}' ELSE 'Catalog' END", "w OR o", "true"),
    "languages": ("CASE WHEN k % 2 = 0 THEN 'en' WHEN k % 7 = 0 THEN 'fr' ELSE 'en' END", f"CASE WHEN k % 2 = 0 THEN CASE WHEN o THEN '{proposals.KEPT_LANGUAGE}' ELSE '' END WHEN w THEN 'Catalog{proposals.WORK_NOTE}' ELSE 'Catalog' END", "k % 2 = 1 AND w", "k % 2 = 1"),
    "authors": ("CASE WHEN k % 4 = 0 AND k % 9 <> 0 THEN 'Someone Else' ELSE p_type END", "CASE WHEN k % 36 = 0 THEN '' ELSE 'Catalog' END", "k % 4 = 0 AND k % 9 <> 0", "k % 4 = 0 AND k % 9 <> 0"),
    "translators": ("CASE WHEN k % 9 = 0 THEN 'Someone Else' ELSE '' END", f"CASE WHEN k % 36 = 0 THEN 'Catalog{proposals.ROLES_RECONCILED}' ELSE '' END", "k % 36 = 0", "false"),
    "tags": ("p_brand", "'Catalog'", "false", "true"),
    "comments": ("p_type", "'Catalog'", "false", "true"),
    "catalog_url": ("'https://c/' || k", "'Catalog'", "false", "true"),
    "original_title": ("CASE WHEN k % 10 = 0 THEN p_name ELSE '' END", "CASE WHEN k % 10 = 0 THEN 'Catalog' ELSE '' END", "false", "k % 10 = 0"),
}
_ROWS_SQL = " UNION ALL ".join(
    "SELECT k::VARCHAR AS book, '{}' AS field, {} AS value, {} AS evidence, {} AS review, {} AS changed FROM b".format(name, *_FIELD_SQL.get(name, ("''", "''", "false", "false"))) for name in NAMES
)


@query(f"""
WITH b AS (SELECT *, p_partkey AS k, p_partkey % 5 = 0 AS w, p_partkey % 14 = 0 AS o FROM part), r AS ({_ROWS_SQL})
SELECT *, changed AND NOT review AND (value <> '' OR field = 'subtitle' AND evidence <> '') AS suggested FROM r
""")
def reconcile_flags(spark, sf_dir):
    rows = reconcile.editor_rows(proposals.proposals(_books(spark, sf_dir)), F.lit("a.epub"))
    return rows.select("book", "field", F.array_join("value", ", ").alias("value"), "evidence", "review", "changed", "suggested")


@query("SELECT event_type, count(*) AS completed, count(*) FILTER (event_type = 'error' OR value < 5) AS failures FROM events GROUP BY event_type")
def job_progress(spark, sf_dir):
    at = held.folder(spark, "job")
    job = jobs.start(_event_stream(spark, sf_dir), lambda df: df.select("event_type", ((F.col("event_type") == "error") | (F.col("value") < 5)).alias("failed")), f"{at}/outcome", f"{at}/checkpoint")
    job.join()
    return jobs.progress(spark.read.schema("event_type string, failed boolean").parquet(f"{at}/outcome"), "event_type")


def _event_stream(spark, sf_dir) -> DataFrame:
    # a pattern that fits this one name: a stream's source takes a folder or a pattern, and the table may be a file
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")


def _drained(rows: DataFrame, at: str) -> DataFrame:
    """All that a stream says of what is there now."""
    streams.drain(rows, f"{at}/said", f"{at}/checkpoint")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/said")


#: Users whose lookups go to one cache, entries of a cache, and the seconds that a lookup accepts.
CACHE_USERS, CACHE_KEEP, CACHE_AGE = 8, 12, 100_000


@query(f"""
WITH o AS (
  SELECT 'c' || user_id // {CACHE_USERS} AS cache, event_id AS seq, floor(epoch(ts))::BIGINT AS sec, event_type IN ('purchase', 'signup') AS put, 'q' || event_id % 40 AS cache_key, props FROM events
), g AS (
  SELECT g.cache, g.seq, g.cache_key, g.sec, p.cache_key AS other, arg_max(p.sec, (p.sec, p.seq)) AS put_sec, arg_max(p.props, (p.sec, p.seq)) AS props
  FROM o g LEFT JOIN o p ON p.put AND p.cache = g.cache AND (p.sec, p.seq) < (g.sec, g.seq) WHERE NOT g.put GROUP BY ALL
), m AS (SELECT cache, seq, put_sec, props FROM g WHERE other = cache_key),
n AS (
  SELECT g.cache, g.seq, any_value(g.cache_key) AS cache_key, any_value(g.sec) AS sec, any_value(m.put_sec) AS put_sec, any_value(m.props) AS props, count(*) FILTER (g.put_sec > m.put_sec OR g.put_sec = m.put_sec AND g.other < g.cache_key) AS newer
  FROM g LEFT JOIN m ON m.cache = g.cache AND m.seq = g.seq GROUP BY g.cache, g.seq
), h AS (SELECT *, coalesce(put_sec >= sec - {CACHE_AGE} AND newer < {CACHE_KEEP}, false) AS hit FROM n)
SELECT cache, seq, cache_key, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS kind, CASE WHEN hit THEN props END AS result_json FROM h
""")
def cache_stream(spark, sf_dir):
    """Every event as an operation of a cache that some users share: purchases and signups put, the others ask."""
    e = _event_stream(spark, sf_dir)
    put = F.col("event_type").isin("purchase", "signup")
    operations = e.select(
        F.concat(F.lit("c"), F.expr(f"user_id div {CACHE_USERS}").cast("string")).alias("cache"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), put.alias("put"),
        F.concat(F.lit("q"), (F.col("event_id") % 40).cast("string")).alias("cache_key"), F.when(put, F.col("props")).alias("result_json"), F.lit(CACHE_AGE).alias("max_age"),
    )
    said = _drained(streams.cache_answers(operations, CACHE_KEEP), held.folder(spark, "job"))
    return said.where("kind <> 'expired'").select("cache", "seq", "cache_key", "kind", "result_json")


@query("""
WITH e AS (
  SELECT event_id, user_id, event_type = 'click' AS fallback, event_type = 'error' AS failed, event_type = 'purchase' AS exact, event_type IN ('purchase', 'signup') AS strong,
    (event_id // 2000 + 1)::INTEGER AS pos, event_id % 2000 AS search FROM events
), w AS (
  SELECT *, coalesce(bool_or(failed OR exact) OVER b, false) AS ended, coalesce(bool_or(strong) OVER b, false) AS firm FROM e
  WINDOW b AS (PARTITION BY search ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT search, pos, NOT ended AND NOT (fallback AND firm) AS do FROM w
""")
def staged_stream(spark, sf_dir):
    """Every 2000th event is an outcome of one search: position by position what was still to be looked up."""
    kind = F.col("event_type")
    outcomes = _event_stream(spark, sf_dir).select(
        (F.col("event_id") % 2000).alias("search"), F.expr("cast(event_id div 2000 + 1 as int)").alias("pos"), "ts",
        (kind == "click").alias("fallback"), (kind == "error").alias("failed"), (kind == "purchase").alias("exact"), kind.isin("purchase", "signup").alias("strong"),
    )
    return _drained(streams.staged_decisions(outcomes, ["search"], F.col("ts")), held.folder(spark, "job"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS path, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT path, 1::INTEGER AS place, 'title' AS field, s AS current, 'New' AS value, '' AS unavailable FROM o WHERE k % 3 = 0 AND k % 5 <> 0
UNION ALL SELECT path, 9, 'pubdate', p, '', '' FROM o WHERE k % 4 = 0 AND k % 5 <> 0
UNION ALL SELECT path, 0, NULL, '', '', CASE WHEN k % 10 = 0 THEN 'broken' ELSE 'file is missing' END FROM o WHERE k % 5 = 0 AND (k % 3 = 0 OR k % 4 = 0)
""")
def draft_review(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    current = o.select("path", F.lit("title").alias("field"), F.array("o_orderstatus").alias("values")).unionByName(o.select("path", F.lit("pubdate").alias("field"), F.array("o_orderpriority").alias("values")))
    staged = o.where(k % 3 == 0).select("path", F.lit("title").alias("field"), F.array(F.lit("New")).alias("values")).unionByName(o.where(k % 4 == 0).select("path", F.lit("pubdate").alias("field"), none.alias("values")))
    readable = o.where((k % 5 != 0) | (k % 10 == 0)).select("path", F.when(k % 10 == 0, "broken").otherwise("").alias("error"))
    return library.review(current, staged, readable)


@query("SELECT o_orderkey::VARCHAR AS path, 'title' AS field, 'x' AS value FROM orders WHERE o_orderkey % 3 = 0")
def draft_migration(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    current = o.select("path", F.lit("title").alias("field"), F.array("o_orderstatus").alias("values")).unionByName(o.select("path", F.lit("series").alias("field"), F.array(F.lit(" ")).alias("values")))
    title = F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).otherwise(F.concat(F.col("o_orderstatus"), F.lit(" ")))
    full = o.select("path", F.lit("title").alias("field"), F.array(title).alias("values")).unionByName(o.select("path", F.lit("series").alias("field"), F.array().cast("array<string>").alias("values"))).unionByName(o.select("path", F.lit("other").alias("field"), F.array(F.lit("y")).alias("values")))
    return library.migrate(full, current).select("path", "field", F.array_join("values", ", ").alias("value"))


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 0 OR value < 3 THEN 'miss' WHEN event_id % 5 = 0 OR event_id % 2 = 0 OR value >= 10 THEN 'use' ELSE 'retry' END AS action,
  (value >= 10 OR event_id % 3 <> 0) AND event_type <> 'error' AND event_id % 11 > 0 AS stored FROM events
""")
def cache_policy(spark, sf_dir):
    e, n = F.col("event_id"), F.when(F.col("value") >= 10, 1).otherwise(0)
    action = library.cache_action(F.col("value") >= 3, n, e % 7 == 0, e % 5 == 0, e % 2 == 0)
    stored = library.cacheable(n, F.when(e % 3 == 0, 1).otherwise(0), F.col("event_type") == "error", e % 11)
    return table(spark, sf_dir, "events").select("event_id", action.alias("action"), stored.alias("stored"))


@query("""
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE k <= 2 OR k > n - 1 GROUP BY conv_id
""")
def page_text(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    return library.page_text(pages, "conv_id", 2, 1)


@query("""
SELECT user_id, event_type || event_id || '.jpg' AS name, k::INTEGER AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type <> 'error') WHERE k < 20 OR k >= n - 10
""")
def page_images(spark, sf_dir):
    ending = F.when(F.col("event_type") == "error", F.lit(".txt")).otherwise(F.lit(".jpg"))
    members = table(spark, sf_dir, "events").select("user_id", F.concat(F.col("event_type"), F.col("event_id").cast("string"), ending).alias("name"))
    return library.page_images(members, "user_id", "name").select("user_id", "name", "position")


@query("""
SELECT conv_id, turn FROM (SELECT *, coalesce(bool_or(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM (
  SELECT conv_id, turn, turn % 3 = 1 AS b FROM conversations)) WHERE NOT seen
""")
def content_clues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    scans = c.select("conv_id", F.col("turn").alias("position"), F.when(F.col("turn") % 3 == 1, F.lit("Chapter 1")).otherwise(F.lit("Title page")).alias("text"))
    return library.clues(scans, "conv_id").select("conv_id", F.col("position").alias("turn"))


@query("""
SELECT c_custkey, c_name AS title, c_mktsegment || ' ' || c_name AS query, c_custkey % 2 = 0 AS cover_editable,
  left(sha256('/lib/' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '.EPUB' ELSE '.fb2' END), 24) AS id FROM customer
""")
def book_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/lib/"), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(".EPUB")).otherwise(F.lit(".fb2")))
    books = c.select("c_custkey", path.alias("path"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("titles"), F.array("c_name").alias("authors"), F.lit(False).alias("staged"))
    shown = library.shown_books(books)
    return shown.join(books.select("path", "c_custkey"), "path").select("c_custkey", "title", "query", "cover_editable", "id")


@query("SELECT n_nationkey, 'title,authors,publisher,pubdate,isbn,languages,tags,comments,catalog_url,cover_url' AS fields, n_name AS source, 10 AS n FROM nation")
def field_provenance(spark, sf_dir):
    p = library.provenance(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.map_keys(p), ",").alias("fields"), F.try_element_at(p, F.lit("isbn")).alias("source"), F.size(p).alias("n"))


@query("SELECT o_orderkey, o_orderpriority AS staged FROM orders WHERE o_orderkey % 4 <> 0")
def staged_drafts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("staged"))
    return state.drafts(rows).select("o_orderkey", "staged")


@query("""
WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS t, CASE WHEN p_partkey % 2 = 0 THEN 'Ann "A" ' || p_type ELSE '' END AS a, CASE WHEN p_partkey % 6 = 0 THEN '12' || p_partkey ELSE '' END AS i FROM part),
q AS (SELECT *, 'Ann A ' || substr(a, 9) AS b FROM l)
SELECT p_partkey,
  CASE WHEN i <> '' THEN 'isbn:' || i WHEN t <> '' THEN 'intitle:"' || t || '"' || CASE WHEN a <> '' THEN ' inauthor:"' || b || '"' ELSE '' END ELSE 'find' END AS google,
  CASE WHEN i <> '' THEN 'q=isbn:' || i WHEN t <> '' THEN 'title=' || t || CASE WHEN a <> '' THEN '&author=' || a ELSE '' END ELSE 'q=find' END AS library,
  CASE WHEN i <> '' THEN 'isbn:"' || i || '"' WHEN t <> '' THEN 'title:"' || t || '"' || CASE WHEN a <> '' THEN ' AND creator:"' || b || '"' ELSE '' END ELSE 'find' END AS archive FROM q
""")
def provider_queries(spark, sf_dir):
    k, none = F.col("p_partkey"), F.lit("")
    title = F.when(k % 3 == 0, none).otherwise(F.col("p_name"))
    q = F.struct(
        title.alias("title"), F.when(k % 2 == 0, F.concat(F.lit('Ann "A" '), F.col("p_type"))).otherwise(none).alias("author"),
        F.when(k % 6 == 0, F.concat(F.lit("12"), k.cast("string"))).otherwise(none).alias("isbn"), F.when(title == "", F.lit("find")).otherwise(none).alias("text"),
    )
    asked = table(spark, sf_dir, "part").select("p_partkey", match.provider_queries(q).alias("m"))
    return asked.select("p_partkey", *(F.try_element_at("m", F.lit(n)).alias(a) for n, a in (("Google Books", "google"), ("Open Library", "library"), ("Internet Archive", "archive"))))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'f' || p_partkey END AS title, p_type || '|B' AS authors, CASE WHEN p_partkey % 3 = 0 THEN 'x|y' ELSE '' END AS tags,
  CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE '' END AS series, CASE WHEN p_partkey % 5 = 0 THEN 'fr' ELSE '' END AS languages FROM part
""")
def pdf_properties(spark, sf_dir):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    given = {"Title": F.when(k % 2 == 0, F.col("p_name")).otherwise(none), "Author": F.concat(F.col("p_type"), F.lit(" & B")), "Keywords": F.when(k % 3 == 0, F.lit("x, y")), "Series": F.when(k % 3 == 1, F.col("p_brand")), "Language": F.when(k % 5 == 0, F.lit("fr"))}
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/lib/f"), k.cast("string"), F.lit(".pdf")).alias("path"), F.create_map(*(x for n, c in given.items() for x in (F.lit(n), c))).alias("properties"))
    found = properties.pdf_records(rows).join(rows.select("path", "p_partkey"), "path")
    return found.select("p_partkey", "title", *(F.array_join(c, "|").alias(c) for c in ("authors", "tags")), "series", F.array_join("languages", "|").alias("languages"))
