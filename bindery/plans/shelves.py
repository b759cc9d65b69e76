"""Queries on candidate lists, folders, searches, stored drafts and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindery.functions import formats, identifiers as ids, text as tx
from bindery.operators import library, match, state, view
from bindery.plans.catalog import SQL_ISBN, SQL_PLAIN, _SQL_PATHS, _isbns, _names, _paths, query, sql_similarity, table
from bindery.sources import properties


@query("""
WITH c AS (
  SELECT o_custkey AS book, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'http://c/' || o_orderkey % 1000 END AS url,
    o_orderpriority AS source, o_orderkey % 13 = 0 AS isbn, o_orderkey % 100 / 100.0 AS near, o_orderkey % 97 / 97.0 AS confidence, o_orderkey AS k FROM orders
), a AS (SELECT * FROM c WHERE trim(title) <> '' AND url <> '' AND (isbn OR near >= 0.35 AND confidence >= 0.4)),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY confidence DESC, url, source, k) AS rank FROM a)
SELECT book, rank::INTEGER AS rank, url, source, round(confidence, 6)::DOUBLE AS confidence FROM r WHERE rank <= 12
""")
def candidate_list(spark, sf_dir):
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("book"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("http://c/"), (k % 1000).cast("string"))).alias("url"), F.col("o_orderpriority").alias("source"),
        (k % 13 == 0).alias("isbn"), (k % 100 / 100).alias("near"), (k % 97 / 97).alias("confidence"),
    )
    kept = c.where(match.admitted(F.col("title"), F.col("url")) & match.passes(F.col("isbn"), F.col("near"), F.col("confidence")))
    return match.top_candidates(kept, ["book"]).select("book", "rank", "url", "source", F.round("confidence", 6).alias("confidence"))


@query(f"""
WITH n AS (SELECT p_partkey, {SQL_PLAIN.format('p_name')} AS t, lower(p_type) AS kind FROM part),
o AS (
  SELECT x.p_partkey AS p_partkey, k, l, r FROM n x JOIN n y ON y.p_partkey = x.p_partkey + 1,
    unnest([{{'k': 0, 'l': x.t}}, {{'k': 1, 'l': x.kind || ' ' || x.t}}, {{'k': 2, 'l': x.t}}]) AS a(a), unnest([y.t, y.kind]) AS b(r), LATERAL (SELECT a.k AS k, a.l AS l)
), s AS (SELECT p_partkey, k, max({sql_similarity('l', 'r')}) AS score FROM o GROUP BY ALL)
SELECT p_partkey, arg_max(k, (score, -k))::INTEGER AS k, round(max(score), 6) AS score FROM s GROUP BY p_partkey
""")
def best_title(spark, sf_dir):
    """Of three titles of every part, the first that comes nearest one of two of the next part."""
    n = _names(spark, sf_dir).select("p_partkey", F.col("p_name_norm").alias("t"), F.lower("p_type").alias("kind"))
    right = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.array("t", "kind").alias("remote"))
    rows = n.join(right, "p_partkey").withColumn("local", F.array("t", F.concat_ws(" ", "kind", "t"), "t"))
    best = rows.select("p_partkey", match.best_title(F.col("local"), F.col("remote")).alias("b"))
    return best.select("p_partkey", F.col("b.k").alias("k"), F.round("b.score", 6).alias("score"))


@query(_SQL_PATHS + """
SELECT DISTINCT split_part(substr(path, 6), '/', 1) AS name, '/lib/' || split_part(substr(path, 6), '/', 1) AS path FROM p WHERE contains(substr(path, 6), '/') AND NOT starts_with(substr(path, 6), '.')
""")
def browse_folders(spark, sf_dir):
    return view.browse(_paths(spark, sf_dir), "/lib")


@query(_SQL_PATHS + " SELECT page_id, path AS folder FROM p")
def folder_inside(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", view.required_inside(F.col("path"), "/lib").alias("folder"))


@query(f"WITH {SQL_ISBN} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN isbn13 ELSE isbn10 || ',' || isbn13 END AS found FROM n")
def search_isbns(spark, sf_dir):
    empty = F.lit("")
    clue = F.concat(F.lit("ISBN "), F.col("isbn13"), F.lit("; again "), F.col("isbn10"))
    found = library.search_isbns(F.col("isbn10"), F.concat(F.lit("isbn:"), F.col("isbn13")), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("find "), F.col("isbn13"))).otherwise(empty), clue, F.col("p_partkey") % 5 == 0)
    return _isbns(spark, sf_dir).select("p_partkey", F.array_join(found, ",").alias("found"))


@query("""
WITH e AS (SELECT event_id, event_id % 3 = 0 AS unknown, event_id % 5 = 0 AS blank, event_id % 7 = 0 AS none, event_id % 2 = 0 AS cached FROM events)
SELECT event_id, CASE WHEN unknown THEN 'book is not in the library' WHEN blank THEN 'search text is empty' ELSE '' END AS error,
  CASE WHEN none AND NOT cached AND NOT unknown AND NOT blank THEN 'no catalog is enabled' ELSE '' END AS warning FROM e
""")
def search_guards(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 10 == 0, F.lit(None).cast("string")).when(e % 5 == 0, F.lit("  ")).otherwise(F.col("event_type"))
    guard = library.search_guard(text, e % 3 != 0, F.when(e % 7 == 0, 0).otherwise(2), e % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", guard.alias("g")).select("event_id", "g.error", "g.warning")


@query("""
WITH e AS (
  SELECT user_id, event_type AS provider, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN 'error ' || event_id ELSE '' END AS error, event_id % 12 = 0 AS canceled, event_id % 6 AS found FROM events
), w AS (SELECT *, error <> '' AND NOT canceled AS told FROM e)
SELECT user_id, sum(found)::BIGINT AS candidates, coalesce(string_agg(DISTINCT provider, ',' ORDER BY provider) FILTER (told), '') AS failed,
  coalesce(string_agg(provider || ': ' || error, '|' ORDER BY provider, pos) FILTER (told), '') AS warnings FROM w GROUP BY user_id
""")
def partial_results(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("provider"), e.alias("pos"), F.when(e % 4 == 0, F.concat(F.lit("error "), e.cast("string"))).otherwise(F.lit("")).alias("error"), (e % 12 == 0).alias("canceled"), (e % 6).alias("found"))
    return library.lookup_outcomes(rows, "user_id").select("user_id", "candidates", F.array_join("failed", ",").alias("failed"), F.array_join("warnings", "|").alias("warnings"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey::VARCHAR AS path, o_orderkey % 3 <> 0 AS saved, o_orderstatus AS error FROM orders)
SELECT o_custkey, coalesce(string_agg(path, '|' ORDER BY path) FILTER (saved), '') AS saved, coalesce(string_agg(path || ': ' || error, '|' ORDER BY path || ': ' || error) FILTER (NOT saved), '') AS failures FROM o GROUP BY o_custkey
""")
def save_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 3 != 0).alias("saved"), F.col("o_orderstatus").alias("error"))
    return library.outcome_lists(rows, "o_custkey").select("o_custkey", F.array_join("saved", "|").alias("saved"), F.array_join("failures", "|").alias("failures"))


@query("SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS saved, count(*) FILTER (o_orderkey % 3 = 0) AS failed FROM orders")
def save_counts(spark, sf_dir):
    return library.outcome(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3 != 0).alias("saved")))


@query("SELECT o_orderkey::VARCHAR AS path, 'title' AS field, o_orderpriority AS value FROM orders WHERE o_orderkey % 2 = 0")
def stored_migration(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    title = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))
    stored = o.select("path", F.to_json(F.create_map(F.lit("title"), F.array(title), F.lit("unknown"), F.array(F.lit("x")))).alias("json"))
    current = o.select("path", F.lit("title").alias("field"), F.array("o_orderstatus").alias("values"))
    return library.migrate_json(stored, current).select("path", "field", F.array_join("values", ", ").alias("value"))


@query("SELECT r_regionkey::VARCHAR AS path, r_name AS name FROM region WHERE r_regionkey = 3")
def state_row(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("path"), F.col("r_name").alias("name"))
    return state.row_of(rows, "3")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","none":null}' AS json FROM nation""")
def json_export(spark, sf_dir):
    return library.export_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@query("""
SELECT c_custkey, left(c_name, 12) AS short, 'a|' || c_mktsegment || '||b' AS items, c_custkey % 3 = 0 AS says_nothing,
  'data:' || CASE c_custkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END || ';base64,' || to_base64(encode(c_name)) AS url, 'dir/' || c_name || ' 1+1' AS href FROM customer
""")
def small_functions(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    title = F.when(k % 6 == 0, F.lit("Unknown")).when(k % 3 == 0, F.lit(" Sans titre! ")).otherwise(name)
    kind = F.when(k % 3 == 0, F.lit("JPG")).when(k % 3 == 1, F.lit("png")).otherwise(F.lit("x"))
    href = F.concat(F.lit("dir/"), F.replace(name, F.lit("#"), F.lit("%23")), F.lit("%201+1"), F.when(k % 2 == 0, F.lit("?q#a")).otherwise(F.lit("")))
    items = formats.comic_list(F.concat(F.lit(" a,"), F.col("c_mktsegment"), F.lit(" ,, b ")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.truncated(name, 12).alias("short"), F.array_join(items, "|").alias("items"), tx.placeholder(tx.normalised(title)).alias("says_nothing"), properties.data_url(kind, F.encode(name, "UTF-8")).alias("url"), properties.path_of_href(href).alias("href"))


@query("SELECT o_orderkey % 2 = 0 AS chosen, false AS allowed, count(*) AS books FROM orders GROUP BY 1 UNION ALL SELECT true, true, count(*) FROM orders WHERE o_orderkey % 2 = 0")
def commit_gate(spark, sf_dir):
    """Whether a commit may go ahead: of all books, of which some are stale, no; of the fresh ones, yes."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("fingerprint"), F.lit("v").alias("version"), (F.col("o_orderkey") % 2 == 0).alias("chosen"))
    now = o.select("path", "fingerprint", F.when(F.col("chosen"), F.lit("v")).otherwise(F.lit("w")).alias("version"))
    every = state.allowed(state.preflight(o.select("path", "fingerprint", "version"), now))
    fresh = o.where("chosen")
    some = state.preflight(fresh.select("path", "fingerprint", "version"), now)
    counted = o.groupBy("chosen").agg(F.count(F.lit(1)).alias("books")).withColumn("allowed", every)
    # what the gate lets through
    passed = state.gated(some).agg(F.lit(True).alias("chosen"), F.count(F.lit(1)).alias("books")).withColumn("allowed", state.allowed(some))
    return counted.unionByName(passed).select("chosen", "allowed", "books")


@query("""
SELECT 'held' AS kind, n_name AS key, n_regionkey::VARCHAR AS value FROM nation UNION ALL SELECT 'held', 'preferences', 'new'
UNION ALL SELECT 'read', 'preferences', 'new' UNION ALL SELECT 'read', 'last_folder', ''
""")
def stored_settings(spark, sf_dir):
    """Storing the preferences over older ones, with retired keys among the settings, and reading two of them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    held = n.unionByName(spark.createDataFrame([("last_folder", "/x"), ("google_books_api_key", "k")], ["key", "value"]))
    held = state.with_setting(state.with_setting(held, "preferences", "old"), "preferences", "new")
    read = [state.setting(held, k).select(F.lit("read").alias("kind"), F.lit(k).alias("key"), "value") for k in ("preferences", "last_folder")]
    return held.select(F.lit("held").alias("kind"), "key", "value").unionByName(read[0]).unionByName(read[1])
