"""Registry of the named queries over the driver's tables, each with SQL written from the operator's description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import formats, identifiers as ids, labels, text as tx
from bindery.operators import match, state, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The time that cache queries take as now.
NOW = 1_704_500_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from bindery.plans import records, shelves, sources  # noqa: F401  (they register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_norm(c: Column) -> Column:
    """The normalised form of text known to be ASCII."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def plain_norm_sql(value: str) -> str:
    return f"trim(regexp_replace(lower({value}), '[^a-z0-9]+', ' '))"


SQL_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
SQL_NORM = r"rtrim(regexp_extract(trim(regexp_replace(lower(strip_accents(nfc_normalize({0}))), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')), '^(?:[ ]?[^ ]){{0,512}}'))"
SQL_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
SQL_EDIT = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 0.0 ELSE 1.0 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) END"


def sql_similarity(a: str, b: str) -> str:
    wa, wb = f"list_distinct({SQL_WORDS.format(a)})", f"list_distinct({SQL_WORDS.format(b)})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE 0.6 * ({SQL_EDIT.format(a, b)}) + 0.4 * 2 * len(list_intersect({wa}, {wb}))::DOUBLE / (len({wa}) + len({wb})) END"


@query(f"SELECT 'document' AS kind, doc_id AS id, {SQL_NORM.format('text')} AS norm FROM documents UNION ALL SELECT 'part', p_partkey, {SQL_NORM.format('p_name')} FROM part")
def norm_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), tx.normalised(F.col("text")).alias("norm"))
    parts = table(spark, sf_dir, "part")
    named = parts.join(tx.norm_dimension(parts, "p_name"), "p_name").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name_norm").alias("norm"))
    return docs.unionByName(named)


def _names(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.join(tx.norm_dimension(parts, "p_name"), "p_name")


@query(f"""
WITH n AS (SELECT DISTINCT p_brand, {SQL_PLAIN.format('p_name')} AS t FROM part),
s AS (SELECT x.p_brand AS p_brand, x.t AS a, y.t AS b, {sql_similarity('x.t', 'y.t')} AS score, {SQL_EDIT.format('x.t', 'y.t')} AS edit FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.t < y.t)
SELECT p_brand, a, b, round(score, 6) AS score, round(edit, 6) AS edit FROM s WHERE score >= 0.4
""")
def text_similarity(spark, sf_dir):
    """All pairs of different names of a brand that are similar at all."""
    found = match.similar_texts(_names(spark, sf_dir), "p_brand", "p_name_norm").where("_a < _b")
    return found.select("p_brand", F.col("_a").alias("a"), F.col("_b").alias("b"), F.round("score", 6).alias("score"), F.round(tx.edit_similarity(F.col("_a"), F.col("_b")), 6).alias("edit"))


@query(f"""
WITH n AS (SELECT p_partkey, p_brand, {SQL_PLAIN.format('p_name')} AS t FROM part),
s AS (SELECT x.p_partkey AS p_partkey, y.p_partkey AS other, {sql_similarity('x.t', 'y.t')} AS score FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS rank FROM s WHERE score >= 0.4)
SELECT p_partkey, rank::INTEGER AS rank, other, round(score, 6) AS score FROM r WHERE rank <= 3
""")
def fuzzy_topk(spark, sf_dir):
    found = match.block_topk(_names(spark, sf_dir), "p_partkey", "p_brand", "p_name_norm", 3)
    return found.withColumn("score", F.round("score", 6))


#: Parts of consecutive keys that stand on one shelf, where those of a brand are each other's candidates.
SHELF = 800
_SQL_NUMBER = "CASE WHEN s_suppkey % 2 = 0 THEN 8.0 / 9 ELSE 1 END"


@query(f"""
WITH m AS (SELECT s_suppkey, 2 * (0.9 + {_SQL_NUMBER} + 1) / 6 AS similarity FROM supplier)
SELECT s_suppkey, round(similarity, 6)::DOUBLE AS similarity, round((similarity + 0.95) / 2, 6)::DOUBLE AS score FROM m
""")
def author_greedy(spark, sf_dir):
    """Supplier names of three words, turned round, one word cut to its initial and in half of them one letter changed."""
    s = table(spark, sf_dir, "supplier")
    s = s.join(tx.norm_dimension(s, "s_name"), "s_name")
    nation = F.concat(F.lit("k"), F.col("s_nationkey").cast("string"))
    number = F.substring("s_name_norm", 10, 20)
    number = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("x"), F.substring(number, 2, 20))).otherwise(number)
    turned = F.concat_ws(" ", nation, F.left("s_name_norm", F.lit(1)), number)
    score = tx.author_score(F.array(F.col("name"), F.lit("jane doe")), F.array(F.lit("doe j"), F.col("turned")))
    rows = s.select("s_suppkey", F.concat_ws(" ", "s_name_norm", nation).alias("name"), turned.alias("turned"))
    return rows.select("s_suppkey", F.round(tx.author_similarity(F.col("name"), F.col("turned")), 6).alias("similarity"), F.round(score, 6).alias("score"))


@query(f"""
WITH b AS (
  SELECT p_partkey AS k, {SQL_PLAIN.format('p_name')} || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_size ELSE '' END AS t, 'brand ' || lower(p_type) AS author, p_size, p_brand, p_partkey // {SHELF} AS shelf FROM part
), p AS (
  SELECT x.k AS book, y.k AS candidate, x.t AS lt, y.t AS rt, x.author AS la, y.author AS ra, x.p_size % 3 = y.p_size % 3 AS language, x.k % 5 <> 0 AS has_authors, x.k % 3 <> 0 AS has_languages,
    y.k % 7 <> 0 AS remote_authors, x.k % 4 = 0 AND y.k % 4 = 0 AND x.p_size <> y.p_size AS numbers, x.k % 6 = 0 AND x.p_size <> y.p_size AS volumes, (x.k + y.k) % 11 = 0 AS isbn
  FROM b x JOIN b y ON x.p_brand = y.p_brand AND x.shelf = y.shelf AND x.k <> y.k
), q AS (SELECT *, {sql_similarity('lt', 'rt')} AS title, {sql_similarity('la', 'ra')} AS author FROM p),
w AS (
  SELECT *, (0.7 * title + CASE WHEN has_authors THEN 0.25 * author ELSE 0 END + CASE WHEN has_languages AND language THEN 0.05 ELSE 0 END)
    / (0.7 + CASE WHEN has_authors THEN 0.25 ELSE 0 END + CASE WHEN has_languages THEN 0.05 ELSE 0 END) AS raw FROM q
),
z AS (
  SELECT *, raw * CASE WHEN has_authors AND remote_authors AND author < 0.35 THEN 0.65 ELSE 1 END * CASE WHEN numbers THEN 0.75 ELSE 1 END * CASE WHEN volumes THEN 0.75 ELSE 1 END AS cut FROM w
),
f AS (SELECT *, least(1.0, CASE WHEN isbn THEN 0.95 + 0.05 * cut ELSE cut END) AS total FROM z)
SELECT book, candidate, round(title, 6) AS title, round(author, 6) AS author, round(total + 1e-9, 6) AS total,
  isbn OR title >= 0.88 AND (NOT has_authors OR author >= 0.75) AND total >= 0.85 AS strong, isbn OR title >= 0.35 AND total >= 0.4 AS passes FROM f
""")
def rank_full(spark, sf_dir):
    """Every part as a book against all others of its brand on its shelf as its candidates, with all that a score takes in."""
    k = F.col("p_partkey")
    named = _names(spark, sf_dir).withColumn("t", F.when(k % 4 == 0, F.concat_ws(" ", "p_name_norm", F.col("p_size").cast("string"))).otherwise(F.col("p_name_norm")))
    b = named.select(k.alias("k"), "p_brand", F.floor(k / SHELF).alias("shelf"), "p_size", "t", F.concat(F.lit("brand "), F.lower("p_type")).alias("author"))
    left = b.select("p_brand", "shelf", F.col("k").alias("book"), F.col("t").alias("lt"), F.col("author").alias("la"), F.col("p_size").alias("ls"))
    right = b.select("p_brand", "shelf", F.col("k").alias("candidate"), F.col("t").alias("rt"), F.col("author").alias("ra"), F.col("p_size").alias("rs"))
    x, y = F.col("book"), F.col("candidate")
    scored = left.join(right, ["p_brand", "shelf"]).where(x != y).withColumn("title", tx.text_similarity(F.col("lt"), F.col("rt"))).withColumn("author", tx.text_similarity(F.col("la"), F.col("ra")))
    scored = scored.withColumns({"has_authors": x % 5 != 0, "isbn": (x + y) % 11 == 0, "numbers": tx.different_numbers(F.col("lt"), F.col("rt")), "volumes": (x % 6 == 0) & (F.col("ls") != F.col("rs"))})
    total = match.total_score(F.col("title"), F.col("author"), F.col("has_authors"), F.col("ls") % 3 == F.col("rs") % 3, x % 3 != 0, y % 7 != 0, F.col("numbers"), F.col("volumes"), F.col("isbn"))
    scored = scored.withColumn("total", total)
    strong = match.strong(F.col("isbn"), F.col("title"), F.col("author"), F.col("has_authors"), F.col("total"))
    passes = match.passes(F.col("isbn"), F.col("title"), F.col("total"))
    return scored.select("book", "candidate", F.round("title", 6).alias("title"), F.round("author", 6).alias("author"), F.round(F.col("total") + 1e-9, 6).alias("total"), strong.alias("strong"), passes.alias("passes"))


#: SQL of an ISBN-10 and an ISBN-13 made of a number below 10**9, right or with a wrong last digit.
_BODY = "lpad(({0} * 7919 % 1000000000)::VARCHAR, 9, '0')"
_SUM10 = "list_sum(list_transform(range(1, 10), lambda i: (11 - i) * substr({0}, i::INT, 1)::INT))"
_SUM13 = "list_sum(list_transform(range(1, 13), lambda i: (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) * substr({0}, i::INT, 1)::INT))"
SQL_ISBN = f"""
i AS (SELECT p_partkey, {_BODY.format('p_partkey')} AS body FROM part),
c AS (SELECT p_partkey, body, ((11 - {_SUM10.format('body')} % 11) % 11)::INT AS c10, ((10 - {_SUM13.format("('978' || body)")} % 10) % 10)::INT AS c13 FROM i),
n AS (SELECT p_partkey, p_partkey % 3 <> 0 AS good, body || CASE WHEN c10 = 10 THEN 'X' ELSE c10::VARCHAR END AS isbn10, '978' || body || c13::VARCHAR AS isbn13,
  body || CASE WHEN (c10 + 1) % 11 = 10 THEN 'X' ELSE ((c10 + 1) % 11)::VARCHAR END AS wrong10 FROM c)
"""


def _isbns(spark, sf_dir) -> DataFrame:
    body = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000).cast("string"), 9, "0")
    c10 = F.pmod(F.lit(11) - ids._weighted(F.col("body"), 9, lambda k: 10 - k) % 11, F.lit(11))
    c13 = F.pmod(F.lit(10) - ids._weighted(F.concat(F.lit("978"), F.col("body")), 12, lambda k: 1 + 2 * (k % 2)) % 10, F.lit(10))

    def ending(c: Column) -> Column:
        return F.concat(F.col("body"), F.when(c == 10, F.lit("X")).otherwise(c.cast("string")))

    rows = table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))
    return rows.select("p_partkey", (F.col("p_partkey") % 3 != 0).alias("good"), ending(c10).alias("isbn10"), F.concat(F.lit("978"), F.col("body"), c13.cast("string")).alias("isbn13"), ending((c10 + 1) % 11).alias("wrong10"))


@query(f"WITH {SQL_ISBN} SELECT p_partkey, CASE WHEN good THEN isbn13 ELSE '' END AS canonical, isbn13 AS canonical13 FROM n")
def isbn_canonical(spark, sf_dir):
    written = F.concat_ws("-", F.substring("code", 1, 1), F.substring("code", 2, 4), F.substring("code", 6, 4), F.substring("code", 10, 1))
    rows = _isbns(spark, sf_dir).withColumn("code", F.when(F.col("good"), F.col("isbn10")).otherwise(F.col("wrong10")))
    return rows.select("p_partkey", ids.canonical_isbn(written).alias("canonical"), ids.canonical_isbn(F.col("isbn13")).alias("canonical13"))


@query(f"WITH {SQL_ISBN} SELECT p_partkey, true AS right10, true AS right13, false AS wrong10, false AS wrong13 FROM n")
def isbn_valid(spark, sf_dir):
    changed = F.concat(F.left("isbn13", F.lit(12)), ((F.right("isbn13", F.lit(1)).cast("int") + 3) % 10).cast("string"))
    return _isbns(spark, sf_dir).select("p_partkey", ids.valid_isbn10(F.col("isbn10")).alias("right10"), ids.valid_isbn13(F.col("isbn13")).alias("right13"), ids.valid_isbn10(F.col("wrong10")).alias("wrong10"), ids.valid_isbn13(changed).alias("wrong13"))


@query(f"WITH {SQL_ISBN} SELECT p_partkey, isbn10 || ',' || isbn13 AS found FROM n")
def isbn_extract(spark, sf_dir):
    line = F.format_string("Brand; ISBN-10: %s; ISBN-13: %s; again ISBN %s; bad %s", F.col("isbn10"), F.concat_ws("-", F.left("isbn13", F.lit(3)), F.substring("isbn13", 4, 10)), F.col("isbn10"), F.col("wrong10"))
    return _isbns(spark, sf_dir).select("p_partkey", F.array_join(ids.extract_isbns(line), ",").alias("found"))


@query(f"WITH {SQL_ISBN} SELECT l_orderkey, l_linenumber, l_partkey, good AS matched FROM lineitem JOIN n ON n.p_partkey = l_partkey")
def isbn_match(spark, sf_dir):
    books = _isbns(spark, sf_dir)
    local = F.array(F.when(F.col("good"), F.col("isbn10")).otherwise(F.col("wrong10")))
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keyed = books.select(F.col("p_partkey").alias("l_partkey"), ids.isbn_match(local, F.array(F.col("isbn13"))).alias("matched"))
    return sold.join(keyed, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "matched")


#: Other spellings of the documents' languages, by doc_id % 4.
_SPELT = {"en": ["eng", "English", "en_GB", " EN "], "fr": ["fra", "French", "fr-CA", "fre"], "de": ["ger", "German", "de_AT", "DEU"], "es": ["spa", "Spanish", "es-MX", "es"]}


def _spelt() -> Column:
    options = F.create_map(*(x for k, v in _SPELT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.try_element_at(F.try_element_at(options, F.col("lang")), (F.col("doc_id") % 4 + 1).cast("int"))


@query("SELECT doc_id, lang AS language FROM documents")
def language_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.language_key(_spelt()).alias("language"))


@query("""
SELECT doc_id, doc_id % 5 <> 0 AND lang <> 'fr' AND NOT (doc_id % 5 = 2 AND lang = 'en') AS conflict,
  lang = 'fr' AND doc_id % 5 <> 0 OR doc_id % 5 = 2 AND lang = 'en' AS matched FROM documents
""")
def language_conflict(spark, sf_dir):
    local = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 5 == 2, F.array(F.lit("fre"), F.lit("eng"))).otherwise(F.array(F.lit("French")))
    return table(spark, sf_dir, "documents").select("doc_id", ids.language_conflict(local, _spelt()).alias("conflict"), ids.language_match(local, F.array(_spelt())).alias("matched"))


_MARKS = ["Tome", "vol.", "#", "Book", ""]
_SQL_LABEL = """
WITH v AS (
  SELECT p_partkey, p_brand, p_name, p_size, CASE p_partkey % 6 WHEN 5 THEN p_name ELSE 'The ' || p_brand || ' ' || ['Tome ', 'vol. ', '#', 'Book ', ''][p_partkey % 6 + 1] || p_size END
    || CASE WHEN p_partkey % 6 < 4 THEN ' - ' || p_name ELSE '' END AS label, p_partkey % 2 = 0 AS known FROM part
), m AS (
  SELECT *, regexp_matches(label, '(?i)^(.+?)\\s+(?:[-:]\\s*)?(?:t(?:ome)?|vol(?:ume)?\\.?|book|livre|#)\\s*([0-9]+(?:[.,][0-9]+)?)\\s*(?:[-:–—]\\s*)?(.*)$') AS numbered,
    CASE WHEN known THEN p_brand ELSE '' END AS series FROM v
)
SELECT p_partkey, label,
  CASE WHEN numbered THEN p_name WHEN known AND p_partkey % 6 = 4 THEN '' ELSE label END AS title,
  CASE WHEN numbered THEN 'The ' || p_brand WHEN known AND p_partkey % 6 = 4 THEN series ELSE '' END AS series,
  CASE WHEN numbered OR known AND p_partkey % 6 = 4 THEN p_size::VARCHAR ELSE '' END AS volume FROM m
"""


@query(_SQL_LABEL)
def label_classify(spark, sf_dir):
    k = F.col("p_partkey") % 6
    mark = F.try_element_at(F.array(*(F.lit(m + " " if m not in ("#", "") else m) for m in _MARKS)), (k + 1).cast("int"))
    label = F.when(k == 5, F.col("p_name")).otherwise(F.concat(F.lit("The "), F.col("p_brand"), F.lit(" "), mark, F.col("p_size").cast("string")))
    label = F.when(k < 4, F.concat(label, F.lit(" - "), F.col("p_name"))).otherwise(label)
    known = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), known.alias("known"))
    return rows.select("p_partkey", "label", labels.classify(F.col("label"), F.col("known"), plain_norm_sql).alias("l")).select("p_partkey", "label", "l.title", "l.series", "l.volume")


@query("SELECT p_partkey, p_name AS title, p_brand AS series, p_size::VARCHAR AS volume FROM part")
def filename_label(spark, sf_dir):
    """File names of the forms author - series - volume - title (epub).epub and series - volume - title - author.epub."""
    author, size = F.lit("Jane Doe"), F.col("p_size").cast("string")
    one = F.concat_ws(" - ", author, "p_brand", size, F.concat("p_name", F.lit(" (epub).epub")))
    two = F.concat_ws(" – ", F.concat("p_brand"), F.lpad(size, 3, "0"), "p_name", F.concat(author, F.lit(".epub")))
    name = F.when(F.col("p_partkey") % 2 == 0, one).otherwise(F.when(F.col("p_size") < 1000, two).otherwise(one))
    rows = table(spark, sf_dir, "part").select("p_partkey", labels.file_parts(name, F.array(F.lit("jane doe")), plain_norm).alias("parts"))
    other = labels.classify(F.array_join("parts", " - "), F.lit(""), plain_norm_sql)
    return rows.select("p_partkey", labels.file_label(F.col("parts"), other).alias("l")).select("p_partkey", "l.title", "l.series", "l.volume")


@query("""
SELECT x.p_partkey AS a, y.p_partkey AS b, x.p_partkey % 4 <> 0 AND y.p_partkey % 4 <> 0 AND floor(x.p_retailprice) <> floor(y.p_retailprice) AS differ
FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_name = y.p_name AND x.p_partkey < y.p_partkey
""")
def different_numbers(spark, sf_dir):
    """All pairs of parts of one brand and name."""
    value = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat_ws(" #", "p_name", F.floor("p_retailprice").cast("string")))
    n = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", tx.number_words(plain_norm(value)).alias("numbers"))
    pairs = match.block_pairs(n, ["p_brand", "p_name"], "p_partkey", "numbers")
    return pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b"), tx.numbers_differ(F.col("_value_a"), F.col("_value_b")).alias("differ"))


@query("""
WITH b AS (
  SELECT p_partkey, [p_name, p_name || ' of ' || p_brand][1 : p_partkey % 3] AS titles, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Ann ' || p_type END AS author,
    ['111', '222', '333'][1 : p_partkey % 4] AS isbns, p_partkey % 7 = 0 AS custom FROM part
), q AS (
  SELECT p_partkey, list_transform(isbns[1 : 2], lambda i: 'isbn|||' || i || '||false') AS i,
    CASE WHEN custom THEN ['text||||find ' || p_partkey || '|false'] WHEN len(titles) = 0 THEN ['text||||find ' || p_partkey || '|false']
    ELSE list_concat(list_transform(titles, lambda t: 'title-author|' || t || '|' || author || '|||false'),
      flatten(list_transform(titles, lambda t: list_concat(CASE WHEN author <> '' THEN ['title|' || t || '||||true'] ELSE [] END, ['text||||' || trim(t || ' ' || author) || '|true'])))) END AS r FROM b
), x AS (SELECT p_partkey, unnest(list_concat(i, r)[1 : 8]) AS lookup, unnest(range(len(list_concat(i, r)[1 : 8]))) AS pos FROM q)
SELECT p_partkey, pos::INTEGER AS pos, lookup FROM x
""")
def search_plan(spark, sf_dir):
    titles = F.slice(F.array("p_name", F.concat_ws(" of ", "p_name", "p_brand")), F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    authors = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Ann "), F.col("p_type"))))
    isbns = F.slice(F.array(F.lit("111"), F.lit("222"), F.lit("333")), F.lit(1), (F.col("p_partkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", titles.alias("titles"), authors.alias("authors"), isbns.alias("isbns"), F.concat(F.lit("find "), F.col("p_partkey").cast("string")).alias("query"), (F.col("p_partkey") % 7 == 0).alias("custom"))
    plan = match.plan_queries(F.col("isbns"), F.col("titles"), F.transform("titles", plain_norm), F.col("authors"), F.col("query"), F.col("custom"), plain_norm)
    q = F.col("q")
    return rows.select("p_partkey", F.posexplode(plan).alias("pos", "q")).select("p_partkey", "pos", F.concat_ws("|", q["kind"], q["title"], q["author"], q["isbn"], q["text"], q["fallback"].cast("string")).alias("lookup"))


@query("""
WITH e AS (
  SELECT event_id, user_id, event_type = 'click' AS fallback, event_type = 'error' AS failed, event_type = 'purchase' AS exact, event_type IN ('purchase', 'signup') AS strong,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events
), w AS (
  SELECT *, coalesce(bool_or(failed OR exact) OVER b, false) AS ended, coalesce(bool_or(strong) OVER b, false) AS firm FROM e
  WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT event_id, user_id, pos::INTEGER AS pos FROM w WHERE NOT ended AND NOT (fallback AND firm)
""")
def staged_stop(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    e = e.select("event_id", "user_id", (kind == "click").alias("fallback"), (kind == "error").alias("failed"), (kind == "purchase").alias("exact"), kind.isin("purchase", "signup").alias("strong"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))
    return match.staged_stop(e, ["user_id"]).select("event_id", "user_id", "pos")


@query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts, event_id) AS n FROM events) WHERE n = 1
""")
def dedupe_best(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 <> 0"))
    return match.best_records(parts, ["user_id", "event_type"], "value", [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""
WITH b AS (
  SELECT p_brand, p_partkey, 'http://c/' || p_partkey AS url, 's' || p_partkey % 3 AS source, p_size % 9 AS isbn_key, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS specific, p_partkey % 5 <> 0 AS ok FROM part
), m AS (
  SELECT x.p_brand AS p_brand, x.url AS url, y.specific AS title, y.source AS donor, y.url AS donor_url,
    row_number() OVER (PARTITION BY x.p_brand, x.url ORDER BY y.p_partkey) AS n
  FROM b x JOIN b y ON x.p_brand = y.p_brand AND x.isbn_key = y.isbn_key AND x.specific = '' AND y.specific <> '' AND y.ok AND x.url <> y.url
)
SELECT p_brand, url, title, donor, donor_url FROM m WHERE n = 1
""")
def corroborate(spark, sf_dir):
    books = table(spark, sf_dir, "part")
    # one shared ISBN for each value of p_size % 9: made from that digit so that the values stay apart
    body = F.concat(F.lit("97800000000"), (F.col("p_size") % 9).cast("string"), F.lit("0"))
    check = F.pmod(F.lit(10) - ids._weighted(body, 12, lambda k: 1 + 2 * (k % 2)) % 10, F.lit(10)).cast("string")
    isbn = ids.canonical_isbn(F.concat(F.substring(body, 1, 12), check))
    rows = books.select("p_brand", "p_partkey", F.concat(F.lit("http://c/"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("source"), F.when(F.col("p_partkey") % 4 == 0, F.lit("")).otherwise(F.col("p_name")).alias("specific"), (F.col("p_partkey") % 5 != 0).alias("language_ok"), F.array(isbn).alias("isbns"))
    return match.corroborate(rows, ["p_brand"], F.col("p_partkey"))


def _order_fields(orders: DataFrame, status: Column, priority: Column) -> DataFrame:
    fields = F.array(F.struct(F.lit("status").alias("field"), F.array(status).alias("values")), F.struct(F.lit("priority").alias("field"), F.array(priority).alias("values")))
    return orders.select(F.col("o_orderkey").alias("path"), F.explode(fields).alias("x")).select("path", "x.field", "x.values")


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as files of two fields, and a draft: every third order's status cleared, every fourth's priority set."""
    o = table(spark, sf_dir, "orders")
    current = _order_fields(o, F.col("o_orderstatus"), F.col("o_orderpriority"))
    draft = current.where("field = 'status' and path % 3 = 0").select("path", "field", F.array().cast("array<string>").alias("values"))
    draft = draft.unionByName(current.where("field = 'priority' and path % 4 = 0").select("path", "field", F.array(F.concat(F.lit(" "), F.when(F.col("path") % 8 == 0, F.col("values")[0]).otherwise(F.lit("9-NEW")))).alias("values")))
    return current, draft


@query("""
SELECT o_orderkey AS path, 'status' AS field, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS shown, o_orderkey % 3 = 0 AS staged FROM orders
UNION ALL SELECT o_orderkey, 'priority', CASE WHEN o_orderkey % 8 = 0 THEN ' ' || o_orderpriority WHEN o_orderkey % 4 = 0 THEN ' 9-NEW' ELSE o_orderpriority END, o_orderkey % 4 = 0 FROM orders
""")
def overlay(spark, sf_dir):
    current, draft = _orders(spark, sf_dir)
    return state.overlay(current, draft, ["path", "field"]).select("path", "field", F.array_join("values", ", ").alias("shown"), "staged")


@query("""
SELECT o_orderkey AS path, 'status' AS field, 0 AS n FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'priority', 1 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0
""")
def diff(spark, sf_dir):
    current, draft = _orders(spark, sf_dir)
    return state.changes(current, draft, ["path", "field"]).select("path", "field", F.size("values").alias("n"))


@query("""
SELECT o_orderkey AS path, 'status' AS field, o_orderkey % 5 = 0 AS apply FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'priority', false FROM orders WHERE o_orderkey % 4 = 0
""")
def split(spark, sf_dir):
    _, draft = _orders(spark, sf_dir)
    chosen = draft.where("path % 5 = 0 and field = 'status'")
    apply, rest = state.split(draft, chosen, ["path", "field"])
    return apply.select("path", "field", F.lit(True).alias("apply")).unionByName(rest.select("path", "field", F.lit(False).alias("apply")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    return state.latest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS staged FROM orders")
def discard(spark, sf_dir):
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderpriority").alias("staged"))
    return state.discard(books, books.where("cast(path as long) % 7 = 0"))


def _cache(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_id").alias("cache_key"), F.col("props").alias("result_json"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("updated_at"))


@query(f"SELECT user_id || '-' || event_id AS cache_key, props AS result_json, floor(epoch(ts))::BIGINT AS updated_at FROM events WHERE floor(epoch(ts)) >= {NOW} - 604800")
def cache_ttl(spark, sf_dir):
    return state.fresh(_cache(spark, sf_dir), None, NOW, 7 * 86_400)


@query("SELECT user_id || '-' || event_id AS cache_key, floor(epoch(ts))::BIGINT AS updated_at FROM events ORDER BY floor(epoch(ts)) DESC, user_id || '-' || event_id LIMIT 500")
def cache_prune(spark, sf_dir):
    return state.prune(_cache(spark, sf_dir), 500).select("cache_key", "updated_at")


@query("""
WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS f, sha256(o_orderpriority) AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, sha256(o_orderpriority) FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT -o_orderkey - 1, 'F', '' FROM orders WHERE o_orderkey % 11 = 0)
SELECT CASE WHEN s.k % 10 = 0 AND s.k >= 0 THEN 'repeated' WHEN s.k < 0 THEN 'missing' WHEN s.k % 6 = 0 THEN 'stale' ELSE '' END AS reason, count(*) AS books FROM s GROUP BY 1
""")
def save_preflight(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("fingerprint"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("changed")).otherwise(F.sha2("o_orderpriority", 256)).alias("version"))
    seen = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("fingerprint"), F.sha2("o_orderpriority", 256).alias("version"))
    gone = o.where("o_orderkey % 11 = 0").select((-F.col("o_orderkey") - 1).alias("path"), F.lit("F").alias("fingerprint"), F.lit("").alias("version"))
    selection = seen.where("path % 2 = 0").unionByName(seen.where("path % 10 = 0")).unionByName(gone)
    return state.preflight(selection, now).groupBy("reason").agg(F.count(F.lit(1)).alias("books"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '1 build') OR contains(lower(c_name || ' ' || c_mktsegment), '00012')")
def library_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.where(view.matches(" 1 BUILD ", F.col("c_name"), F.col("c_mktsegment")) | view.matches("00012", F.col("c_name"), F.col("c_mktsegment"))).select("c_custkey", "c_name")


_SQL_PATHS = r"WITH p AS (SELECT page_id, '/lib/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"


def _paths(spark, sf_dir) -> DataFrame:
    path = F.concat(F.lit("/lib/"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(_SQL_PATHS + " SELECT count(*) FILTER (path = '/lib' OR starts_with(path, '/lib/')) AS folder_count, count(*) FILTER (starts_with(path, '/lib/') AND contains(lower(path), '/en/')) AS total FROM p")
def view_counts(spark, sf_dir):
    return view.counts(_paths(spark, sf_dir), "/lib", " /EN/", F.col("path"))


@query(_SQL_PATHS + """
, s AS (SELECT string_split(substr(path, 6), '/') AS parts FROM p),
f AS (SELECT array_to_string(parts[1 : k], '/') AS name, k AS depth FROM (SELECT parts, unnest(range(0, len(parts))) AS k FROM s))
SELECT CASE WHEN name = '' THEN '/lib' ELSE '/lib/' || name END AS folder, CASE WHEN name = '' THEN '.' ELSE name END AS name,
  (CASE WHEN name = '' THEN 0 ELSE len(string_split(name, '/')) END)::INTEGER AS depth, count(*) AS books FROM f GROUP BY ALL
""")
def folder_rollup(spark, sf_dir):
    return view.folders(_paths(spark, sf_dir), "/lib")


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 4 = 0, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'brand#' || lpad(substr(p_brand, 7), 20, '0') END,
  CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 9 = 0 THEN 0 ELSE p_size + 0.5 END, lower(p_name), p_partkey)::BIGINT AS place FROM part
""")
def shelf_order(spark, sf_dir):
    series = F.when(F.col("p_partkey") % 4 == 0, F.lit(" ")).otherwise(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")))
    volume = F.when(F.col("p_partkey") % 9 == 0, F.lit("")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5")))
    rows = table(spark, sf_dir, "part").select("p_partkey", series.alias("s"), volume.alias("v"), "p_name", F.col("p_partkey").cast("string").alias("f"))
    return _placed(rows, view.shelf_order(F.col("s"), F.col("v"), F.col("p_name"), F.col("f"), F.col("f")))


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """p_partkey and its place in the order: range-sorted partitions are numbered and shifted by the rows before them."""
    from pyspark.sql import Window

    keyed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # numbered where the rows stand: a partition's rows keep their order under this id
    marked = keyed.select("p_partkey", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")).persist()
    before = marked.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return marked.join(F.broadcast(before), "part").select("p_partkey", (F.coalesce("before", F.lit(0)) + local).cast("long").alias("place"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY lpad(substr(p_brand, 7), 20, '0'), p_partkey)::BIGINT AS place FROM part")
def natural_order(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(".jpg")).alias("name"))
    return _placed(rows, [formats.natural_key(F.col("name")), F.col("p_partkey")])


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE year(o_orderdate) END::INTEGER AS y, CASE WHEN o_orderkey % 4 IN (1, 2) THEN month(o_orderdate) END::INTEGER AS m,
  CASE WHEN o_orderkey % 4 = 2 THEN day(o_orderdate) END::INTEGER AS d,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS best FROM orders
""")
def partial_date(spark, sf_dir):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(day, "yyyy-MM"), F.lit("-32")))
    best = formats.best_date(F.year(day).cast("string"), F.when(k != 0, F.month(day).cast("string")).otherwise(F.lit("13")), F.when(k == 2, F.dayofmonth(day).cast("string")).otherwise(F.lit("x")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", formats.partial_date(text).alias("p"), best.alias("best"))
    return rows.select("o_orderkey", F.col("p.year").alias("y"), F.col("p.month").alias("m"), F.col("p.day").alias("d"), "best")


@query("SELECT p_partkey, p_partkey % 5 = 0 OR (p_partkey % 5 IN (1, 2) AND p_size / 10.0 <= 5) AS valid FROM part")
def rating_valid(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_size") / 10
    text = F.when(k == 0, F.lit(" ")).when(k == 1, F.format_string("%.1f", n)).when(k == 2, F.format_string("%.2f", n)).when(k == 3, F.format_string("%.3f", n)).otherwise(F.format_string("-%.1f", n))
    return table(spark, sf_dir, "part").select("p_partkey", formats.rating_valid(text).alias("valid"))


@query("SELECT page_id, left(sha256(url), 24) AS id, sha256('r1' || chr(0) || 'fp' || chr(0) || lower(trim(url))) AS key FROM pages")
def path_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ids.path_id(F.col("url")).alias("id"), ids.cache_key("r1", F.lit("fp"), F.concat(F.lit(" "), F.col("url"))).alias("key"))


@query("""
SELECT o_orderkey, sha256('[{"key":"priority","value":["' || o_orderpriority || '"]},{"key":"status","value":["' || o_orderstatus || '"]}]') AS version, true AS order_free FROM orders
""")
def draft_version(spark, sf_dir):
    fields = F.create_map(F.lit("status"), F.array("o_orderstatus"), F.lit("priority"), F.array("o_orderpriority"))
    turned = F.create_map(F.lit("priority"), F.array("o_orderpriority"), F.lit("status"), F.array("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.draft_version(fields).alias("version"), (ids.draft_version(fields) == ids.draft_version(turned)).alias("order_free"))


@query("""
WITH d AS (SELECT doc_id, text, strlen(text) AS n, hex(encode(text)) AS h FROM documents),
c AS (
  SELECT *, 100 + len(regexp_extract(substr(h, 201), '^(?:[89AB].)*')) // 2 AS a, n - 50 + len(regexp_extract(substr(h, 2 * n - 99), '^(?:[89AB].)*')) // 2 AS z FROM d
)
SELECT doc_id, CASE WHEN n <= 150 THEN text ELSE decode(unhex(substr(h, 1, 2 * a))) || chr(10) || decode(unhex(substr(h, 2 * z + 1))) END AS sample FROM c
""")
def front_back(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", formats.front_back(F.col("text"), 100, 50).alias("sample"))


_SQL_ENTITIES = "text"
for _name, _sign in (("nbsp", "\u00a0"), ("middot", "\u00b7"), ("copy", "\u00a9"), ("quot", '"'), ("apos", "\'\'"), ("#39", "\'\'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    # the oldest names count without a semicolon, too
    _SQL_ENTITIES = f"regexp_replace({_SQL_ENTITIES}, '&{_name};{'' if _name in ('apos', '#39') else '?'}', '{_sign}', 'g')"


@query(rf"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>', chr(1), 'g'), '<[^>]*>', chr(1), 'g') AS text FROM pages),
e AS (SELECT page_id, {_SQL_ENTITIES} AS text FROM p)
SELECT page_id, trim(regexp_replace(text, '[\x01\s\x{{a0}}\x{{85}}\x{{2028}}\x{{2029}}\x{{3000}}]+', ' ', 'g')) AS text FROM e
""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", formats.html_text(F.col("html")).alias("text"))


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, t <> '' AND (regexp_matches(t, '(?i)\b(chapter|chapitre)\s+(\d+|[ivxlcdm]+|one|two|three|four|five|premier|première|deux|trois|quatre|cinq)\b')
  OR strlen(t) >= 1300 AND NOT regexp_matches(t, '(?i)\b(dedication|dédicace|acknowledg(e)?ments|remerciements|copyright|table of contents|sommaire)\b')
    AND len(regexp_extract_all(t, '[.!?…][”’"'')\]]?\s+[A-ZÀ-Þ]')) >= 4) AS body FROM d
""")
def body_heuristic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", formats.looks_like_body(F.col("text")).alias("body"))


@query("SELECT p_partkey, p_name || '|' || p_brand || ', ' || p_type AS items, 2 AS n, p_name || ',\"' || p_brand || ', ' || p_type || '\"' AS written FROM part")
def csv_list(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.col("p_name"), F.lit(' , "'), F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit('", '))
    rows = table(spark, sf_dir, "part").select("p_partkey", formats.list_items(raw).alias("l"))
    return rows.select("p_partkey", F.array_join("l", "|").alias("items"), F.size("l").alias("n"), formats.list_text(F.col("l")).alias("written"))
