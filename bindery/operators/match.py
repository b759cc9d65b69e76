"""Matching books with catalog candidates: lookup plan, staged stop, score, dedupe, corroboration, top-k.

Candidates meet books by equi-joins on blocking keys only (canonical ISBN, block column); similar texts of a block meet by an inverted
index of their words and letters, and similarities are worked out once per distinct pair of strings and joined back where strings repeat.
Where all pairs of a block are wanted, they are dealt to tasks in cells of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import text as tx
from bindery.operators.held import held

#: What a candidate must reach, and what makes a match strong.
LEAST_TITLE, LEAST_CONFIDENCE = 0.35, 0.4
STRONG_TITLE, STRONG_AUTHOR, STRONG_TOTAL = 0.88, 0.75, 0.85
WEIGHTS = {"title": 0.7, "author": 0.25, "language": 0.05}
TOP = 12
MAX_QUERIES, MAX_ISBNS, MAX_TITLES = 8, 2, 3


def admitted(title: Column, url: Column) -> Column:
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & (F.coalesce(url, F.lit("")) != "")


def passes(isbn: Column, title: Column, confidence: Column) -> Column:
    return isbn | ((title >= LEAST_TITLE) & (confidence >= LEAST_CONFIDENCE))


def strong(isbn: Column, title: Column, author: Column, has_authors: Column, total: Column) -> Column:
    return isbn | ((title >= STRONG_TITLE) & (~has_authors | (author >= STRONG_AUTHOR)) & (total >= STRONG_TOTAL))


def total_score(title: Column, author: Column, has_authors: Column, language: Column, has_languages: Column, remote_authors: Column, numbers_differ: Column, volumes_differ: Column, isbn: Column) -> Column:
    """Weighted evidence over the weights that apply, then the penalties, then the lift of a matching ISBN."""
    zero = F.lit(0.0)
    weight = F.lit(WEIGHTS["title"]) + F.when(has_authors, WEIGHTS["author"]).otherwise(zero) + F.when(has_languages, WEIGHTS["language"]).otherwise(zero)
    held = F.lit(WEIGHTS["title"]) * title + F.when(has_authors, F.lit(WEIGHTS["author"]) * author).otherwise(zero) + F.when(has_languages & language, WEIGHTS["language"]).otherwise(zero)
    total = held / weight
    total = total * F.when(has_authors & remote_authors & (author < 0.35), 0.65).otherwise(1.0)
    total = total * F.when(numbers_differ, 0.75).otherwise(1.0)
    total = total * F.when(volumes_differ, 0.75).otherwise(1.0)
    total = F.when(isbn, 0.95 + 0.05 * total).otherwise(total)
    return F.least(F.greatest(total, zero), F.lit(1.0))


def best_title(local: Column, remote: Column) -> Column:
    """struct<score, k> of the first of the local titles that comes nearest any remote one (normalised, k from 0)."""
    start = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("k"))
    best = F.transform(local, lambda t, k: F.struct(F.array_max(F.transform(remote, lambda r: tx.text_similarity(t, r))).alias("score"), k.alias("k")))
    return F.aggregate(best, start, lambda held, x: F.when(x["score"] > held["score"], F.struct(x["score"].alias("score"), x["k"].alias("k"))).otherwise(held))


def plan_queries(isbns: Column, titles: Column, title_norms: Column, authors: Column, query: Column, custom: Column, key_norm) -> Column:
    """array<struct<kind, title, author, isbn, text, fallback>> of at most eight lookups, exact ones first.

    ``key_norm(column)`` normalises a text; lookups equal in kind and normalised content are made once.
    """
    empty, no, yes = F.lit(""), F.lit(False), F.lit(True)
    author = F.coalesce(F.try_element_at(authors, F.lit(1)), empty)
    few = F.slice(titles, 1, MAX_TITLES)

    def one(kind: str, title=empty, by=empty, isbn=empty, text=empty, fallback=no) -> Column:
        return F.struct(F.lit(kind).alias("kind"), title.alias("title"), by.alias("author"), isbn.alias("isbn"), text.alias("text"), fallback.alias("fallback"))

    by_isbn = F.transform(F.slice(isbns, 1, MAX_ISBNS), lambda i: one("isbn", isbn=i))
    exact = F.transform(few, lambda t: one("title-author", t, author))
    wide = F.flatten(F.transform(few, lambda t: F.filter(F.array(one("title", t, fallback=yes), one("text", text=F.trim(F.concat_ws(" ", t, author)), fallback=yes)), lambda q: (q["kind"] == "text") | (author != ""))))
    plain = F.array(one("text", text=F.trim(query)))
    rest = F.when(custom, plain).when(F.size(few) == 0, F.array(one("text", text=query))).otherwise(F.concat(exact, wide))
    found = F.concat(by_isbn, rest)
    # the first of equal lookups stays: its place is that of its key's first appearance
    key = F.transform(found, lambda q: F.concat(q["kind"], F.lit("\0"), key_norm(F.concat_ws(" ", q["title"], q["author"], q["isbn"], q["text"]))))
    return F.slice(F.filter(found, lambda q, k: F.array_position(key, F.element_at(key, k + 1)) == k + 1), 1, MAX_QUERIES)


def query_text(q: Column) -> Column:
    return F.when(q["isbn"] != "", q["isbn"]).when(q["text"] != "", q["text"]).otherwise(F.trim(F.concat_ws(" ", q["title"], q["author"])))


def quoted(value: Column) -> Column:
    """A phrase in quotes, without quotes, backslashes and control characters, blanks collapsed."""
    return F.concat(F.lit('"'), F.trim(F.regexp_replace(F.regexp_replace(value, '["\\\\\\x00-\\x1f]', " "), r"[ \u0085 ]+", " ")), F.lit('"'))


def provider_queries(q: Column) -> Column:
    """Map of each catalog to the search text it is asked with: fielded for an ISBN or a title, plain otherwise."""
    plain, author = query_text(q), q["author"] != ""
    google = F.when(q["isbn"] != "", F.concat(F.lit("isbn:"), q["isbn"])).when(q["title"] != "", F.concat(F.lit("intitle:"), quoted(q["title"]), F.when(author, F.concat(F.lit(" inauthor:"), quoted(q["author"]))).otherwise(F.lit("")))).otherwise(plain)
    library = F.when(q["isbn"] != "", F.concat(F.lit("q=isbn:"), q["isbn"])).when(q["title"] != "", F.concat(F.lit("title="), q["title"], F.when(author, F.concat(F.lit("&author="), q["author"])).otherwise(F.lit("")))).otherwise(F.concat(F.lit("q="), plain))
    archive = F.when(q["isbn"] != "", F.concat(F.lit("isbn:"), quoted(q["isbn"]))).when(q["title"] != "", F.concat(F.lit("title:"), quoted(q["title"]), F.when(author, F.concat(F.lit(" AND creator:"), quoted(q["author"]))).otherwise(F.lit("")))).otherwise(plain)
    return F.create_map(F.lit("Google Books"), google, F.lit("Open Library"), library, F.lit("Internet Archive"), archive)


def staged_stop(lookups: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """The lookups that a provider would still have made: none after a failure or an exact hit, no fallback after a strong one.

    Columns: keys (book, provider), position, and the booleans fallback, failed, exact, strong of each lookup's outcome.
    """
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.bool_or(F.col("failed") | F.col("exact")).over(before), F.lit(False))
    firm = F.coalesce(F.bool_or("strong").over(before), F.lit(False))
    return lookups.withColumn("_skip", ended | (F.col("fallback") & firm)).where("not _skip").drop("_skip")


def best_records(candidates: DataFrame, keys: list[str], confidence: str, arrival: list[Column]) -> DataFrame:
    """The record of highest confidence for each key, the first to arrive among equals."""
    order = Window.partitionBy(*keys).orderBy(F.col(confidence).desc(), *arrival)
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top_candidates(scored: DataFrame, book: list[str], k: int = TOP) -> DataFrame:
    """The k best candidates of each book by confidence, then URL, then source, with their rank."""
    order = Window.partitionBy(*book).orderBy(F.col("confidence").desc(), F.col("url"), F.col("source"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def corroborate(candidates: DataFrame, book: list[str], rank: Column) -> DataFrame:
    """Evidence for candidates without a specific title: the title of the first ranked donor that shares a canonical ISBN.

    candidates: book, url, source, specific (title or empty), isbns (canonical), language_ok; a donor has another URL and
    a compatible language. Of each (book, ISBN) the two first donors of different URLs are enough, as one of them has another URL than
    whoever asks: they are chosen with limits in the tasks, so an ISBN that many share sends on two rows a task, and is joined with two.
    """
    ranked = candidates.withColumn("_rank", rank)
    rows = ranked.select(*book, "url", "source", "specific", "language_ok", "_rank", F.explode(F.array_distinct(F.filter("isbns", lambda i: i != ""))).alias("_isbn"))
    asks = rows.where("specific = ''").select(*book, "_isbn", "url")
    gives = rows.where("specific <> '' and language_ok").groupBy(*book, "_isbn", F.col("url").alias("donor_url"))
    gives = gives.agg(F.min(F.struct("_rank", F.col("specific").alias("title"), F.col("source").alias("donor"))).alias("_d"))
    first = Window.partitionBy(*book, "_isbn").orderBy("_d._rank", "donor_url")
    two = gives.withColumn("_n", F.row_number().over(first)).where("_n <= 2").drop("_n")
    met = asks.join(two, [*book, "_isbn"]).where("donor_url <> url")
    best = met.groupBy(*book, "url").agg(F.min(F.struct("_d._rank", "donor_url", "_d.title", "_d.donor")).alias("_d"))
    return best.select(*book, "url", "_d.title", "_d.donor", "_d.donor_url")


# ---- all pairs of a block

#: Rows of a block that meet as many others in one cell; pairs that a task is given.
TILE, PAIRS_A_TASK = 1024, 4_000_000
#: Tasks that the pairs are dealt to at most; beyond that a task is given more of them.
MOST_TASKS = 10_000


def block_pairs(rows: DataFrame, blocks: list[str], key: str, value: str) -> DataFrame:
    """_a, _b (keys), _value_a, _value_b: all pairs of rows of a block, the smaller key first; equal keys and nulls make no pair.

    A block of more than ``TILE`` rows is dealt into parts of about that size, and each two parts meet in a cell of their own, so one block may hold
    all rows. Pairs grow with the square of a block while its bytes don't, so the number of tasks comes from the pairs.
    """
    rows, n = rows.select(*blocks, key, value), F.col("_n")
    for column in [*blocks, key]:
        rows = rows.where(F.col(column).isNotNull())
    sizes = rows.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n"))
    work = sizes.agg(F.sum(n * (n + 1) / 2)).first()[0] or 0
    tasks = min(MOST_TASKS, math.ceil(work / PAIRS_A_TASK) or 1)
    parts = sizes.where(n > TILE).select(*blocks, F.ceil(n / TILE).cast("int").alias("_parts"))
    count = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(parts, blocks, "left").select(*blocks, key, value, F.pmod(F.xxhash64(key), count).cast("int").alias("_part"), F.sequence(F.lit(0), count - 1).alias("_others"))
    cell = [*blocks, "_left", "_right"]
    left = dealt.select(*blocks, F.col("_part").alias("_left"), F.explode("_others").alias("_right"), F.col(key).alias("_a"), F.col(value).alias("_value_a"))
    right = dealt.select(*blocks, F.explode("_others").alias("_left"), F.col("_part").alias("_right"), F.col(key).alias("_b"), F.col(value).alias("_value_b"))
    met = left.repartition(tasks, *cell).join(right.repartition(tasks, *cell).hint("merge"), cell)
    return met.where("_a < _b").select("_a", "_b", "_value_a", "_value_b")


# ---- similar texts within a block, by an inverted index

#: Shares of the text similarity; a pair without a common word scores at most the first.
EDIT_SHARE, WORD_SHARE = 0.6, 0.4
#: Texts of a block that share a token and are met in one task.
SPAN = 4096
#: Texts up to here have signatures of deletions; longer than SHORT they have enough pairs of letters.
SHORT, SIGNED = 5, 7


def _frequent_last(tokens: DataFrame, block: str, text: str, keep: Column) -> DataFrame:
    """block, text, _own, the ``keep`` rarest of a text's ``_tokens`` by how many texts of the block have each (ties by token)."""
    each = tokens.select(block, text, "_keep", F.explode("_tokens").alias("_w")) if "_keep" in tokens.columns else tokens.select(block, text, keep.alias("_keep"), F.explode("_tokens").alias("_w"))
    often = each.groupBy(block, "_w").agg(F.count(F.lit(1)).alias("_n"))
    order = each.join(often, [block, "_w"]).groupBy(block, text).agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_o"), F.first("_keep").alias("_keep"))
    return order.select(block, text, F.transform(F.slice("_o", F.lit(1), F.col("_keep")), lambda x: x["_w"]).alias("_own"))


def _met(index: DataFrame, asking: DataFrame, block: str, text: str) -> DataFrame:
    """block, _a, _b: an asking text and another that have one of their ``_own`` tokens in common, each pair once.

    A token that more than ``SPAN`` texts of a block have is dealt into parts of about that size, each met by all that ask by it.
    """
    right = index.select(block, F.col(text).alias("_b"), F.col("_own").alias("_own_b"), F.explode("_own").alias("_w"))
    parts = right.groupBy(block, "_w").agg(F.ceil(F.count(F.lit(1)) / SPAN).cast("int").alias("_parts"))
    left = index.join(asking.select(block, text), [block, text], "left_semi").select(block, F.col(text).alias("_a"), F.col("_own").alias("_own_a"), F.explode("_own").alias("_w"))
    right = right.join(parts.where("_parts > 1").hint("merge"), [block, "_w"], "left").withColumn("_part", F.pmod(F.xxhash64("_b"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    left = left.join(parts.where("_parts > 1").hint("merge"), [block, "_w"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    # a pair counts at the first token that both have
    once = F.col("_w") == F.array_min(F.array_intersect("_own_a", "_own_b"))
    return left.join(right, [block, "_w", "_part"]).where((F.col("_a") != F.col("_b")) & once).select(block, "_a", "_b")


def _by_words(classes: DataFrame, asking: DataFrame, block: str, text: str, least: float) -> DataFrame:
    """Pairs with a common word that may reach ``least``; above EDIT_SHARE only the rarest words of each text are looked at.

    A score of ``least`` needs a word overlap (Dice) of d = (least - EDIT_SHARE) / WORD_SHARE, hence d * n / (2 - d) common words of a text's n.
    """
    words = classes.select(block, text, F.array_distinct(tx.words(F.col(text))).alias("_tokens"))
    dice = max(0.0, (least - EDIT_SHARE) / WORD_SHARE)
    if dice > 0:
        n = F.size("_tokens")
        needed = F.greatest(F.lit(1), F.ceil(n * (dice / (2 - dice)) - 1e-9))
        index = _frequent_last(words, block, text, (n - needed + 1).cast("int"))
    else:
        index = words.withColumnRenamed("_tokens", "_own")
    return _met(index, asking, block, text)


def _deletions(value: Column) -> Column:
    """A short text, and what is left of it without one or two of its letters."""

    def less(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda k: F.concat(F.substring(v, F.lit(1), k - 1), F.substring(v, k + 1, F.length(v))))

    one = less(value)
    return F.array_distinct(F.concat(F.array(value), one, F.flatten(F.transform(one, less))))


def _by_letters(classes: DataFrame, asking: DataFrame, block: str, text: str) -> DataFrame:
    """Pairs that may have an edit similarity of two thirds, as those need that reach LEAST_CONFIDENCE without a common word.

    That allows one edit for three letters of the longer text: of a text's L letters at most 2L / 3 of its pairs of letters are lost, so some of the
    2L / 3 + 1 rarest different ones are common; texts too short for that share what is left without one or two letters.
    """
    t, n = F.col(text), F.length(text)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.substring(t, k, F.lit(2))))
    long = classes.where(n > SHORT).select(block, text, pairs.alias("_tokens"), (F.floor(n * 2 / 3) + 1).cast("int").alias("_keep"))
    index = _frequent_last(long, block, text, F.col("_keep"))
    short = classes.where((n <= SIGNED) & (n > 0)).select(block, text, _deletions(t).alias("_own"))
    both = _met(index, asking, block, text).unionByName(_met(short, asking, block, text))
    return both.where(F.least(F.length("_a"), F.length("_b")) * 3 >= F.greatest(F.length("_a"), F.length("_b")) * 2).distinct()


def _scored(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs that reach ``least``, with their score; no edit distance is worked out where lengths and common words rule it out."""
    a, b = F.col("_a"), F.col("_b")
    may = pairs.where(tx.similarity_bound(a, b) >= least - 1e-9)
    return may.withColumn("score", tx.text_similarity(a, b)).where(F.col("score") >= least)


def similar_texts(texts: DataFrame, block: str, text_norm: str, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """block, _a, _b, score of all pairs of different (normalised) texts of a block that score ``least`` or more, both ways round.

    Complete for every ``least`` from LEAST_CONFIDENCE on: a pair that shares no word of the index scores less.
    """
    if least < LEAST_CONFIDENCE:
        raise ValueError(f"below {LEAST_CONFIDENCE} the index misses pairs")
    classes = held(texts.select(block, text_norm).distinct(), "texts")
    found = _scored(_by_words(classes, classes, block, text_norm, least), least)
    if least >= EDIT_SHARE:
        return found
    no_word = ~F.arrays_overlap(tx.words(F.col("_a")), tx.words(F.col("_b")))
    return found.unionByName(_scored(_by_letters(classes, classes, block, text_norm).where(no_word), least))


def block_topk(items: DataFrame, key: str, block: str, text_norm: str, k: int, strong: float = 0.8) -> DataFrame:
    """The k most similar other items of each item within its block, ties to the smaller key.

    Items of one text are one class, whose own copies score 1. Classes ask an inverted index in three rounds, and only those go on whose k-th
    best score so far may still be beaten: first for partners of ``strong`` by the rarest words, then for any that share a word, and then, where the k-th
    stands below what a pair without a common word can reach, by letters. An item's best partners lie in its best classes, and of each class only the k + 1
    smallest keys can be among them, so at most k + 1 keys of a class are spread out.
    """
    items = items.select(key, block, text_norm)
    classes = held(items.groupBy(block, text_norm).agg(F.count(F.lit(1)).alias("_items")), "classes")
    sizes = classes.select(block, F.col(text_norm).alias("_b"), "_items")

    def unsure(asking: DataFrame, found: DataFrame, sure: float) -> DataFrame:
        """Those with fewer than k partners of a score of ``sure``, their own copies included."""
        better = found.where(F.col("score") >= sure).join(sizes, [block, "_b"]).groupBy(block, F.col("_a").alias(text_norm)).agg(F.sum("_items").alias("_got"))
        return asking.join(better, [block, text_norm], "left").where(F.col("_items") - 1 + F.coalesce("_got", F.lit(0)) < k).drop("_got")

    asking = classes.where(F.col("_items") <= k)
    first = held(_scored(_by_words(classes, asking, block, text_norm, strong), strong), "strong")
    asking = held(unsure(asking, first, strong), "asking")
    second = held(_scored(_by_words(classes, asking, block, text_norm, LEAST_CONFIDENCE), LEAST_CONFIDENCE), "sharing")
    asking = held(unsure(asking, second, EDIT_SHARE), "asking")
    no_word = ~F.arrays_overlap(tx.words(F.col("_a")), tx.words(F.col("_b")))
    third = _scored(_by_letters(classes, asking, block, text_norm).where(no_word), LEAST_CONFIDENCE)
    pairs = first.unionByName(second).unionByName(third).distinct()
    own = classes.select(block, F.col(text_norm).alias("_a"), F.col(text_norm).alias("_b"), F.when(F.col(text_norm) == "", 0.0).otherwise(1.0).alias("score")).where(F.col("score") > 0)

    smallest = Window.partitionBy(block, text_norm).orderBy(key)
    few = items.withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= k + 1)
    best = Window.partitionBy(block, "_a").orderBy(F.col("score").desc(), F.col("other"))
    partners = pairs.unionByName(own).join(few.select(block, F.col(text_norm).alias("_b"), F.col(key).alias("other")), [block, "_b"])
    partners = partners.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    found = items.select(block, F.col(text_norm).alias("_a"), F.col(key)).join(partners, [block, "_a"]).where(F.col(key) != F.col("other"))
    mine = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("other"))
    return found.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select(key, "rank", "other", "score")
