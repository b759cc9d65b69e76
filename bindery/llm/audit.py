"""Filter interaction audit by the Walsh-Hadamard transform.

Every document gets a mask of the filters that it fails. Of each part and label the 32 signed parity sums of the masks are
added up (one for each set of filters: +1 for a document that fails an even number of the set, else -1), with partial sums in
the task; the transform is its own inverse but for a factor, so the same signs give back how many documents have each mask, exactly.
What any order of the filters keeps, removes and loses follows from these 32 counts alone: no order is run over the documents.
A filter removes a document in 120/f of all orders where the document fails f filters, which is its closed-form Shapley share.

Texts are read once and never shuffled: a row of masks has a 256-bit digest of its text, by which a text's smallest id is found. That
id is joined on digest and id together, so that thousands of copies of a text don't meet in one task.

Defined cases: a null text is empty, a null part the empty string. An empty text has no words and fails A only (and E, if it is no first).
Repeated rows are documents each; those that hold a text's smallest id don't fail E. A null id is smaller or larger than none: it
fails no E and causes none, and has no labels. Of several labels of one id, one that is 1 is enough. Texts may be of any length. An empty
table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch

#: The filters; bit k of a mask is set where a document fails the k-th.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
GAP = r"[ \x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone: A, B, C, D."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < MIN_WORDS, distinct * 100 < n * MIN_DISTINCT, capitals.cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS, text.rlike(SIGNS)]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def odd(mask: int, subset: int) -> int:
    """Whether a mask has an odd number of the subset's bits."""
    return (mask & subset).bit_count() & 1


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, good, toxic, mask of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    seen = scratch.save(seen, "masks")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = seen.join(first, ["digest", "doc_id"], "left").join(label, "doc_id", "left")
    copies = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return found.select(
        "part",
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")),
        (F.col("mask") + F.when(copies, 1 << (len(FILTERS) - 1)).otherwise(0)).alias("mask"),
    )


def parity_sums(found: DataFrame) -> DataFrame:
    """part, good, toxic, parity: the signed sums of all sets of filters, as an array."""
    sums = [F.expr(f"sum(1 - 2 * (bit_count(mask & {s}) & 1))").alias(f"s{s}") for s in range(MASKS)]
    return found.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(MASKS))).alias("parity"))


def cells(sums: DataFrame) -> DataFrame:
    """part, and of all, good and toxic documents how many have each mask."""

    def inverse(m: int) -> str:
        return " ".join(f"{'-' if odd(m, s) else '+'} parity[{s}]" for s in range(MASKS))

    count = sums.selectExpr("part", "good", "toxic", *(f"({inverse(m)}) div {MASKS} as n{m}" for m in range(MASKS)))
    each = {"every": "true", "good": "good", "toxic": "toxic"}
    added = count.groupBy("part").agg(*(F.expr(f"sum(if({of}, n{m}, 0L)) as {kind}{m}") for kind, of in each.items() for m in range(MASKS)))
    return added.selectExpr("part", *(f"array({', '.join(f'{kind}{m}' for m in range(MASKS))}) as {kind}_cells" for kind in each))


def steps() -> Column:
    """Every order and step: the filter's bit, and those of the filters before it."""
    found = []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            found.append(f"named_struct('filter_order', '{order}', 'step', {k + 1}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return F.expr(f"explode(array({', '.join(found)}))")


def _count(cells: str, when: str) -> Column:
    """Documents of the masks ``i`` for which the condition holds."""
    return F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (n, i) -> n + if({when}, {cells}[i], 0L))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    scratch = Scratch(docs.sparkSession, "audit")
    found = scratch.save(cells(parity_sums(masks(docs, labels, scratch))), "cells")
    rows = found.select("*", steps().alias("_at")).select("*", "_at.*")
    removed = "(i & bit) <> 0 and (i & before) = 0"
    shares = f"(i & bit) <> 0, every_cells[i] * {len(ORDERS)} div bit_count(i)"
    return rows.select(
        "part",
        "filter_order",
        "step",
        _count("every_cells", "(i & (before | bit)) = 0").alias("kept"),
        _count("every_cells", removed).alias("removed"),
        _count("every_cells", "(i & bit) <> 0 and (i & before) <> 0").alias("redundant"),
        F.expr("every_cells[bit]").alias("unique_fails"),
        _count("good_cells", removed).alias("good_lost"),
        _count("toxic_cells", removed).alias("toxic_lost"),
        F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (n, i) -> n + if({shares}, 0L))").alias("shapley"),
    )


def oracle() -> str:
    """The same in SQL, from the documents' failures: every order is run step by step."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, len({words}) AS n, len(list_distinct({words})) AS k, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS c FROM d
), f AS (
  SELECT part, n < 200 AS "A", 100 * k < 50 * n AS "B", 100 * c > 2 * length(t) AS "C", regexp_matches(t, '[#$%&*|]') AS "D",
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS "E",
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM w
), g AS (
  SELECT part, (CASE WHEN "A" THEN 'A' ELSE '' END || CASE WHEN "B" THEN 'B' ELSE '' END || CASE WHEN "C" THEN 'C' ELSE '' END
    || CASE WHEN "D" THEN 'D' ELSE '' END || CASE WHEN "E" THEN 'E' ELSE '' END) AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM o, range(1, 6) r(step)
), p AS (
  SELECT part, fails, good, toxic, n, filter_order, step, own, contains(fails, own) AS fails_own,
    before <> '' AND length(translate(fails, before, '')) < length(fails) AS gone
  FROM g, s
), r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT fails_own) AS kept, sum(n) FILTER (NOT gone AND fails_own) AS removed,
    sum(n) FILTER (gone AND fails_own) AS redundant, sum(n) FILTER (fails = own) AS unique_fails,
    sum(n) FILTER (NOT gone AND fails_own AND good) AS good_lost, sum(n) FILTER (NOT gone AND fails_own AND toxic) AS toxic_lost
  FROM p GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM r
"""
