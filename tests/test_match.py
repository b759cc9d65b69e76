"""The inverted index and corroboration against plain Python."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import plain
from bindery.operators import match


def names(n, seed):
    """Texts of few and many words, long and short, some a letter apart, some without any word in common."""
    rng = random.Random(seed)
    letters = "abcdefghij"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    out = []
    while len(out) < n:
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 5)))
        out.append(text)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(text) + 1)
            text = " ".join((text[:at] + rng.choice([*letters, "", " "]) + text[at + rng.randint(0, 1) :]).split())
            out.append(text)
    return out[:n]


def by_block(texts):
    return [(i, f"b{i % 3}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least", [0.4, 0.55, 0.7, 0.9])
@pytest.mark.parametrize("span", [4096, 8])
def test_similar_texts_are_complete(spark, monkeypatch, least, span):
    monkeypatch.setattr(match, "SPAN", span)
    rows = by_block(names(330, 5))
    found = match.similar_texts(spark.createDataFrame(rows, "id long, block string, norm string"), "block", "norm", least).collect()
    got = {(r.block, r._a, r._b): r.score for r in found}
    assert len(got) == len(found)
    want = {}
    for block in ("b0", "b1", "b2"):
        texts = {t for _, b, t in rows if b == block}
        want |= {(block, a, b): s for a in texts for b in texts if a != b and (s := plain.text_similarity(a, b)) >= least + 1e-12}
    assert got.keys() >= want.keys() and all(got[k] >= least for k in got)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert all(plain.text_similarity(a, b) >= least - 1e-9 for _, a, b in got.keys() - want.keys())


def test_best_partners_of_every_item(spark):
    k, rows = 3, by_block(names(240, 6) + ["one of many copies"] * 30 + ["ab", "ab", "ac", "a", "", ""])
    found = match.block_topk(spark.createDataFrame(rows, "id long, block string, norm string"), "id", "block", "norm", k).collect()
    got = {}
    for r in found:
        got.setdefault(r.id, {})[r.rank] = (r.other, round(r.score, 9))
    for i, block, t in rows:
        scored = sorted(((-round(plain.text_similarity(t, u), 9), j) for j, b, u in rows if b == block and j != i))
        best = [x for x in scored if -x[0] >= match.LEAST_CONFIDENCE][:k]
        want = {n + 1: (j, -s) for n, (s, j) in enumerate(best)}
        assert got.get(i, {}) == want, t


def test_fewer_pairs_are_formed_than_there_are(spark):
    """Titles of a growing vocabulary, each with two near ones: rows that the index forms grow in proportion, pairs with the square."""
    formed = {}
    for n in (500, 2000):
        rng = random.Random(n)
        vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 9))) for _ in range(n)]
        texts = set()
        while len(texts) < n:
            text = " ".join(rng.sample(vocabulary, 4))
            texts |= {text, text + "s", "x" + text}
        classes = spark.createDataFrame([("b", t) for t in sorted(texts)], "block string, norm string").cache()
        formed[n] = match._by_words(classes, classes, "block", "norm", 0.8).count()
        found = match.similar_texts(classes, "block", "norm", 0.8)
        assert found.select("_a").distinct().count() == len(texts)
        classes.unpersist()
    assert formed[2000] < 6 * formed[500] and formed[2000] < 2000 * 2000 / 50


def test_corroboration_against_a_plain_search(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        rows.append((f"b{k % 4}", f"u{rng.randrange(120)}", f"s{k}", rng.choice(["", f"t{k}"]), [rng.choice(["", "1", "2", "3", "4"]) for _ in range(rng.randint(0, 3))], rng.random() < 0.7, k))
    schema = "book string, url string, source string, specific string, isbns array<string>, language_ok boolean, place long"
    got = {(r.book, r.url): (r.title, r.donor, r.donor_url) for r in match.corroborate(spark.createDataFrame(rows, schema), ["book"], F.col("place")).collect()}
    want = {}
    for book, url, _, specific, isbns, _, _ in rows:
        if specific:
            continue
        donors = [(place, u, t, s) for b, u, s, t, found, ok, place in rows if b == book and u != url and t and ok and {x for x in found if x} & set(isbns)]
        if donors:
            place, u, t, s = min(donors)
            if (book, url) not in want or place < want[book, url][0]:
                want[book, url] = (place, t, s, u)
    assert got == {k: v[1:] for k, v in want.items()}


def test_an_isbn_that_all_share_sends_on_two_donors(spark):
    rows = [("b", f"u{k}", "s", "" if k % 2 else f"t{k}", ["9"], True, k) for k in range(2000)]
    schema = "book string, url string, source string, specific string, isbns array<string>, language_ok boolean, place long"
    found = match.corroborate(spark.createDataFrame(rows, schema).repartition(4), ["book"], F.col("place"))
    assert found.count() == 1000 and {r.donor_url for r in found.select("donor_url").distinct().collect()} == {"u0"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # limits in the tasks, before rows are shuffled


@pytest.mark.parametrize("tile, pairs", [(1024, 4_000_000), (4, 50)])
def test_block_pairs_are_complete(spark, monkeypatch, tile, pairs):
    monkeypatch.setattr(match, "TILE", tile)
    monkeypatch.setattr(match, "PAIRS_A_TASK", pairs)
    rng = random.Random(3)
    rows = [("x" if i < 60 else f"b{i % 5}", rng.choice("uv") if i % 9 else None, rng.randint(-40, 400) if i % 11 else None, str(rng.randint(0, 3)) if i % 7 else None) for i in range(140)]
    found = match.block_pairs(spark.createDataFrame(rows, "one string, two string, id long, n string"), ["one", "two"], "id", "n").collect()
    want = [(a, b, va, vb) for one, two, a, va in rows for o, t, b, vb in rows if (one, two) == (o, t) and None not in (two, a, b) and a < b]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert match.block_pairs(spark.createDataFrame([], "one string, id long, n string"), ["one"], "id", "n").count() == 0


def test_pairs_of_one_large_block_are_dealt_to_tasks(spark, tmp_path):
    """Number words are found once a row, below the join, and no task has all pairs of a brand and name that many parts have."""
    from bindery.plans import catalog

    n = 3000
    parts = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("old ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), (900 + F.col("id") % 700 / 10).alias("p_retailprice"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["different_numbers"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in plan[: plan.index("Join ")]
    by_task = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("differ").cast("int")).alias("differ"), F.sum(F.col("a") * 7 + F.col("b")).alias("keys")).collect()
    assert sum(r.n for r in by_task) == n * (n - 1) // 2
    assert max(r.n for r in by_task) < 0.8 * sum(r.n for r in by_task)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = duck.sql(f"SELECT sum(differ::int), sum(a * 7 + b) FROM ({catalog.oracle_sql()['different_numbers']})").fetchall()[0]
    assert (sum(r.differ for r in by_task), sum(r["keys"] for r in by_task)) == want
