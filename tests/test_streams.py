"""Streams with keyed state against plain replays, over restarts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bindery.operators import match
from bindery.streaming import state

OPERATION = "cache string, seq long, at timestamp, put boolean, cache_key string, result_json string, max_age long"


def replay(operations, keep):
    """operations: (cache, seq, second, put, key, result, max_age) in their order, one after another over a plain list."""
    caches, said = {}, []
    for cache, seq, second, put, key, result, max_age in operations:
        rows = caches.setdefault(cache, [])
        if put:
            rows[:] = [r for r in rows if r[0] != key] + [(key, result, second)]
            rows.sort(key=lambda r: (-r[2], r[0]))
            del rows[keep:]
        else:
            found = [r for r in rows if r[0] == key and max_age > 0 and r[2] >= second - max_age]
            said.append((cache, seq, "hit" if found else "miss", found[0][1] if found else None))
    return sorted(said, key=repr), caches


def drawn(n, seed):
    rng = random.Random(seed)
    out, second = [], 1_700_000_000
    for seq in range(n):
        second += rng.choice([0, 0, 1, 5, 40])
        put = rng.random() < 0.5
        out.append((rng.choice(["a", "a", "b"]), seq, second, put, f"k{rng.randrange(30)}", f"r{seq}" if put else None, None if put else rng.choice([0, 30, 300, 10_000])))
    return out


def written(spark, operations, path, minutes=0):
    spark.createDataFrame(operations, OPERATION.replace("at timestamp", "second long")).withColumn("at", F.timestamp_seconds("second")).drop("second").coalesce(1).write.mode("append").parquet(path)


def test_cache_equals_a_replay_over_restarts(spark, tmp_path):
    at, keep, longest = f"file://{tmp_path}", 12, 3600
    operations = drawn(600, 1)
    schema = spark.createDataFrame([], OPERATION).schema
    # the files are cut where the clock moves on, so that no second is split over two batches
    cuts = [0, *(next(k for k in range(c, len(operations)) if operations[k][2] > operations[k - 1][2]) for c in (150, 300, 420)), len(operations)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        written(spark, operations[a:b], f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        state.drain(state.cache_answers(stream, keep, longest, "10 minutes"), f"{at}/out", f"{at}/checkpoint")  # a new run each time, from the checkpoint
    got = spark.read.parquet(f"{at}/out").collect()
    want, caches = replay(operations, keep)
    assert sorted(((r.cache, r.seq, r.kind, r.result_json) for r in got if r.kind != "expired"), key=repr) == want
    kinds = [w[2] for w in want]
    assert kinds.count("hit") > 30 and kinds.count("miss") > 30
    assert not [r for r in got if r.kind == "expired"]
    # a much later row moves the watermark: what was put an hour before is out of reach, and is said to be
    late = operations[-1][2] + 20_000
    for k in (0, 1):
        written(spark, [("c", 1000 + k, late + k * 5000, False, "x", None, 10)], f"{at}/in")
        state.drain(state.cache_answers(spark.readStream.schema(schema).parquet(f"{at}/in"), keep, longest, "10 minutes"), f"{at}/out", f"{at}/checkpoint")
    gone = {(r.cache, r.cache_key, r.at) for r in spark.read.parquet(f"{at}/out").where("kind = 'expired'").collect()}
    assert gone == {(c, k, s) for c, rows in caches.items() for k, _, s in rows} and gone


def test_cache_holds_its_bound_and_breaks_ties_by_key():
    found = state.Entries(3)
    for k in ("d", "b", "c", "a"):
        found.put(k, k, 7)
    assert sorted(found.held) == ["a", "b", "c"]
    found.put("z", "z", 8)
    assert sorted(found.held) == ["a", "b", "z"]
    assert found.get("z", 8, 0) == (False, None) and found.get("z", 18, 10) == (True, "z") and found.get("z", 19, 10) == (False, None)
    assert found.expire(20, 12) == [("a", 7), ("b", 7)] and list(found.held) == ["z"]


def plain_decisions(outcomes):
    """(fallback, failed, exact, strong) by position: whether each lookup is made."""
    ended = firm = False
    out = []
    for fallback, failed, exact, strong in outcomes:
        out.append(not (ended or fallback and firm))
        ended, firm = ended or failed or exact, firm or strong
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.booleans(), *(st.integers(0, 4).map(lambda x: x == 0) for _ in range(3))), max_size=8).flatmap(lambda x: st.tuples(st.just(x), st.permutations(range(len(x))))), st.data())
def test_decisions_do_not_depend_on_the_order_of_arrival(drawn, data):
    outcomes, order = drawn
    stage, said = state.Stage(), []
    for k in order:
        said += stage.arrive(k + 1, *outcomes[k])
        if data.draw(st.booleans()):
            assert stage.arrive(k + 1, *outcomes[k]) == []  # once more
    assert sorted(said) == [(p + 1, do) for p, do in enumerate(plain_decisions(outcomes))]
    assert not stage.beyond


def test_what_never_comes_is_settled():
    stage = state.Stage()
    assert stage.arrive(2, False, False, False, True) == []
    assert stage.arrive(4, True, False, False, False) == [(4, False)]
    assert stage.arrive(5, False, False, False, False) == []
    assert stage.settle() == [(2, True), (5, True)] and stage.settle() == []
    # what comes after all is settled by then, and counts for what follows
    assert stage.arrive(1, False, True, False, False) == [(1, True)]
    assert stage.arrive(3, False, False, False, False) == [(3, False)] and stage.upto == 5
    assert stage.arrive(6, False, False, False, False) == [(6, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_staged_search_as_a_stream(spark, tmp_path, seed):
    at, rng = f"file://{tmp_path}", random.Random(seed)
    rows = []
    for book in range(12):
        for provider in ("x", "y"):
            rows += [(book, provider, p, rng.random() < 0.5, rng.random() < 0.1, rng.random() < 0.1, rng.random() < 0.3) for p in range(1, rng.randint(2, 9))]
    schema = "book int, provider string, pos int, fallback boolean, failed boolean, exact boolean, strong boolean"
    want = {(r.book, r.provider, r.pos) for r in match.staged_stop(spark.createDataFrame(rows, schema), ["book", "provider"]).collect()}
    rng.shuffle(rows)
    said = []
    for k in range(3):  # in any order, over three runs
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        state.drain(state.staged_decisions(stream, ["book", "provider"], F.timestamp_seconds(F.lit(1_700_000_000))), f"{at}/out", f"{at}/checkpoint")
        said.append(spark.read.parquet(f"{at}/out").count())
    got = spark.read.parquet(f"{at}/out").collect()
    assert len(got) == len({(r.book, r.provider, r.pos) for r in got}) == len(rows)
    assert {(r.book, r.provider, r.pos) for r in got if r.do} == want
    assert 0 < said[0] < said[1] < said[2]


def test_waiting_lookups_are_settled_by_a_timer(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "book int, pos int, fallback boolean, failed boolean, exact boolean, strong boolean, second long"
    day = 1_700_000_000
    # position 1 of book 1 is late: other books move the watermark beyond an hour, and it comes after that, in time for its own row
    batches = [[(1, 2, False, False, False, True, day)], [(2, 1, False, False, False, False, day + 9000)], [(2, 2, False, False, False, False, day + 9000)], [(1, 1, False, True, False, False, day + 9000), (1, 3, False, False, False, False, day + 9000)]]
    said = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        state.drain(state.staged_decisions(stream, ["book"], F.timestamp_seconds("second"), "10 minutes"), f"{at}/out", f"{at}/checkpoint")
        said.append({(r.pos, r.do) for r in spark.read.schema("book int, pos int, do boolean").parquet(f"{at}/out").where("book = 1").collect()})
    assert said[0] == set() and (2, True) in said[-2]
    assert said[-1] == {(1, True), (2, True), (3, False)}
