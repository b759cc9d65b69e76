import functools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import packing, registry, sharding, tokenfiles, topk
from bindery.llm.simple8b import BLOCK, Reader, decode, encode, pack_file
from bindery.llm.tokens import encoder, vocabulary_path

DOCS = "doc_id long, text string, lang string, slot string, size long"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def brute_ids(text):
    found = tokenizer().encode(text or "", add_special_tokens=False).ids
    return np.array([*found, 2], "<u4")


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [
        (5, "Plain words, plain words.", "en", "x", 1),
        (None, "no id", None, None, None),
        (5, "Plain words, plain words.", "en", "x", 1),
        (7, None, "de", "y", 2),
        (8, "", "de", "y", 2),
        (9, "中文 и кириллица \x1c\x85 é", None, "z", 3),
        (-3, "long " * 6000, "en", "z", 3),
        (5, "another text of the same id", "en", "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_pieces_equal_the_tokenizer(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", "'s 'tis I'll\n\n  x\t y  ", "a" * 500 + " b", "<|endoftext|> 中 é½²", "  lead", "trail  "]
    flat, n = encoder(vocabulary_path()).batch(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(n)[:-1]), strict=True):
        if "<|" not in text:
            assert ids.tolist() == brute_ids(text).tolist()


@pytest.mark.parametrize("letters", ["ab cd  \n\t\r'sA.1é ñ¿½ªº\x00\x1c\x85  中<|×÷", "ab  \n\t's trelvdm.1éñ", "a' lsved!r1 \n"])
def test_random_texts_equal_the_tokenizer(letters):
    import random

    draw = random.Random(5)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(3000)] + [None, "", "x" * 100, "é" * 40]
    flat, n = encoder(vocabulary_path()).batch(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(n)[:-1]), strict=True):
        assert ids.tolist() == brute_ids(text).tolist()


def test_table_of_pieces_is_thinned(monkeypatch, sf_dir):
    import duckdb

    from bindery.llm import tokens

    monkeypatch.setattr(tokens, "TABLE_SIZE", 500)
    monkeypatch.setattr(tokens, "AT_ONCE", 20_000)
    few = tokens.Encoder(vocabulary_path())
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()]
    for at in range(0, len(texts), 20):
        flat, _ = few.batch(texts[at : at + 20])
        assert flat.tolist() == np.concatenate([brute_ids(t) for t in texts[at : at + 20]]).tolist()


@pytest.mark.parametrize("kind", ["small", "ids", "wide", "mixed", "empty", "zeros"])
def test_simple8b_round_trip(kind):
    rng = np.random.default_rng(7)
    ids = {"small": rng.integers(0, 3, 5000), "ids": rng.integers(0, 50257, 9001), "wide": rng.integers(0, 2**59, 300), "mixed": np.where(rng.random(9999) < 0.01, 2**45, rng.integers(0, 300, 9999)), "empty": np.zeros(0, int), "zeros": np.zeros(130, int)}[kind]
    assert (decode(encode(ids), len(ids)) == ids).all()


def test_file_reads_blocks_alone():
    ids = np.random.default_rng(3).integers(0, 50257, 3 * BLOCK + 17).astype(np.uint32)
    reader = Reader(pack_file([4, None, 9], np.array([10, 0, len(ids) - 10]), ids))
    assert (reader.ids(BLOCK - 5, BLOCK + 5) == ids[BLOCK - 5 : BLOCK + 5]).all()
    got = list(reader.documents())
    assert [d for d, _ in got] == [4, None, 9]
    assert (np.concatenate([x for _, x in got]) == ids).all()
    with pytest.raises(ValueError):
        Reader(b"x" * 200)


def test_token_files_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start, want = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = brute_ids(r.text)
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    got = registry.op3_simple8b(spark, sf_dir).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_token_files_of_odd_rows(spark, odd_docs):
    got = sorted(tokenfiles.round_trip(odd_docs, segment_ids=50, some=2).collect(), key=lambda r: r.start)
    assert len(got) == 8 and got[0].doc_id is None and got[0].start == 0
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got[1:]] == ends[:-1]
    assert [r.n_tokens for r in got if r.doc_id in (7, 8)] == [1, 1]
    assert tokenfiles.round_trip(odd_docs.limit(0)).count() == 0


def test_packing_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = registry.op7_best_fit(spark, sf_dir).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in docs.collect():
        ids, parts = brute_ids(r.text), sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        at = 0
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length])
            assert p.length == 1024 or p.piece == 0
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert len(by_sequence) == best_fit_decreasing([r.length for r in got], 1024)


def best_fit_decreasing(lengths, most):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(most - n)
    return len(gaps)


def test_sweeps_equal_best_fit_decreasing():
    rng = np.random.default_rng(11)
    for turn in range(60):
        most = int(rng.integers(5, 60))
        lengths = np.sort(rng.integers(1, most + 1, int(rng.integers(1, 300))))[::-1]
        filled: list[int] = []  # tokens of each sequence
        rank = 0
        for low, high in packing.bands(most, 1 + turn % 6):
            order = sorted((k for k, n in enumerate(filled) if n < most), key=lambda k: most - filled[k])
            sizes = dict(zip(*(x.tolist() for x in np.unique([most - filled[k] for k in order], return_counts=True)), strict=True)) if order else {}
            own = lengths[(lengths >= low) & (lengths <= high)]
            sweeps = packing.Sweeps(most, rank, {int(n): c for n, c in sizes.items()})
            for n in np.unique(own)[::-1].tolist():
                sweeps.place(n, int((own == n).sum()))
            order += range(len(filled), len(filled) + sweeps.opened)
            filled += [0] * sweeps.opened
            first, number, offset = map(np.array, (sweeps.first, sweeps.number, sweeps.offset))
            ranks = np.arange(rank, rank + len(own))
            at = np.searchsorted(first, ranks, "right") - 1 if len(own) else ranks
            taken = sorted(zip(offset[at], number[at] + ranks - first[at], own, strict=True)) if len(own) else []
            for o, k, n in taken:  # by rising offset: each piece begins where its sequence ends
                assert filled[order[k]] == o
                filled[order[k]] += n
            rank += len(own)
            assert rank == sweeps.rank
        assert rank == len(lengths) and max(filled) <= most and min(filled) > 0
        assert len(filled) == best_fit_decreasing(lengths.tolist(), most)


def test_packing_of_short_sequences_in_rounds(spark, sf_dir):
    """Many pieces a sequence, over several rounds of gaps: no hole, no overlap, as few sequences as best-fit decreasing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = docs.withColumn("text", F.left("text", F.col("doc_id") % 90 + 1))
    for most, rounds in ((48, 6), (48, 1), (7, 4)):
        got = packing.pack(short, most=most, rounds=rounds).collect()
        by_sequence = defaultdict(list)
        for r in got:
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= most
        assert len(by_sequence) == best_fit_decreasing([r.length for r in got], most)
        assert len({(r.doc_id, r.piece) for r in got}) == len(got)


def test_packing_of_odd_rows(spark, odd_docs):
    placed = packing.pack(odd_docs)
    got = placed.collect()
    assert sum(r.piece == 0 for r in got) == 8
    whole = {r.sequence_id: r.ids for r in packing.assemble(odd_docs, placed).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in got)
    for r in got:
        ids = np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(ids) == r.ids_crc32
    assert packing.pack(odd_docs.limit(0)).count() == 0


def test_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = registry.op4_virtual_slots(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"} and {r.map_version for r in got} == {1}
    totals, rows = defaultdict(lambda: [0, 0]), defaultdict(list)
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        totals[r.virtual_slot][0] += 1
        totals[r.virtual_slot][1] += r.size
        rows[r.virtual_slot].append(r)
    # every row against a map made and edited in plain Python
    flat = [{"virtual_slot": v, "rows": n, "bytes": b} for v, (n, b) in totals.items()]
    placed = sharding.balanced_map({v: v % 40 for v in totals}, flat, 40)
    at = defaultdict(int)
    for v in sorted(rows):
        for r in sorted(rows[v], key=lambda r: (r.doc_id, r.text_crc32, r.size)):
            assert (r.shard, r.slot) == (placed[v], at[placed[v]])
            at[placed[v]] += 1
    # the law: no shard exceeds the mean by more than the smallest exchange there is, or the one document that fills it
    held = defaultdict(int)
    for r in got:
        held[r.shard] += r.size
    mean = sum(held.values()) / 40
    assert set(held) == set(range(40)) and max(held.values()) <= max(1.02 * mean, max(r.size for r in got))


def test_sharding_sizes_and_growth():
    rng = np.random.default_rng(5)
    totals = [{"virtual_slot": k, "rows": 3, "bytes": int(b)} for k, b in enumerate(rng.integers(1000, 90000, 8192))]
    first = sharding.first_map(totals, 40)
    placed = sharding.balanced_map(first, totals, 40)
    held = np.bincount([placed[r["virtual_slot"]] for r in totals], [r["bytes"] for r in totals])
    assert held.max() / held.mean() < 1.0001 and sum(placed[s] != first[s] for s in placed) < 1000
    grown = sharding.grow_map(placed, totals, 40)
    assert all(grown[s] in (placed[s], 40) for s in placed)
    held = np.bincount([grown[r["virtual_slot"]] for r in totals], [r["bytes"] for r in totals])
    assert held[40] / held.mean() > 0.99
    fewer = sharding.balanced_map(grown, totals, 39)
    held = np.bincount([fewer[r["virtual_slot"]] for r in totals], [r["bytes"] for r in totals])
    assert len(held) == 39 and held.max() / held.mean() < 1.0001


def test_stored_map_is_edited_version_by_version(spark, tmp_path):
    rng = np.random.default_rng(6)
    totals = [{"virtual_slot": k, "rows": 2, "bytes": int(b)} for k, b in enumerate(rng.integers(100, 9000, 512))]
    path = f"file://{tmp_path}/map"
    sharding.store_map(spark, path, sharding.first_map(totals, 8), totals, 0)
    for n, n_shards in ((1, 8), (2, 10), (3, 9)):
        table, version = sharding.rebalance(spark, path, n_shards)
        assert version == n == sharding.last_version(spark, path)
        now = {r.virtual_slot: r.shard for r in table.collect()}
        before = {r.virtual_slot: r.shard for r in sharding.read_map(spark, path, n - 1).collect()}
        assert len(now) == 512 and set(now.values()) == set(range(n_shards))
        if n == 2:  # new shards take slots, the others only give
            assert all(now[s] == before[s] or now[s] >= 8 for s in now)
        held = np.bincount([now[r["virtual_slot"]] for r in totals], [r["bytes"] for r in totals])
        assert held.max() / held.mean() < 1.03
        starts = {r.virtual_slot: r.slot_start for r in table.collect()}
        for k in range(n_shards):
            own = sorted(s for s in now if now[s] == k)
            assert [starts[s] for s in own] == [2 * i for i in range(len(own))]


def test_repeated_rows_fill_no_shard(spark):
    rows = [(None, "one and the same text")] * 900 + [(k, f"text {k}") for k in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, 256).collect()
    held = defaultdict(int)
    for r in got:
        held[r.shard] += r.size
    assert len(got) == 1500 and max(held.values()) < 1.02 * sum(held.values()) / 8
    for k in held:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_sharding_of_odd_rows(spark, odd_docs):
    got = sharding.shard_documents(odd_docs).collect()
    assert len(got) == 8 and sum(r.size for r in got if r.doc_id in (7, 8)) == 32
    assert sharding.shard_documents(odd_docs.limit(0)).count() == 0


def test_written_shards_hold_every_row(spark, odd_docs, tmp_path):
    clash = odd_docs.withColumnRenamed("slot", "shard")
    sharding.write_shards(clash, f"file://{tmp_path}/out", n_shards=3)
    written = spark.read.parquet(f"file://{tmp_path}/out/shards")
    assert written.count() == 8 and set(written.columns) == {"doc_id", "text", "lang", "document_shard", "size", "shard"}


def test_topk_of_odd_rows(spark):
    inf = float("inf")
    rows = [(0, [1.0, 2.0], "a"), (100, [1.0, 0.5], "b"), (3, None, "c"), (4, [1.0, None], "c"), (5, [inf, 1.0], "c"), (6, [1.0, 2.0], "c"), (2, [1.0, 2.0], "c"), (None, [1.0, 2.0], "c"), (7, [1.0], "d"), (200, None, "e"), (8, [], "f")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.top_k(table, table.where("vec_id % 100 = 0"), k=2).collect()
    one = 5 * 1024 * 1024
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 2, one), (0, 2, 6, one), (100, 1, 0, 2 * 1024 * 1024), (100, 2, 2, 2 * 1024 * 1024)]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_topk_with_outliers(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(60)] + [(60, [1e30, 1.0, 0.0, 0.0]), (61, [3e8, -2e8, 1e9, 5.0]), (62, [-1e300, 0.0, 0.0, 1e-300])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, table.where("vec_id % 20 = 0"), k=5).collect()
    whole = {k: [int(np.floor(1024 * x)) for x in v] for k, v in rows}
    for q in (0, 20, 40, 60):
        score = {k: max(-(2**63) + 2, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))) for k, v in whole.items() if k != q}
        want = sorted((-s, k) for k, s in score.items())[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_topk_of_repeated_queries_and_other_columns(spark):
    rows = [(0, [1.0], 5), (0, [1.0], 6), (0, [2.0], 7), (1, [3.0], 8), (1, [3.0], 8), (2, [1.0], 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = topk.top_k(table, table.where("vec_id = 0"), k=3).collect()
    top = 3 * 1024 * 1024
    # the two vectors of the query's id share its list
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 2 * top), (2, 1, 2 * top), (3, 1, top)]


def test_topk_in_blocks_and_tiles(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = table.where("vec_id % 20 = 0")
    monkeypatch.setattr(topk, "FAN_IN", 2)
    monkeypatch.setattr(topk, "TILE_SCORES", 100)
    got = topk.top_k(table.repartition(7), queries, query_block=6, shard=90).collect()
    rows = {r.vec_id: np.floor(1024 * np.array(r.embedding, np.float32).astype(float)) for r in table.collect()}
    for q in (0, 20, 480):
        want = sorted(((-int(rows[q] @ x), v) for v, x in rows.items() if v != q))[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_written_tables_can_be_removed(spark, odd_docs):
    from bindery.llm import scratch

    own = scratch.Scratch(spark, "kept")
    assert own.save(odd_docs, "t").count() == 8
    scratch.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(own.at("t")).count()
