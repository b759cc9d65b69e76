"""The similarity joins against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import jaccard, lattice, links
from bindery.llm.words import words


def components(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def check_links(rows, pairs, ids):
    """rows: (id, n_links, component, kept) in the order of ids."""
    label = components(len(ids), pairs)
    for k, (i, n, component, _) in enumerate(rows):
        assert i == ids[k]
        assert n == sum(k in p for p in pairs)
        own = [ids[j] for j in range(len(ids)) if label[j] == label[k] and ids[j] is not None]
        assert component == (min(own) if own else None)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) * 2
    point = lattice.decode(x)
    assert (((2 * point) % 1) == 0).all() and (point.sum(axis=1) % 2 == 0).all()
    # no lattice point one or two shortest vectors away is nearer
    roots = [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2] + [v for v in itertools.product((-0.5, 0.5), repeat=8) if sum(c < 0 for c in v) % 2 == 0]
    roots = np.array(roots, float)
    assert len(roots) == 240
    best = ((x[:, None, :] - point[:, None, :] - roots[None]) ** 2).sum(axis=2)
    assert (((x - point) ** 2).sum(axis=1) <= best.min(axis=1) + 1e-9).all()
    second = lattice.neighbour(x, point)
    assert np.allclose(((x - second) ** 2).sum(axis=1), best.min(axis=1))


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    for width in (64, 96, 10):
        u = rng.normal(size=(3000, width))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        v = 0.93 * u + np.sqrt(1 - 0.93**2) * w
        cells = lattice.Cells(width)
        a, b = cells.keys(u), cells.keys(v)
        met = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
        assert met.mean() > 0.99


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=64) for _ in range(60)]
    rows += [rows[0] + 0.02 * rng.normal(size=64) for _ in range(40)]
    rows += [rows[1] + 0.25 * rng.normal(size=64) for _ in range(40)]
    rows += [rows[2] * s for s in (1, 2, 5)] + [rows[3].copy() for _ in range(5)]
    return np.array(rows)


@pytest.mark.parametrize("chunk", [512, 8])
def test_near_duplicate_vectors(spark, vectors, chunk, monkeypatch):
    monkeypatch.setattr(links.tiles, "__defaults__", (chunk, links.SALTS, None, 0))
    rows = [(k, [float(c) for c in x], k % 2 if k < 60 else 0, "e") for k, x in enumerate(vectors)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = unit @ unit.T
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if rows[a][2] == rows[b][2] and score[a, b] >= 0.93]
    assert len(pairs) > 700
    check_links([(r.vec_id, r.n_links, r.component_id, r.kept) for _, r in sorted(got.items())], pairs, list(range(len(rows))))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (9, [], 1), (10, [1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e300, 1e280], 1), (13, [1.0, 0.0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(table).collect())
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (12, 3, 1, False)]
    assert [g for g in got if g[0] in (1, 2, 12)] == linked
    assert got[0] == (-1, 0, None, False)
    assert all(g[1:] == (0, g[0], True) for g in got if g[0] not in (-1, 1, 2, 12))
    assert lattice.near_duplicates(table.limit(0)).count() == 0


def brute_pairs(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]


def test_least_similarities_of_sets():
    forest = jaccard.Forest()
    for n in range(1, 60):
        possible = [k / (n + m - k) for m in range(1, 2 * n + 3) for k in range(1, min(n, m) + 1) if 2 * k < n + m and k / (n + m - k) >= 0.8 - 1e-9]
        assert abs(forest.least_of(np.array([n]))[0] - min(possible, default=1.0)) < 1e-9
    assert forest.least_of(np.array([3, 4, 10_000])).tolist() == [1.0, 0.8, 0.8]


def test_prefixes_are_shortened_until_the_recall_is_met():
    rng = np.random.default_rng(1)
    begun = rng.integers(jaccard.LEAST, jaccard.DEPTH + 1, (300, jaccard.TREES))
    least = rng.choice([0.8, 5 / 6, 0.9], 300)
    got = jaccard.shortened(least, begun)
    found = jaccard.recall_of(least, got)
    assert (found >= jaccard.RECALL).all() and (got <= begun).all() and (got >= jaccard.LEAST).all()
    for s, a, b in zip(least, begun, got, strict=True):
        # no more than is needed: with its cut prefixes one longer, the recall is not met
        if (b < a).any():
            longer = np.minimum(a, b.max() + 1)
            assert 1 - np.prod(1 - s**longer) < jaccard.RECALL
    assert len({tuple(sorted(r)) for r in got.tolist()}) > 50


def test_lengths_of_large_sets_differ_where_texts_crowd(spark):
    """A thousand near copies crowd in every tree and are met by longer prefixes than texts that stand alone; each meets the recall."""
    rng = np.random.default_rng(7)
    forest = jaccard.Forest()
    base = rng.integers(1, 2**62, 300).astype(np.uint64)
    rows = []
    for k in range(1000):
        near = base.copy()
        near[rng.choice(300, 3, replace=False)] = rng.integers(1, 2**62, 3).astype(np.uint64)
        rows.append((k, 300, bytearray(forest.sequences(np.unique(near)))))
    rows += [(2000 + k, 300, bytearray(forest.sequences(np.unique(rng.integers(1, 2**62, 300).astype(np.uint64))))) for k in range(500)]
    reps = spark.createDataFrame(rows, "uid long, n int, sequences binary").repartition(3)
    got = {r.uid: np.frombuffer(bytes(r.lengths), np.uint8) for r in jaccard.prefix_lengths(reps, forest, crowd=64).collect()}
    assert set(got) <= set(range(1000)) and len(got) > 900  # texts that stand alone stay at the least length
    lengths = np.array(list(got.values())).astype(int)
    assert (jaccard.recall_of(np.full(len(lengths), 0.8), lengths) >= jaccard.RECALL).all()
    assert len({tuple(sorted(x)) for x in lengths.tolist()}) > 1 and lengths.max() > jaccard.LEAST
    mean = {crowd: np.mean([np.frombuffer(bytes(r.lengths), np.uint8).mean() for r in jaccard.prefix_lengths(reps, forest, crowd=crowd).collect()] or [jaccard.LEAST]) for crowd in (64, 5000)}
    assert mean[64] > mean[5000] == jaccard.LEAST


def test_pairs_match_by_their_longest_common_prefix():
    forest = jaccard.Forest()
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(1, 2**62, n).astype(np.uint64)) for n in (6, 6, 7, 40)]
    sets += [np.unique(np.append(sets[0], np.uint64(5))), sets[3][1:], sets[3][2:]]
    m, trees, further = len(sets), forest.trees, forest.further
    lengths = rng.integers(jaccard.LEAST, jaccard.DEPTH + 1, (m, trees)).astype(np.uint8)
    raw = [forest.sequences(x) for x in sets]
    import pyarrow as pa

    def common(i, j, k):
        """Hashes that begin both sequences of a tree."""
        if raw[i][4 * k : 4 * k + 4] != raw[j][4 * k : 4 * k + 4]:
            return 0
        a, b = (raw[x][4 * trees + further * k : 4 * trees + further * (k + 1)] for x in (i, j))
        return forest.least + next((d for d in range(further) if a[d] != b[d]), further)

    seen = 0
    for t in range(trees):
        batch = pa.RecordBatch.from_pydict({"tree": [t] * m, "prefix": [0] * m, "tile_i": [0] * m, "tile_j": [0] * m, "side": [0] * m, "uid": list(range(m)), "n": [len(x) for x in sets], "sequences": [x + y.tobytes() for x, y in zip(raw, lengths, strict=True)]})
        _, a, b = jaccard.Tries(forest, batch).pairs(np.arange(m)[None, :])
        want = []
        for i, j in itertools.combinations(range(m), 2):
            first = next((k for k in range(trees) if common(i, j, k) >= min(lengths[i, k], lengths[j, k])), None)
            if first == t and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])):
                want.append((i, j))
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == want
        seen += len(want)
    assert seen >= 3


def test_tiles_are_bounded_by_bytes(spark, texts, monkeypatch):
    entries = spark.createDataFrame([(1, k, 100 if k else 5000) for k in range(40)], "bucket int, member long, bytes long")
    got = links.tiles(entries, ["bucket"], "member", weight="bytes", most=1000).collect()
    met, chunks = set(), {}
    for r in got:
        chunks.setdefault(r.side, set()).add(r.member)
        met.add((r.tile_i, r.tile_j))
    assert len(chunks) == 9 and len(met) == 45
    # verified in parts of few bytes, the result is the same
    monkeypatch.setattr(jaccard, "TILE_BYTES", 3000)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(jaccard.near_duplicates(docs).collect(), key=lambda r: r.doc_id)
    check_links([(r.doc_id, r.n_links, r.class_id, r.kept) for r in got], brute_pairs(texts), list(range(len(texts))))


def test_shingles_of_short_texts():
    a, b, c, d, e, f, g = jaccard.shingles(["a b c d e f", "a b", " ! ", None, "A b", "a  B.", "x " * 40])
    assert list(map(len, (a, b, c, d, g))) == [2, 1, 0, 0, 1] and (e == f).all()


def test_hashes_of_words_and_tokens():
    from bindery.llm.words import hashed, tokens

    texts = ["A b, b\tB!! \x00c", None, "", "éa É", "ab" * 64 + " " + "ba" * 64, "x" * 200 + " " + "x" * 136, "don't 'x'"]
    for split, signs in ((words, False), (tokens, True)):
        found, n = hashed(texts, signs)
        flat = [w for t in texts for w in split(t)]
        assert n.tolist() == [len(split(t)) for t in texts]
        of = dict(zip(flat, found.tolist(), strict=True))
        assert [of[w] for w in flat] == found.tolist() and len(set(of.values())) == len(of)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(12)]
    out = [" ".join(b) for b in base]
    for k in range(60):  # one large group of near copies
        w = list(base[0])
        w[int(rng.integers(0, 120))] = f"x{k}"
        out.append(" ".join(w))
    for k in range(12):  # at about the threshold
        w = list(base[1])
        for j in rng.choice(120, 1 + k % 4, replace=False):
            w[j] = f"y{k}{j}"
        out.append(" ".join(w))
    return out + [out[3]] * 7 + [out[3].upper() + " !!"] + ["short text", "Short, text", "", None, "..."]


@pytest.mark.parametrize("chunk", [512, 16])
def test_near_duplicate_texts(spark, texts, chunk, monkeypatch):
    monkeypatch.setattr(links.tiles, "__defaults__", (chunk, links.SALTS, None, 0))
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, n_links string")
    got = sorted(jaccard.near_duplicates(docs).collect(), key=lambda r: r.doc_id)
    pairs = brute_pairs(texts)
    assert len(pairs) > 1500
    check_links([(r.doc_id, r.n_links, r.class_id, r.kept) for r in got], pairs, list(range(len(texts))))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_odd_documents_and_kept_rows(spark):
    rows = [(None, "one two three four five six", "a"), (None, "one two three four five six", "b"), (4, "one two three four five six", "c"), (4, "one two three four five six", "c"), (5, None, None), (5, None, None), (None, "alone here", "d"), (6, "", "e"), (7, "long " * 30000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got = jaccard.near_duplicates(docs).collect()
    assert sorted(r.n_links for r in got) == [0, 0, 0, 0, 0, 3, 3, 3, 3]
    assert all(r.class_id == 4 for r in got if r.n_links)
    assert sum(r.kept for r in got) == 6
    kept = jaccard.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.other or "") for r in kept.collect()) == [(0, "d"), (4, "c"), (5, ""), (5, ""), (6, "e"), (7, "f")]
    assert jaccard.keep(docs.limit(0)).count() == 0 and jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_kept_rows_with_clashing_names(spark):
    names = ["_uid", "kept", "doc_id", "_d1", "text", "_n", "column0", "n_links"]
    docs = spark.createDataFrame([(1, 2, k, 4, "a b c d e f", 6, 7, 8) for k in (9, 3)], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    kept = jaccard.keep(docs)
    assert kept.columns == names and [tuple(r) for r in kept.collect()] == [(1, 2, 3, 4, "a b c d e f", 6, 7, 8)]


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 99), (100, 101), (5, 5)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99, 101: 99}
    assert links.components(spark.createDataFrame([(5, 5)], "a long, b long"), "test").count() == 0


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(9)
    for n, m in ((40, 25), (60, 60), (30, 90)):
        edges = rng.integers(0, n, (m, 2)).tolist()
        label = components(n, [(a, b) for a, b in edges])
        got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
        assert got == {k: label[k] for a, b in edges if a != b for k in (a, b)}


def test_intersections_by_matrix():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3000, 400).astype(np.uint64)) for _ in range(30)]
    a, b = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    assert jaccard.shared(sets, a, b).tolist() == want


def test_hot_bucket_becomes_tiles(spark):
    entries = spark.range(100).select(F.lit(7).alias("bucket"), F.col("id").alias("member")).unionByName(spark.range(1).select(F.lit(8).alias("bucket"), F.col("id").alias("member")))
    got = links.tiles(entries, ["bucket"], "member", chunk=10).collect()
    met = {}
    for r in got:
        met.setdefault((r.tile_i, r.tile_j), []).append(r)
    assert all(r.bucket == 7 for r in got) and max(map(len, met.values())) < 60
    pairs = set()
    for (i, j), rows in met.items():
        pairs |= {frozenset((x.member, y.member)) for x in rows for y in rows if x.member != y.member and (i == j or x.side != y.side)}
    assert len(pairs) == 100 * 99 // 2
