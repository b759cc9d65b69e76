"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every text's set of five-word shingles gets ``TREES`` sequences of ``DEPTH`` minimum hashes. A tree is the trie of its sequences, sorted over the
cluster by whole sequences: texts under one node stand next to each other and share a prefix of their sequences. A text is matched in each
tree by a prefix of its own length, and that length adapts to the data. In each tree it begins at the shallowest node, down from
``LEAST`` hashes, that holds at most ``CROWD`` texts, or at ``DEPTH`` where none does: long where texts crowd, short where they are few. From the lengths that
a text has in all its trees follows the chance that a partner of the least similarity it can be linked with shares one of its prefixes; where
that is below the target recall, its longest prefixes are shortened, one hash after another, until it is reached. The least similarity follows from
the size of its set and the threshold (a set of six can be linked at 5/6 or more). A pair matches in a tree if its common prefix reaches the
length of either text, so each text finds its partners with its own recall. Matched pairs whose set sizes allow the threshold are
compared by their whole shingle sets. A pair that matches in several trees is taken in the first of them alone. Sets too small to be linked with any but
equal ones stay out of the forest.

Texts with equal shingle sets are one class with a multiplicity, so copies are never paired row by row. Subtrees under ``LEAST`` hashes are
dealt into tiles bounded by members and by bytes of text (see ``links``). What travels is texts, not pairs: a tile first finds which of its texts match any, the
texts are fetched for those, and the tile matches them again and verifies; pairs are never written.

Words: A-Z lower-cased, then runs of ASCII letters and digits and of any character beyond ASCII; a text of fewer than
five words has one shingle, all of them. Defined cases: a null text, or one without words, links with nothing; null
and repeated ``doc_id`` are rows of their own (of equal rows one is kept); a class's id is the smallest doc_id in
its component, null if all are null, and of the rows with that id the first is kept; a text of any length is compared whole; an
empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.links import TILE, by_tile, components, map_runs, roots, tiles
from bindery.llm.scratch import Scratch
from bindery.llm.words import hashed, mixed, released, runs, slices

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.9995
SEED = 42
#: Columns added to the documents' own.
OWN = "_d1 long, _d2 long, _n int, _bytes long, _sequences binary"
#: Hashes of the shortest prefix, which a sequence holds as one number of 4 bytes; each further hash is one byte, as a collision only costs a comparison.
LEAST = 3
#: Texts of a node that may all be compared, and rows of a tree that a task sorts.
CROWD, SORTED_ROWS = 256, 200_000
#: Bytes of text on one side of a tile, and of the sets compared at once.
TILE_BYTES = 8_000_000


def recall_of(similarity: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The chance that a pair of this similarity shares a prefix of the given length in some of the trees; lengths: (texts, trees)."""
    return 1 - np.prod(1 - similarity[:, None] ** lengths, axis=1)


def shortened(similarity: np.ndarray, lengths: np.ndarray, least: int = LEAST, recall: float = RECALL) -> np.ndarray:
    """The lengths, of which the longest are cut by one until the target recall is reached or all are ``least``."""
    out = lengths.copy()
    while (unmet := np.flatnonzero((recall_of(similarity, out) < recall) & (out.max(axis=1) > least))).size:
        out[unmet] = np.minimum(out[unmet], out[unmet].max(axis=1, keepdims=True) - 1)
    return out


def least_similarity(n: int, threshold: float = THRESHOLD) -> float:
    """The least Jaccard similarity at or above the threshold that a set of n can have with another set; 1 if there is none."""
    sizes = range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1)
    # the fewest common members that reach the threshold, for each size of the other set
    found = ((k, n + m - k) for m in sizes if m for k in [math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)] if k <= min(n, m) and 2 * k < n + m)
    return min((k / whole for k, whole in found), default=1.0)


def least_similarities(most: int = 400, threshold: float = THRESHOLD) -> np.ndarray:
    """The least similarity of sets of 0, 1, ... members; the threshold for all larger ones."""
    return np.array([1.0, *(least_similarity(n, threshold) for n in range(1, most)), threshold])


def shingles(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text."""
    found, counts = hashed(texts)
    ends = np.cumsum(counts)
    return [np.unique(runs(found[e - c : e], n)) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


class Forest:
    """Minimum-hash sequences of a set: for each tree the hash of its least prefix (4 bytes), then for each tree a byte for every further hash."""

    def __init__(self, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees, self.threshold, self.depth, self.recall = trees, threshold, depth, recall
        self.least = min(LEAST, depth)
        self.further = depth - self.least
        self.similarity = least_similarities(threshold=threshold)
        self.factor = rng.integers(0, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def sequences(self, found: np.ndarray) -> bytes:
        low = np.full(len(self.factor), np.uint64(2**64 - 1))
        for at in range(0, len(found), 2048):
            np.minimum(low, (found[at : at + 2048, None] * self.factor + self.add).min(axis=0), out=low)
        levels = low.reshape(self.trees, self.depth)
        top = mixed(np.arange(self.trees).astype(np.uint64))
        for k in range(self.least):
            top = mixed(top * np.uint64(31) + mixed(levels[:, k]))
        rest = mixed(levels[:, self.least :]) >> np.uint64(56)
        return (top >> np.uint64(32)).astype(">u4").tobytes() + rest.astype(np.uint8).tobytes()

    def least_of(self, n: np.ndarray) -> np.ndarray:
        """The least similarity of sets of n members."""
        return self.similarity[np.minimum(n, len(self.similarity) - 1)]


def _lengths(forest: Forest, crowd: int):
    """Of rows (tree, prefix, rest, uid) in their order: the length of the prefix that a text begins with, where that is not the least.

    A node that goes on in the next task counts as its part here, and so may be taken for a smaller one: a shorter prefix, and more comparisons.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        tree, prefix, rest, uid = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(4))
        new = np.r_[True, (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])]
        length = np.full(len(uid), forest.depth, np.int8)
        crowded = np.ones(len(uid), bool)
        for d in range(forest.least, forest.depth):
            begin = new.copy()
            begin[1:] |= (rest[1:] >> 8 * (forest.depth - d)) != (rest[:-1] >> 8 * (forest.depth - d))
            starts = np.flatnonzero(begin)
            size = np.diff(starts, append=len(uid))
            few = np.repeat(size <= crowd, size) & crowded
            length[few], crowded[few] = d, False
        deep = length > forest.least
        yield pa.RecordBatch.from_arrays([pa.array(uid[deep]), pa.array(tree[deep]), pa.array(length[deep].astype(np.int32))], names=["uid", "tree", "length"])

    return run


def _adapted(forest: Forest):
    """Of (uid, n, begun: lengths of some trees): the lengths that reach the target recall, as one byte for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.full((batch.num_rows, forest.trees), forest.least, np.int64)
            begun = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(begun.value_lengths()))
            flat = begun.flatten()
            lengths[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
            found = shortened(forest.least_of(batch.column(1).to_numpy()), lengths, forest.least, forest.recall).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in found], pa.binary())], names=["uid", "lengths"])

    return run


def _prepare(at_text: int, n_words: int, forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, at_text):
                d1, d2, n, sequences = [], [], [], []
                for found in shingles(some.column(at_text).to_pylist(), n_words):
                    n.append(len(found))
                    if not len(found):
                        d1.append(None), d2.append(None), sequences.append(None)
                        continue
                    # the sums of two scramblings of a set stand for the set
                    d1.append(int(mixed(found + np.uint64(1)).sum().view(np.int64)))
                    d2.append(int(mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)))
                    sequences.append(forest.sequences(found))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int32()), pc.cast(pc.binary_length(some.column(at_text)), pa.int64()), pa.array(sequences, pa.binary())], names=[*some.schema.names, "_d1", "_d2", "_n", "_bytes", "_sequences"])

    return run


class Tries:
    """The members of tiles that stand one after another in a batch, with their sequences and the lengths of their prefixes.

    Columns: tree, prefix, tile_i, tile_j, side, uid, n, sequences.
    """

    def __init__(self, forest: Forest, batch: pa.RecordBatch):
        self.tree = batch.column(0).to_numpy()
        self.own_tile = batch.column(2).to_numpy() == batch.column(3).to_numpy()
        self.side, self.n = batch.column(4).to_numpy(), batch.column(6).to_numpy().astype(float)
        raw = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        trees, further = forest.trees, forest.further
        self.top = raw[:, : 4 * trees].copy().view(np.uint32)
        self.rest = np.zeros((batch.num_rows, trees), np.int64)
        for k in range(further):
            self.rest |= raw[:, 4 * trees : (4 + further) * trees].reshape(-1, trees, further)[:, :, k].astype(np.int64) << 8 * (further - 1 - k)
        # two sequences with one least prefix have a common prefix of a length if they differ below this only
        self.below = np.int64(1) << 8 * (forest.depth - raw[:, (4 + further) * trees :].astype(np.int64))
        self.threshold = forest.threshold

    def pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tile, member, member) of the pairs of which the tile's tree is the first where they match; rows: (tiles, members) of
        tiles of one size and tree."""
        t, some = int(self.tree[rows[0, 0]]), self.n[rows]
        fit = np.minimum(some[:, :, None], some[:, None, :]) >= self.threshold * np.maximum(some[:, :, None], some[:, None, :]) - 1e-9
        fit &= np.triu(np.ones(fit.shape[1:], bool), 1)
        fit &= self.own_tile[rows[:, 0]][:, None, None] | (self.side[rows][:, :, None] != self.side[rows][:, None, :])
        for k in [t, *range(t)]:
            top, rest, below = self.top[rows, k], self.rest[rows, k], self.below[rows, k]
            # the shorter of the two lengths is enough
            match = (top[:, :, None] == top[:, None, :]) & ((rest[:, :, None] ^ rest[:, None, :]) < np.maximum(below[:, :, None], below[:, None, :]))
            fit &= match if k == t else ~match
        return np.nonzero(fit)


def _matching(forest: Forest):
    """The rows of each tile that match any other there."""

    def work(batch: pa.RecordBatch, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        tries, used = Tries(forest, batch), np.zeros(batch.num_rows, bool)
        size, starts = np.diff(edges), edges[:-1]
        for m in np.unique(size).tolist():
            same = starts[size == m]
            for t in np.unique(tries.tree[same]) if m > 1 else ():
                own = same[tries.tree[same] == t]
                step = max(1, 200_000 // (m * m))  # tiles at once
                for at in range(0, len(own), step):
                    rows = own[at : at + step][:, None] + np.arange(m)
                    of, a, b = tries.pairs(rows)
                    used[rows[of, a]] = used[rows[of, b]] = True
        if used.any():
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(used)) for k in range(6)], names=batch.schema.names[:6])

    return work


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a[k] and b[k]."""
    if len(a) <= 2 * len(sets) or len(sets) < 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    # many pairs of few sets: products of the membership matrix, some shingles at a time; a shingle of one set adds nothing
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s = slice(*np.searchsorted(column, [at, at + width]))
        part = np.zeros((len(sets), width), np.float32)
        part[row[s], column[s] - at] = 1
        out += part @ part.T
    return out[a, b].astype(np.int64)


def _similar(texts: pa.Array, a: np.ndarray, b: np.ndarray, threshold: float, n_words: int) -> np.ndarray:
    """Which of the pairs a[k], b[k] of texts reach the threshold, by their whole sets; those of some bytes of text are held at once."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // TILE_BYTES
    fine = np.zeros(len(a), bool)
    for p, q in np.unique(np.stack([np.minimum(part[a], part[b]), np.maximum(part[a], part[b])]), axis=1).T.tolist():
        own = np.flatnonzero((np.minimum(part[a], part[b]) == p) & (np.maximum(part[a], part[b]) == q))
        used, place = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
        sets = [x for at in range(0, len(used), 256) for x in shingles(texts.take(pa.array(used[at : at + 256])).to_pylist(), n_words)]
        n = np.array([len(x) for x in sets])
        x, y = place[: len(own)], place[len(own) :]
        both = shared(sets, x, y)
        fine[own] = both >= threshold * (n[x] + n[y] - both) - 1e-9
    return fine


def _verify(forest: Forest, n_words: int):
    """Links of each tile: for every text its linked multiplicity and the least text of the tile that it is joined to."""

    def work(batch: pa.RecordBatch, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        tries = Tries(forest, batch)
        uid, many, texts = batch.column(5).to_numpy(), batch.column(8).to_numpy(), batch.column(9)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            _, a, b = tries.pairs(np.arange(s, e)[None, :])
            if not len(a):
                continue
            fine = _similar(texts.slice(s, e - s), a, b, forest.threshold, n_words)
            a, b = a[fine], b[fine]
            if not len(a):
                continue
            own = uid[s:e]
            order = np.argsort(own)
            place = np.argsort(order)
            ends = np.concatenate([a, b])
            linked = np.bincount(ends, np.concatenate([many[s + b], many[s + a]]), e - s).astype(np.int64)
            used = np.unique(ends)
            root = order[roots(e - s, place[a], place[b])[place]]
            yield pa.RecordBatch.from_arrays([pa.array(own[used]), pa.array(linked[used]), pa.array(own[root[used]])], names=["uid", "linked", "root"])

    return work


def prefix_lengths(reps: DataFrame, forest: Forest, crowd: int = CROWD) -> DataFrame:
    """uid, lengths (one byte for each tree) of the texts that crowd anywhere; all others begin and stay at the least length.

    reps: uid, n, sequences. Each tree is sorted by whole sequences, with a row's number last so that equal ones spread over tasks too.
    """
    trees, further = forest.trees, forest.further
    rows = reps.select("uid", "sequences", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    number = lambda at, n: F.conv(F.hex(F.expr(f"substring(sequences, {at}, {n})")), 16, 10).cast("long")
    rest = number(f"{4 * trees + 1} + tree * {further}", further) if further else F.lit(0).cast("long")
    rows = rows.select("tree", number("tree * 4 + 1", 4).alias("prefix"), rest.alias("rest"), "uid")
    key = ["tree", "prefix", "rest", "uid"]
    tasks = max(1, -(-reps.count() * trees // SORTED_ROWS))
    begun = rows.repartitionByRange(tasks, *key).sortWithinPartitions(*key).mapInArrow(released(_lengths(forest, crowd)), "uid long, tree int, length int")
    begun = begun.groupBy("uid").agg(F.collect_list(F.struct("tree", "length")).alias("begun"))  # one for each tree at most
    return begun.join(reps.select("uid", "n"), "uid").select("uid", "n", "begun").mapInArrow(released(_adapted(forest)), "uid long, lengths binary")


def _joined(docs: DataFrame, threshold: float = THRESHOLD, n_words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """The documents with ``_uid``, a number of the row, and for every row: doc_id, _uid, n_links, class_id, kept."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    forest = Forest(threshold, trees, depth, recall)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    prepared = docs.mapInArrow(released(_prepare(docs.columns.index("text"), n_words, forest)), f"{kinds}, {OWN}")
    # written once, so that the numbers stay
    prepared = scratch.save(prepared.withColumn("_uid", F.monotonically_increasing_id()), "prepared", few=True)
    # one row a set: the least row of it, and its least document and that one's first row, null ids last
    of_row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").cast("long").alias("id"), F.col("_uid").alias("row"))
    reps = prepared.where("_n > 0").groupBy("_d1", "_d2").agg(
        F.min("_uid").alias("uid"), F.count(F.lit(1)).alias("many"), F.min(of_row).alias("best"), F.min("_n").alias("n"), F.min("_sequences").alias("sequences"), F.max("_bytes").alias("bytes"),
    )
    reps = scratch.save(reps, "reps", few=True)
    # sets so small that only equal ones can be linked need no forest
    smallest = int(np.argmax(forest.similarity < 1))
    wooded = reps.where(F.col("n") >= smallest)
    lengths = prefix_lengths(wooded.select("uid", "n", "sequences"), forest)
    short = F.lit(bytearray([forest.least] * trees))
    wooded = wooded.join(lengths, "uid", "left").select("uid", "n", "many", "bytes", F.concat("sequences", F.coalesce("lengths", short)).alias("sequences"))
    wooded = scratch.save(wooded, "wooded", few=True)
    node = ["tree", "prefix"]
    nodes = wooded.select("uid", "bytes", "sequences", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    nodes = nodes.select("tree", F.conv(F.hex(F.expr("substring(sequences, tree * 4 + 1, 4)")), 16, 10).cast("long").alias("prefix"), "uid", "bytes")
    key = [*node, *TILE, "side", "uid"]
    members = tiles(nodes, node, "uid", weight="bytes", most=TILE_BYTES).drop("bytes").join(wooded.select("uid", "n", "sequences"), "uid")
    matching = map_runs(by_tile(members.select(*key, "n", "sequences"), node), 4, _matching(forest), "tree int, prefix long, tile_i int, tile_j int, side int, uid long")
    # merged at every size: what matches grows with the input, so no plan may hang on its being little
    texts = prepared.select(F.col("_uid").alias("uid"), "text").hint("merge").join(matching, "uid").join(wooded.select("uid", "n", "sequences", "many"), "uid")
    texts = by_tile(texts.select(*key, "n", "sequences", "many", "text"), node)
    linked = scratch.save(map_runs(texts, 4, _verify(forest, n_words), "uid long, linked long, root long"), "linked", few=True)
    group = components(linked.select(F.col("uid").alias("a"), F.col("root").alias("b")), "jaccard-components")
    # a component's best is that of its sets; a set without links is its own
    least = group.join(reps.select(F.col("uid").alias("node"), "best"), "node").groupBy("component").agg(F.min("best").alias("of_component"))
    linked = group.join(least, "component").join(linked.groupBy(F.col("uid").alias("node")).agg(F.sum("linked").alias("linked")), "node", "left")
    found = reps.join(linked.withColumnRenamed("node", "uid"), "uid", "left").select(
        "_d1", "_d2", F.coalesce("of_component", "best").alias("best"), (F.col("many") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    rows = prepared.select(F.col("doc_id").cast("long").alias("doc_id"), "_uid", "_d1", "_d2").join(found, ["_d1", "_d2"], "left")
    alone = F.col("best").isNull()
    return prepared, rows.select(
        "doc_id", "_uid", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("class_id"), (alone | (F.col("best.row") == F.col("_uid"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_links, class_id, kept of every row; kept marks one row of every class."""
    return _joined(docs.select("doc_id", "text"), **options)[1].drop("_uid")


def keep(docs: DataFrame, **options) -> DataFrame:
    """One row of every class, with all its columns, whatever their names."""
    inner = docs.toDF(*(n if n in ("doc_id", "text") else f"column{k}" for k, n in enumerate(docs.columns)))
    prepared, rows = _joined(inner, **options)
    kept = prepared.hint("merge").join(rows.where("kept").select("_uid"), "_uid", "left_semi")
    return kept.select(*inner.columns).toDF(*docs.columns)


def oracle() -> str:
    """By brute force: shingle sets joined on their shingles."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents
),
s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')) END) AS g FROM d
),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE k >= {THRESHOLD} * (x.n + y.n - k) - 1e-9),
g(r, m) AS (SELECT r, r FROM d UNION SELECT l.b, g.m FROM g JOIN l ON l.a = g.r),
c AS (SELECT g.r AS r, min(e.doc_id) AS class_id FROM g JOIN d e ON e.r = g.m GROUP BY g.r),
q AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_links, class_id, doc_id = class_id AS kept
FROM d LEFT JOIN q USING (r) LEFT JOIN c USING (r)
"""
