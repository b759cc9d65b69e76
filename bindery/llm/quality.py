"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

The target model counts hashed unigrams and bigrams of labelled good documents, the raw model those of every document of
the corpus. A bucket's ratio is that of the target's count to the count expected of the raw model, both raised by
``SHRINK`` so that thin buckets say little. A document's log importance weight is the sum of its n-grams' log ratios, each less
a level: raw text holds good text too, so ratios of good text are near 0, and the level is where labelled good and labelled bad
part best by the mean ratio. It is found with a target model of the other half of the labelled documents. The score is the mean
log ratio per n-gram, drawn towards 0 as by ``PRIOR`` n-grams of ratio 1. Weights plus seeded Gumbel noise are ranked, and
the k largest are kept: a sample without replacement in proportion to the importance weights. k is a parameter; if it is not
given, it is the number of documents whose weight is positive, those likelier as target text than as raw text.

The labelled sample is bounded: at most ``LABELLED`` labelled rows, those of the smallest seeded hashes of their ids.
Everything else, the raw counts, the scores, k and the k-th largest key, covers all rows.

Defined cases: a null text is empty; a document without n-grams has score 0, weight 0 and is not kept; null and
repeated ``doc_id`` are scored row by row (rows equal in id and text share their noise and their fate); labels with a
null id or a null quality are not used, and an id labelled both ways counts as bad; of a repeated id the least text is learned from; without labelled bad
documents the level is just below the lowest good mean, and without good ones there is no ground to reject: every score is 0 and
all are kept, whatever k; a text of any length is scored whole; ties at the k-th key are all kept. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch
from bindery.llm.words import hashed, mixed, released, segment_sums, slices

BUCKETS = 1 << 14
LABELLED = 20_000
SHRINK = 10.0
PRIOR = 20.0
SEED = 42
SCORED = "doc_id long, score double, log_weight double, gumbel double, key double"


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram of the texts, text by text, and how many each text has."""
    h, n = hashed(texts, signs=True)
    if not len(h):
        return np.zeros(0, np.int64), n
    mask = np.uint64(buckets - 1)
    one = (mixed(h) & mask).astype(np.int64)
    two = (mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + mixed(h[1:])) & mask).astype(np.int64)
    two[h[:-1] == h[1:]] = 0  # any token twice in a row is one and the same bigram: repeating is a trait of its own
    # a text's n unigrams and its n - 1 bigrams stand together: unigram, bigram, unigram, ...
    both = np.zeros(2 * len(h), np.int64)
    both[0::2], both[1:-1:2] = one, two
    keep = np.ones(2 * len(h), bool)
    ends = np.cumsum(n)[n > 0]
    keep[2 * ends - 1] = False
    return both[keep], np.maximum(2 * n - 1, 0)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in slices(batch, 0):
                total += np.bincount(features(some.column(0).to_pylist(), buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    return run


def counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed n-gram counts of all the texts; each task adds its own up first, one row a bucket comes to the driver."""
    found = docs.select("text").mapInArrow(released(_count(buckets)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.float64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, shrink: float = SHRINK) -> np.ndarray:
    """Log probability ratio per bucket, drawn towards 0 where the raw model expects few counts."""
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + shrink) / (expected + shrink))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """text, half, good and toxic of at most ``bound`` labelled rows; the bounded side is broadcast to the documents."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.agg((F.min("quality") > 0).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    few = rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # one text for an id, however many rows hold it, so that the sample is bounded
    found = found.groupBy("doc_id", "good", "toxic").agg(F.min("text").alias("text"))
    return found.select("text", (F.pmod(F.xxhash64("text"), F.lit(2)) == 1).alias("half"), "good", "toxic")


def gumbel(ids: list[int | None], texts: list[str | None], seed: int = SEED) -> np.ndarray:
    """Noise that a row's id, text and the seed decide."""
    h = [xxhash.xxh3_64_intdigest(f"{i}\0".encode() + (t or "").encode(), seed) for i, t in zip(ids, texts, strict=True)]
    u = (np.array(h, np.float64) + 0.5) / 2.0**64
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


class Model:
    """log ratio per bucket, and the score level that parts good from bad."""

    def __init__(self, ratio: np.ndarray, level: float = 0.0):
        self.ratio, self.level = ratio, level

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the log ratios of each text, and its number of n-grams."""
        bucket, n = features(texts, len(self.ratio))
        return segment_sums(self.ratio[bucket], n), n

    def keys(self, ids: list, texts: list) -> tuple[np.ndarray, ...]:
        total, n = self.sums(texts)
        weight = total - self.level * n
        noise = gumbel(ids, texts)
        return total / (n + PRIOR), weight, noise, np.where(n > 0, weight + noise, -np.inf)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                got = model.keys(some.column(0).to_pylist(), some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, got)], names=["doc_id", "score", "log_weight", "gumbel", "key"])

    return run


def _labelled_scores(models: dict[bool, Model]):
    """Scores of labelled texts, each by the model of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (s for batch in batches for s in slices(batch, 0)):
            for half, model in models.items():
                own = some.filter(pc.equal(some.column(1), half))
                total, n = model.sums(own.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array((total / (n + PRIOR))[n > 0]), own.column(2).filter(pa.array(n > 0))], names=["score", "good"])

    return run


def best_level(score: np.ndarray, good: np.ndarray) -> float:
    """The middle of the widest gap among the levels with the best balanced accuracy."""
    if not len(score) or not good.any():
        return 0.0
    if good.all():
        return float(score.min() - 0.1 * (score.max() - score.min()) - 1e-9)
    order = np.argsort(score, kind="stable")
    score, good = score[order], good[order]
    low = np.cumsum(~good) / (~good).sum()  # bad ones at or below
    high = 1 - np.cumsum(good) / good.sum()  # good ones above
    gap = np.diff(score, append=score[-1])
    value = np.where(gap > 0, low + high, -1)
    if value.max() < 0:
        return 0.0
    near = value >= value.max() - 0.002
    at = int(np.argmax(np.where(near, gap, -1)))
    return float(score[at] + gap[at] / 2)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, bound: int = LABELLED) -> Model:
    scratch = Scratch(docs.sparkSession, "quality")
    raw = counts(docs, buckets)
    # a bounded number of rows needs few files
    sample = scratch.save(labelled_sample(docs, labels, bound).coalesce(16), "labelled")
    half = {h: counts(sample.where(f"good and toxic = 0 and {'' if h else 'not'} half"), buckets) for h in (False, True)}
    if not half[False].sum() or not half[True].sum():
        half = dict.fromkeys(half, half[False] + half[True])
    target = half[False] if half[False] is half[True] else half[False] + half[True]
    if not target.sum():
        return Model(np.zeros(buckets))
    model = Model(log_ratio(target, raw))
    others = {h: Model(log_ratio(half[not h], raw)) for h in half}
    # the sample is bounded, and so are its scores
    table = sample.select("text", "half", "good").mapInArrow(released(_labelled_scores(others)), "score double, good boolean").toArrow()
    model.level = best_level(table.column("score").to_numpy(), table.column("good").to_numpy().astype(bool))
    scratch.drop("labelled")
    return model


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest ``key``: passes that narrow a range of keys by counting, until one key is left.

    Each pass counts rows in 4096 equal steps of the range, so a pass brings a bounded number of rows to the driver and
    no rows are sorted.
    """
    steps = 4096
    edge = keys.agg(F.min("key").alias("a"), F.max("key").alias("b")).first()
    low, high, above = edge["a"], edge["b"], 0
    while low < high:
        width = (high - low) / steps
        if width == 0 or low + width == low:
            break
        step = F.least(F.floor((F.col("key") - low) / width), F.lit(steps - 1))
        found = keys.where(F.col("key").between(low, high)).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for r in sorted(found, key=lambda r: -r["step"]):
            if above + r["n"] >= k:
                if (r["a"], r["b"]) == (low, high):
                    return float(low)
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return float(low)


def resample(docs: DataFrame, model: Model, k: int | None = None) -> tuple[DataFrame, float]:
    """Every row's score, log_weight, gumbel and key, and the least key that is kept."""
    scratch = Scratch(docs.sparkSession, "resample")
    scored = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_scored(model)), SCORED), "scored", few=True)
    if not model.ratio.any():
        return scored, float("-inf")
    fine = scored.where(F.col("key") > float("-inf"))
    most = fine.where("log_weight > 0").count() if k is None else min(k, fine.count())
    return scored, kth_largest(fine, most) if most > 0 else float("inf")


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """doc_id, score, log_weight, gumbel, key, kept of every row."""
    scored, least = resample(docs, fit(docs, labels, **options), k)
    return scored.withColumn("kept", F.col("key") >= F.lit(least))


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """The kept rows with all their columns; keys are computed again where the rows are, which moves no text."""
    model = fit(docs, labels, **options)
    _, least = resample(docs, model, k)
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, at_text):
                key = model.keys(some.column(at_id).cast(pa.int64()).to_pylist(), some.column(at_text).to_pylist())[-1]
                yield some.filter(pa.array(key >= least))

    return docs.mapInArrow(released(run), docs.schema)
