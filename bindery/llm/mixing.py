"""Mixing to target weights by soft membership.

A naive Bayes classifier on hashed words, fitted to a labelled table, gives every document a posterior over the
domains. Rates r >= 0 are then fitted so that the expected domain token totals, the sum of rate * tokens * posterior, match the
targets: projected gradient steps on the squared error from rates of 1, in the metric given by the tokens and the
domains' Gram matrix. A step needs one vector the size of the domains, so each is one pass over a narrow table that
returns sums, and a document's rate follows from its posterior and the list of steps wherever it is.

Words of a text are not independent, so the evidence of n words counts as that of n ** power, by one rule for texts of every length: summed as it
stands it would make every posterior 0 or 1, and membership would not be soft. The power is fitted, to the likelihood of a held-out fifth of the labelled
sample under a model of the rest.

Which domains there are, and the prior of each, comes from a count of all labelled rows. The sample that the words are
learned from is bounded: at most ``LABELLED`` rows, the same number for each domain, those of the smallest seeded hashes of
their ids; so a domain with few rows is learned from all of them at every size. Everything else covers all rows. Without given weights, a domain's target share is its expected share to the power
``TEMPER``, scaled to keep the total of tokens.

Defined cases: a null text has no tokens, the prior as posterior and no effect on totals; null and repeated ``doc_id`` are
rated row by row; labels that are null or of a null id are not used, and of a repeated id the least label and text are; without labelled rows every rate is 1 and the domain
null; weights of domains not learned are left out and the rest scaled to 1; a learned domain without a given weight
has target 0; where targets can't be met, the rates come as near as the steps allow; of equal posteriors the first domain in alphabetical order
is named; a text of any length counts whole; other columns are not looked at, or kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch
from bindery.llm.words import hashed, mixed, released, slices

BUCKETS = 1 << 15
LABELLED = 20_000
SMOOTHING = 0.1
#: Powers that are tried, the one taken where no labelled row is held out, and one row in so many that is.
POWERS = tuple(k / 20 for k in range(1, 21))
POWER, HELD = 0.5, 5
TEMPER = 0.5
STEPS = 40
TOLERANCE = 1e-6
SEED = 42
MEMBERS = "doc_id long, tokens long, posterior array<double>, luck double"


def _buckets(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    found, n = hashed(texts, signs=True)
    return (mixed(found) & np.uint64(buckets - 1)).astype(np.int64), n


class Classifier:
    """Log probabilities of the buckets in each domain, log priors, and the power of the number of words that evidence counts as."""

    def __init__(self, counts: dict[str, np.ndarray], documents: dict[str, int], buckets: int = BUCKETS, power: float = POWER):
        self.domains, self.power = sorted(counts), power
        table = np.array([counts[d] for d in self.domains]).T + SMOOTHING if counts else np.zeros((buckets, 0))
        self.log = np.log(table / table.sum(axis=0)) if counts else table
        prior = np.array([documents[d] for d in self.domains], float)
        self.prior = np.log(prior / prior.sum()) if counts else prior

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The mean log probability of each text's words in each domain, and how many there are."""
        bucket, n = _buckets(texts, len(self.log))
        total = np.zeros((len(n), len(self.domains)))
        if len(bucket):  # one domain after another: a number for each word and domain would not be bounded
            first, some = (np.cumsum(n) - n)[n > 0], n > 0
            for k in range(len(self.domains)):
                total[some, k] = np.add.reduceat(self.log[bucket, k], first) / n[some]
        return total, n

    def log_posteriors(self, mean: np.ndarray, n: np.ndarray, power: float) -> np.ndarray:
        score = mean * (n.astype(float) ** power)[:, None] + self.prior
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        mean, n = self.evidence(texts)
        return np.exp(self.log_posteriors(mean, n, self.power)) if self.domains else mean, n


def fitted_power(sample: DataFrame, model: Classifier) -> float:
    """The power of the highest likelihood of the labels of (text, label), the smallest of equals; one sum for each power and task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(POWERS)), 0
        for some in (s for batch in batches for s in slices(batch, 0)):
            mean, n = model.evidence(some.column(0).to_pylist())
            own = np.array([model.domains.index(x) for x in some.column(1).to_pylist()], np.int64)
            for k, power in enumerate(POWERS):
                total[k] += model.log_posteriors(mean, n, power)[np.arange(len(own)), own].sum()
            seen += len(own)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(POWERS), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    found = {r["k"]: r["v"] for r in sample.mapInArrow(released(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return max(((round(v, 6), -POWERS[k]) for k, v in found.items()), default=(0.0, -POWER))[1] * -1


def fit(docs: DataFrame, labelled: DataFrame, bound: int = LABELLED, buckets: int = BUCKETS) -> Classifier:
    """Fit to a table of (doc_id, label); the bounded sample of it is broadcast to the documents. One row a domain, and one
    for each domain and bucket, come to the driver."""
    rows = labelled.where("doc_id is not null and label is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("string").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    documents = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not documents:
        return Classifier({}, {}, buckets)
    # of each domain about twice as many rows as are wanted are drawn by their hash, so that none is ranked over all its rows
    each = max(1, bound // len(documents))
    draw = F.create_map(*(F.lit(x) for label, n in documents.items() for x in (label, min(1.0, (2.0 * each + 100) / n))))
    luck_of = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40))
    few = rows.where(luck_of < draw[F.col("label")] * float(1 << 40)).withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(luck_of, "doc_id")))
    sample = docs.select("doc_id", "text").join(F.broadcast(few.where(F.col("_n") <= each).drop("_n")), "doc_id")
    # one text for an id, however many rows hold it, so that the sample is bounded; a text that repeats is held out or not as one
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label", (F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0).alias("held"))
    scratch = Scratch(docs.sparkSession, "mixing-sample")
    sample = scratch.save(sample.coalesce(16), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bool], np.ndarray] = {}
        for some in (s for batch in batches for s in slices(batch, 0)):
            texts, labels, held = (some.column(k).to_pylist() for k in range(3))
            bucket, n = _buckets(texts, buckets)
            kinds = list(zip(labels, held, strict=True))
            names = sorted(set(kinds))
            row = np.repeat(np.array([names.index(x) for x in kinds]), n)
            for k, name in enumerate(names):
                found[name] = found.get(name, 0) + np.bincount(bucket[row == k], minlength=buckets)
        for (label, out), count in found.items():
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(used), pa.string()), pa.array([out] * len(used), pa.bool_()), pa.array(used.astype(np.int32)), pa.array(count[used])], names=["label", "held", "bucket", "n"])

    table = sample.mapInArrow(released(run), "label string, held boolean, bucket int, n long").groupBy("label", "held", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = {held: {label: np.zeros(buckets) for label in documents} for held in (False, True)}
    for label, held, bucket, n in zip(*(table.column(c).to_pylist() for c in ("label", "held", "bucket", "n")), strict=True):
        counts[held][label][bucket] = n
    power = fitted_power(sample.where("held").select("text", "label"), Classifier(counts[False], documents, buckets))
    return Classifier({label: counts[False][label] + counts[True][label] for label in documents}, documents, buckets, power)


def luck(ids: list, texts: list, seed: int = SEED) -> np.ndarray:
    """A number in [0, 1) that a row's id, text and the seed decide."""
    return np.array([xxhash.xxh3_64_intdigest(f"{i}\0".encode() + (t or "").encode(), seed) >> 11 for i, t in zip(ids, texts, strict=True)], float) / 2.0**53


def members(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens, posterior (in the order of the model's domains) and luck of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                ids, texts = (some.column(k).to_pylist() for k in (0, 1))
                posterior, n = model.posteriors(texts)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), pa.array(list(posterior), pa.list_(pa.float64())), pa.array(luck(ids, texts))], names=["doc_id", "tokens", "posterior", "luck"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), MEMBERS)


class Rates:
    """Targets, the steps taken, and the totals they led to."""

    def __init__(self, n: int):
        self.steps: list[np.ndarray] = []
        self.target = self.total = np.zeros(n)

    def of(self, posterior: np.ndarray) -> np.ndarray:
        rate = np.ones(len(posterior))
        for step in self.steps:
            rate = np.maximum(0.0, rate - posterior @ step)
        return rate


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _sums(rates: Rates, n: int, gram: bool):
    """Per task: the totals of each domain by the present rates, and the Gram matrix of the posteriors if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, matrix = np.zeros(n), np.zeros((n, n))
        for batch in batches:
            if batch.num_rows:
                p, t = _matrix(batch.column(1), n), batch.column(0).to_numpy().astype(float)
                total += (rates.of(p) * t) @ p
                matrix += (p * t[:, None]).T @ p if gram else 0
        values = np.concatenate([total, matrix.ravel()]) if gram else total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["k", "v"])

    return run


def fit_rates(found: DataFrame, domains: list[str], weights: dict[str, float] | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    n = len(domains)
    rates = Rates(n)

    def sums(gram: bool = False) -> np.ndarray:
        rows = found.select("tokens", "posterior").mapInArrow(released(_sums(rates, n, gram)), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(n + n * n * gram)
        for r in rows:
            out[r["k"]] = r["v"]
        return out

    if not n:
        return rates
    first = sums(gram=True)
    rates.total, matrix = first[:n], first[n:].reshape(n, n)
    whole = rates.total.sum()
    if not whole:
        return rates
    want = np.array([max(0.0, weights.get(d, 0.0)) for d in domains]) if weights else (rates.total / whole) ** TEMPER
    rates.target = whole * want / want.sum() if want.sum() else rates.total
    inverse = np.linalg.pinv(matrix, hermitian=True)
    for _ in range(steps):
        error = rates.total - rates.target
        if np.abs(error).max() <= tolerance * whole:
            break
        rates.steps.append(inverse @ error)
        before, rates.total = rates.total, sums()
        if np.abs(rates.total - before).max() <= tolerance * whole * 0.01:
            break
    return rates


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, tokens, domain, p_domain, rate and copies of every row; copies is the rate rounded by the row's luck."""
    scratch = Scratch(docs.sparkSession, "mixing")
    model = fit(docs, labelled)
    found = scratch.save(members(docs, model), "members", few=True)
    rates, domains = fit_rates(found, model.domains, weights), model.domains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            p = _matrix(batch.column(2), len(domains)) if domains and n else np.zeros((n, 0))
            rate = rates.of(p)
            best = p.argmax(axis=1) if domains else np.zeros(n, int)
            copies = np.floor(rate + batch.column(3).to_numpy()).astype(np.int64)
            names = pa.array([domains[k] for k in best] if domains else [None] * n, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array(p.max(axis=1) if domains else np.zeros(n)), pa.array(rate), pa.array(copies)], names=["doc_id", "tokens", "domain", "p_domain", "rate", "copies"])

    return found.mapInArrow(released(run), "doc_id long, tokens long, domain string, p_domain double, rate double, copies long")


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows with all their columns, each as often as its copies say; rates are worked out where the rows are."""
    scratch = Scratch(docs.sparkSession, "mixing")
    model = fit(docs, labelled)
    rates = fit_rates(scratch.save(members(docs, model).select("tokens", "posterior"), "members", few=True), model.domains, weights)
    scratch.drop("members")
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, at_text):
                ids, texts = some.column(at_id).cast(pa.int64()).to_pylist(), some.column(at_text).to_pylist()
                rate = rates.of(model.posteriors(texts)[0])
                yield some.take(pa.array(np.repeat(np.arange(some.num_rows), np.floor(rate + luck(ids, texts)).astype(np.int64))))

    return docs.mapInArrow(released(run), docs.schema)
