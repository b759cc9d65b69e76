"""Language identification of whole texts by scripts, per-word scores and Viterbi spans.

Training counts the documents that words, and character 3-grams of their words, are in, per language, hashed into tables of
fixed size, over all the labelled rows it is given; it also notes which scripts each language's letters are in. To label a text, the script of
each word narrows the candidate languages, its hashed counts score them, and Viterbi with a penalty for every switch
labels spans of words. The text's language is the one whose spans hold most
words, where a word said n times in a text counts as the square root of n words: a repeated phrase says less than as many
different words, but always more for every repeat.

Some learned language always wins, so ``keep`` can also ask for evidence: the mean log probability of a text's distinct words
by their 3-grams, each in the language of its span, against a floor for each language measured on the learned documents.
Texts in languages that were not learned, markup and gibberish are far below; a text of several learned languages is not.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no spans; null and repeated ``doc_id`` are
labelled row by row; a null ``doc_id`` is not held out; rows without a language are not learnt from; a script that no
learned language uses leaves all languages as candidates; with nothing learned every text is ``und``; ties go to the first
language in alphabetical order; a text of any length is labelled whole. An empty table gives an empty result. Other columns are no input of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.words import mixed, released, slices

BUCKETS = 1 << 17
SWITCH = 6.0
SMOOTHING = 0.5
#: Count of a word above which its own bucket is trusted rather than its character 3-grams.
TRUST = 3.0
UNKNOWN = "und"
#: Floor of a language: so many times as far below the median of its learned documents as the hundredth of them that fits
#: least, or SPREAD if that is nearer; fewer than ENOUGH documents tell no floor.
REACH, SPREAD, ENOUGH = 3.0, 0.5, 20
#: How far one word alone may be below its floor; the mean of more words may be by this over the root of their number.
SLACK = 3.0
#: Rows labelled at once, and bytes that Viterbi may take for them: about 20 a word and language, and one a word and pair of languages.
SOME, WORK = 400, 32_000_000
LETTERS = re.compile(r"[^\W\d_]+")
#: First code point of each range, and its script; ranges end where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "hiragana"), (0x30A0, "katakana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "other"),
]
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(s) for _, s in SCRIPTS])


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For many words: the bucket of each in the table's lower half; the buckets of their character 3-grams, with ends
    marked, in the upper half, and how many each has; the script of each word's first letter."""
    half = buckets // 2
    code = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size + 1) - size
    place = np.arange(len(code)) - np.repeat(np.append(first, len(code)), np.append(size + 1, 1))[: len(code)]
    single = mixed(code + (place.astype(np.uint64) << np.uint64(32)))
    single[code == 0] = 0
    whole = mixed(np.add.reduceat(single, first)) % np.uint64(half)
    middle = np.flatnonzero(code)  # a 3-gram stands around each letter
    gram = mixed(code[middle - 1] + (code[middle] << np.uint64(21)) + (code[middle + 1] << np.uint64(42))) % np.uint64(half)
    return whole.astype(np.int64), gram.astype(np.int64) + half, size, _SCRIPT_OF[np.searchsorted(_STARTS, code[first].astype(np.int64), "right") - 1]


def letters(text: str | None) -> list[str]:
    """Runs of letters, numerals and other numbers that hold a letter (Unicode category L)."""
    found = LETTERS.findall(text.lower()) if text else []
    # among ASCII, and in runs that are letters only, there is nothing else to leave out
    return found if not found or text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3 == 1, F.lit(False))


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for some in (s for b in batches for s in slices(b, 0)):
            words: dict[str, Counter] = {}
            for text, lang in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(set(letters(text)))
            for lang, own in words.items():
                table, scripts = by_language.setdefault(lang, (np.zeros(buckets), np.zeros(len(_NAMES))))
                if own:
                    n = np.fromiter(own.values(), np.float64, len(own))
                    whole, gram, size, script = word_features(list(own), buckets)
                    table += np.bincount(whole, n, buckets) + np.bincount(gram, np.repeat(n, size), buckets)
                    scripts += np.bincount(script, n, len(_NAMES))
        for lang, (table, scripts) in by_language.items():
            seen, used = np.flatnonzero(table), np.flatnonzero(scripts)
            key = np.concatenate([seen, -1 - used]).astype(np.int32)
            n = np.concatenate([table[seen], scripts[used]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], names=["lang", "key", "n"])

    return run


class Model:
    """Languages, log probabilities per bucket, which buckets are trusted, and the scripts of each language."""

    def __init__(self, counts: dict[str, dict[int, int]], buckets: int = BUCKETS, switch: float = SWITCH):
        self.languages = sorted(counts)
        self.buckets, self.switch = buckets, switch
        n, half = len(self.languages), buckets // 2
        table, scripts = np.zeros((buckets, n)), np.zeros((len(_NAMES), n))
        for k, lang in enumerate(self.languages):
            for key, c in counts[lang].items():
                if key >= 0:
                    table[key, k] = c
                else:
                    scripts[-1 - key, k] = c
        self.trusted = table[:half].sum(axis=1) >= TRUST
        smooth = table + SMOOTHING
        self.log = np.vstack([np.log(part / part.sum(axis=0)) for part in (smooth[:half], smooth[half:])]).astype(np.float32)
        # a script counts as a language's if at least one letter word in 500 of that language is in it
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.scripts = share >= 0.002
        self.scripts[~self.scripts.any(axis=1)] = True

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores of the languages for each word, 0 the best; far below for those whose scripts exclude the word. And
        the mean log probabilities of its 3-grams."""
        whole, gram, size, script = word_features(words, self.buckets)
        by_gram = np.add.reduceat(self.log[gram], np.cumsum(size) - size) / size[:, None]
        found = np.where(self.trusted[whole][:, None], self.log[whole], by_gram)
        return np.where(self.scripts[script], found - found.max(axis=1, keepdims=True), np.float32(-1e5)).astype(np.float32), by_gram.astype(np.float32)


class Labeller:
    """Labels batches of texts, keeping the scores of words seen before."""

    def __init__(self, model: Model, table_size: int = 150_000):
        self.model, self.table_size = model, table_size
        # bytes of text to label at once; a word and the gap after it take two bytes at least
        n = max(1, len(model.languages))
        self.size = max(10_000, 2 * WORK // (20 * n + n * n))
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.score = self.gram = np.zeros((0, len(self.model.languages)), np.float32)

    def paths(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language number of every word of the texts, one text after another, how many words each has, and the words' numbers."""
        if len(self.number) > self.table_size:
            self._reset()
        found = [letters(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        known = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        if new := list(islice(self.number, known, None)):
            score, gram = self.model.words(new)
            self.score, self.gram = np.concatenate([self.score, score]), np.concatenate([self.gram, gram])
        return viterbi(self.score[numbers], counts, self.model.switch), counts, numbers

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of the words (n repeats counted as the root of n), and the number of spans of every text."""
        return self.weigh(texts)[:3]

    def weigh(self, texts: list[str | None], floors: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """As ``label``, and the mean log probability of each text's distinct words in their spans' languages; if floors are
        given, how far it is above them, with the slack that so few words have."""
        n = len(self.model.languages)
        if not n:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        path, counts, numbers = self.paths(texts)
        row = np.repeat(np.arange(len(texts)), counts)
        _, same, often = np.unique(row * (len(self.number) + 1) + numbers, return_inverse=True, return_counts=True)
        weight = (1 / np.sqrt(often))[same]
        held = np.bincount(row * n + path, weight, len(texts) * n).reshape(-1, n)
        best = held.argmax(axis=1)
        names = [self.model.languages[k] if c else UNKNOWN for k, c in zip(best.tolist(), counts.tolist(), strict=True)]
        switched = np.bincount(row[1:], (path[1:] != path[:-1]) & (row[1:] == row[:-1]), len(texts)) if len(path) else 0
        once = 1 / often[same]
        above = self.gram[numbers, path] - (0 if floors is None else floors[path])
        distinct = np.maximum(np.bincount(row, once, len(texts)), 1e-9)
        evidence = np.bincount(row, once * above, len(texts)) / distinct + (0 if floors is None else SLACK / np.sqrt(distinct))
        return names, held.max(axis=1) / np.maximum(held.sum(axis=1), 1e-9), (switched + (counts > 0)).astype(np.int64), evidence


def viterbi(score: np.ndarray, counts: np.ndarray, switch: float, stretch: int = 32) -> np.ndarray:
    """Best state of each word of texts that stand one after another, given each word's scores and a cost per switch.

    Texts are cut into stretches of equal length that step through their words at the same time: once from each state
    that a stretch may begin after, which gives its best transfers; then, with the stretches of a text joined by their
    transfers, from the values it does begin with. Both passes decide ties alike, so the path is that of one long pass.
    """
    n_states = score.shape[1]
    parts = -(-counts // stretch)
    total = int(parts.sum())
    if not total:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), parts)
    part = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(counts) - counts, parts) + part * stretch
    left = np.minimum(stretch, counts[text] - part * stretch)
    step = np.arange(stretch)
    real = step[:, None] < left[None, :]
    at = np.where(real, begin[None, :] + step[:, None], 0)
    worth = np.where(real[:, :, None], score[at], np.float32(0)).astype(np.float64)

    def advance(value: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = value.argmax(axis=-1)
        other = np.take_along_axis(value, best[..., None], -1) - switch
        moved = other > value
        moved[~real[t]] = False  # beyond its end a text stays in its state
        return np.where(moved, other, value), moved, best

    # transfers: the value of ending a stretch in each state after each state before it
    value = np.where(np.eye(n_states, dtype=bool), 0.0, -1e15)[None].repeat(total, 0)
    for t in range(stretch):
        value = advance(value, t)[0] + worth[t][:, None, :]
    first = np.zeros((total, n_states))
    rows = np.flatnonzero(part == 0)
    while len(rows):
        rows = rows[part[rows] + 1 < parts[text[rows]]]
        after = (first[rows][:, :, None] + value[rows]).max(axis=1)
        first[rows + 1] = after - after.max(axis=1, keepdims=True)
        rows = rows + 1
    moved = np.zeros((stretch, total, n_states), bool)
    kind = np.min_scalar_type(-n_states)  # holds every state's number
    source = np.zeros((stretch, total), kind)
    value = first
    for t in range(stretch):
        value, moved[t], source[t] = advance(value, t)
        value = value + worth[t]
    # back through each stretch from every state it may end in
    every = np.arange(total)[:, None]
    state = np.arange(n_states)[None, :].repeat(total, 0)
    back = np.zeros((stretch, total, n_states), kind)
    for t in range(stretch - 1, -1, -1):
        back[t] = state
        state = np.where(moved[t][every, state], source[t][:, None], state)
    # and through the stretches of each text, from the last one's best state
    last = np.zeros(total, np.int64)
    rows = np.flatnonzero(part == parts[text] - 1)
    last[rows] = value[rows].argmax(axis=1)
    while len(rows):
        rows = rows[part[rows] > 0]
        last[rows - 1] = state[rows, last[rows]]
        rows = rows - 1
    path = np.take_along_axis(back, last[None, :, None], 2)[:, :, 0]
    return path.T[real.T].astype(np.int64)


def train(rows: DataFrame, buckets: int = BUCKETS, switch: float = SWITCH) -> Model:
    """Learn from text and lang of the rows; at most ``buckets`` rows a language come to the driver."""
    used = rows.where("lang is not null and text is not null").select("text", "lang")
    found = used.mapInArrow(released(_count(buckets)), "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[int, int]] = {}
    for lang, key, n in zip(*(found.column(c).to_pylist() for c in ("lang", "key", "n")), strict=True):
        counts.setdefault(lang, {})[key] = n
    return Model(counts, buckets, switch)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long").cast("string")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            for some in slices(batch, 2, SOME, labeller.size):
                names, share, spans = labeller.label(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(names, pa.string()), pa.array(share), pa.array(spans)], names=["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    return rows.mapInArrow(released(run), "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, span, lang, first_word, n_words: the labelled spans of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for some in (s for batch in batches for s in slices(batch, 1, SOME, labeller.size)):
            if not model.languages:
                return
            path, counts, _ = labeller.paths(some.column(1).to_pylist())
            row = np.repeat(np.arange(len(counts)), counts)
            starts = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (row[1:] != row[:-1])])[: len(path)])
            of = row[starts]
            number = np.arange(len(starts)) - np.searchsorted(of, of)
            names = pa.array([model.languages[k] for k in path[starts].tolist()], pa.string())
            begin = starts - (np.cumsum(counts) - counts)[of]
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), pa.array(number.astype(np.int32)), names, pa.array(begin), pa.array(np.diff(np.append(starts, len(path))))], names=["doc_id", "span", "lang", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, span int, lang string, first_word long, n_words long")


def learned_from(docs: DataFrame) -> DataFrame:
    """The rows that are not held out."""
    return docs.where(~held_out(F.col("doc_id").cast("long").cast("string")))


def floors(rows: DataFrame, model: Model) -> np.ndarray:
    """Least evidence of each of the model's languages, by the documents it was learned from; one row a language reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            for some in slices(batch, 0, SOME, labeller.size):
                names, _, _, evidence = labeller.weigh(some.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(evidence)], names=["lang", "evidence"])

    out = np.full(len(model.languages), -np.inf)
    if not model.languages:
        return out
    found = rows.where("lang is not null and text is not null").select("text").mapInArrow(released(run), "lang string, evidence double").where(F.col("lang") != UNKNOWN)
    for r in found.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("evidence", [0.01, 0.5], 10_000).alias("q")).collect():
        if r["n"] >= ENOUGH:
            low, middle = r["q"]
            out[model.languages.index(r["lang"])] = middle - REACH * max(middle - low, SPREAD)
    return out


def keep(docs: DataFrame, model: Model, least: float = 0.5, floors: np.ndarray | None = None) -> DataFrame:
    """Rows with a language that holds at least ``least`` of their words, with all their columns, and whose words are on the
    mean not below the floors if given; all rows if nothing was learned."""
    if not model.languages:
        return docs
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            for some in slices(batch, at_text, SOME, labeller.size):
                names, share, _, evidence = labeller.weigh(some.column(at_text).to_pylist(), floors)
                kept = (np.array(names, object) != UNKNOWN) & (share >= least)
                yield some.filter(pa.array(kept if floors is None else kept & (evidence >= 0)))

    return docs.mapInArrow(released(run), docs.schema)
