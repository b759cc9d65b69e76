"""Streams with keyed state: a result cache that is read, filled, bounded and aged as its operations arrive, and a staged search that
says of every lookup whether it is to be made as soon as the outcomes so far settle it.

Both are ``transformWithState`` over a watermarked stream: state is keyed and checkpointed by Spark (RocksDB), timers run on event
time, and a query that is stopped goes on from its checkpoint. What a key's state holds is bounded: by ``keep`` entries of a
cache, by the positions of a plan that are still waiting. Rows of one key in a micro-batch are put in order in memory, so the source's
own limit (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds that. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The only state store that keeps maps and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Entries of a cache, and the longest age in seconds that a lookup may ask for.
KEEP, LONGEST = 500, 365 * 86_400
ANSWER = "cache string, seq long, cache_key string, kind string, result_json string, at long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drain(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now to Parquet under ``out``; the next run goes on from the checkpoint."""
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# ---- the cache


@dataclass
class Entries:
    """The entries of one cache: key to result and second of its last put."""

    keep: int = KEEP
    held: dict[str, tuple[str | None, int]] = field(default_factory=dict)

    def put(self, key: str, result: str | None, now: int) -> None:
        """Store a result; beyond ``keep`` the oldest entries go, of equally old ones the largest key."""
        self.held[key] = (result, now)
        while len(self.held) > self.keep:
            oldest = min(at for _, at in self.held.values())
            del self.held[max(k for k, (_, at) in self.held.items() if at == oldest)]

    def get(self, key: str, now: int, max_age: int) -> tuple[bool, str | None]:
        """Whether there is a result not older than ``max_age`` seconds, and the result; none is there if that is 0 or less."""
        result, at = self.held.get(key, (None, None))
        hit = max_age > 0 and at is not None and at >= now - max_age
        return hit, result if hit else None

    def expire(self, now: int, longest: int) -> list[tuple[str, int]]:
        """Drop entries that no lookup can reach any more: their keys and seconds."""
        gone = sorted((k, at) for k, (_, at) in self.held.items() if at + longest < now)
        for k, _ in gone:
            del self.held[k]
        return gone


class _Cache(StatefulProcessor):
    def __init__(self, keep: int, longest: int):
        self.keep, self.longest = keep, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "cache_key string", "result_json string, updated_at long")

    def _load(self) -> Entries:
        return Entries(self.keep, {k[0]: (v[0], int(v[1])) for k, v in self.entries.iterator()})

    def _store(self, before: dict, after: dict) -> None:
        for k in before.keys() - after.keys():
            self.entries.removeKey((k,))
        for k, v in after.items():
            if before.get(k) != v:
                self.entries.updateValue((k,), v)
        # one timer, for the entry that is out of reach first
        due = min((at for _, at in after.values()), default=None)
        want = set() if due is None else {(due + self.longest + 1) * 1000}
        have = set(self.handle.listTimers())
        for t in have - want:
            self.handle.deleteTimer(t)
        for t in want - have:
            self.handle.registerTimer(t)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = self._load()
        before = dict(found.held)
        said = []
        for op in pd.concat(rows).sort_values(["second", "seq"], kind="stable").itertuples():
            if op.put:
                found.put(op.cache_key, op.result_json, int(op.second))
            else:
                hit, result = found.get(op.cache_key, int(op.second), int(op.max_age))
                said.append((key[0], int(op.seq), op.cache_key, "hit" if hit else "miss", result, int(op.second)))
        self._store(before, found.held)
        if said:
            yield pd.DataFrame(said, columns=_names(ANSWER))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        found = self._load()
        before = dict(found.held)
        gone = found.expire(timerValues.getCurrentWatermarkInMs() // 1000, self.longest)
        self._store(before, found.held)
        if gone:
            yield pd.DataFrame([(key[0], None, k, "expired", None, at) for k, at in gone], columns=_names(ANSWER)).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def cache_answers(operations: DataFrame, keep: int = KEEP, longest: int = LONGEST, delay: str = "1 hour") -> DataFrame:
    """What a stream of cache operations answers: cache, seq, cache_key, kind (hit, miss or expired), result_json, at.

    operations: cache (whose entries are bounded together), seq (their order within a second), at (timestamp), put, cache_key,
    result_json (of a put), max_age (seconds, of a get). A put replaces its key's entry; an entry that is older than ``longest``, the largest
    ``max_age`` there is, is dropped by a timer once the watermark has passed it, which says so in a row of its own.
    """
    use_rocksdb(operations.sparkSession)
    rows = operations.select(
        "cache", F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), F.unix_timestamp(F.col("at").cast("timestamp")).alias("second"),
        "put", "cache_key", "result_json", F.coalesce(F.col("max_age").cast("long"), F.lit(0)).alias("max_age"),
    )
    return rows.withWatermark("at", delay).groupBy("cache").transformWithStateInPandas(_Cache(keep, longest), ANSWER, "Append", "EventTime")


# ---- the staged search


@dataclass
class Stage:
    """What is known of a provider's lookups for one book: positions count from 1 and each has one outcome."""

    upto: int = 0
    ended: int | None = None
    firm: int | None = None
    #: positions beyond ``upto`` that have arrived: whether a fallback, and whether decided
    beyond: dict[int, tuple[bool, bool]] = field(default_factory=dict)

    def arrive(self, pos: int, fallback: bool, failed: bool, exact: bool, strong: bool) -> list[tuple[int, bool]]:
        """Take in an outcome, in any order; returns the positions that are settled by it, and whether each is to be done.

        A lookup is skipped as soon as one before it has failed or was exact, or, for a fallback, was strong; it is done once all
        before it are known and none says so. An outcome that arrives twice counts once.
        """
        if pos <= self.upto or pos in self.beyond:
            return []
        self.beyond[pos] = (fallback, False)
        if failed or exact:
            self.ended = pos if self.ended is None else min(self.ended, pos)
        if strong:
            self.firm = pos if self.firm is None else min(self.firm, pos)
        settled = []
        while self.upto + 1 in self.beyond:
            self.upto += 1
            own, decided = self.beyond.pop(self.upto)
            if not decided:
                settled.append((self.upto, not self._skipped(self.upto, own)))
        for p in sorted(self.beyond):
            own, decided = self.beyond[p]
            if not decided and self._skipped(p, own):
                self.beyond[p] = (own, True)
                settled.append((p, False))
        return settled

    def settle(self) -> list[tuple[int, bool]]:
        """Decide what still waits as if the missing outcomes said nothing."""
        left = [(p, not self._skipped(p, own)) for p, (own, decided) in sorted(self.beyond.items()) if not decided]
        self.beyond = {p: (own, True) for p, (own, _) in self.beyond.items()}
        return left

    def _skipped(self, pos: int, fallback: bool) -> bool:
        return self.ended is not None and self.ended < pos or fallback and self.firm is not None and self.firm < pos


class _Staged(StatefulProcessor):
    def __init__(self, names: list[str], patience: int):
        self.names, self.patience = names, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "upto int, ended int, firm int")
        self.waiting = handle.getMapState("waiting", "pos int", "fallback boolean, decided boolean")

    def _load(self) -> Stage:
        upto, ended, firm = self.facts.get() if self.facts.exists() else (0, None, None)
        return Stage(upto, ended, firm, {int(k[0]): (bool(v[0]), bool(v[1])) for k, v in self.waiting.iterator()})

    def _store(self, before: dict, stage: Stage) -> None:
        self.facts.update((stage.upto, stage.ended, stage.firm))
        for p in before.keys() - stage.beyond.keys():
            self.waiting.removeKey((p,))
        for p, v in stage.beyond.items():
            if before.get(p) != v:
                self.waiting.updateValue((p,), v)

    def _said(self, key: Any, settled: list[tuple[int, bool]]) -> Iterator[pd.DataFrame]:
        if settled:
            yield pd.DataFrame([(*key, p, do) for p, do in settled], columns=[*self.names, "pos", "do"]).astype({"pos": "int32"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stage = self._load()
        before, settled = dict(stage.beyond), []
        new = pd.concat(rows).sort_values("pos")
        latest = int(new["second"].max())
        for r in new.itertuples():
            settled += stage.arrive(int(r.pos), bool(r.fallback), bool(r.failed), bool(r.exact), bool(r.strong))
        self._store(before, stage)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if any(not decided for _, decided in stage.beyond.values()):
            self.handle.registerTimer(1000 * (latest + self.patience))
        yield from self._said(key, settled)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        stage = self._load()
        before, settled = dict(stage.beyond), stage.settle()
        self._store(before, stage)
        yield from self._said(key, settled)

    def close(self) -> None:
        pass


def staged_decisions(outcomes: DataFrame, keys: list[str], at: Column, delay: str = "1 hour", patience: int = 3600) -> DataFrame:
    """keys, pos, do: of every lookup of a stream of outcomes whether it is to be made, given what those before it brought.

    outcomes: keys (book, provider), pos from 1, and the booleans fallback, failed, exact, strong, in any order and as late as ``delay``. A
    position is said once, when it is settled; whatever the order of arrival, the positions to be done are those of ``match.staged_stop``. What
    waits for an outcome that does not come is settled once the watermark is ``patience`` seconds beyond its arrival; the outcome itself is
    settled when it comes after all.
    """
    use_rocksdb(outcomes.sparkSession)
    kinds = dict(outcomes.dtypes)
    rows = outcomes.select(*keys, F.col("pos").cast("int").alias("pos"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("fallback", "failed", "exact", "strong")), at.cast("timestamp").alias("_at"), F.unix_timestamp(at.cast("timestamp")).alias("second"))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "pos int", "do boolean"])
    return rows.withWatermark("_at", delay).groupBy(*keys).transformWithStateInPandas(_Staged(keys, patience), schema, "Append", "EventTime")
