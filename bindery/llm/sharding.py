"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots; rows and bytes are added up per slot; a stored, versioned
slot-to-shard map says where each slot lives. Rebalancing reads the last version, edits it (whole slots move) and stores
the next; the hash never changes. The first version deals the slots out in turn, and the second is rebalanced by bytes. Built
from DataFrame functions only; the driver sees one row per virtual slot, a number set by a parameter.

Defined cases: a null text counts no bytes and has the checksum of the empty text; a null or repeated ``doc_id``
is one more value to hash (with the size and the checksum of the text, so that one id holding many rows spreads
over slots); rows equal in id, size and checksum are interchangeable and share a slot, unless together they hold more bytes
than an average slot: then they are spread over slots row by row, so that no repeated row fills a shard; a text of any length is one
row, never cut; ties in size go to the smaller slot; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.scratch import Scratch

N_SLOTS = 8192
N_SHARDS = 40
ROW_BYTES = 16
_MAP = "array<struct<virtual_slot:int,shard:int,slot_start:bigint,rows:bigint,bytes:bigint>>"


def _size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _key(n_slots: int) -> list[Column]:
    """A record's hash, its virtual slot, and a number that tells repeated records apart."""
    key = F.xxhash64(F.col("doc_id").cast("long"), _size(), F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    return [key.alias("_key"), F.pmod(key, F.lit(n_slots)).cast("int").alias("virtual_slot"), F.monotonically_increasing_id().alias("_row")]


def sizes(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row; the text itself goes no further."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), *_key(n_slots))


def repeated(narrow: DataFrame, totals: list[dict], n_slots: int) -> DataFrame | None:
    """Hashes of repeated records that together hold more bytes than an average slot: at most ``n_slots`` of them.

    Only slots that hold more than that are looked at, one row of each record in them after partial sums.
    """
    mean = sum(r["bytes"] for r in totals) / n_slots
    full = [r["virtual_slot"] for r in totals if r["bytes"] > mean and r["rows"] > 1]
    if not full:
        return None
    own = narrow.where(F.col("virtual_slot").isin(full)).groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return own.where((F.col("n") > 1) & (F.col("bytes") > mean)).select("_key")


def spread(rows: DataFrame, hot: DataFrame | None, n_slots: int) -> DataFrame:
    """The rows with those of hot records dealt to slots one by one; the hot hashes are at most ``n_slots``, so they are broadcast."""
    if hot is None:
        return rows
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_key", "left")
    return marked.withColumn("virtual_slot", F.when(F.col("_hot"), F.pmod(F.xxhash64("_key", "_row"), F.lit(n_slots)).cast("int")).otherwise(F.col("virtual_slot"))).drop("_hot")


def slot_totals(narrow: DataFrame) -> list[dict]:
    """Rows and bytes per virtual slot: at most one row per slot, pre-aggregated before the shuffle."""
    found = narrow.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()
    return [r.asDict() for r in found]


def first_map(totals: list[dict], n_shards: int = N_SHARDS) -> dict[int, int]:
    """Slots dealt out in turn, whatever they hold."""
    return {r["virtual_slot"]: r["virtual_slot"] % n_shards for r in totals}


def balanced_map(placed: dict[int, int], totals: list[dict], n_shards: int = N_SHARDS) -> dict[int, int]:
    """The map edited until the shards' bytes are near equal; slots of shards that are no more, and new slots, are placed first.

    Time after time the fullest shard gives the emptiest one a slot, or exchanges one for a smaller one, so that the two come as
    near as they can, until that helps no more.
    """
    size = {r["virtual_slot"]: r["bytes"] for r in totals}
    out = {s: k for s, k in placed.items() if s in size and k < n_shards}
    held = [0] * n_shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for s, k in sorted(out.items()):
        held[k] += size[s]
        own[k].append((size[s], s))
    for s in sorted(size.keys() - out.keys(), key=lambda s: (-size[s], s)):
        k = min(range(n_shards), key=lambda k: (held[k], k))
        out[s] = k
        held[k] += size[s]
        own[k].append((size[s], s))
    for _ in range(64 * n_shards):
        full, empty = max(range(n_shards), key=lambda k: (held[k], -k)), min(range(n_shards), key=lambda k: (held[k], k))
        gap = held[full] - held[empty]
        mine, theirs = sorted(own[full]), [(0, -1), *sorted(own[empty])]
        best = (gap, None, None)
        for give in mine:  # of what could come back for it, the one that leaves the two nearest
            at = bisect.bisect_left(theirs, (give[0] - gap / 2, -1))
            for take in theirs[max(0, at - 1) : at + 1]:
                best = min(best, (abs(gap - 2 * (give[0] - take[0])), give, take), key=lambda x: x[0])
        if best[1] is None or best[0] >= gap:
            break
        _, give, take = best
        for slot, a, b in ((give, full, empty), (take, empty, full)):
            if slot[1] >= 0:
                own[a].remove(slot)
                own[b].append(slot)
                out[slot[1]] = b
                held[a], held[b] = held[a] - slot[0], held[b] + slot[0]
    return out


def grow_map(placed: dict[int, int], totals: list[dict], n_shards: int) -> dict[int, int]:
    """The map for one more shard, number ``n_shards``: slots move into the new shard only.

    The fullest shard gives the largest slot that does not lift the new shard over the new mean, until none fits.
    """
    size = {r["virtual_slot"]: r["bytes"] for r in totals}
    own: dict[int, list[int]] = {k: [] for k in range(n_shards)}
    for slot, shard in placed.items():
        own[shard].append(slot)
    for slots in own.values():
        slots.sort(key=lambda s: (size[s], s))
    mean, held, grown = sum(size.values()) / (n_shards + 1), 0, dict(placed)
    heap = [(-sum(size[s] for s in slots), k) for k, slots in own.items()]
    heapq.heapify(heap)
    while heap:
        full, shard = heapq.heappop(heap)
        fit = next((s for s in reversed(own[shard]) if held + size[s] <= mean), None)
        if fit is None or -full <= mean:
            continue
        own[shard].remove(fit)
        grown[fit], held = n_shards, held + size[fit]
        heapq.heappush(heap, (full + size[fit], shard))
    return grown


def store_map(spark, path: str, placed: dict[int, int], totals: list[dict], version: int) -> DataFrame:
    """Write one version of the map: virtual_slot, shard, slot_start (rows of the shard's slots before it), rows, bytes."""
    start: dict[int, int] = {}
    entries = []
    for r in sorted(totals, key=lambda r: r["virtual_slot"]):
        shard = placed[r["virtual_slot"]]
        entries.append({"virtual_slot": r["virtual_slot"], "shard": shard, "slot_start": start.get(shard, 0), "rows": r["rows"], "bytes": r["bytes"]})
        start[shard] = start.get(shard, 0) + r["rows"]
    table = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(entries)), _MAP)).alias("m")).select("m.*")
    table.write.parquet(f"{path}/map_version={version}")
    return read_map(spark, path, version)


def read_map(spark, path: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP[len("array<struct<") : -2].replace(":", " ")).parquet(f"{path}/map_version={version}")


def last_version(spark, path: str) -> int:
    """The number of the last version of the map that a folder holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return max(int(name.split("=")[1]) for name in (f.getPath().getName() for f in found) if name.startswith("map_version="))


def rebalance(spark, path: str, n_shards: int, totals: list[dict] | None = None) -> tuple[DataFrame, int]:
    """Read the last version of the map, edit it, and store it as the next version, which is returned with its number.

    Where there are to be more shards than before, slots move into the new ones only; else they move until the shards' bytes are
    near equal. totals: rows and bytes of the slots now, if they are not those stored. Writing a version that another call has
    stored meanwhile fails.
    """
    version = last_version(spark, path)
    stored = [r.asDict() for r in read_map(spark, path, version).collect()]
    placed, now = {r["virtual_slot"]: r["shard"] for r in stored}, stored if totals is None else totals
    before = max(placed.values(), default=-1) + 1
    if before < n_shards and placed:
        missing = {r["virtual_slot"]: r["virtual_slot"] % before for r in now if r["virtual_slot"] not in placed}
        for n in range(before, n_shards):
            placed = grow_map(placed | missing, now, n)
    else:
        placed = balanced_map(placed, now, n_shards)
    return store_map(spark, path, placed, now, version + 1), version + 1


def place(narrow: DataFrame, slot_map: DataFrame, version: int, order: tuple[Column | str, ...] = ("doc_id", "text_crc32", "size")) -> DataFrame:
    """Each row's shard and its place there: the rows of the shard's slots before its own, then its rank in the slot.

    The map has at most one row per virtual slot, so it is broadcast; rows are ranked per slot, thousands of groups.
    """
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)).cast("long") - 1
    return (
        narrow.withColumn("_rank", rank)
        .join(F.broadcast(slot_map.select("virtual_slot", "shard", "slot_start")), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot_start") + F.col("_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
    )


def _mapped(narrow: DataFrame, path: str, n_shards: int, n_slots: int) -> tuple[DataFrame | None, DataFrame, int]:
    """Hashes of the hot records, and the rebalanced map of the rows with its version."""
    spark = narrow.sparkSession
    totals = slot_totals(narrow)
    if (hot := repeated(narrow, totals, n_slots)) is not None:
        hot = spark.createDataFrame(hot.collect(), "_key long")
        totals = slot_totals(spread(narrow, hot, n_slots))
    store_map(spark, path, first_map(totals, n_shards), totals, 0)
    return hot, *rebalance(spark, path, n_shards)


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> DataFrame:
    """All rows with shard, slot and the map version used. The law is ``bytes``: the shards' sizes are near equal."""
    scratch = Scratch(docs.sparkSession, "sharding")
    narrow = scratch.save(sizes(docs, n_slots), "sizes")
    hot, slot_map, version = _mapped(narrow, scratch.at("slot_map"), n_shards, n_slots)
    return place(spread(narrow, hot, n_slots), slot_map, version)


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> None:
    """Write whole documents as one folder per shard, by the same hash and map; several tasks may fill one shard.

    A column of the documents named shard or virtual_slot is written as document_shard or document_virtual_slot.
    """
    hot, slot_map, _ = _mapped(sizes(docs, n_slots), f"{path}/_slot_map", n_shards, n_slots)
    keep = [F.col(c).alias(f"document_{c}" if c in ("virtual_slot", "shard", "_key", "_row", "_hot") else c) for c in docs.columns]
    rows = spread(docs.select(*keep, *_key(n_slots)), hot, n_slots).drop("_key", "_row")
    placed = rows.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot").drop("virtual_slot")
    placed.write.partitionBy("shard").parquet(f"{path}/shards")
