"""Simple-8b word-aligned coding of token ids, and its file format.

A 64-bit word holds a 4-bit selector and a 60-bit payload; the selector says how many ids of which width the payload
packs. Blocks of ``BLOCK`` ids are coded alone, so each can be decoded without the others; an id wider than 60 bits
never occurs, and one wider than ``ESCAPE_BITS`` is written as an escape: the selector's payload is the id itself.

A file: magic, version, counts; the document table (doc_id, null flag, number of ids); per block the offset of its
first word; the words. Integers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ids per word and bits per id of the packing selectors 0 to 12; selector 13 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30])
ESCAPE, ESCAPE_BITS = 13, 30
BLOCK = 4096
MAGIC, VERSION = b"BS8B", 1


def selectors(ids: np.ndarray) -> np.ndarray:
    """The selector that packs most ids from each place on, as if the run were followed by zeros."""
    if len(ids) and int(ids.max()) >> 60:
        raise ValueError("ids must be below 2**60")
    small = np.minimum(ids, 1 << ESCAPE_BITS).astype(np.float32)
    # exact below 2**24; above it rounding may only widen an id that needs over 23 bits
    widest = np.maximum(np.frexp(small)[1], 1).astype(np.uint8)
    widest = np.concatenate([widest, np.ones(COUNTS[0], np.uint8)])
    chosen = np.full(len(ids), ESCAPE, np.uint8)
    covers = 1
    for s in range(len(COUNTS) - 1, -1, -1):
        # the widest of COUNTS[s] ids is that of two stretches of those looked at before
        step = int(COUNTS[s]) - covers
        widest = np.maximum(widest[:-step], widest[step:])
        covers = int(COUNTS[s])
        chosen[widest[: len(ids)] <= WIDTHS[s]] = s
    return chosen


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of all the blocks of a run of ids, and the number of words of each block."""
    ids = np.ascontiguousarray(ids)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    chosen = selectors(ids)
    took = np.append(COUNTS, 1)
    # every block steps through its words at the same time
    place = np.arange(0, n, block)
    end = np.minimum(place + block, n)
    is_start = np.zeros(n, bool)
    while len(place):
        is_start[place] = True
        place = place + took[chosen[place]]
        going = place < end
        place, end = place[going], end[going]
    starts = np.flatnonzero(is_start)
    selector = chosen[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    edge = np.minimum((starts // block + 1) * block, n)
    for s in np.unique(selector).tolist():
        rows = np.flatnonzero(selector == s)
        at = starts[rows]
        if s == ESCAPE:
            words[rows] |= ids[at].astype(np.uint64)
            continue
        packed = np.zeros(len(rows), np.uint64)
        last = at + COUNTS[s] > edge[rows]
        whole, short = np.flatnonzero(~last), np.flatnonzero(last)
        for k in range(COUNTS[s]):
            shift = np.uint64(k * int(WIDTHS[s]))
            packed[whole] |= ids[at[whole] + k].astype(np.uint64) << shift
            some = short[at[short] + k < edge[rows][short]]
            packed[some] |= ids[at[some] + k].astype(np.uint64) << shift
        words[rows] |= packed
    return words, np.bincount(starts // block, minlength=-(-n // block))


def encode(ids: np.ndarray) -> np.ndarray:
    """Words of one run of ids."""
    return encode_blocks(ids, max(1, len(ids)))[0]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of a run of words, every selector's words at once."""
    return decode_blocks(words, np.array([len(words)]), np.array([n]))


def decode_blocks(words: np.ndarray, n_words: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, given the number of words and of ids of each; unsigned, of 32 bits if all fit."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    took = np.append(COUNTS, 1)[chosen]
    # a block's last word may be padded: it holds what is left of the block's ids
    ends = np.cumsum(n_words)
    real = np.flatnonzero(n_words)
    held = np.cumsum(took)
    before = np.concatenate([[0], held])[ends - n_words]
    over = (held[ends[real] - 1] - before[real]) - n_ids[real]
    took[ends[real] - 1] -= over
    starts = np.cumsum(took) - took
    total = int(n_ids.sum())
    wide = (chosen == ESCAPE).any()
    out = np.zeros(total + int(COUNTS[0]), np.uint64 if wide else np.uint32)
    payload = words & np.uint64((1 << 60) - 1)
    # a padded word's zeros would fall on the next block's ids, so these few words go one by one
    padded = np.flatnonzero(took != np.append(COUNTS, 1)[chosen])
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[starts[rows]] = payload[rows]
            continue
        if len(padded):
            rows = rows[~np.isin(rows, padded)]
        value, at, width, mask = payload[rows], starts[rows], np.uint64(WIDTHS[s]), np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[at + k] = value & mask
            value >>= width
    for r in padded.tolist():
        s = int(chosen[r])
        for k in range(int(took[r])):
            out[starts[r] + k] = int(payload[r]) >> (k * int(WIDTHS[s])) & ((1 << int(WIDTHS[s])) - 1)
    return out[:total]


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: its documents in the order given, their ids one after another."""
    parts = [encode_blocks(ids[at : at + 256 * BLOCK]) for at in range(0, max(1, len(ids)), 256 * BLOCK)]
    words, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    head = struct.pack("<4sHHQQQ", MAGIC, VERSION, 0, len(lengths), len(ids), len(counts))
    number = np.array([0 if d is None else d for d in doc_ids], "<i8")
    absent = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head, number.tobytes(), absent.tobytes(), np.asarray(lengths, "<u4").tobytes(), offsets.tobytes(), words.astype("<u8").tobytes()])


class Reader:
    """A file's documents; blocks are decoded as they are asked for."""

    def __init__(self, raw: bytes):
        magic, version, _, self.n_docs, self.n_ids, self.n_blocks = struct.unpack_from("<4sHHQQQ", raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of this format and version")
        at = struct.calcsize("<4sHHQQQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        number, absent = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if a else int(d) for d, a in zip(number, absent, strict=True)]
        self.lengths = take("<u4", self.n_docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.offsets = take("<u8", self.n_blocks + 1).astype(np.int64)
        self.words = take("<u8", int(self.offsets[-1]))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1, decoded together."""
        n_ids = np.minimum(BLOCK, self.n_ids - np.arange(first, last) * BLOCK)
        words = self.words[self.offsets[first] : self.offsets[last]]
        return decode_blocks(words, np.diff(self.offsets[first : last + 1]), n_ids)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids by place in the file; only the blocks that hold them are decoded."""
        first, last = start // BLOCK, -(-end // BLOCK)
        if last <= first:
            return np.zeros(0, np.uint32)
        return self.blocks(first, last)[start - first * BLOCK : end - first * BLOCK].astype(np.uint32)

    def documents(self, step: int = 256):
        """(doc_id, ids) in file order, decoding ``step`` blocks at a time, each once."""
        held, base, done = np.zeros(0, np.uint32), 0, 0
        for doc_id, start, end in zip(self.doc_ids, self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if done * BLOCK < end:
                more = [held[start - base :]]
                while done * BLOCK < end:
                    more.append(self.blocks(done, min(done + step, self.n_blocks)).astype(np.uint32))
                    done = min(done + step, self.n_blocks)
                held, base = np.concatenate(more), start
            yield doc_id, held[start - base : end - base]
