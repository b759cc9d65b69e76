"""Words of whole texts as hashes, a batch of texts at once, for the operators that count or compare them."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cased A-Z, then runs of letters and digits of ASCII and of anything beyond; on UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words with their case, and runs of other signs, on UTF-8 bytes.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20\x30-\x39A-Za-z\x7f-\xff]+")
#: Bytes of text that are split at once.
AT_ONCE = 1_000_000
#: Rows, and bytes of text, that an operator takes from a batch at once; one text may be longer.
SOME_ROWS, SOME_BYTES = 1000, 2_000_000
_WIDTH = 64
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library keeps its own counsel
    _libc = None


def slices(batch: pa.RecordBatch, text: int, rows: int = SOME_ROWS, size: int = SOME_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most so many rows and bytes in its text column, of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        upto = min(max(upto, at + 1), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def give_back() -> None:
    """Return the memory that this process no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def released(run: Callable) -> Callable:
    """A mapInArrow function after which its worker gives the memory back that it no longer uses: workers live on from task to task, and
    what the allocators keep of several would add up in an executor."""

    @functools.wraps(run)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return work


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def tokens(text: str | None) -> list[bytes]:
    return TOKEN.findall((text or "").encode())


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte (0 between tokens, 1 in words, 2 in runs of signs), lower case, and a random number for each byte at each place."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 2
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        kind[a:b] = 1
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    return kind, lower, np.random.default_rng(11).integers(1, 2**63, (_WIDTH, 256), dtype=np.uint64).ravel()


_KIND, _LOWER, _PARTS = _tables()


def hashed(texts: list[str | None], signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all the texts (with ``signs``: of their tokens), and how many each text has.

    A hash is a sum of one random number for each byte at its place, so equal words have equal hashes in every process.
    """
    raw = [(t or "").encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    if size.sum() > AT_ONCE and len(raw) > 1:
        half = max(1, min(len(raw) - 1, int(np.searchsorted(np.cumsum(size), size.sum() // 2))))
        return tuple(np.concatenate(x) for x in zip(hashed(texts[:half], signs), hashed(texts[half:], signs), strict=True))
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    kind = _KIND[data]
    if not signs:
        data, kind = _LOWER[data], kind & 1
    start = np.concatenate([[True], kind[1:] != kind[:-1]])
    begin = np.flatnonzero(start)
    length = np.diff(begin, append=len(data))
    place = np.arange(len(data)) - np.repeat(begin, length)
    parts = _PARTS[((place & (_WIDTH - 1)) << 8) + data]
    if length.max() > _WIDTH:
        parts = parts * (2 * (place // _WIDTH) + 1).astype(np.uint64)
    real = kind[begin] > 0
    found = mixed(np.add.reduceat(parts, begin)[real])
    ends = np.cumsum(size + 1)
    upto = np.searchsorted(begin[real], ends)
    return found, np.diff(upto, prepend=0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for every n consecutive hashes; of a shorter sequence, one for all of it."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mixed(h[k : k + len(out)] + np.uint64(k + 1))
    return mixed(out + np.uint64(n))


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each of consecutive segments, which may be empty."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]
