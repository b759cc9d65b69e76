"""Token ids of whole texts by the public byte-level BPE vocabulary.

Byte-level BPE never merges across the pieces its split pattern makes. A batch of texts is split into pieces on its bytes, all
at once; pieces are looked up by a 64-bit hash in a bounded table of pieces seen before, only new ones go to the
tokenizer, and the batch's ids are gathered at once. A text with a character beyond a plain set (ASCII and the Latin letters from
U+00C0 to U+023F) or with a piece of over 64 bytes goes to the tokenizer whole. Strings of special tokens in a text
are ordinary text.
"""

from __future__ import annotations

import os

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Pieces that the table may hold between batches (its slots: four times as many), and the longest piece, in bytes.
TABLE_SIZE, PIECE_BYTES = 200_000, 64
#: Bytes of text that are split into pieces at once.
AT_ONCE = 1_000_000
_LETTER, _NUMBER, _SIGN, _SPACE, _WHITE, _BREAK, _ODD = range(7)

_loaded: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _kinds() -> np.ndarray:
    """The kind of each byte of a plain text; letters beyond ASCII are two bytes, both of the kind letter."""
    kind = np.full(256, _ODD, np.uint8)
    kind[0x21:0x7F] = _SIGN
    for a, b, k in ((0x41, 0x5B, _LETTER), (0x61, 0x7B, _LETTER), (0x30, 0x3A, _NUMBER), (0x80, 0xC0, _LETTER), (0xC3, 0xC9, _LETTER)):
        kind[a:b] = k
    kind[0x20], kind[[0x09, 0x0A, 0x0D]], kind[0] = _SPACE, _WHITE, _BREAK
    return kind


_KIND = _kinds()


def piece_starts(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the vocabulary's split pattern begins a piece, in plain texts that each end with a zero byte.

    A run of letters, of digits or of other signs is a piece, with one space before it if there is one; so is a run of
    white space, but for its last character where something follows; so are 's 't 're 've 'm 'll 'd at the start of a piece.
    """
    white = (kind == _SPACE) | (kind == _WHITE)
    before = np.concatenate([[_BREAK], kind[:-1]])
    white_before = np.concatenate([[False], white[:-1]])
    follows = np.concatenate([~white[1:] & (kind[1:] != _BREAK), [False]])
    start = np.where(white, follows | ~white_before, (kind != before) & (before != _SPACE))
    start |= kind == _BREAK
    quote = np.flatnonzero(start & (raw == 0x27))
    if len(quote):
        one, two = (raw[np.minimum(quote + k, len(raw) - 1)] for k in (1, 2))
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for rows, n in ((quote[short], 2), (quote[long], 3)):
            start[rows + 1] = False
            after = rows + n
            start[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end_id = end_id
        # a byte-level token has one character for each byte it stands for
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        # a piece's hash is the sum of one random number for each byte at its place
        self.parts = np.random.default_rng(7).integers(1, 2**63, (PIECE_BYTES, 256), dtype=np.uint64).ravel()
        bits = int(np.ceil(np.log2(4 * TABLE_SIZE)))
        self.shift = np.uint64(63 - bits)
        self.slots = (1 << bits) + 64
        self._fill(self.parts[:1].copy(), np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64))

    def _fill(self, hashes: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, uses: np.ndarray) -> None:
        """Begin the table anew with these pieces, the text end first."""
        self.hashes, self.ids, self.start, self.size, self.uses = hashes, ids, start, size, uses
        self.key, self.number = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self._insert(hashes, np.arange(len(hashes)))

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes & np.uint64(2**63 - 1)) >> self.shift).astype(np.int64)

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot = self._first(hashes)
        while len(hashes):
            free = np.flatnonzero(self.key[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)  # of those that meet in a free slot, one takes it
            won = free[one]
            self.key[slot[won]], self.number[slot[won]] = hashes[won], numbers[won]
            rest = np.ones(len(hashes), bool)
            rest[won] = False
            hashes, numbers, slot = hashes[rest], numbers[rest], (slot[rest] + 1) % self.slots

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for those that are new."""
        slot = self._first(hashes)
        found = self.key[slot]
        out = np.where(found == hashes, self.number[slot], -1)
        left = np.flatnonzero((found != hashes) & (found != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) % self.slots
            found = self.key[slot]
            hit = found == hashes[left]
            out[left[hit]] = self.number[slot[hit]]
            on = ~hit & (found != 0)
            left, slot = left[on], slot[on]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _learn(self, raw: np.ndarray, kind: np.ndarray, hashes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Give numbers and ids to pieces that are not in the table."""
        first = len(self.hashes)
        start, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        parts, base = [self.ids], len(self.ids)
        # words of letters after a space: as one text, which the tokenizer splits into the same pieces
        plain = (raw[begin] == 0x20) & (kind[begin + 1] == _LETTER)
        rows = np.flatnonzero(plain)
        for at in range(0, len(rows), 4000):
            some = rows[at : at + 4000]
            ends = np.cumsum(length[some])
            text = raw[np.repeat(begin[some] - (ends - length[some]), length[some]) + np.arange(ends[-1])]
            (got,) = self.encode([text.tobytes().decode()])
            cuts = np.concatenate([[0], np.searchsorted(np.cumsum(self.n_bytes[got]), ends) + 1])
            start[some], size[some] = base + cuts[:-1], np.diff(cuts)
            parts.append(got)
            base += len(got)
        rows = np.flatnonzero(~plain).tolist()
        for at in range(0, len(rows), 4000):
            some = rows[at : at + 4000]
            for k, got in zip(some, self.encode([raw[begin[k] : begin[k] + length[k]].tobytes().decode() for k in some]), strict=True):
                start[k], size[k] = base, len(got)
                parts.append(got)
                base += len(got)
        self.ids = np.concatenate(parts)
        self.hashes, self.start, self.size = (np.concatenate(x) for x in ((self.hashes, hashes), (self.start, start), (self.size, size)))
        self.uses = np.append(self.uses, np.zeros(len(hashes), np.int64))
        if len(self.hashes) * 2 > self.slots:  # a batch may bring more new pieces than the table is meant to keep
            while len(self.hashes) * 2 > self.slots:
                self.slots, self.shift = 2 * (self.slots - 64) + 64, self.shift - np.uint64(1)
            self._fill(self.hashes, self.ids, self.start, self.size, self.uses)
        else:
            self._insert(hashes, np.arange(first, len(self.hashes)))

    def _thin(self) -> None:
        """Keep the half of the table that was used most, of what was used more than once."""
        order = np.argsort(-self.uses, kind="stable")[: TABLE_SIZE // 2]
        rows = np.union1d(order[self.uses[order] > 1], [0])
        size = self.size[rows]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[rows] - (ends - size), size) + np.arange(ends[-1])]
        self._fill(self.hashes[rows], ids, ends - size, size, self.uses[rows] // 2)

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts with their end ids, the number of each, and which texts must go to the tokenizer whole."""
        raw = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        kind = _KIND[raw]
        breaks = np.flatnonzero(raw == 0)
        begin = piece_starts(raw, kind)
        length = np.diff(begin, append=len(raw))
        bad = [np.flatnonzero(kind == _ODD), begin[length > PIECE_BYTES], np.flatnonzero(((raw[1:] == 0x97) | (raw[1:] == 0xB7)) & (raw[:-1] == 0xC3))]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(breaks, np.concatenate(bad))] = True
        if odd.any():
            return raw, begin, odd
        place = np.arange(len(raw)) - np.repeat(begin, length)
        hashes = np.add.reduceat(self.parts[(place << 8) + raw], begin)
        hashes |= np.uint64(1)
        hashes[raw[begin] == 0] = self.hashes[0]
        numbers = self._find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            _, one = np.unique(hashes[new], return_index=True)
            one = new[one]
            self._learn(raw, kind, hashes[one], begin[one], length[one])
            numbers[new] = self._find(hashes[new])
        size = self.size[numbers]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[numbers] - (ends - size), size) + np.arange(ends[-1])]
        lengths = np.diff(ends[np.searchsorted(begin, breaks)], prepend=0)
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        if len(self.hashes) > TABLE_SIZE:
            self._thin()
        return ids, lengths, odd

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all the texts, each with the end id after it, and how many each has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = [(t or "").encode() for t in texts]
        ends = np.cumsum([len(t) for t in raw])
        if ends[-1] > AT_ONCE and len(texts) > 1:
            half = max(1, min(len(texts) - 1, int(np.searchsorted(ends, ends[-1] // 2))))
            return tuple(np.concatenate(x) for x in zip(self.batch(texts[:half]), self.batch(texts[half:]), strict=True))
        odd = np.array([b"\0" in t for t in raw])
        rows = np.flatnonzero(~odd)
        ids, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        while len(rows):
            ids, lengths, found = self._plain([raw[k] for k in rows.tolist()])
            if not found.any():
                break
            odd[rows[found]] = True
            rows = rows[~found]
            ids, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not odd.any():
            return ids, lengths
        out: list = [None] * len(texts)
        for k, part in zip(rows.tolist(), np.split(ids, np.cumsum(lengths)[:-1]) if len(rows) else [], strict=True):
            out[k] = part
        whole = np.flatnonzero(odd).tolist()
        for k, part in zip(whole, self.encode([texts[k] for k in whole]), strict=True):
            out[k] = np.append(part, np.uint32(self.end_id))
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
