"""Vectorised word kernel over whole batches of texts: numpy on the UTF-8 bytes, no loop over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Bytes of text in one kernel call; a longer text is a call of its own, never cut.
CHUNK_BYTES = 1_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are runs of digits, a-z and anything beyond ASCII, after lower-casing A-Z.
WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_rng = np.random.default_rng(20_240_229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def _power(n: int, base: int, key: str) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64; a table of CHUNK_BYTES is kept."""
    if key not in _powers or len(_powers[key]) < n:
        x = np.full(max(n, CHUNK_BYTES + 2), np.uint64(base))
        x[0] = 1
        made = np.cumprod(x)
        if n > CHUNK_BYTES + 2:
            return made
        _powers[key] = made
    return _powers[key][:n]


@dataclass
class Words:
    """Words of several texts: text i has words first[i] to first[i + 1]; starts and ends are byte places in data."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    text_at: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def words(texts: list[bytes]) -> Words:
    """Words of the texts, with 64-bit hashes that depend on the word alone."""
    data = b" ".join(texts).translate(LOWER)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text_at = np.concatenate([[0], np.cumsum(lengths + 1)])
    buf = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = WORD[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[buf] * _power(len(buf), BASE, "up"), out=total[1:])
    inverse = pow(BASE, -1, 2**64)
    hashes = mix((total[ends] - total[starts]) * _power(len(buf) + 1, inverse, "down")[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, hashes, np.append(np.searchsorted(starts, text_at[:-1]), len(starts)), text_at)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES together."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        if i > low and size + len(text) > CHUNK_BYTES:
            yield low, i
            low, size = i, 0
        size += len(text) + 1
    if low < len(texts):
        yield low, len(texts)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """The batches in views of a few rows, so that only those become Python objects at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of the texts one after another, the end of each text); a view, not a copy. Null is empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at[1:] - at[0]


def calls(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts, given their ends, of about `size` bytes together; a longer text is a range of its own."""
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield low, high
        low = high


def pieces_between(buf: np.ndarray, begins: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct pieces, number of each piece) of bytes cut at `begins`; the first begin is 0."""
    offsets = pa.array(np.append(begins, len(buf)), pa.int64())
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, offsets.buffers()[1], pa.py_buffer(buf)])
    coded = cut.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


class Slots:
    """The ids of remembered byte strings, which stand in numbered slots of one flat array. `limit` strings and `room` bytes of them bound
    the memory: with more, those which no second call has asked for are forgotten (all, if that leaves over half of either), and learnt
    again where they occur. What one call asks for is held during that call, whatever its size."""

    def __init__(self, limit: int, room: int = 64 << 20):
        self.limit, self.room = limit, room
        self.clear()

    def clear(self) -> None:
        self.slot_of: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.ends, self.calls = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _forget(self) -> None:
        n = len(self.slot_of)
        kept = np.flatnonzero(self.calls[:n] > 1)
        if len(kept) > self.limit // 2:
            kept = kept[:0]
        every = list(self.slot_of)  # in the order of their slots
        if sum(len(every[k]) for k in kept.tolist()) > self.room // 2:
            kept = kept[:0]
        strings, sizes = [every[k] for k in kept.tolist()], self.ends[kept + 1] - self.ends[kept]
        ids = self.gathered(kept)[0]
        self.clear()
        self.append(strings, ids, sizes)

    def append(self, strings: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """The strings' ids, one after another, as the next slots."""
        n = len(self.slot_of)
        used = int(self.ends[n])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(strings) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.calls = np.concatenate([self.calls, np.zeros_like(self.calls)])
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(strings)] = used + np.cumsum(sizes)
        self.slot_of.update(zip(strings, range(n, n + len(strings)), strict=True))
        self.held += sum(map(len, strings))

    def slots(self, distinct: list[bytes], learn: Callable[[list[bytes]], None]) -> np.ndarray:
        """The slot of each string; `learn` appends those that are new."""
        if len(self.slot_of) > self.limit or self.held > self.room:
            self._forget()
        found = np.fromiter(map(self.slot_of.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            learn(new)
            found[missing] = np.fromiter(map(self.slot_of.__getitem__, new), np.int64, len(new))
        self.calls[found] += 1
        return found

    def gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slots one after another, how many ids stand before each slot and at the end)."""
        begin = self.ends[slots]
        sizes = self.ends[slots + 1] - begin
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(begin - upto[:-1], sizes) + np.arange(upto[-1])], upto
