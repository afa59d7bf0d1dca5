"""Vectorised work on whole Arrow batches of texts: spans, hashes, lookups.

Texts stay UTF-8 bytes in NumPy arrays.  A batch is worked off in chunks of
about ``CHUNK`` bytes cut between documents, which bounds temporary memory; one
longer document makes one longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

CHUNK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_TABLE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def widened(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` and more columns behind it."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items())])


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n+1 offsets; a null counts as empty."""
    array = array.cast(pa.large_binary() if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else pa.large_string())
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_large_binary(array.type) else "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class _Powers:
    """Powers of the hash base and of its inverse, grown when needed."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, CHUNK + (1 << 16))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(n, base, U)
                p[0] = 1
                setattr(cls, name, np.cumprod(p, dtype=U))


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Sums from which span_hash gets the hash of any span of bytes."""
    n = len(data)
    _Powers.to(n + 1)
    out = np.zeros(n + 1, U)
    v = (_FOLDED if fold else _TABLE)[data]
    v *= _Powers.up[:n]
    np.cumsum(v, dtype=U, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes have equal hashes wherever they lie."""
    h = (sums[ends] - sums[starts]) * _Powers.down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each document's words: spans at[d] to at[d+1] (relative offsets)."""
    word = np.zeros(len(data) + 1, bool)
    np.logical_not(_WHITE[data], out=word[:-1])
    change = word.copy()
    change[1:] ^= word[:-1]
    change[0] = word[0]
    inner = at[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    split = inner[word[inner] & word[inner - 1]]
    edges = np.flatnonzero(change)
    if len(split):
        edges = np.sort(np.concatenate([edges, split, split]))
    starts, ends = edges[0::2], edges[1::2]
    return starts, ends, np.searchsorted(starts, at)


class HashIndex:
    """Open addressing from non-zero 64-bit keys to 32-bit values, whole arrays at a time."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, U)
        self.vals = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9FB21C651E98DF25)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where absent."""
        slot = self._slots(keys)
        k = self.keys[slot]
        out = np.where(k == keys, self.vals[slot], np.int32(-1))
        todo = np.flatnonzero((k != keys) & (k != 0))
        slot = slot[todo]
        last = (1 << self.bits) - 1
        while len(todo):
            slot = (slot + 1) & last
            k, want = self.keys[slot], keys[todo]
            hit = k == want
            out[todo[hit]] = self.vals[slot[hit]]
            on = ~hit & (k != 0)
            todo, slot = todo[on], slot[on]
        return out

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Adds keys that are distinct and absent."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            live = np.flatnonzero(self.keys)
            old, held = self.keys[live], self.vals[live]
            while 2 * (self.n + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.vals = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int32)
            self._put(old, held)
        self._put(keys, vals)
        self.n += len(keys)

    def _put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        slot, last = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = np.zeros(len(keys), bool)
            mine[free] = self.keys[slot[free]] == keys[free]
            self.vals[slot[mine]] = vals[mine]
            keys, vals, slot = keys[~mine], vals[~mine], (slot[~mine] + 1) & last


def flat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start, ``count`` numbers each."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of rows in which all columns stay the same."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n)


class SpanCache:
    """Ids of byte spans, worked out once a span: hash -> a run in one flat store.

    ``encode`` takes a list of byte strings and returns (flat ids, counts).
    Beyond ``most`` spans the store starts afresh, which bounds memory.
    """

    def __init__(self, encode, most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.reset()

    def reset(self) -> None:
        self.index = HashIndex(16)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def find(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each span's number in the store."""
        if self.index.n > self.most:
            self.reset()
        if not len(hashes):
            return np.zeros(0, np.int32)
        hashes = np.maximum(hashes, U(1))
        got = self.index.find(hashes)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            new, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            raw = data.tobytes()
            s, e = starts[miss[first]].tolist(), ends[miss[first]].tolist()
            ids, counts = self.encode([raw[a:b] for a, b in zip(s, e, strict=True)])
            n, k = self.index.n, len(new)
            while n + k > len(self.starts):
                self.starts, self.counts = np.concatenate([self.starts, self.starts]), np.concatenate([self.counts, self.counts])
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, self.ids])
            self.ids[self.used : self.used + len(ids)] = ids
            self.counts[n : n + k] = counts
            self.starts[n : n + k] = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            self.index.add(new, np.arange(n, n + k, dtype=np.int32))
            got[miss] = (n + back).astype(np.int32)
        return got

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.counts[numbers].astype(np.int64)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these spans in a row, and how many each has."""
        counts = self.sizes(numbers)
        return self.ids[flat_ranges(self.starts[numbers], counts)], counts
