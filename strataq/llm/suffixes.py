"""Removal of repeated passages by longest previous factors.

A byte goes if it is covered by a string of ``width`` bytes that also starts in a
document with a smaller key: if a suffix that starts in reach has a longest previous
factor, over smaller documents, of ``width`` or more.

The suffixes are dealt out without breaking a match.  Every window of ``width``
bytes has one anchor, the leftmost of the least-hashed GRAM-byte strings inside it;
equal windows have equal anchors at equal offsets, so all windows of one anchor, a
short context, go to one place.

1. Anchors that occur in one document only are sorted out first: sorted hashes
   travel in packed blocks, and documents learn which of their anchors are shared.
2. Contexts of shared anchors travel in packed blocks, sorted by anchor; equal
   contexts within a task are settled there, the smallest document asking for all.
3. Each place puts its suffixes in order, with the common prefix of neighbours, finds
   the previous and next smaller document of each, and from them the longest previous
   factors; suffixes whose factor reaches ``width`` give the spans to remove.

Questions travel by range of the hash, answers by bucket of the document, both packed:
a row for each sender and receiver, not one for each document.  Places take one range
at a time.  The anchors that most documents hold, HOT of each range, are cut up by the
bytes around them: windows with an anchor at nearly the same offset share all but a few
bytes, and the hash of the shared ones is the key.  So no anchor left whole has more
than a fifth of a range's documents, and what one cut piece gathers is bounded by the
strings of STEP - 1 bytes that stand on either side of it, once for each task.
Texts are shuffled once; both joins read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from strataq.llm.batch import CHUNK, U, _Powers, chunks, column, flat_ranges, mix, prefix_hash, runs, span_hash, text_bytes
from strataq.llm.shared import bound_batches, frugal, materialise

GRAM, STEP, HOT, HOT_LEAST = 32, 5, 4, 256
FLUSH_ANCHORS, FLUSH_DOCS, FLUSH_BYTES, FLUSH_ANSWERS, SLICE = 1_000_000, 60_000, 24 << 20, 1_000_000, 250_000
NONE, NO_U = np.zeros(0, np.int64), np.zeros(0, U)


def planes(x: np.ndarray) -> bytes:
    """Little-endian bytes, all first ones, all second ones, ...: small numbers leave long runs of zeros."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    size, have = 1, x
    while 2 * size <= span:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[: len(have) - (span - size)], have[span - size :]) if size < span else have


def anchors(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of documents: each anchor's document, hash, and first and last window start, and where it stands."""
    n = len(data)
    if n < width:
        return NONE, NO_U, NONE, NONE, NONE
    sums = prefix_hash(data)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * _Powers.down[: n - GRAM + 1])
    span = width - GRAM + 1
    # The place, modulo 64, breaks ties; where it wraps inside the window, it counts from 32 on.
    top, spot = h & ~U(63), np.arange(len(h), dtype=U)
    plain, late = sliding_least(top | (spot & U(63)), span), sliding_least(top | ((spot + U(32)) & U(63)), span)
    starts = np.arange(len(plain))
    wraps = (starts & 63) + span > 64
    away = np.where(wraps, (late & U(63)).astype(np.int64) - 32 - starts, (plain & U(63)).astype(np.int64) - starts) & 63
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(starts)]
    ok = starts + width <= at[1:][doc]
    starts, doc, away = starts[ok], doc[ok], away[ok]
    if not len(starts):
        return NONE, NO_U, NONE, NONE, NONE
    place = starts + away
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    # Least hashes are small numbers: mixed again, they fill all ranges alike.
    return doc[first], mix(h[place[first]] ^ U(0xA0761D6478BD642F)), starts[first], starts[last], place[first]


def _by_range(h48: np.ndarray, ranges: int) -> np.ndarray:
    return ((h48 >> U(16)) * U(ranges) >> U(32)).astype(np.int64)


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(U)) % U(buckets)).astype(np.int64)


def within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


PACK = "place int, bucket int, a binary, b binary, c binary, d binary, e binary"
NAMES = ["place", "bucket", *"abcde"]


def packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], NAMES)


def keyed(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each key in turn, from a partition in order of the key."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = column(b, name).to_numpy()
        for i, j in zip(*(x.tolist() for x in runs(keys)), strict=True):
            if held and keys[i] != now:
                yield int(now), held
                held = []
            now = keys[i]
            held.append(b.slice(i, j - i))
    if held:
        yield int(now), held


def split_off(parts: list[pa.RecordBatch]) -> tuple[list[tuple], list[pa.RecordBatch]]:
    """Questions as tuples (a, b, c, d, e); answers on their way to a bucket as they are."""
    asked, passing = [], []
    for b in parts:
        answer = column(b, "bucket").is_valid()
        own = b.filter(answer)
        if own.num_rows:
            passing.append(own)
        asked += zip(*(c.to_pylist() for c in b.filter(pc.invert(answer)).columns[2:]), strict=True)
    return asked, passing


class Answers:
    """What documents are told, and which rows there are, packed by bucket."""

    def __init__(self, places: int):
        self.places = places
        self.clear()

    def clear(self) -> None:
        self.told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.there: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def tell(self, doc: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        self.told.append((doc, x.astype(U), y.astype(U)))
        self.n += len(doc)

    def rows(self) -> list[tuple]:
        out: dict[int, list[bytes]] = {}
        for groups, slot in ((self.told, 0), (self.there, 3)):
            if not groups:
                continue
            cols = [np.concatenate(c) for c in zip(*groups, strict=True)]
            bucket = bucket_of(cols[0], self.places)
            order = np.lexsort((cols[1], cols[0], bucket))
            bucket, cols = bucket[order], [c[order] for c in cols]
            for i, j in zip(*(x.tolist() for x in runs(bucket)), strict=True):
                row = out.setdefault(int(bucket[i]), [b""] * 5)
                for k, c in enumerate(cols):
                    row[slot + k] = planes(c[i:j].view(U))
        self.clear()
        return [(k, k, *v) for k, v in out.items()]


def unpacked(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's answers (document, two values), and its distinct documents and rows, in order."""
    got: list[list[np.ndarray]] = [[NO_U] for _ in range(5)]
    for b in parts:
        for k, name in enumerate("abcde"):
            got[k] += [unplanes(x) for x in column(b, name).to_pylist() if x]
    doc, x, y, there, row = (np.concatenate(g) for g in got)
    order = np.lexsort((row.view(np.int64), there.view(np.int64)))
    there, row = there[order].view(np.int64), row[order].view(np.int64)
    first, _ = runs(there, row)
    return doc.view(np.int64), x, y, there[first], row[first]


class Survey:
    """Step 1 in a task: which anchors to ask about, which are known to be shared."""

    def __init__(self, ranges: int, places: int):
        self.ranges, self.answers = ranges, Answers(places)
        self.clear()

    def clear(self) -> None:
        self.h: list[np.ndarray] = []
        self.d: list[np.ndarray] = []
        self.n, self.docs = 0, 0

    def add(self, keys: np.ndarray, rows: np.ndarray, doc: np.ndarray, h: np.ndarray) -> None:
        self.h.append(h >> U(16))
        self.d.append(keys[doc])
        self.n += len(h)
        self.docs += len(keys)
        some = np.unique(doc)
        self.answers.there.append((keys[some], rows[some]))

    def rows(self) -> pa.RecordBatch:
        h, d = np.concatenate([NO_U, *self.h]), np.concatenate([NONE, *self.d])
        self.clear()
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        first, _ = runs(h, d)
        h, d = h[first], d[first]
        first, end = runs(h)
        count = end - first
        many = np.repeat(count > 1, count)
        ask_h, ask_d, tell, told = h[~many], d[~many], h[first[count > 1]], count[count > 1]
        edges = np.arange(self.ranges + 1)
        a, t = np.searchsorted(_by_range(ask_h, self.ranges), edges).tolist(), np.searchsorted(_by_range(tell, self.ranges), edges).tolist()
        out: list[tuple] = []
        for r in range(self.ranges):
            i, j, k, m = a[r], a[r + 1], t[r], t[r + 1]
            if i < j or k < m:
                out.append((r, None, planes(np.diff(ask_h[i:j], prepend=U(0))), planes(ask_d[i:j].view(U)), planes(np.diff(tell[k:m], prepend=U(0))), planes(told[k:m]), b""))
        self.answers.tell(d[many], h[many] & U(0xFFFFFFFF), np.zeros(int(many.sum()), U))
        return packed(out + self.answers.rows())


def settle_survey(places: int):
    """Step 1 in a place: tells documents which of their anchors are shared, and names the range's hot anchors (bucket -1)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(places)
        for _, parts in keyed(batches, "place"):
            asked, passing = split_off(parts)
            yield from passing
            if not asked:
                continue
            h = np.concatenate([np.cumsum(unplanes(q[0]), dtype=U) for q in asked])
            d = np.concatenate([unplanes(q[1]).view(np.int64) for q in asked])
            t = np.concatenate([np.cumsum(unplanes(q[2]), dtype=U) for q in asked])
            told = np.concatenate([unplanes(q[3]).view(np.int64) for q in asked])
            every = np.concatenate([h, t])
            weight = np.concatenate([np.ones(len(h), np.int64), told])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            first, end = runs(every)
            if not len(first):
                continue
            docs = np.add.reduceat(weight, first)
            shared = every[first[docs > 1]]
            hit = within(shared, h)
            answers.tell(d[hit], h[hit] & U(0xFFFFFFFF), np.zeros(int(hit.sum()), U))
            top = np.argsort(-docs, kind="stable")[:HOT]
            top = top[docs[top] >= HOT_LEAST]
            if len(top):
                yield packed([(-1, -1, every[first[top]].tobytes(), b"", b"", b"", b"")])
            if answers.n >= FLUSH_ANSWERS:
                yield packed(answers.rows())
        yield packed(answers.rows())

    return run


@frugal
def known_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document's text that has shared anchors; hot anchors stand in rows without a key."""
    for bucket, parts in keyed(batches, "bucket"):
        if bucket < 0:
            hot = [x for b in parts for x in column(b, "a").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.bool_()), pa.array(hot, pa.binary())], ["doc_id", "row", "several", "hashes"])
            continue
        doc, x, _, there, row = unpacked(parts)
        order = np.lexsort((x, doc))
        doc, x = doc[order], x[order]
        first, _ = runs(doc, x)
        doc, x = doc[first], x[first]
        low, high = np.searchsorted(doc, there, "left"), np.searchsorted(doc, there, "right")
        some = np.flatnonzero(high > low)
        several = np.zeros(len(there), bool)
        same = there[1:] == there[:-1]
        several[1:] |= same
        several[:-1] |= same
        counts = (high - low)[some]
        data = x.astype("<u4")[flat_ranges(low[some], counts)]
        yield pa.RecordBatch.from_arrays([pa.array(there[some]), pa.array(row[some]), pa.array(several[some]), binary_column(data, counts)], ["doc_id", "row", "several", "hashes"])


def binary_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes of each run of values as one binary value."""
    at = (np.concatenate([[0], np.cumsum(counts)]) * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


class Contexts:
    """Step 2 in a task: contexts of shared anchors, equal ones settled."""

    def __init__(self, ranges: int, places: int, width: int, hot: np.ndarray):
        self.ranges, self.width, self.hot, self.answers = ranges, width, hot, Answers(places)
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, data: np.ndarray, keys: np.ndarray, rows: np.ndarray, tags: np.ndarray, at: np.ndarray, doc: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> None:
        lens = last - first + self.width
        self.parts.append((h, span_hash(prefix_hash(data), first, first + lens), keys[doc], tags[doc], first - at[doc], lens, place - first))
        self.texts.append(data[flat_ranges(first, lens)])
        self.bytes += int(lens.sum())
        some = np.unique(doc)
        self.answers.there.append((keys[some], rows[some]))

    def settled(self, h: np.ndarray, c: np.ndarray, d: np.ndarray, tag: np.ndarray, pos: np.ndarray, lens: np.ndarray, off: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of equal contexts, those of the smallest document stay; the others are answered."""
        order = np.lexsort((pos, tag, d, c, h))
        h, c, d, tag, pos, lens, off, begin = (x[order] for x in (h, c, d, tag, pos, lens, off, begin))
        head, end = runs(h, c, lens)
        gone = d > np.repeat(d[head], end - head)
        self.answers.tell(d[gone], tag[gone].view(U), (pos[gone] << 32 | lens[gone]).view(U))
        ask = np.zeros(len(h), bool)
        ask[runs(h, c, d, tag, pos)[0]] = True  # a repeated row asks once
        ask &= ~gone
        return tuple(x[ask] for x in (h, c, d, tag, pos, lens, off, begin))

    def cut_up(self, text: np.ndarray, h: np.ndarray, d: np.ndarray, tag: np.ndarray, pos: np.ndarray, lens: np.ndarray, off: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Contexts of hot anchors in pieces, by the offset of the anchor; a piece's key is the hash of what its windows share."""
        out, span, i = [], self.width - GRAM + 1, 0
        reach = np.cumsum(lens)
        while i < len(h):
            j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + CHUNK, "right")))
            part = text[flat_ranges(begin[i:j], lens[i:j])]
            sums = prefix_hash(part)
            inner = np.cumsum(lens[i:j]) - lens[i:j]
            place, most, least = inner + off[i:j], off[i:j], off[i:j] - (lens[i:j] - self.width)
            for lo in range(0, span, STEP):
                hi = min(lo + STEP, span) - 1
                take = np.flatnonzero((most >= lo) & (least <= hi))
                top, low, at = np.minimum(most[take], hi), np.maximum(least[take], lo), place[take]
                key = mix(span_hash(sums, at - lo, at + GRAM + span - 1 - hi) + U((lo + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
                size = top - low + self.width
                out.append((key, span_hash(sums, at - top, at - top + size), d[i:j][take], tag[i:j][take], pos[i:j][take] + most[take] - top, size, top, begin[i:j][take] + most[take] - top))
            i = j
        return out

    def rows(self) -> pa.RecordBatch:
        if not self.parts:
            return packed(self.answers.rows())
        cols = [np.concatenate([p[i] for p in self.parts]) for i in range(7)]
        text = np.concatenate(self.texts)
        self.clear()
        h, c, d, tag, pos, lens, off, begin = self.settled(*cols, np.cumsum(cols[5]) - cols[5])
        hot = within(self.hot, h >> U(16))
        if hot.any():
            pieces = self.cut_up(text, *(x[hot] for x in (h, d, tag, pos, lens, off, begin)))
            fine = self.settled(*(np.concatenate(x) for x in zip(*pieces, strict=True)))
            h, c, d, tag, pos, lens, off, begin = (np.concatenate([x[~hot], y]) for x, y in zip((h, c, d, tag, pos, lens, off, begin), fine, strict=True))
            order = np.argsort(h, kind="stable")
            h, d, tag, pos, lens, off, begin = (x[order] for x in (h, d, tag, pos, lens, off, begin))
        codec = pa.Codec("zstd", 1)
        out: list[tuple] = []
        edges = np.searchsorted(_by_range(h >> U(16), self.ranges), np.arange(self.ranges + 1)).tolist()
        for r in range(self.ranges):
            i, j = edges[r], edges[r + 1]
            if i < j:
                where = pos[i:j] << 16 | lens[i:j] << 8 | off[i:j]
                out.append((r, None, planes(np.diff(h[i:j], prepend=U(0))), planes(d[i:j].view(U)), planes(tag[i:j].view(U)), planes(where.view(U)), codec.compress(text[flat_ranges(begin[i:j], lens[i:j])].tobytes(), asbytes=True)))
        return packed(out + self.answers.rows())


def suffix_order(text: np.ndarray, starts: np.ndarray, group: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of group, offset of the anchor, and the first ``width`` bytes; and the length of each one's common prefix with the one before it.

    The suffixes of one group and offset share the anchor, so that only the other
    bytes are compared.  A common prefix is cut at ``width`` and at the group's edge.
    """
    free = width - GRAM
    words = -(-free // 8)
    bytes_ = np.zeros((len(starts), 8 * words), np.uint8)
    for k in range(free):
        bytes_[:, k] = text[starts + k + GRAM * (k >= off)]
    keys = bytes_.view(">u8").astype(U)
    order = np.lexsort((*keys.T[::-1], group << 6 | off))
    lcp = np.zeros(len(order), np.int64)
    if len(order):
        near = bytes_[order]
        group, off = group[order], off[order]
        same = (group[1:] == group[:-1]) & (off[1:] == off[:-1])
        apart = near[1:] != near[:-1]
        first = apart.argmax(axis=1)
        differs = apart.any(axis=1)
        lcp[1:] = np.where(same, np.where(differs, first + GRAM * (first >= off[1:]), width), 0)
    return order, lcp


def smaller_before(value: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """For each place, the common prefix with the nearest place before it that has a smaller value; 0 where there is none or it is below ``least``.

    All places move at once: one whose candidate is not smaller takes the
    candidate's own candidate, between which and itself nothing smaller lies.
    """
    n = len(value)
    at, common = np.arange(-1, n - 1), lcp.copy()
    common[(at < 0) | (common < least)] = 0
    todo = np.flatnonzero(common)
    todo = todo[value[at[todo]] >= value[todo]]
    while len(todo):
        far, shared = at[at[todo]], np.minimum(common[todo], common[at[todo]])
        alive = (far >= 0) & (shared >= least)
        at[todo], common[todo] = far, np.where(alive, shared, 0)
        todo = todo[alive]
        todo = todo[value[at[todo]] >= value[todo]]
    return common


def longest_previous_factors(value: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """Of suffixes in order, each one's longest common prefix with any of smaller value, from the previous and the next smaller ones; below ``least`` it counts as 0."""
    back = np.zeros(len(lcp), np.int64)
    back[1:] = lcp[1:][::-1]
    return np.maximum(smaller_before(value, lcp, least), smaller_before(value[::-1], back, least)[::-1])


def settle_contexts(places: int, width: int):
    """Step 3: tells documents which spans to remove."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, codec = Answers(places), pa.Codec("zstd")
        for _, parts in keyed(batches, "place"):
            asked, passing = split_off(parts)
            yield from passing
            if not asked:
                continue
            got = []
            for a, b, c, d, e in asked:
                where = unplanes(d).astype(np.int64)
                lens = where >> 8 & 0xFF
                got.append((np.cumsum(unplanes(a), dtype=U), unplanes(b).view(np.int64), unplanes(c), where >> 16, lens, where & 0xFF, np.frombuffer(codec.decompress(e, int(lens.sum()), asbytes=True), np.uint8)))
            h, doc, tag, pos, lens, off, text = (np.concatenate([g[i] for g in got]) for i in range(7))
            got.clear()
            asked.clear()
            begin = np.cumsum(lens) - lens
            order = np.argsort(h, kind="stable")
            first, end = runs(h[order])
            order = order[np.repeat(end - first > 1, end - first)]
            h, doc, tag, pos, lens, off, begin = (x[order] for x in (h, doc, tag, pos, lens, off, begin))
            first, end = runs(h)
            group = np.repeat(np.arange(len(first)), end - first)
            windows = np.concatenate([[0], np.cumsum(lens - width + 1)])
            edges, i = np.append(first, len(h)), 0
            while i < len(h):  # slices of about SLICE windows, cut between anchors
                j = int(np.searchsorted(windows, windows[i] + SLICE, "right")) - 1
                j = int(edges[np.searchsorted(edges, max(j, i + 1), "left")])
                count = lens[i:j] - width + 1
                owner = np.repeat(np.arange(i, j), count)
                starts = flat_ranges(begin[i:j], count)
                order, lcp = suffix_order(text, starts, group[owner], off[owner] - (starts - begin[owner]), width)
                hit = np.sort(order[longest_previous_factors(doc[owner[order]], lcp, width) >= width])
                owner, offset = owner[hit], starts[hit] - begin[owner[hit]]
                a, z = runs(owner, offset - np.arange(len(offset)))
                who = owner[a]
                answers.tell(doc[who], tag[who], (pos[who] + offset[a]) << 32 | offset[z - 1] - offset[a] + width)
                i = j
            if answers.n >= FLUSH_ANSWERS:
                yield packed(answers.rows())
        yield packed(answers.rows())

    return run


@frugal
def found_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document's text that loses bytes: its maximal spans as pairs of numbers."""
    for _, parts in keyed(batches, "bucket"):
        doc, tag, span, there, row = unpacked(parts)
        low, high = np.searchsorted(there, doc, "left"), np.searchsorted(there, doc, "right")
        # A tag names the row where a document has several; their rows are few.
        own, of = [np.flatnonzero(high - low == 1)], [low[high - low == 1]]
        for i in np.flatnonzero(high - low > 1).tolist():
            mine = low[i] + np.flatnonzero(row[low[i] : high[i]] == tag[i : i + 1].view(np.int64)[0])
            own.append(np.full(len(mine), i))
            of.append(mine)
        own, of = np.concatenate(own), np.concatenate(of)
        start = (span[own] >> U(32)).astype(np.int64)
        merged = merge_spans(of << 32 | start, (of << 32 | start) + (span[own] & U(0xFFFFFFFF)).astype(np.int64))
        of = merged[:, 0] >> 32
        first, end = runs(of)
        which = of[first]
        pairs = (merged & 0xFFFFFFFF).astype("<i4").ravel()
        yield pa.RecordBatch.from_arrays([pa.array(there[which]), pa.array(row[which]), binary_column(pairs, 2 * (end - first))], ["doc_id", "row", "spans"])


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs of spans as (start, end) rows; touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([starts[first], reach[np.append(first[1:], len(starts)) - 1] if len(first) else first], axis=1)


def repeated_spans(df: DataFrame, width: int = 50, key_column: str = "doc_id", text: str = "text", pass_through: Sequence[str] = ()) -> DataFrame:
    """Returns all rows as (doc_id, text, row, spans, _more): which bytes of each text to remove, as packed pairs (null: none), and a struct of the columns to pass through.

    Rows with a null key take part in nothing and keep their bytes; null texts are
    empty.  Rows of equal keys never remove from each other; different texts of one key
    are told apart by 64 bits of a hash.  ``width`` lies between 40 and 62.
    """
    if not GRAM + 8 <= width <= GRAM + 30:
        raise ValueError(f"width must lie between {GRAM + 8} and {GRAM + 30}")
    spark = df.sparkSession
    bound_batches(spark)
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * places
    # No alias where none is needed: with one, the planner takes the two exchanges of the texts for different ones.
    key = F.col("doc_id") if key_column == "doc_id" and df.schema["doc_id"].dataType == T.LongType() else F.col(key_column).cast("long").alias("doc_id")
    more = [F.struct(*[F.col(c) for c in pass_through]).alias("_more")] if pass_through else []
    extra = ["_more"] if pass_through else []
    whole = F.coalesce(F.col(text), F.lit("")).alias("text")
    docs = df.select(key, whole).withColumn("row", F.xxhash64("text")).filter(F.col("doc_id").isNotNull())
    full = df.select(key, whole, *more).withColumn("row", F.xxhash64("text"))

    @frugal
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Survey(ranges, places)
        for b in batches:
            keys, rows = column(b, "doc_id").to_numpy(), column(b, "row").to_numpy()
            data, at = text_bytes(column(b, "text"))
            for i, j in chunks(at):
                doc, h, *_ = anchors(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                s.add(keys[i:j], rows[i:j], doc, h)
                if s.n >= FLUSH_ANCHORS or s.docs >= FLUSH_DOCS:
                    yield s.rows()
        yield s.rows()

    def dealt_by(packs: DataFrame, name: str) -> DataFrame:
        return packs.repartition(places, name).sortWithinPartitions(name)

    known = dealt_by(dealt_by(docs.mapInArrow(survey, PACK), "place").mapInArrow(settle_survey(places), PACK), "bucket")
    # Written, so that the shuffle files of the first step can go before those of the second come.
    known = materialise(known.mapInArrow(known_anchors, "doc_id long, row long, several boolean, hashes binary"))
    # At most HOT numbers for each range.
    hot = np.sort(np.concatenate([NO_U, *(np.frombuffer(r[0], U) for r in known.filter("doc_id IS NULL").select("hashes").collect())]))
    hot = spark.sparkContext.broadcast(hot)

    @frugal
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Contexts(ranges, places, width, hot.value)
        for b in batches:
            keys, rows = column(b, "doc_id").to_numpy(), column(b, "row").to_numpy()
            tags = np.where(column(b, "several").to_numpy(zero_copy_only=False), rows, 0)
            shared = column(b, "hashes").to_pylist()
            data, at = text_bytes(column(b, "text"))
            for i, j in chunks(at):
                part, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
                doc, h, first, last, place = anchors(part, offsets, width)
                own = np.frombuffer(b"".join(shared[i:j]), "<u4").astype(U)
                own |= np.repeat(np.arange(j - i, dtype=U), [len(x) // 4 for x in shared[i:j]]) << U(32)
                keep = within(own, doc.astype(U) << U(32) | (h >> U(16)) & U(0xFFFFFFFF))
                c.add(part, keys[i:j], rows[i:j], tags[i:j], offsets, doc[keep], h[keep], first[keep], last[keep], place[keep])
                if c.bytes >= FLUSH_BYTES:
                    yield c.rows()
        yield c.rows()

    # A join of the texts with what is known; the same exchange of the texts serves the last join.
    dealt = full.filter(F.col("doc_id").isNotNull()).repartition(places, "doc_id", "row")
    asking = dealt.join(known.filter("doc_id IS NOT NULL").hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "row", "text", "several", "hashes", *extra)
    found = dealt_by(dealt_by(asking.mapInArrow(contexts, PACK), "place").mapInArrow(settle_contexts(places, width), PACK), "bucket")
    found = found.mapInArrow(found_spans, "doc_id long, row long, spans binary")
    out = dealt.join(found.hint("shuffle_hash"), ["doc_id", "row"], "left").select("doc_id", "text", "row", "spans", *extra)
    alone = full.filter(F.col("doc_id").isNull())
    return out.unionByName(alone.withColumn("spans", F.lit(None).cast("binary")).select(*out.columns))


def kept_text(spans: np.ndarray, text: bytes) -> bytes:
    parts, at = [], 0
    for a, b in spans.tolist():
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def remove_repeats(df: DataFrame, width: int = 50, key_column: str = "doc_id", text: str = "text", pass_through: Sequence[str] = ()) -> DataFrame:
    """Returns (doc_id, text, n_removed) and the columns to pass through of every row, with the repeated bytes cut out.

    What is left of a character that loses some of its bytes is dropped too.  A column to
    pass through that is named n_removed stands in place of the number.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for t, found in zip(column(b, "text").to_pylist(), column(b, "spans").to_pylist(), strict=True):
                spans = np.frombuffer(found or b"", "<i4").reshape(-1, 2)
                texts.append(kept_text(spans, t.encode()).decode("utf-8", "ignore") if len(spans) else t)
                removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            extra = [column(b, "_more")] if pass_through else []
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), *extra], ["doc_id", "text", "n_removed", "_more"][: 3 + len(extra)])

    spans = repeated_spans(df, width, key_column, text, pass_through)
    schema = T.StructType([*T._parse_datatype_string("doc_id long, text string, n_removed long").fields, *([spans.schema["_more"]] if pass_through else [])])
    return spans.mapInArrow(run, schema).select("doc_id", "text", *(["n_removed"] if "n_removed" not in pass_through else []), *[F.col(f"_more.`{c}`").alias(c) for c in pass_through])


def repeat_digests(df: DataFrame, width: int = 50, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            data, at = text_bytes(column(b, "text"))
            whole = data.tobytes()
            for i, found in enumerate(column(b, "spans").to_pylist()):
                raw = whole[at[i] : at[i + 1]]
                spans = np.frombuffer(found or b"", "<i4").reshape(-1, 2)
                out.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept_text(spans, raw)).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(df, width, key_column, text).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
