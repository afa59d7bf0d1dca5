"""Order-preserving packing by dynamic programming over cut points.

The documents of a partition make one stream of ids.  Cut points are the ends of
documents and of sentences.  With ``f(j)`` the least cost of all sequences that
end at cut point j,

    f(j) = penalty(j) + min over i of  f(i) + padding(p_j - p_i),   p_j - p_i <= width

where padding(n) is width - n, so the minimum of f(i) + p_i over a sliding window
is at the head of a monotone queue; a power of two needs no padding, and those
few transitions are looked up apart.  A partition is packed by one task in blocks
of bounded size, without a shuffle; the last sequence of a block goes on into the
next block.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strataq.llm.batch import SpanCache, chunks, column, prefix_hash, span_hash, text_bytes, word_spans
from strataq.llm.bpe import read_file
from strataq.llm.shared import bound_batches, frugal

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_workers: dict[int, tuple] = {}


def word_tables(key: int, text) -> tuple[SpanCache, np.ndarray]:
    """A cache of the ids of space-separated words, and which ids end a sentence.

    The word-level tokenizer drops white space and never joins across it, so a
    text's ids are those of its words in a row.
    """
    if key not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(text())

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            made = [e.ids for e in t.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            return np.array([i for x in made for i in x], np.int32), np.fromiter(map(len, made), np.int64, len(made))

        vocab = t.get_vocab()
        stops = np.zeros(max(vocab.values()) + 1, bool)
        stops[[i for s, i in vocab.items() if (w := s.removesuffix("</w>")) and not w.strip(".!?")]] = True
        _workers.clear()
        _workers[key] = SpanCache(encode), stops
    return _workers[key]


def word_ids(tables: tuple, array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cache = tables[0]
    data, at = text_bytes(array)
    for i, j in chunks(at):
        part, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
        s, e, docs = word_spans(part, offsets)
        ids, counts = cache.gather(cache.find(part, span_hash(prefix_hash(part), s, e), s, e))
        yield ids, np.concatenate([[0], np.cumsum(counts)])[docs]


def best_cuts(points: np.ndarray, penalty: np.ndarray, width: int, least: int = 6) -> list[int]:
    """Indices into ``points`` (from 0 to the stream's end, gaps of ``width`` at most) at which sequences end, at least cost."""
    exact: list[list[int]] = [[] for _ in points]
    k = 1 << least
    while k <= width:
        want = points - k
        i = np.searchsorted(points, want)
        for j in np.flatnonzero((want >= 0) & (points[np.minimum(i, len(points) - 1)] == want)).tolist():
            exact[j].append(int(i[j]))
        k *= 2
    p, pen = points.tolist(), penalty.tolist()
    n = len(p)
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        pj = p[j]
        while p[queue[0][1]] < pj - width:
            queue.popleft()
        g, i = queue[0]
        best = g + width - pj
        for x in exact[j]:
            if cost[x] < best:
                best, i = cost[x], x
        best += pen[j]
        cost[j], back[j] = best, i
        g = best + pj
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def split_tail(length: int, width: int, penalty: float) -> list[int]:
    """Lengths for the last ids of a partition: powers of two, unless padding is cheaper."""
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return parts if penalty * (len(parts) - 1) < width - length else [length]


class Packer:
    """Packs one partition's documents."""

    def __init__(self, first: int, width: int, sentence: float, inside: float, block: int):
        self.sequence, self.width, self.sentence, self.inside, self.block = first, width, sentence, inside, block
        self.rows: list[tuple] = []
        self.docs: list[tuple[int, np.ndarray, np.ndarray, int]] = []  # id, ids, sentence ends, ids before these
        self.size = 0

    def add(self, doc: int, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc, ids, ends, 0))
        self.size += len(ids)
        if self.size >= self.block:
            self.flush(False)

    def flush(self, last: bool) -> None:
        if not self.docs:
            return
        points, cost, at = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, ends, _ in self.docs:
            ends = ends[ends < len(ids)]
            points += [ends + at, [at + len(ids)]]
            cost += [np.full(len(ends), self.sentence), [0.0]]
            at += len(ids)
        p, c = np.concatenate(points), np.concatenate(cost)
        step = max(1, self.width // 64)
        gaps = np.flatnonzero(np.diff(p) > 2 * step)
        if len(gaps):  # long sentences can be cut too, at a higher penalty
            more = np.concatenate([np.arange(p[g] + step, p[g + 1], step) for g in gaps])
            p, c = np.concatenate([p, more]), np.concatenate([c, np.full(len(more), self.inside)])
            order = np.argsort(p)
            p, c = p[order], c[order]
        stops = p[best_cuts(p, c, self.width)].tolist()
        start = stops[-2] if len(stops) > 1 else 0
        if last:
            tail = split_tail(stops.pop() - start, self.width, self.inside)
            stops += np.cumsum([start, *tail])[1:].tolist()
        elif len(stops) > 1:
            stops.pop()
        self.emit(stops)

    def emit(self, stops: list[int]) -> None:
        at, k, filled, keep = 0, 0, 0, []
        for doc, ids, ends, before in self.docs:
            lo, n = 0, len(ids)
            while lo < n and k < len(stops):
                take = min(n - lo, stops[k] - at - lo)
                self.rows.append((doc, before + lo, take, zlib.crc32(ids[lo : lo + take].astype("<u4")), before + n, self.sequence, filled))
                lo += take
                filled += take
                if at + lo == stops[k]:
                    k, filled, self.sequence = k + 1, 0, self.sequence + 1
            if lo < n:
                keep.append((doc, ids[lo:], ends[ends > lo] - lo, before + lo))
            at += n
        self.docs, self.size = keep, sum(len(x[1]) for x in keep)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [()] * len(names))], names)


def pack(df: DataFrame, vocab_path: str, width: int = 4096, end_id: int = 2, sentence: float = 2.0, inside: float = 24.0, block: int = 1 << 20, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents, in the order in which partitions hold them, into sequences of at most ``width`` ids.

    A null text counts as empty: such a document is its ``end_id`` alone.  One row
    per piece.  ``sequence_id`` has the partition in its upper bits, so that tasks
    need nothing from each other and a task that runs again gives the same rows.
    A sequence whose length is a power of two needs no padding: the last ids of each
    partition, fewer than ``width``, become up to log2(``width``) such sequences, one for
    each bit of their number, unless padding costs less than the cuts.
    ``sentence`` and ``inside`` are the penalties of a cut at a sentence's end and
    within a sentence, in ids of padding.
    """
    bound_batches(df.sparkSession)
    content = read_file(vocab_path)
    spec, key = df.sparkSession.sparkContext.broadcast(content), zlib.crc32(content.encode())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = word_tables(key, lambda: spec.value)
        packer = Packer(TaskContext.get().partitionId() << 36, width, sentence, inside, block)
        for b in batches:
            docs, k = column(b, key_column).to_pylist(), 0
            for flat, at in word_ids(tables, column(b, text)):
                stop = np.flatnonzero(tables[1][flat]) + 1
                first = np.searchsorted(stop, at, "right").tolist()
                for d, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    packer.add(docs[k], np.append(flat[i:j], np.int32(end_id)), stop[first[d] : first[d + 1]] - i)
                    k += 1
                if packer.rows:
                    yield packer.take()
        packer.flush(True)
        yield packer.take()

    return df.select(key_column, text).mapInArrow(run, SCHEMA)
