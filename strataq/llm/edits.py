"""Edit-aware token counts.

A document's pre-tokens are the leaves of a segment tree that holds their token counts
and bytes, with sums above.  An edit re-encodes only the pre-tokens it touches and
a little context: the byte-level pattern scans from left to right and looks at
most three characters ahead, so pre-tokens that end earlier than that stay, and
once a new pre-token begins where an old one began behind the edit, all later
ones stay too.  What was encoded anew goes into the first leaf that it replaces, the
other ones are emptied, and the sums above them are set anew; places are found by the
sums of bytes.  So a tree takes one batch of edits after another, and can be kept.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataq.llm.batch import chunks, column, prefix_hash, span_hash, text_bytes
from strataq.llm.bpe import read_file, worker
from strataq.llm.shared import bound_batches, frugal

Edit = tuple[int, int, bytes]
LOOK = 32  # bytes: three characters, or a special token
_HOST = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(rb"[0-9](?:[ -]?[0-9]){6,}")


def addresses(text: bytes) -> Iterator[tuple[int, int]]:
    """E-mail addresses, found from the sign backwards and forwards, so that long runs without one cost nothing."""
    done = at = 0
    while m := _HOST.search(text, at):
        start = m.start()
        while start > done and text[start - 1] in _NAME:
            start -= 1
        at = m.start() + 1
        if start < m.start():
            yield start, m.end()
            done = at = m.end()


def digit_runs(text: bytes) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _DIGITS.finditer(text))


#: What the registered query edits: e-mail addresses and long digit runs give way to a placeholder.
REDACTIONS: tuple[tuple[Callable[[bytes], Iterator[tuple[int, int]]], bytes], ...] = ((addresses, b"<email>"), (digit_runs, b"<number>"))


def find_edits(text: bytes, redactions=REDACTIONS) -> list[Edit]:
    """Spans that redactions (a function from text to spans, and what is put there) find, in order; of overlapping ones the first."""
    found = sorted((a, b, new) for spans, new in redactions for a, b in spans(text))
    out: list[Edit] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def encode_text(tables: tuple, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of a text's pre-tokens and their token counts."""
    _, pre, cache = tables
    data = np.frombuffer(text, np.uint8)
    s, e, _ = pre.spans(data, np.array([0, len(data)]))
    return s, cache.sizes(cache.find(data, span_hash(prefix_hash(data), s, e), s, e))


class TokenTree:
    """Leaves with bytes and token counts, and their sums; ``sums[1]`` is the whole.

    A leaf is a pre-token, or what an edit put in its place: ``changed`` has the text and
    the inner starts of such leaves.
    """

    def __init__(self, text: bytes, starts: np.ndarray, counts: np.ndarray):
        self.origin, self.starts = text, np.append(starts, len(text)).astype(np.int64)
        self.changed: dict[int, tuple[bytes, np.ndarray]] = {}
        self.leaves = max(1, len(starts))
        width = 1
        while width < self.leaves:
            width *= 2
        self.width = width
        self.sums = np.zeros((2 * width, 2), np.int64)
        if len(starts):
            self.sums[width : width + len(starts), 0] = np.diff(self.starts)
            self.sums[width : width + len(starts), 1] = counts
        else:
            self.changed[0] = b"", np.zeros(0, np.int64)
        while width > 1:
            self.sums[width // 2 : width] = self.sums[width : 2 * width : 2] + self.sums[width + 1 : 2 * width : 2]
            width //= 2

    @classmethod
    def of(cls, tables: tuple, text: bytes) -> TokenTree:
        return cls(text, *encode_text(tables, text))

    def total(self) -> int:
        return int(self.sums[1, 1])

    def size(self) -> int:
        return int(self.sums[1, 0])

    def _set(self, leaf: int, size: int, count: int) -> None:
        at = leaf + self.width
        self.sums[at] = size, count
        at //= 2
        while at:
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]
            at //= 2

    def _find(self, place: int) -> tuple[int, int]:
        """The last leaf that begins at or before a byte's place, and has bytes there or ends the text; and where it begins."""
        at, before = 1, 0
        while at < self.width:
            at *= 2
            here = int(self.sums[at, 0])
            if place - before >= here and before + here < self.size():
                before += here
                at += 1
        return min(at - self.width, self.leaves - 1), before

    def _piece(self, leaf: int) -> tuple[bytes, np.ndarray]:
        if leaf in self.changed:
            return self.changed[leaf]
        a, b = self.starts[leaf], self.starts[leaf + 1]
        return self.origin[a:b], np.zeros(1 if b > a else 0, np.int64)

    def text(self) -> bytes:
        return b"".join(self._piece(i)[0] for i in range(self.leaves))

    def apply(self, tables: tuple, edits: Sequence[Edit]) -> int:
        """Brings the tree up to date with (start, end, new bytes) edits, in order and apart, of its present text; returns how many pre-tokens were encoded anew."""
        again = 0
        for start, end, new in reversed(edits):  # from the back, so that the places before stay
            again += self._edit(tables, start, end, new)
        return again

    def _edit(self, tables: tuple, start: int, end: int, new: bytes) -> int:
        left, begin = self._find(max(0, start - LOOK))
        right, _ = self._find(end)
        reach = 4
        while True:
            stop = min(self.leaves, right + 1 + reach)
            pieces = [self._piece(i) for i in range(left, stop)]
            old = b"".join(p for p, _ in pieces)
            ahead, i = b"", stop
            while i < self.leaves and len(ahead) < LOOK:
                ahead += self._piece(i)[0]
                i += 1
            head, tail = old[: start - begin] + new, old[end - begin :]
            s, counts = encode_text(tables, head + tail + ahead)
            shift = len(old) - len(tail) - len(head)
            # Where a new pre-token begins behind the edit, and a leaf did: all leaves from there on stay.
            sizes = np.cumsum([0, *(len(p) for p, _ in pieces)])
            if stop == self.leaves and not ahead:
                meet, n = stop, len(s)
                break
            fits = np.flatnonzero((s >= len(head)) & np.isin(s + shift, sizes[1:]))
            fits = fits[(s[fits] + shift >= end - begin)]
            if len(fits):
                n = int(fits[0])
                meet = left + int(np.searchsorted(sizes, s[n] + shift))
                break
            reach *= 2
        until = int(s[n]) if n < len(s) else len(head) + len(tail)
        body = (head + tail)[:until]
        for leaf in range(left + 1, meet):
            if len(self._piece(leaf)[0]) or self.sums[leaf + self.width].any():
                self._set(leaf, 0, 0)
            self.changed[leaf] = b"", np.zeros(0, np.int64)
        self.changed[left] = body, s[:n].astype(np.int64)
        self._set(left, len(body), int(counts[:n].sum()))
        return n

    def to_bytes(self) -> bytes:
        """The tree to be kept: leaves without bytes are left out."""
        at = self.sums[self.width : self.width + self.leaves]
        live = np.flatnonzero(at[:, 0])
        text = self.text()
        starts = (np.cumsum(at[live, 0]) - at[live, 0]).astype("<i8")
        return struct.pack("<QQ", len(live), len(text)) + starts.tobytes() + at[live, 1].astype("<i8").tobytes() + text

    @classmethod
    def from_bytes(cls, raw: bytes) -> TokenTree:
        n, size = struct.unpack_from("<QQ", raw)
        starts, counts = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<i8", n, 16 + 8 * n)
        return cls(raw[16 + 16 * n : 16 + 16 * n + size], starts, counts)


def _vocabulary(df: DataFrame, vocab_path: str) -> tuple:
    content = read_file(vocab_path)
    return df.sparkSession.sparkContext.broadcast(content), zlib.crc32(content.encode())


def edited_token_counts(df: DataFrame, vocab_path: str, redactions=REDACTIONS, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Token counts before and after the edits that ``redactions`` (a function from text to spans, a replacement) make.

    Returns doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens and
    n_reencoded (pre-tokens encoded anew).  A null text counts as empty: zeros.
    """
    bound_batches(df.sparkSession)
    spec, key = _vocabulary(df, vocab_path)
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_reencoded"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker(key, lambda: spec.value)
        _, pre, cache = tables
        for b in batches:
            rows: list[tuple[int, ...]] = []
            data, at = text_bytes(column(b, text))
            for i, j in chunks(at):
                part, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
                s, e, docs = pre.spans(part, offsets)
                counts = cache.sizes(cache.find(part, span_hash(prefix_hash(part), s, e), s, e))
                raw = part.tobytes()
                for d in range(j - i):
                    own = raw[offsets[d] : offsets[d + 1]]
                    x, y = docs[d], docs[d + 1]
                    n, again, edits = int(counts[x:y].sum()), 0, find_edits(own, redactions)
                    after = n
                    if edits:
                        tree = TokenTree(own, s[x:y] - offsets[d], counts[x:y])
                        again, after = tree.apply(tables, edits), tree.total()
                    rows.append((n, len(edits), after, int(y - x), again))
            yield pa.RecordBatch.from_arrays([column(b, key_column), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 5))], names)

    return df.select(key_column, text).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def kept_trees(df: DataFrame, vocab_path: str, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, tree) of every row, to be written and edited later; a null text is empty."""
    bound_batches(df.sparkSession)
    spec, key = _vocabulary(df, vocab_path)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker(key, lambda: spec.value)
        for b in batches:
            trees = [TokenTree.of(tables, (t or "").encode()) for t in column(b, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, key_column), pa.array([t.total() for t in trees], pa.int64()), pa.array([t.to_bytes() for t in trees], pa.binary())], ["doc_id", "n_tokens", "tree"])

    return df.select(F.col(key_column).cast("long").alias(key_column), text).mapInArrow(run, "doc_id long, n_tokens long, tree binary")


def edit_trees(trees: DataFrame, edits: DataFrame, vocab_path: str) -> DataFrame:
    """Trees brought up to date with edits: (doc_id, edits), an array of (start, end, new bytes) in order and apart, a row a document.

    Documents without edits keep their trees.
    """
    spec, key = _vocabulary(trees, vocab_path)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker(key, lambda: spec.value)
        for b in batches:
            n, kept = [], []
            for count, raw, es in zip(*(column(b, c).to_pylist() for c in ("n_tokens", "tree", "edits")), strict=True):
                if es:
                    tree = TokenTree.from_bytes(raw)
                    tree.apply(tables, [(e["start"], e["end"], bytes(e["new"] or b"")) for e in es])
                    count, raw = tree.total(), tree.to_bytes()
                n.append(count)
                kept.append(raw)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_tokens", "tree"])

    both = trees.join(edits.select("doc_id", "edits"), "doc_id", "left").select("doc_id", "n_tokens", "tree", "edits")
    return both.mapInArrow(run, "doc_id long, n_tokens long, tree binary")
