"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token there is exactly one token that can be last in
the prefix's BPE encoding.  It is found among the vocabulary tokens that are
suffixes of the prefix: the one whose pair with the last token of the shorter
prefix survives all merges.  An automaton of all prefixes of tokens, with links from
each to its longest suffix that is one too, reads a pre-token once and knows at every
position the longest token that ends there; shorter ones follow along the tokens' own
suffix links.  Following the last tokens back from the end gives the ids.  All
pre-tokens that a worker has not met yet are worked on together, position by
position; one of more than LONG bytes, such as unspaced text, by itself.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataq.llm.batch import U, HashIndex, SpanCache, chunks, column, flat_ranges, mix, prefix_hash, span_hash, text_bytes, widened
from strataq.llm.shared import bound_batches, frugal

SPACE, LETTER, NUMBER, OTHER = range(4)
LONG = 256
#: White space as regular expressions see it (Unicode White_Space).
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte, by the rule of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 and up in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    out[list(_WHITE)] = SPACE
    return out


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Vocabulary:
    """Byte-level BPE tables, read from a tokenizer file's JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        byte_of = byte_symbols()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in s)
        for b, i in self.special.items():
            self.bytes[i] = b
        id_of = {b: i for i, b in enumerate(self.bytes) if b and b not in self.special}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        keys, made = [], []
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[z], self.left[z], self.right[z] = r, x, y
            keys.append(x << 20 | y)
            made.append(z)
        self.merged = HashIndex()
        self.merged.add(np.array(keys, U) + U(1), np.array(made, np.int32))
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for b, i in id_of.items():
            at = 0
            for x in b:
                at = nodes.setdefault((at, x), len(token))
                if at == len(token):
                    token.append(-1)
            token[at] = i
        self.node_token = np.array(token, np.int32)
        self.step = HashIndex()
        self.step.add(np.array([p << 8 | x for p, x in nodes], U) + U(1), np.array([*nodes.values()], np.int32))
        self.suffix, self.ending = self._suffix_links(nodes)
        #: The longest token that is a proper suffix of each token.
        self.link = np.full(size, -1, np.int32)
        for b, i in id_of.items():
            for k in range(1, len(b)):
                if (j := id_of.get(b[k:])) is not None:
                    self.link[i] = j
                    break
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.flat_at = np.cumsum(self.length) - self.length
        self.pairs = HashIndex(16)
        self._plain: tuple | None = None

    def _suffix_links(self, nodes: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """Of every node, the node of its longest proper suffix in the automaton, and the longest token that ends in it (-1: none)."""
        n = len(self.node_token)
        parent, byte, depth = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for (p, x), i in nodes.items():  # parents come before their children
            parent[i], byte[i], depth[i] = p, x, depth[p] + 1
        suffix, ending = np.zeros(n, np.int64), self.node_token.copy()
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2)) if n else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            own = order[i:j]
            if depth[own[0]] > 1:
                suffix[own] = self._step(suffix[parent[own]], byte[own], suffix)
            none = own[ending[own] < 0]
            ending[none] = ending[suffix[none]]
        return suffix, ending

    def _step(self, node: np.ndarray, byte: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Where the automaton goes from nodes with bytes: along the byte, or else from the node's suffix."""
        out, todo = np.zeros(len(node), np.int64), np.arange(len(node))
        node, byte = node.astype(np.int64), byte.astype(np.int64)
        while len(todo):
            got = self.step.find((node[todo] << 8 | byte[todo]).astype(U) + U(1))
            hit = got >= 0
            out[todo[hit]] = got[hit]
            todo = todo[~hit & (node[todo] != 0)]
            node[todo] = suffix[node[todo]]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when their bytes are merged together."""
        out = np.ones(len(a), bool)
        todo = np.arange(len(a))
        limit = np.full(len(a), 1 << 40, np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(todo):
            m = self.merged.find((a << 20 | b).astype(U) + U(1))
            bad = (m >= 0) & (self.rank[m] < limit)
            out[todo[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            cut_left = ra > rb
            on = ~bad & (cut_left | (rb >= 0))
            limit = np.where(cut_left, ra, rb + 1)[on]
            a, b = np.where(cut_left, self.right[a], a)[on], np.where(cut_left, b, self.left[b])[on]
            todo = todo[on]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_compatible, with earlier answers kept."""
        if self.pairs.n > 1_500_000:
            self.pairs = HashIndex(16)
        keys = mix((a.astype(U) << U(20) | b.astype(U)) + U(1))
        got = self.pairs.find(keys)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            said = self._compatible(a[miss[first]], b[miss[first]])
            self.pairs.add(new, said.astype(np.int32))
            got[miss] = said[back]
        return got == 1

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's number of ids."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lens) - lens
        total = len(data)
        # last[p]: the last token of the prefix that ends before p; words by length, so that the active ones are a slice.
        last = np.full(total + 1, -1, np.int32)
        for w in np.flatnonzero(lens > LONG).tolist():
            last[begin[w] + 1 : begin[w] + lens[w] + 1] = self.encode_long(words[w])
        short = np.flatnonzero(lens <= LONG)
        order = short[np.argsort(-lens[short], kind="stable")]
        neg = -lens[order]
        node = np.zeros(len(order), np.int64)
        i = 1
        while (active := int(np.searchsorted(neg, -i, "right"))) > 0:
            word = order[:active]
            end = begin[word] + i
            node = self._step(node[:active], data[end - 1], self.suffix)
            cand = self.ending[node].copy()
            todo = np.arange(active)
            while len(todo):
                c = cand[todo]
                if (c < 0).any():
                    raise ValueError("a byte is missing from the vocabulary")
                whole = self.length[c] == i
                ok = whole.copy()
                part = np.flatnonzero(~whole)
                if len(part):
                    cp = c[part]
                    ok[part] = self.compatible(last[end[todo[part]] - self.length[cp]], cp)
                last[end[todo[ok]]] = c[ok]
                todo = todo[~ok]
                cand[todo] = self.link[cand[todo]]
            i += 1
        # Back-pointers: mark the tokens' ends from the back.
        mark = np.zeros(total + 1, bool)
        end, low = begin + lens, begin
        keep = lens > 0
        end, low = end[keep], low[keep]
        while len(end):
            mark[end] = True
            end = end - self.length[last[end]]
            on = end > low
            end, low = end[on], low[on]
        marked = np.flatnonzero(mark)
        edge = np.searchsorted(marked, np.append(begin, total), "right")
        return last[marked].astype(np.int32), np.diff(edge)

    def encode_long(self, word: bytes) -> list[int]:
        """The last token of every prefix of one word, without arrays: a step for each byte."""
        if self._plain is None:
            live = np.flatnonzero(self.step.keys)
            steps = dict(zip((self.step.keys[live] - U(1)).tolist(), self.step.vals[live].tolist(), strict=True))
            live = np.flatnonzero(self.merged.keys)
            merged = dict(zip((self.merged.keys[live] - U(1)).tolist(), self.merged.vals[live].tolist(), strict=True))
            self._plain = steps, merged, self.suffix.tolist(), self.ending.tolist(), self.link.tolist(), self.length.tolist(), self.rank.tolist(), self.left.tolist(), self.right.tolist()
        steps, merged, suffix, ending, link, length, rank, left, right = self._plain
        known: dict[int, bool] = {}

        def apart(a: int, b: int) -> bool:
            limit = 1 << 40
            while True:
                m = merged.get(a << 20 | b)
                if m is not None and rank[m] < limit:
                    return False
                ra, rb = rank[a], rank[b]
                if ra > rb:
                    limit, a = ra, right[a]
                elif rb >= 0:
                    limit, b = rb + 1, left[b]
                else:
                    return True

        last, node = [0] * (len(word) + 1), 0
        for i, x in enumerate(word, 1):
            while (to := steps.get(node << 8 | x)) is None and node:
                node = suffix[node]
            node = to or 0
            c = ending[node]
            while True:
                if c < 0:
                    raise ValueError("a byte is missing from the vocabulary")
                n = length[c]
                if n == i:
                    break
                pair = last[i - n] << 20 | c
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = apart(last[i - n], c)
                if ok:
                    break
                c = link[c]
            last[i] = c
        return last[1:]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[flat_ranges(self.flat_at[ids], self.length[ids])]


class PreTokenizer:
    """Pre-tokens of the byte-level pattern, found on arrays of code points:

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    """

    def __init__(self, special: list[bytes]):
        self.classes, self.special = char_classes(), special

    def spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts, byte ends, and each document's range of pre-tokens."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(at), np.int64)
        raw = data.tobytes()
        lead = (data & 0xC0) != 0x80
        where = np.flatnonzero(lead)
        cp = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(cp) != len(where):
            raise ValueError("text is not UTF-8")
        taken = np.zeros(0, np.int64)
        for s in self.special:
            k = raw.find(s)
            while k >= 0:
                if np.searchsorted(at, k, "right") == np.searchsorted(at, k + len(s) - 1, "right"):
                    taken = np.append(taken, [k, k + len(s)])
                k = raw.find(s, k + 1)
        cuts = np.concatenate([at, taken])
        first = np.zeros(n + 1, bool)
        first[cuts] = True
        first = first[:-1][where]  # code points that begin a document or follow a cut
        c = self.classes[cp]
        start = np.ones(len(cp), bool)
        np.not_equal(c[1:], c[:-1], out=start[1:])
        start |= first
        turn = np.flatnonzero((c[1:] != SPACE) & (c[:-1] == SPACE) & ~first[1:]) + 1  # a token's first letter, after white space
        start[turn - 1] = True
        start[turn[cp[turn - 1] == 0x20]] = False
        quote = np.flatnonzero((cp == 0x27) & start)
        quote = quote[quote + 1 < len(cp)]
        quote = quote[(c[quote + 1] == LETTER) & ~first[quote + 1]]
        if len(quote):
            one = np.isin(cp[quote + 1], [ord(x) for x in "stmd"])
            more = quote[~one]
            more = more[more + 2 < len(cp)]
            pair = cp[more + 1].astype(np.int64) << 8 | cp[more + 2]
            more = more[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (cp[more + 2] < 256) & ~first[more + 2]]
            single = quote[one]
            start[single + 1] = False
            start[more + 1] = False
            start[(single + 2)[single + 2 < len(cp)]] = True
            start[(more + 3)[more + 3 < len(cp)]] = True
        for a, b in taken.reshape(-1, 2).tolist():
            start[np.searchsorted(where, a) + 1 : np.searchsorted(where, b)] = False
        starts = where[start]
        return starts, np.append(starts[1:], n), np.searchsorted(starts, at)


_workers: dict[int, tuple] = {}


def worker(key: int, text) -> tuple[Vocabulary, PreTokenizer, SpanCache]:
    """This Python worker's tables, built once."""
    if key not in _workers:
        v = Vocabulary(text() if callable(text) else text)

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            plain = [b"" if w in v.special else w for w in words]
            ids, counts = v.encode(plain)
            if any(w in v.special for w in words):
                parts = np.split(ids, np.cumsum(counts)[:-1])
                parts = [np.array([v.special[w]], np.int32) if w in v.special else p for w, p in zip(words, parts, strict=True)]
                return np.concatenate(parts), np.array([len(p) for p in parts])
            return ids, counts

        _workers.clear()
        _workers[key] = v, PreTokenizer([*v.special]), SpanCache(encode)
    return _workers[key]


def encode_batch(tables: tuple, array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every chunk of documents: all their ids in a row, and the offsets of each document's."""
    _, pre, cache = tables
    data, at = text_bytes(array)
    for i, j in chunks(at):
        part, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
        s, e, docs = pre.spans(part, offsets)
        ids, counts = cache.gather(cache.find(part, span_hash(prefix_hash(part), s, e), s, e))
        yield ids, np.concatenate([[0], np.cumsum(counts)])[docs]


def bpe_encode(df: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of a text column as ``array<int>``.

    A null text counts as empty and has no ids.  Other columns pass through; a
    column already named ``ids`` is replaced.  The file at ``vocab_path`` is read
    on the driver and broadcast (its size is fixed).
    """
    bound_batches(df.sparkSession)
    content = read_file(vocab_path)
    spec, key = df.sparkSession.sparkContext.broadcast(content), zlib.crc32(content.encode())
    df = df.drop(ids)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker(key, lambda: spec.value)
        for b in batches:
            flat, at = [], [np.zeros(1, np.int64)]
            for x, o in encode_batch(tables, column(b, text)):
                flat.append(x)
                at.append(o[1:] + at[-1][-1])
            made = pa.ListArray.from_arrays(pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, ids])

    return df.mapInArrow(run, widened(df, **{ids: "array<int>"}))


def bpe_decode(df: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that an ``array<int>`` column of ids stands for.

    Null ids give null; bytes that are no UTF-8 become U+FFFD.  Special tokens
    are kept.  A column already named like the result is replaced.
    """
    bound_batches(df.sparkSession)
    content = read_file(vocab_path)
    spec, key = df.sparkSession.sparkContext.broadcast(content), zlib.crc32(content.encode())
    df = df.drop(text)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _, _ = worker(key, lambda: spec.value)
        for b in batches:
            out = [None if x is None else v.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in column(b, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, text])

    return df.mapInArrow(run, widened(df, **{text: "string"}))


def bpe_digests(df: DataFrame, vocab_path: str, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again and returns a digest of both, so that the ids need not leave the worker."""
    bound_batches(df.sparkSession)
    content = read_file(vocab_path)
    spec, key = df.sparkSession.sparkContext.broadcast(content), zlib.crc32(content.encode())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker(key, lambda: spec.value)
        v = tables[0]
        for b in batches:
            n, left, right = [], [], []
            for flat, at in encode_batch(tables, column(b, text)):
                back = v.decode(flat)
                ends = np.concatenate([[0], np.cumsum(v.length[flat])])[at]
                packed = flat.astype("<u4")
                for i, j, x, y in zip(at[:-1].tolist(), at[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    n.append(j - i)
                    left.append(hashlib.sha256(packed[i:j]).hexdigest())
                    right.append(hashlib.sha256(back[x:y].tobytes().decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([column(b, key_column), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key_column, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
