"""Language identification by prediction by partial matching.

Per language a context tree of depth ``ORDER`` over bytes keeps how often each byte
followed each context.  The code length of a byte is exact under these frozen counts
with escape method C: in a context seen N times with d different bytes, a byte seen c
times costs -log2(c / (N + d)); any other costs -log2(d / (N + d)) for the escape plus
its cost in the context that is shorter by one, down to 8 bits.  The language with the
shortest code for the whole text wins.

A tree holds the contexts that were seen, and nothing else.  Bytes that no training text
has are one symbol, which changes no code length, for none of them is ever predicted or
known as a context.  The trees of up to BLOCK languages share their index: from the
id of a context and one more symbol before it to the id of the longer context, and
from a context's id and the next symbol to a row of code lengths, one for each language.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataq.llm.batch import chunks, column, text_bytes, widened
from strataq.llm.shared import bound_batches, frugal

ORDER, BLOCK = 3, 16
UNKNOWN = "und"
_trees: dict[str, list] = {}


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each byte, the ORDER bytes before it and itself as one number; before a text there are spaces."""
    n = len(data)
    starts = at[:-1]
    key = data.astype(np.uint32)
    for k in range(1, ORDER + 1):
        back = np.full(n, 0x20, np.uint32)
        back[k:] = data[: n - k]
        for t in range(k):
            p = starts + t
            back[p[p < n]] = 0x20
        key |= back << np.uint32(8 * k)
    return key


def count_grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(data, at), return_counts=True)


class Trees:
    """The contexts of some languages, of all orders, from their counts of ORDER + 1 bytes; row 0 of every table means unseen."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]]):
        keys = np.unique(np.concatenate([np.zeros(0, np.uint32), *(k for k, _ in counted)]))
        every = np.zeros((len(keys), len(counted)))
        for i, (k, c) in enumerate(counted):
            every[np.searchsorted(keys, k), i] = c
        found = np.unique(np.concatenate([np.zeros(0, np.uint32), *((keys >> np.uint32(8 * k)) & np.uint32(255) for k in range(ORDER + 1))]))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[found] = np.arange(1, len(found) + 1)
        self.size = len(found) + 1
        self.longer: list[np.ndarray] = []  # of each order from 1: (id of the shorter context, symbol before it) to its id
        self.row: list[np.ndarray] = []  # of each order from 0: (id of the context, symbol) to a row of bits
        self.bits: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        below, shorter = None, np.zeros(0, np.uint32)
        for order in range(ORDER + 1):
            # The counts of an order are those of the deepest one, summed over what stands before.
            own, back = np.unique(keys & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            c = np.zeros((len(own), len(counted)))
            np.add.at(c, back, every)
            context, where = np.unique(own >> np.uint32(8), return_inverse=True)
            n, d = np.zeros((len(context), len(counted))), np.zeros((len(context), len(counted)))
            np.add.at(n, where, c)
            np.add.at(d, where, (c > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, np.log2((n + d) / d), 0.0)
                less = 8.0 if below is None else below[1][np.searchsorted(below[0], own & np.uint32((1 << 8 * order) - 1))]
                bits = np.where(c > 0, np.log2((n + d)[where] / c), escape[where] + less)
            below = own, bits
            if order:
                step = np.zeros((len(shorter) + 1) * self.size, np.int32)
                parent = np.searchsorted(shorter, context & np.uint32((1 << 8 * (order - 1)) - 1)) + 1
                step[parent * self.size + self.symbol[context >> np.uint32(8 * (order - 1))]] = np.arange(1, len(context) + 1)
                self.longer.append(step)
            shorter = context
            row = np.zeros((len(context) + 1) * self.size, np.int32)
            row[(where + 1) * self.size + self.symbol[own & np.uint32(255)]] = np.arange(1, len(own) + 1)
            self.row.append(row)
            blank = np.zeros((1, len(counted)))
            self.bits.append(np.concatenate([blank, bits]).astype(np.float32))
            self.escape.append(np.concatenate([blank, escape]).astype(np.float32))

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each byte after its context, one column for each language."""
        now = self.symbol[keys & np.uint32(255)]
        ids = [np.full(len(keys), int(len(self.row[0]) > self.size))]
        for k in range(1, ORDER + 1):
            ids.append(self.longer[k - 1][ids[-1] * self.size + self.symbol[(keys >> np.uint32(8 * k)) & np.uint32(255)]].astype(np.int64))
        row = self.row[ORDER][ids[ORDER] * self.size + now]
        out = self.bits[ORDER][row]
        todo = np.flatnonzero(row == 0)
        for k in range(ORDER, 0, -1):
            out[todo] += self.escape[k][ids[k][todo]]
            row = self.row[k - 1][ids[k - 1][todo] * self.size + now[todo]]
            out[todo] += self.bits[k - 1][row]
            todo = todo[row == 0]
        out[todo] += self.escape[0][ids[0][todo]] + np.float32(8.0)
        return out


def worker_trees(key: str, frozen: list[tuple[str, bytes, bytes]]) -> tuple[list[str], list[Trees]]:
    """This worker's trees, built once from (language, packed keys, packed counts)."""
    if key not in _trees:
        _trees.clear()
        counted = [(np.frombuffer(k, np.uint32), np.frombuffer(c, np.int64)) for _, k, c in frozen]
        _trees[key] = [Trees(counted[i : i + BLOCK]) for i in range(0, len(counted), BLOCK)]
    return [lang for lang, _, _ in frozen], _trees[key]


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def score_texts(langs: list[str], trees: list[Trees], array: pa.Array) -> tuple[list[str], list[float]]:
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    said: list[str] = []
    sure: list[float] = []
    data, at = text_bytes(array)
    for i, j in chunks(at):
        part, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
        bits = np.zeros((j - i, len(langs)))
        if len(part) and langs:
            keys = grams(part, offsets)
            full = np.flatnonzero(np.diff(offsets))
            for k, block in enumerate(trees):
                bits[full, BLOCK * k : BLOCK * (k + 1)] = np.add.reduceat(block.code_lengths(keys), offsets[full], axis=0, dtype=np.float64)
        plain = np.concatenate([[0], np.cumsum(letter[part])])
        plain = np.diff(plain[offsets]) > 0
        best = bits.argmin(axis=1) if langs else np.zeros(j - i, int)
        for d in range(j - i):
            if not langs or not (plain[d] or has_letter(part[offsets[d] : offsets[d + 1]].tobytes())):
                said.append(UNKNOWN)
                sure.append(0.0)
            else:
                said.append(langs[best[d]])
                sure.append(float(1.0 / np.exp2(np.maximum(bits[d, best[d]] - bits[d], -1000.0)).sum()))
    return said, sure


COUNTS = "lang string, keys binary, counts binary"


def training_counts(df: DataFrame, per_language: int, key_column: str, text: str, lang: str) -> list[tuple[str, bytes, bytes]]:
    """(language, keys, counts) over about ``per_language`` whole texts of each language, chosen by a hash of the key, in order of language.

    Texts are counted where they lie; what is collected has a number for each context and
    byte that the sample holds.
    """
    usable = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key_column).isNotNull())
    numbers = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not numbers:
        return []
    share = F.create_map(*[F.lit(x) for g, n in numbers.items() for x in (g, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64(F.col(key_column), F.lit("langid")), F.lit(1 << 40)) / float(1 << 40)
    rows = usable.filter(chance < share[F.col(lang)]).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def packed(totals: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*totals], pa.string()), pa.array([k.tobytes() for k, _ in totals.values()], pa.binary()), pa.array([c.tobytes() for _, c in totals.values()], pa.binary())], ["lang", "keys", "counts"])

    def add(totals: dict, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
        if name in totals:
            keys, back = np.unique(np.concatenate([totals[name][0], keys]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([totals[name][1], counts])).astype(np.int64)
        totals[name] = keys, counts

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            names = np.array(column(b, "lang").to_pylist(), object)
            for name in dict.fromkeys(names.tolist()):
                data, at = text_bytes(column(b, "text").take(pa.array(np.flatnonzero(names == name))))
                for i, j in chunks(at):
                    add(totals, name, *count_grams(data[at[i] : at[j]], at[i : j + 1] - at[i]))
        yield packed(totals)

    @frugal
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for name, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                add(totals, name, np.frombuffer(k, np.uint32), np.frombuffer(c, np.int64))
        yield packed(totals)

    found = rows.mapInArrow(count, COUNTS).repartition(min(len(numbers), 64), "lang").mapInArrow(total, COUNTS).collect()
    return sorted((r["lang"], bytes(r["keys"]), bytes(r["counts"])) for r in found)


def identify_language(df: DataFrame, train: DataFrame, per_language: int = 400, key_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row of ``df``; trees are learned from ``train``.

    ``per_language`` bounds the rows that training reads, whatever their length.  A null
    text, a text without letters, or no training rows give ``und`` with score 0; of equal
    codes, the language that comes first in order wins.  The score is the posterior of the
    language under equal priors.  Columns of these names are replaced.
    """
    bound_batches(df.sparkSession)
    counts = training_counts(train, per_language, key_column, text, lang)
    frozen, key = df.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex
    df = df.drop("lang_pred", "score")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, trees = worker_trees(key, frozen.value)
        for b in batches:
            said, sure = score_texts(langs, trees, column(b, text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(sure, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, widened(df, lang_pred="string", score="double"))
