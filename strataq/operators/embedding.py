"""Vectors of texts: model files, static embeddings by mean pooling, an index by sign bits."""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strataq.functions import vectors as V

OVERFETCH = 40


def checked_file(path: str, sha256: str | None = None) -> bytes:
    """A model file's bytes, from a local path; another hash than the one asked for is an error."""
    with open(path, "rb") as f:
        body = f.read()
    if sha256 is not None and hashlib.sha256(body).hexdigest() != sha256:
        raise ValueError(f"{os.path.basename(path)} has another SHA-256")
    return body


def read_matrix(body: bytes) -> np.ndarray:
    """The first matrix of 32-bit floats in a safetensors file."""
    if len(body) < 8:
        raise ValueError("no safetensors file")
    (size,) = struct.unpack("<Q", body[:8])
    try:
        header = json.loads(body[8 : 8 + size])
    except ValueError as e:
        raise ValueError("no safetensors file") from e
    data = body[8 + size :]
    for name, t in header.items():
        if name != "__metadata__" and isinstance(t, dict) and t.get("dtype") == "F32" and len(t.get("shape", ())) == 2 and min(t["shape"]) > 0:
            (rows, dims), (start, end) = t["shape"], t["data_offsets"]
            if not 0 <= start <= end <= len(data) or end - start != 4 * rows * dims:
                raise ValueError("no safetensors file")
            return np.frombuffer(data[start:end], "<f4").reshape(rows, dims)
    raise ValueError("no matrix of 32-bit floats")


@dataclass
class StaticModel:
    """Token vectors by token; the model's size is fixed."""

    vocab: dict[str, int]
    matrix: np.ndarray

    @classmethod
    def load(cls, folder: str, sha256: dict[str, str] | None = None) -> StaticModel:
        want = sha256 or {}
        spec = json.loads(checked_file(os.path.join(folder, "tokenizer.json"), want.get("tokenizer.json")))
        vocab = spec.get("model", {}).get("vocab") or spec.get("vocab") or {}
        pairs = {k: v if isinstance(v, int) else v[0] for k, v in vocab.items()} if isinstance(vocab, dict) else {k[0]: i for i, k in enumerate(vocab)}
        return cls(pairs, read_matrix(checked_file(os.path.join(folder, "model.safetensors"), want.get("model.safetensors"))))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(token, vector) of all tokens that have a vector; a token also stands for its forms with a word mark or a capital."""
        known = {t: i for t, i in self.vocab.items() if 0 <= i < len(self.matrix)}
        return spark.createDataFrame([(t, self.matrix[i].astype(float).tolist()) for t, i in known.items()], "token string, vector array<double>")


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def forms(x: Column) -> Column:
    """The forms under which a vocabulary may have a word."""
    return F.array_distinct(F.array(x, F.concat(F.lit(" "), x), F.concat(F.lit("Ġ"), x), F.concat(F.lit("▁"), x), F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 20))))


def tokens(text: Column) -> Column:
    """Distinct lower-case words, each with the forms under which a vocabulary may have it."""
    return F.array_distinct(F.flatten(F.transform(words(text), forms)))


def mean_pooled(docs: DataFrame, model: DataFrame, key: str, text: str = "text", model_rows: int | None = None, few: bool = False) -> DataFrame:
    """(key, vector, signature): the unit mean of the vectors of a text's tokens.

    Texts without a known token have no row.  The model is broadcast if ``model_rows``, its
    proven number of tokens, is at most 200 000; the texts are if they are ``few``.  Else
    nothing is broadcast: keys are dealt to blocks, each block gets the vector of each of
    its tokens once, and means are taken there, so that vectors are not sent for each text.
    """
    if few or (model_rows is not None and model_rows <= 200_000):
        own = docs.select(key, F.explode(tokens(F.col(text))).alias("token"))
        found = F.broadcast(own).join(model, "token") if few else own.join(F.broadcast(model), "token")
        held = found.groupBy(key).agg(F.collect_list("vector").alias("_v"))
        total = F.aggregate(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(1))), F.get("_v", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        mean = F.transform(F.when(F.size("_v") == 1, F.get("_v", F.lit(0))).otherwise(total), lambda x: x / F.size("_v"))
        means = held.select(key, mean.alias("vector"))
    else:
        means = _block_means(docs, model, key, text)
    return means.select(key, V.normalise(F.col("vector")).alias("vector")).withColumn("signature", V.signature(F.col("vector")))


def _block_means(docs: DataFrame, model: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_b"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    needed = own.select("_b", F.explode(words(F.col("_text"))).alias("_word")).distinct()
    needed = needed.select("_b", "_word", F.explode(forms(F.col("_word"))).alias("token"))
    # Sizes of exploded rows are guessed too low, so that a side could be taken for small and collected by the driver.
    found = needed.hint("merge").join(model.select("token", F.col("vector").cast("array<double>").alias("vector")).filter("vector IS NOT NULL"), "token")
    none = lambda t: F.lit(None).cast(t)
    left = found.select("_b", F.lit(False).alias("_asks"), none(kind).alias("_key"), none("string").alias("_text"), "_word", "token", "vector")
    right = own.select("_b", F.lit(True).alias("_asks"), "_key", "_text", none("string").alias("_word"), none("string").alias("token"), none("array<double>").alias("vector"))
    both = left.unionByName(right).repartition(blocks, "_b").sortWithinPartitions("_b", "_asks", "_key")
    rows = both.select("_b", "_asks", "_key", F.when(F.col("_asks"), tokens(F.col("_text"))).alias("_tokens"), "_word", "token", "vector")
    return rows.mapInArrow(_means, T.StructType([T.StructField("_key", kind), T.StructField("vector", T.ArrayType(T.DoubleType()))])).withColumnRenamed("_key", key)


class _Vectors:
    """Sums of the vectors of a block's tokens, and how many components each sum has; components may be null."""

    def __init__(self, rows: list):
        import pyarrow as pa

        table = pa.Table.from_batches(rows).combine_chunks()
        col = lambda c: table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c]
        coded, vector = col("token").dictionary_encode(), col("vector")
        self.known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        # Words that share a form each bring its vectors: the first word's count.
        word = col("_word").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.full(len(self.known), np.iinfo(np.int64).max)
        np.minimum.at(first, code, word)
        keep = np.flatnonzero(word == first[code])
        code, vector = code[keep], vector.take(pa.array(keep))
        sizes = np.diff(vector.offsets.to_numpy())
        dims = int(sizes.max(initial=0))
        flat = vector.values.slice(vector.offsets[0].as_py(), int(sizes.sum()))
        there = np.zeros((len(code), dims), bool)
        there[np.arange(dims) < sizes[:, None]] = flat.is_valid().to_numpy(zero_copy_only=False)
        plain = np.zeros((len(code), dims))
        plain[np.arange(dims) < sizes[:, None]] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        if len(code) == len(self.known):
            order = np.argsort(code, kind="stable")
            self.sums, self.counts = plain[order], there[order].astype(np.int32)
        else:
            self.sums, self.counts = np.zeros((len(self.known), dims)), np.zeros((len(self.known), dims), np.int32)
            np.add.at(self.sums, code, plain)
            np.add.at(self.counts, code, there)


def _means(batches):
    """In a partition in order of block, vectors before texts, keys in order: the mean of each key."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def made(keys, sums, counts):
        means = pa.array((sums / np.maximum(counts, 1)).ravel(), mask=(counts == 0).ravel())
        at = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * (sums.shape[1] if len(sums) else 0))
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(at, means)], ["_key", "vector"])

    now, known, held, last = None, None, [], None
    for b in batches:
        col = lambda c, b=b: b.column(b.schema.get_field_index(c))
        mark = 2 * col("_b").to_numpy().astype(np.int64) + col("_asks").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if mark[i] // 2 != now:
                if last is not None:
                    yield made(*last)
                now, known, held, last = mark[i] // 2, None, [], None
            part = b.slice(i, j - i)
            if mark[i] % 2 == 0:
                held.append(part.select(["token", "_word", "vector"]))
                continue
            if known is None:
                if not held:
                    continue
                known, held = _Vectors(held), []
            for k in range(0, len(part), 2000):
                keys = part.column(part.schema.get_field_index("_key")).slice(k, 2000)
                lists = part.column(part.schema.get_field_index("_tokens")).slice(k, 2000)
                row = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                code = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=known.known), -1).to_numpy(zero_copy_only=False)
                row, code = row[code >= 0], code[code >= 0]
                if not len(row):
                    continue
                coded = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[row]  # equal keys lie together
                starts = np.concatenate([[0], np.flatnonzero(np.diff(coded)) + 1])
                sums, counts = np.add.reduceat(known.sums[code], starts, axis=0), np.add.reduceat(known.counts[code], starts, axis=0)
                own = keys.take(pa.array(row[starts]))
                if last is not None and last[0][0].as_py() == own[0].as_py():
                    sums[0] += last[1][0]
                    counts[0] += last[2][0]
                elif last is not None:
                    yield made(*last)
                if len(own) > 1:
                    yield made(own[:-1], sums[:-1], counts[:-1])
                last = own[-1:], sums[-1:], counts[-1:]
    if last is not None:
        yield made(*last)


def embedded(docs: DataFrame, adapter: Callable[[list[str]], list], text: str = "text") -> DataFrame:
    """Adds ``vector`` (array<double>) by an adapter from texts to vectors, a batch at a time; where it fails, or gives no numbers, the vector is null."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = ["" if t is None else t for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            try:
                made = [None if v is None else [float(x) for x in v] for v in adapter(texts)]
                if len(made) != len(texts):
                    made = [None] * len(texts)
            except Exception:  # an adapter is user code: memories go in without a vector
                made = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], [*b.schema.names, "vector"])

    docs = docs.drop("vector")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


@dataclass
class VectorIndex:
    """(id, scope, vector, signature) rows; the last write of an id counts."""

    rows: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> VectorIndex:
        return cls(spark.createDataFrame([], "id string, scope string, vector array<double>, signature long"))

    def upsert(self, new: DataFrame) -> VectorIndex:
        new = new.select("id", "scope", V.normalise(F.col("vector")).alias("vector")).withColumn("signature", V.signature(F.col("vector")))
        return VectorIndex(self.delete(new.select("id")).rows.unionByName(new))

    def delete(self, ids: DataFrame) -> VectorIndex:
        return VectorIndex(self.rows.join(ids.select("id").distinct(), "id", "left_anti"))

    def reset(self) -> VectorIndex:
        return VectorIndex(self.rows.limit(0))

    def exact(self, cue: list[float], k: int = OVERFETCH, scope: str | None = None) -> DataFrame:
        """The k best of a scope by vector score, then Hamming distance, then id."""
        return _ranked(self.rows.filter(F.col("scope").eqNullSafe(F.lit(scope))), cue, k)

    def near(self, cue: list[float], k: int = OVERFETCH, scope: str | None = None, wider: int = 8) -> DataFrame:
        """About the same from sign bits: candidates of all scopes by Hamming distance, twice as many until enough are in scope, then scored exactly."""
        want, total = F.lit(_signature(cue)).cast("long"), None
        away, take = F.bit_count(F.col("signature").bitwiseXOR(want)), k * wider
        while True:
            found = self.rows.select("id", "scope", away.alias("_d")).orderBy("_d", "id").limit(take)
            inside = found.filter(F.col("scope").eqNullSafe(F.lit(scope))).select("id")
            if inside.count() >= k * wider or take >= (total := self.rows.count() if total is None else total):
                break
            take *= 2
        return _ranked(self.rows.join(F.broadcast(inside.limit(max(take, 1))), "id", "left_semi"), cue, k)  # at most ``take`` ids


def _signature(cue: list[float]) -> int:
    bits = "".join("1" if cue[min(len(cue) - 1, i * len(cue) // 64)] > 0 else "0" for i in range(64))
    return struct.unpack(">q", int(bits, 2).to_bytes(8, "big"))[0]


def _ranked(rows: DataFrame, cue: list[float], k: int) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in cue])
    rows = rows.withColumn("score", F.round(V.vector_score(F.col("vector"), q), 9)).withColumn("hamming", F.bit_count(F.col("signature").bitwiseXOR(F.lit(_signature(cue)).cast("long"))))
    return rows.orderBy(F.desc("score"), "hamming", "id").limit(k).select("id", "score", "hamming")
