"""Sharding along a Hilbert curve.

Metadata columns are quantised (numbers by their quantiles, the commonest strings in
order over the whole range), the cells are put in the order of a Hilbert curve, and the
ordered rows are cut into runs of nearly equal bytes.  Files of one run then have
narrow ranges in every dimension.  Rows with equal texts stay together unless
their group is large against a shard; such a group is one run of the curve too,
and cut between its rows where a shard ends.

All sorting is a range exchange of narrow rows, with a hash of the key as the last
sort column, so that no value and no group can fill a task; a group that goes on
over partitions is told where it began.  Groups of a thousandth of the rows or more, a
thousand at most, are broadcast, the others joined.  Totals by partition are
collected: one row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from strataq.llm.batch import column, widened
from strataq.llm.shared import frugal, materialise

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the curve of integer cells (rows: points, columns: dimensions), by Gray-code rotation and exchange of axes."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def quantisers(df: DataFrame, numbers: Sequence[str], strings: Sequence[str]) -> list[Column]:
    """One column of 0 to 2^BITS - 1 for each dimension; nulls are 0.  What is collected has a fixed size."""
    levels = 1 << BITS
    out: list[Column] = []
    if numbers:
        cuts = df.agg(*[F.percentile_approx(c, [i / levels for i in range(1, levels)], 2000).alias(c) for c in numbers]).first()
        for c in numbers:
            edges = sorted({float(v) for v in cuts[c] or []})
            out.append(F.coalesce(sum(((F.col(c) > v).cast("int") for v in edges), F.lit(0)), F.lit(0)))
    for c in strings:
        top = [r[0] for r in df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(levels - 2).collect()]
        rank = F.lit(levels - 1)
        if top:
            rank = F.coalesce(F.create_map(*[F.lit(v) for i, x in enumerate(sorted(top)) for v in (x, 1 + i * (levels - 2) // len(top))])[F.col(c)], rank)
        out.append(F.when(F.col(c).isNull(), F.lit(0)).otherwise(rank))
    return out


def whole_parts(parts: list) -> list[tuple[int, int, int, int]]:
    """Of each partition in order (number, rows, bytes, first and last row's group): rows and bytes before it, and where its first group opened, over all partitions."""
    out, rows, size, going = [], 0, 0, None
    for p, n, bytes_, first, last in parts:
        own = tuple(first[:4])
        opened = going[1] if going is not None and going[0] == own else size
        out.append((p, rows, size, opened))
        end = tuple(last[:4])
        going = (end, opened if end == own else size + last[4])
        rows, size = rows + n, size + bytes_
    return out


def hilbert_shards(df: DataFrame, shards: int = 8, key_column: str = "doc_id", text: str = "text", strings: Sequence[str] = ("lang", "source"), group_share: float = 1 / 32) -> DataFrame:
    """Returns key, size, text_crc32, curve, shard and slot for every row.

    ``size`` is the text's UTF-8 length plus 1; a null text has size 1.  Rows are
    numbered from 0 in each shard, in curve order.  Groups of equal texts of at
    most ``group_share`` of a shard's bytes are kept whole; the rows of larger ones
    follow each other, whatever their metadata.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(F.col(key_column).alias("_key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.xxhash64(t).alias("_group"), *strings)
    narrow = materialise(narrow)
    n, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    copies = narrow.groupBy("_group", "size").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*strings)).alias("_first") if strings else F.lit(None).alias("_first"))
    copies = materialise(copies.filter(F.col("_n") > 1))
    large = F.broadcast(copies.filter(F.col("_n") * 1000 >= n))  # a thousand rows at most
    others = narrow.join(large.select("_group", "size"), ["_group", "size"], "left_anti").join(copies.filter(F.col("_n") * 1000 < n), ["_group", "size"], "left")
    rows = narrow.join(large, ["_group", "size"]).unionByName(others)
    shared = F.col("_n").isNotNull()
    whole = F.col("_n") * F.col("size") <= total / shards * group_share
    rows = rows.select("_key", "size", "text_crc32", "_group", *[F.when(shared, F.col("_first")[s]).otherwise(F.col(s)).alias(s) for s in strings], F.when(whole, F.col("_n") * F.col("size")).alias("_bytes"))
    cells = quantisers(narrow, ["size"], strings)
    dims = len(cells)
    rows = rows.select("_key", "size", "text_crc32", "_group", "_bytes", *[c.cast("int").alias(f"_c{i}") for i, c in enumerate(cells)])

    @frugal
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.stack([column(b, f"_c{i}").to_numpy() for i in range(dims)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert_index(at))], [*b.schema.names, "curve"])

    rows = rows.mapInArrow(place, widened(rows, curve="long")).drop(*[f"_c{i}" for i in range(dims)])
    rows = rows.withColumn("_tie", F.xxhash64("_key", "size"))
    order = ["curve", "_group", "size", "_tie", "_key"]
    rows = rows.repartitionByRange(*order[:4]).sortWithinPartitions(*order)

    @frugal
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places and bytes before each row in its partition; of a whole group, where it opened, but for the partition's first one."""
        part, row, cum, now, opened, head = TaskContext.get().partitionId(), 0, 0, None, 0, None
        for b in batches:
            size = column(b, "size").to_numpy()
            before = (cum + np.cumsum(size) - size).tolist()
            ids = list(zip(*(column(b, c).to_pylist() for c in ("curve", "_group", "size", "_bytes")), strict=True))
            opens, heads = [], []
            for i, own in enumerate(ids):
                if own != now:
                    now, opened = own, before[i]
                head = own if head is None else head
                opens.append(opened)
                heads.append(own == head)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part)), pa.array(np.arange(row, row + len(size))), pa.array(before, pa.int64()), pa.array(opens, pa.int64()), pa.array(heads, pa.bool_())], [*b.schema.names, "_part", "_row", "_before", "_open", "_head"])
            row, cum = row + len(size), cum + int(size.sum())

    rows = materialise(rows.mapInArrow(number, widened(rows, _part="long", _row="long", _before="long", _open="long", _head="boolean")))
    group = F.struct("curve", "_group", "size", "_bytes", "_open")
    parts = sorted(rows.groupBy("_part").agg(F.count(F.lit(1)), F.sum("size"), F.min_by(group, "_row"), F.max_by(group, "_row")).collect())
    base = whole_parts(parts)
    base = df.sparkSession.createDataFrame(base, "_part long, _rows_before long, _bytes_before long, _head_open long")
    rows = rows.join(F.broadcast(base), "_part")  # one row for each partition
    opened = F.when(F.col("_head"), F.col("_head_open")).otherwise(F.col("_bytes_before") + F.col("_open"))
    middle = F.when(F.col("_bytes").isNull(), F.col("_bytes_before") + F.col("_before") + F.floor(F.col("size") / 2)).otherwise(opened + F.floor(F.col("_bytes") / 2))
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total)))).cast("int")).withColumn("_at", F.col("_rows_before") + F.col("_row"))
    first = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.min("_at")).collect()}
    start = F.create_map(*[F.lit(x) for k, v in first.items() for x in (k, v)])[F.col("shard")] if first else F.lit(0)
    return rows.select(F.col("_key").alias(key_column), "size", "text_crc32", "curve", "shard", (F.col("_at") - start).cast("long").alias("slot"))
