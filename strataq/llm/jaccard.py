"""N-gram Jaccard join with index lists, position blocks and answers carried over.

Sets of 5-word shingles are numbered by a hash of the whole set, so that equal sets
are one set.  All shingles have one global order: those of the commonest classes
last (classes come from a sketch of fixed size over all documents), then by hash.
Two sets that link share a shingle in both their prefixes, and the first one they
share stands early in both: the position filter.

1. Prefix entries (shingle, set, size, position) travel in packed blocks to index
   lists.  A short list gives its pairs that pass the size and position filters.  A
   long list gives each member's pair with a hub only.
2. Pairs are compared exactly, on whole sets; links give connected components.
3. In a long list, sets that a component already holds need no more pairs among
   themselves: a set's answers follow from those of the similar set before it.  Each
   list offers its other members a hub of its largest component; what is then still
   apart is taken in blocks by size and position, and block pairs that no link can
   join are skipped.

No link between different sets is lost; pairs inside a component are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataq.llm.batch import U, chunks, column, flat_ranges, mix, prefix_hash, runs, span_hash, text_bytes, word_spans
from strataq.llm.shared import bound_batches, frugal, materialise
from strataq.llm.suffixes import planes, unplanes

WORDS, SKETCH_BITS, SKETCH_BLOCKS, LONG = 5, 21, 64, 32
_STEP = U(0xC2B2AE3D27D4EB4F)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document of a chunk, and the offsets of each."""
    s, e, docs = word_spans(data, at)
    if not len(s):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    h = span_hash(prefix_hash(data, fold=True), s, e)
    n = len(h)
    roll = np.full(max(0, n - WORDS + 1), U(WORDS))
    for k in range(WORDS):
        roll = mix(roll * _STEP + h[k : n - WORDS + 1 + k])
    parts, sizes = [], []
    for i, j in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True):
        if j - i >= WORDS:
            x = np.sort(roll[i : j - WORDS + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        elif j > i:
            x = np.array([j - i], U)
            for k in range(i, j):
                x = mix(x * _STEP + h[k : k + 1])
        else:
            x = h[:0]
        parts.append(x)
        sizes.append(len(x))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def set_numbers(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set as a signed number."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ U(0x5851F42D4C957F2D)), dtype=U)])
    size = np.diff(at).astype(U)
    return mix(sums[at[1:]] - sums[at[:-1]] + size * _STEP).view(np.int64)


def each_chunk(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    return array_chunks(column(batch, text))


def array_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, at = text_bytes(texts)
    for i, j in chunks(at):
        sets, o = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
        yield i, j, sets, o, set_numbers(sets, o)


def numbered_sets(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, row): doc_id, row, n, and the set's number (null without words)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, _, o, f in each_chunk(b, "text"):
                n.append(np.diff(o))
                number.append(f)
            n, number = np.concatenate(n), np.concatenate(number)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "row"), pa.array(n), pa.array(number, mask=n == 0)], ["doc_id", "row", "n", "number"])

    return docs.mapInArrow(run, "doc_id long, row long, n long, number long")


def shingle_classes(docs: DataFrame) -> np.ndarray:
    """The class of every sketch cell: 0, or the magnitude by which its count stands out."""
    cells = (1 << SKETCH_BITS) // SKETCH_BLOCKS

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        for b in batches:
            for _, _, sets, o, f in each_chunk(b, "text"):
                new = [k for k, x in enumerate(f.tolist()) if not (x in seen or seen.add(x))]
                if len(seen) > 1_000_000:
                    seen.clear()
                if len(new) == len(f):
                    cell = sets
                elif new:
                    cell = sets[flat_ranges(o[:-1][new], np.diff(o)[new])]
                else:
                    continue
                sketch += np.bincount((cell >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([planes(sketch[i * cells : (i + 1) * cells]) for i in range(SKETCH_BLOCKS)], pa.binary())], ["block", "counts"])

    @frugal
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(column(b, "block").to_pylist(), column(b, "counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + unplanes(x)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "counts"])

    rows = docs.select("text").mapInArrow(count, "block int, counts binary").repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, counts binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        sketch[r["block"] * cells : (r["block"] + 1) * cells] = np.frombuffer(r["counts"], np.int64)
    mean = sketch.mean()
    over = sketch - mean - 6 * np.sqrt(mean)
    return np.where(over > 24, np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def can_link(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n <= m, whose first common shingle stands at p and q, can link: size and position filters."""
    need = (4 * (n + m) + 8) // 9
    return (5 * n >= 4 * m) & (p + q <= n + m - 2 * need) & (1 + np.minimum(n - p, m - q) - 1 >= need)


INDEX = "range int, a binary, b binary, c binary"


def index_entries(docs: DataFrame, classes, ranges: int) -> DataFrame:
    """Packed prefix entries; equal sets of one task are entered once."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count, seen = 0, set()

        def flush() -> pa.RecordBatch:
            nonlocal count
            t, f, w = (np.concatenate([np.zeros(0, k), *(x[i] for x in held)]) for i, k in enumerate((U, np.int64, U)))
            held.clear()
            count = 0
            order = np.argsort(t, kind="stable")
            t, f, w = t[order], f[order], w[order]
            edge = np.searchsorted(((t >> U(32)) * U(ranges)) >> U(32), np.arange(ranges + 1))
            rows = [(r, planes(t[i:j]), planes(f[i:j].view(U)), planes(w[i:j])) for r in range(ranges) if (i := edge[r]) < (j := edge[r + 1])]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["range", "a", "b", "c"])

        for b in batches:
            for _, _, sets, o, f in each_chunk(b, "text"):
                size = np.diff(o)
                level = classes.value[(sets >> U(64 - SKETCH_BITS)).astype(np.int64)]
                for k, x in enumerate(f.tolist()):
                    n = int(size[k])
                    if not n or x in seen:
                        continue
                    seen.add(x)
                    s, v = sets[o[k] : o[k + 1]], level[o[k] : o[k + 1]]
                    p = int(prefix_length(np.int64(n)))
                    if v[: 2 * p].any():
                        s = s[np.argsort(v, kind="stable")[:p]]
                    held.append((s[:p].copy(), np.full(p, x), (U(n) << U(32)) | np.arange(p, dtype=U)))
                    count += p
                if len(seen) > 500_000:
                    seen.clear()
                if count > 1_000_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, INDEX)


def hash_pairs(a: np.ndarray, b: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """Distinct pairs, packed by bucket."""
    if not len(a):
        return []
    a, b = np.minimum(a, b), np.maximum(a, b)
    where = (mix(a.view(U) * _STEP + b.view(U)) % U(buckets)).astype(np.int64)
    order = np.lexsort((b, a, where))
    a, b, where = a[order], b[order], where[order]
    first, _ = runs(where, a, b)
    a, b, where = a[first], b[first], where[first]
    return [(int(where[i]), a[i:j].tobytes(), b[i:j].tobytes()) for i, j in zip(*(x.tolist() for x in runs(where)), strict=True)]


def settle_index(buckets: int):
    """Index lists of a place: pairs (kind 0, packed) and the members of long lists (kind 1, packed)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for i in range(b.num_rows):
                parts.append(tuple(unplanes(b.column(c)[i].as_py()) for c in (1, 2, 3)))
        if not parts:
            return
        t, f, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
        parts.clear()
        f = f.view(np.int64)
        order = np.argsort(t, kind="stable")
        first, last = runs(t[order])
        live = np.repeat(last - first > 1, last - first)
        order = order[live]
        t, f, w = t[order], f[order], w[order]
        order = np.lexsort((f, w >> U(32), t))
        t, f, w = t[order], f[order], w[order]
        first, _ = runs(t, f)
        t, f, w = t[first], f[first], w[first]
        n, p = (w >> U(32)).astype(np.int64), (w & U(0xFFFFFFFF)).astype(np.int64)
        first, last = runs(t)
        size = last - first
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, LONG):
            # Members k apart in short lists; lists are in order of size.
            start = first[(size > k) & (size <= LONG)]
            count = size[(size > k) & (size <= LONG)] - k
            i = flat_ranges(start, count)
            ok = can_link(n[i], p[i], n[i + k], p[i + k])
            left.append(f[i[ok]])
            right.append(f[i[ok] + k])
        far = [np.zeros(0, np.int64)]
        for i, j in zip(first[size > LONG].tolist(), last[size > LONG].tolist(), strict=True):
            far.append(np.arange(i, j))
            while i < j:  # a hub for every range of sizes
                stop = i + int(np.searchsorted(4 * n[i:j], 5 * n[i], "right"))
                left.append(np.full(stop - i - 1, f[i]))
                right.append(f[i + 1 : stop])
                i = stop
        rows = [(0, *r) for r in hash_pairs(np.concatenate(left), np.concatenate(right), buckets)]
        far = np.concatenate(far)
        if len(far):
            rows.append((1, 0, np.stack([t[far].view(np.int64), f[far], n[far], p[far]], axis=1).tobytes(), b""))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["kind", "bucket", "x", "y"])

    return run


def distinct_pairs(packed: DataFrame, places: int) -> DataFrame:
    """(a, b) rows, a < b, each once, from packed buckets."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a += [np.frombuffer(x, np.int64) for x in column(batch, "x").to_pylist()]
            b += [np.frombuffer(x, np.int64) for x in column(batch, "y").to_pylist()]
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first, _ = runs(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])

    return packed.select("bucket", "x", "y").repartition(places, "bucket").mapInArrow(run, "a long, b long")


def long_lists(packed: DataFrame) -> DataFrame:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in column(b, "x").to_pylist():
                m = np.frombuffer(x, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(m[:, k]) for k in range(4)], ["list", "number", "n", "p"])

    return packed.select("x").mapInArrow(run, "list long, number long, n long, p long")


def squeezed(df: DataFrame) -> DataFrame:
    """(number, packed, size): compressed texts."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            data, at = text_bytes(column(b, "text"))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([column(b, "number"), pa.array([codec.compress(raw[i:j], asbytes=True) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()), pa.array(np.diff(at))], ["number", "packed", "size"])

    return df.select("number", "text").mapInArrow(run, "number long, packed binary, size long")


def unsqueezed(batch: pa.RecordBatch, packed: str, size: str) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(x, n, asbytes=True) for x, n in zip(column(batch, packed).to_pylist(), column(batch, size).to_pylist(), strict=True)], pa.large_binary())


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``link`` to pairs: the exact test on whole sets."""
    both = pairs.join(texts.toDF("a", "_pa", "_na"), "a").join(texts.toDF("b", "_pb", "_nb"), "b")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for x in "ab":
                out: list[np.ndarray] = []
                for i, j, s, o, _ in array_chunks(unsqueezed(b, f"_p{x}", f"_n{x}")):
                    out += [s[o[k] : o[k + 1]] for k in range(j - i)]
                sets.append(out)
            link = []
            for x, y in zip(*sets, strict=True):
                z = np.sort(np.concatenate([x, y]))
                same = int((z[1:] == z[:-1]).sum())
                link.append(100 * same >= 80 * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([column(b, "a"), column(b, "b"), pa.array(link, pa.bool_())], ["a", "b", "link"])

    return both.select("a", "b", "_pa", "_na", "_pb", "_nb").mapInArrow(run, "a long, b long, link boolean")


@frugal
def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins a place's edges to stars around least vertices; tells which edges are new."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        u.append(column(b, "u").to_numpy())
        v.append(column(b, "v").to_numpy())
    u, v = np.concatenate(u), np.concatenate(v)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (y := above.get(root, root)) != root:
            root = y
        while (y := above.get(x, x)) != root and y != x:
            above[x] = root
            x = y
        return root

    edges = set(zip(u.tolist(), v.tolist(), strict=True))
    for x, y in edges:
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
    stars = [(x, top(x)) for x in {x for e in edges for x in e}]
    rows = [(x, r, (x, r) not in edges) for x, r in stars if x != r]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_())], ["u", "v", "changed"])


def components(edges: DataFrame) -> DataFrame:
    """(number, component) of every end of an edge: the least number that edges reach.

    Each edge goes to the places of both its ends, where all edges that have come
    together become stars around their least vertex.  When no place makes a new
    edge, every vertex points to its component's least one.  One exchange a pass;
    edges are written to the shared folder between passes.
    """
    places = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    while True:
        dealt = e.select(F.explode(F.array("u", "v")).alias("key"), "u", "v").repartition(places, "key")
        e = materialise(dealt.mapInArrow(contract, "u long, v long, changed boolean"))
        if e.filter("changed").isEmpty():
            break
    stars = e.select("u", "v").union(e.select("v", "v"))
    return stars.toDF("number", "component").distinct()


def with_components(lists: DataFrame, found: DataFrame) -> DataFrame:
    return lists.join(found, "number", "left").withColumn("component", F.coalesce("component", "number"))


def hub_pairs(lists: DataFrame) -> DataFrame:
    """Of every long list, each member outside its largest component with one member of that."""
    parts = lists.groupBy("list", "component").agg(F.count(F.lit(1)).alias("_k"), F.min_by(F.struct(F.col("number").alias("hub"), F.col("n").alias("hub_n")), F.xxhash64("number", "list")).alias("_hub"))
    best = parts.groupBy("list").agg(F.max(F.struct("_k", "component", "_hub")).alias("_best"))
    best = best.select("list", F.col("_best.component").alias("_main"), F.col("_best._hub.hub").alias("hub"), F.col("_best._hub.hub_n").alias("hub_n"))
    near = lists.join(best, "list").filter((F.col("component") != F.col("_main")) & (5 * F.least("n", "hub_n") >= 4 * F.greatest("n", "hub_n")))
    return near.select(F.least("number", "hub").alias("a"), F.greatest("number", "hub").alias("b")).distinct()


def block_pairs(lists: DataFrame, places: int, buckets: int, block: int = 256) -> DataFrame:
    """All pairs of long lists that can link and lie in different components; blocks that cannot are skipped whole."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[np.zeros(0, np.int64)] for _ in range(5)]
        for b in batches:
            for c, name in zip(cols, ("list", "n", "p", "number", "component"), strict=True):
                c.append(column(b, name).to_numpy())
        t, n, p, f, c = (np.concatenate(x) for x in cols)
        order = np.lexsort((p, n, t))
        t, n, p, f, c = (x[order] for x in (t, n, p, f, c))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(*(x.tolist() for x in runs(t)), strict=True):
            if (c[i:j] == c[i]).all():
                continue
            edges = [*range(i, j, block), j]
            least = [int(p[x:y].min()) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            for x in range(len(least)):
                for y in range(x, len(least)):
                    a, b = edges[x], edges[y]
                    n_hi, m_lo, m_hi = int(n[edges[x + 1] - 1]), int(n[b]), int(n[edges[y + 1] - 1])
                    if 5 * n_hi < 4 * m_lo:
                        break
                    if 9 * (least[x] + least[y]) > n_hi + m_hi:
                        continue
                    u, v = np.arange(a, edges[x + 1])[:, None], np.arange(b, edges[y + 1])[None, :]
                    ok = (u < v) & (c[u] != c[v]) & can_link(n[u], p[u], n[v], p[v])
                    k, m = np.nonzero(ok)
                    left.append(f[a + k])
                    right.append(f[b + m])
        rows = hash_pairs(np.concatenate(left), np.concatenate(right), buckets)
        out = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "x", "y"])

    packed = lists.select("list", "number", "n", "p", "component").repartition(places, "list").mapInArrow(run, "bucket int, x binary, y binary")
    return distinct_pairs(packed, places)


def near_duplicates(df: DataFrame, key_column: str = "doc_id", text: str = "text", rows: bool = False) -> DataFrame:
    """Returns doc_id, n_shingles and component_id of every row.

    Texts that are null or have no words have no shingles and are their own
    component; rows with a null key link with nothing and have a null component.
    Rows of one key share a component if their sets do.  With ``rows``, two more
    columns tell texts of one key apart: ``row``, a hash of the text (a null text is
    empty), and ``component_row``, that of the component's least key (and hash).
    """
    spark: SparkSession = df.sparkSession
    bound_batches(spark)
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = buckets = 4 * places
    docs = df.select(F.col(key_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    base = materialise(numbered_sets(docs))
    usable = docs.filter(F.col("doc_id").isNotNull())
    classes = spark.sparkContext.broadcast(shingle_classes(usable))
    index = index_entries(usable, classes, ranges).repartition(places, "range").mapInArrow(settle_index(buckets), "kind int, bucket int, x binary, y binary")
    index = materialise(index)
    pairs = materialise(distinct_pairs(index.filter("kind = 0"), places))
    lists = materialise(long_lists(index.filter("kind = 1")))
    first = base.filter("number IS NOT NULL AND doc_id IS NOT NULL").groupBy("number").agg(F.min(F.struct("doc_id", "row")).alias("_at"))
    needed = pairs.select(F.col("a").alias("number")).union(pairs.select("b")).union(lists.select("number")).distinct()
    at = needed.join(first, "number").select("number", F.col("_at.doc_id").alias("doc_id"), F.col("_at.row").alias("row"))
    # Repeated rows lie together already, so that no further exchange is needed to keep one.
    texts = materialise(squeezed(usable.join(at, ["doc_id", "row"]).dropDuplicates(["doc_id", "row", "number"])))
    known = materialise(compared(pairs, texts))
    if not lists.isEmpty():
        found = components(known.filter("link"))
        extra = hub_pairs(with_components(lists, found)).join(known, ["a", "b"], "left_anti")
        known = materialise(known.union(compared(extra, texts)))
        found = components(known.filter("link"))
        rest = block_pairs(with_components(lists, found), places, buckets).join(known, ["a", "b"], "left_anti")
        known = materialise(known.union(compared(rest, texts)))
    found = components(known.filter("link"))
    whole = first.select("number", "_at.doc_id", "_at.row").join(found, "number", "left").withColumn("component", F.coalesce("component", "number"))
    least = whole.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("_least"))
    ids = whole.join(least, "component").select("number", F.col("_least.doc_id").alias("component_id"), F.col("_least.row").alias("component_row"))
    out = base.join(ids, "number", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"), "row", F.coalesce("component_row", "row").alias("component_row"))
    return out if rows else out.drop("row", "component_row")
