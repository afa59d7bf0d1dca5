"""Exact top-k inner products by best-first search in M-trees.

With one more coordinate, sqrt(M^2 - |x|^2), inner product order becomes Euclidean
distance order, which is a metric, so that an M-tree answers exactly: nodes are
pages of at most ``PAGE`` entries with covering radii and distances to the parent's
routing object.  A search opens nodes in the order of their least possible
distance; stored distances and the triangle inequality save most distance
computations, and scores themselves are integers computed exactly.  Queries of one
tree go down together, each only into the nodes that its own bound reaches, so that
a page's scores are one matrix product.

The top of the tree is spread over the cluster.  Vectors go to the cell of their
nearest pivot; one row for each cell, with its covering radius and greatest norm, is
broadcast.  A first bound on each query's k-th score, from a bounded sample of real
candidates, rules out cells before anything is sent: a query travels only to cells
that its bound cannot exclude.  A cell of more than ``group`` vectors is dealt to
several trees; a tree that more than ``block`` queries ask is built several times.
Trees are large, for each query is sent to each tree that it has to ask.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strataq.llm.batch import column, runs
from strataq.llm.shared import frugal, materialise

PAGE = 256
TOGETHER = 1024  # queries that go down a tree together
SENT = 16 << 20  # bytes of queries in one batch
EXACT, WHOLE = float(1 << 23), float(1 << 27)  # below these, sums of products are exact as doubles, or as 64-bit integers
MOST = 2.0**500


def quantise(embedding: list | None) -> np.ndarray | None:
    """floor(256 x) of every component as exact doubles, or None if the vector takes no part."""
    if not embedding or any(v is None for v in embedding):
        return None
    x = np.asarray(embedding, np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(256.0 * x)
    return x if (np.abs(x) < MOST).all() else None


def pack(x: np.ndarray) -> bytes:
    """A quantised vector: 16-bit integers if they hold it, else doubles; the length tells them apart."""
    return x.astype("<i2").tobytes() if len(x) and float(np.abs(x).max()) < 32768 else x.tobytes()


def unpack(packed: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(packed, "<i2").astype(np.float64) if len(packed) == 2 * dims else np.frombuffer(packed, np.float64)


def quantised(df: DataFrame, key_column: str, vector: str) -> DataFrame:
    """Rows that take part: key, number of components, packed vector."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, len(q), pack(q)) for k, v in zip(column(b, key_column).to_pylist(), column(b, vector).to_pylist(), strict=True) if k is not None and (q := quantise(v)) is not None]
            keys, dims, packed = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "dims", "packed"])

    return df.select(key_column, vector).mapInArrow(run, "vec_id long, dims int, packed binary")


def vectors(packed: list[bytes], dims: int) -> np.ndarray:
    if all(len(p) == 2 * dims for p in packed):
        return np.frombuffer(b"".join(packed), "<i2").reshape(-1, dims).astype(np.float64)
    return np.stack([unpack(p, dims) for p in packed])


def whole_numbers(x: np.ndarray, most: float) -> np.ndarray:
    """The same vectors in a type whose sums of products are exact if no component of either side reaches ``most``."""
    if most < EXACT and x.shape[-1] < 128:
        return x
    if most < WHOLE and x.shape[-1] <= 256:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def float_kind(most: float) -> type | None:
    """The float type in which sums of products are exact if lengths multiply to ``most``: no partial sum is larger."""
    return np.float32 if most < 2.0**23 else np.float64 if most < 2.0**52 else None


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    most = max(float(np.abs(x).max(initial=0.0)), float(np.abs(q).max(initial=0.0)))
    return whole_numbers(x, most) @ whole_numbers(q, most)


def sort_key(score: int) -> bytes:
    """Bytes in the order of the integers, however large."""
    size = (abs(score).bit_length() + 7) // 8
    plain = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + plain if score >= 0 else b"\0" + bytes(255 - v for v in plain)


class Node:
    """Routing vectors or leaf entries, with radii and distances to the parent's routing object."""

    __slots__ = ("children", "from_parent", "radii", "rows", "start")

    def __init__(self, rows: np.ndarray, from_parent: np.ndarray, radii: np.ndarray | None = None, children: list | None = None, start: int = 0):
        self.rows, self.from_parent, self.radii, self.children, self.start = rows, from_parent, radii, children, start


class MTree:
    """An M-tree over vectors of whole numbers, loaded in bulk; rows that repeat key and vector count once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order].astype(np.float64)
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
        self.ids, self.x = ids[new], x[new]
        self.largest = float(np.abs(self.x).max(initial=0.0))
        self.typed: dict[str, np.ndarray] = {}
        self.scale = 1.0 if self.largest < 2.0**60 else 2.0 ** -np.ceil(np.log2(self.largest))
        f = self.x * self.scale
        square = (f * f).sum(axis=1)
        self.most = float(square.max()) if len(f) else 0.0
        self.y = np.concatenate([f, np.sqrt(np.maximum(0.0, self.most - square))[:, None]], axis=1)
        self.slack = 1e-6 * (self.scale + np.sqrt(self.most))
        self.square = (self.y * self.y).sum(axis=1)
        self.computed = 0
        self.paged: list[np.ndarray] = []
        self.placed = 0
        self.root = self._build(np.arange(len(f)), None, np.random.default_rng(5))
        # Vectors in the order of the pages, for products of whole pages.
        self.paged = np.concatenate(self.paged) if self.paged else np.zeros(0, np.int64)
        self.longest = float(np.sqrt((self.x * self.x).sum(axis=1).max(initial=0.0)))
        self.pages: dict[type, np.ndarray] = {}

    def _distance(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        d = self.y[rows] - point
        return np.sqrt((d * d).sum(axis=1))

    def _distances(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each point to each row; ``slack`` is above their error."""
        d = -2.0 * (points @ self.y[rows].T)
        d += (points * points).sum(axis=1)[:, None]
        d += self.square[rows]
        return np.sqrt(np.maximum(d, 0.0, out=d), out=d)

    def _build(self, rows: np.ndarray, parent: int | None, rng: np.random.Generator) -> Node:
        away = (lambda r: np.zeros(len(r)) if parent is None else self._distance(r, self.y[parent]))
        if len(rows) <= PAGE:
            far = away(rows)
            order = np.argsort(far, kind="stable")
            start, self.placed = self.placed, self.placed + len(rows)
            self.paged.append(rows[order])
            return Node(rows[order], far[order], start=start)
        pivots = rng.choice(rows, max(2, min(32, len(rows) // (PAGE // 2))), replace=False)
        near = np.concatenate([self._distances(self.y[rows[i : i + 8192]], pivots) for i in range(0, len(rows), 8192)])
        owner = near.argmin(axis=1)
        if (owner == owner[0]).all():  # equal vectors: pages in order
            owner = np.arange(len(rows)) * len(pivots) // len(rows)
        used = [i for i in range(len(pivots)) if (owner == i).any()]
        children = [self._build(rows[owner == i], int(pivots[i]), rng) for i in used]
        radii = np.array([near[owner == i, i].max() for i in used])
        return Node(pivots[used], away(pivots[used]), radii, children)

    def search(self, own: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) with score >= floor, without the id ``own``; ties to smaller ids."""
        most = max(self.largest, float(np.abs(q).max(initial=0.0)))
        asked = whole_numbers(q.astype(np.float64), most)
        kind = asked.dtype.char
        if kind not in self.typed:
            self.typed[kind] = self.x if kind == "d" else whole_numbers(self.x, most)
        plain = self.typed[kind]
        qf = np.append(q.astype(np.float64) * self.scale, 0.0)
        shift = float(qf @ qf) + self.most
        give = self.slack + 1e-6 * float(np.sqrt(qf @ qf))
        reach = lambda score: np.sqrt(max(0.0, shift - 2.0 * float(score) * self.scale * self.scale)) + give  # noqa: E731  distance at which this score lies
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        far = np.inf if floor is None else reach(floor)
        queue: list[tuple[float, int, Node, float | None]] = [(0.0, 0, self.root, None)]
        n = 0
        while queue and queue[0][0] <= far:
            _, _, node, d_parent = heapq.heappop(queue)
            radii = node.radii if node.radii is not None else 0.0
            if d_parent is None:
                keep = np.arange(len(node.rows))
            else:  # stored distances rule entries out before any computation
                keep = np.flatnonzero(np.abs(d_parent - node.from_parent) - radii <= far)
            if not len(keep):
                continue
            rows = node.rows[keep]
            self.computed += len(rows)
            if node.children is None:
                scores = plain[rows] @ asked
                low = floor if len(best) < k else best[0][0] if floor is None else max(floor, best[0][0])
                for i in np.flatnonzero(scores >= low) if low is not None else range(len(rows)):
                    item = (int(scores[i]), -int(self.ids[rows[i]]))
                    if item[1] == -own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    far = min(far, reach(best[0][0]))
            else:
                d = self._distance(rows, qf)
                least = np.maximum(0.0, d - node.radii[keep])
                for i in np.flatnonzero(least <= far):
                    n += 1
                    heapq.heappush(queue, (float(least[i]), n, node.children[keep[i]], float(d[i])))
        return sorted(((s, -i) for s, i in best), key=lambda r: (-r[0], r[1]))


    def search_all(self, own: np.ndarray, q: np.ndarray, k: int, floors: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many queries at once: places of queries, scores, ids; each query's best come first."""
        kind = float_kind(float(np.sqrt((q * q).sum(axis=1).max(initial=0.0))) * self.longest)
        if kind is None:  # whole numbers of any size
            found = [(i, s, v) for i in range(len(q)) for s, v in self.search(int(own[i]), q[i], k, floors[i])]
            which, scores, ids = zip(*found, strict=True) if found else ((), (), ())
            return np.array(which, np.int64), np.array(scores, object), np.array(ids, np.int64)
        if kind not in self.pages:
            self.pages[kind] = self.x[self.paged].astype(kind)
        parts = [self._down(own[i : i + TOGETHER], q[i : i + TOGETHER], k, floors[i : i + TOGETHER], kind) for i in range(0, len(q), TOGETHER)]
        which = np.concatenate([w + i * TOGETHER for i, (w, _, _) in enumerate(parts)])
        return which, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def _down(self, own: np.ndarray, q: np.ndarray, k: int, floors: list[int | None], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(q)
        asked, pages = q.astype(kind), self.pages[kind]
        qf = np.concatenate([q * self.scale, np.zeros((n, 1))], axis=1)
        square = (qf * qf).sum(axis=1)
        shift, give = square + self.most, self.slack + 1e-6 * np.sqrt(square)
        least = np.array([-np.inf if f is None else float(f) for f in floors])
        reach = lambda at: np.sqrt(np.maximum(0.0, shift[at] - 2.0 * least[at] * self.scale * self.scale)) + give[at]
        far = reach(np.arange(n))
        best_s, best_i = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

        def page(node: Node, at: np.ndarray, d: np.ndarray | None) -> None:
            lo, hi = 0, len(node.rows)
            if d is not None:  # stored distances rule entries out before any computation
                lo = int(np.searchsorted(node.from_parent, (d - far[at]).min(), "left"))
                hi = int(np.searchsorted(node.from_parent, (d + far[at]).max(), "right"))
            if lo >= hi:
                return
            self.computed += len(at) * (hi - lo)
            first = node.start + lo
            scores = asked[at] @ pages[first : node.start + hi].T
            # A floor beyond the type's whole numbers is beyond every score too.
            hit = np.flatnonzero(scores >= least[at].astype(kind)[:, None])
            i, j = at[hit // (hi - lo)], hit % (hi - lo)
            ids = self.ids[self.paged[first + j]]
            other = ids != own[i]
            if not other.any():
                return
            i, ids, s = i[other], ids[other], scores.ravel()[hit[other]].astype(np.float64)
            touched = np.unique(i)
            i = np.concatenate([i, np.repeat(touched, k)])
            s = np.concatenate([s, best_s[touched].ravel()])
            ids = np.concatenate([ids, best_i[touched].ravel()])
            order = np.lexsort((ids, -s, i))
            i, s, ids = i[order], s[order], ids[order]
            begins = np.searchsorted(i, touched)
            take = begins[:, None] + np.arange(k)  # every query has its k old ones here
            best_s[touched], best_i[touched] = s[take], ids[take]
            least[touched] = np.maximum(least[touched], best_s[touched, k - 1])
            far[touched] = np.minimum(far[touched], reach(touched))

        def down(node: Node, at: np.ndarray, d: np.ndarray | None) -> None:
            if node.children is None:
                page(node, at, d)
                return
            self.computed += len(at) * len(node.rows)
            away = self._distances(qf[at], node.rows)
            nearest = away.argmin(axis=1)
            # Each query first into its nearest node, for a good bound, then into the others that this bound reaches.
            for c in np.unique(nearest).tolist():
                own_ = np.flatnonzero((nearest == c) & (away[:, c] - node.radii[c] <= far[at]))
                if len(own_):
                    down(node.children[c], at[own_], away[own_, c])
            for c in np.argsort(away.sum(axis=0)).tolist():
                rest = np.flatnonzero((nearest != c) & (away[:, c] - node.radii[c] <= far[at]))
                if len(rest):
                    down(node.children[c], at[rest], away[rest, c])

        if len(self.ids):
            down(self.root, np.arange(n), None)
        i, j = np.nonzero(best_s > -np.inf)
        return i, best_s[i, j], best_i[i, j]


class Cells:
    """The top of the tree for vectors of one length: pivots, and for each cell its covering radius, greatest norm, first tree and number of trees."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: int):
        self.ids, self.x, self.pivots = ids, x, x[:pivots]
        self.scale = 2.0 ** -np.ceil(np.log2(max(1.0, float(np.abs(x).max(initial=0.0)))))
        self.unit = self.pivots * self.scale
        self.square = (self.unit * self.unit).sum(axis=1)
        self.cells = np.zeros(0, np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector: its cell, the distance to that cell's pivot, and its norm."""
        u = x * self.scale
        cell = (self.square - 2.0 * (u @ self.unit.T)).argmin(axis=1)
        away = np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))
        return cell, away, np.sqrt((x * x).sum(axis=1))

    def set(self, cells: list[tuple[int, float, float, int, int]]) -> None:
        self.cells, self.radius, self.norm, self.base, self.trees = (np.array(c) for c in zip(*cells, strict=True))

    def reached(self, own: int, q: np.ndarray, k: int) -> tuple[int | None, np.ndarray]:
        """A score that the k-th best of ``q`` has at least, and the cells that can hold such a score."""
        apart = np.flatnonzero(self.ids != own)
        if len(apart) < k:
            return None, np.arange(len(self.cells))
        scores = exact_products(self.x[apart], q)
        floor = int(np.sort(scores)[-k])
        size = float(np.sqrt(q @ q))
        at = self.pivots[self.cells]
        greatest = np.minimum(at @ q + size * self.radius, size * self.norm)
        give = 1e-9 * size * (np.sqrt((at * at).sum(axis=1)) + self.radius)
        return floor, np.flatnonzero(greatest + give >= float(floor) - 1e-9 * abs(float(floor)))


def grouped_cells(counts: list, top: dict[int, Cells], group: int) -> int:
    """Gives every cell its trees; returns how many there are."""
    base = 0
    cells: dict[int, list[tuple[int, float, float, int, int]]] = {}
    for dims, cell, n, radius, norm in sorted(counts):
        trees = -(-n // group)
        cells.setdefault(dims, []).append((cell, radius, norm, base, trees))
        base += trees
    for dims, own in cells.items():
        top[dims].set(own)
    return base


def sent(queries: DataFrame, top, k: int) -> DataFrame:
    """(g, query_id, mark, dims, packed, floor): every query once for each tree that can hold one of its best.

    Batches of at most about twice ``SENT`` bytes leave the worker, whatever the number of trees.
    """

    def batch(b: pa.RecordBatch, which: list[int], trees: list[int], floors: list[str | None]) -> pa.RecordBatch:
        out = b.take(pa.array(which, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), *(column(out, c) for c in ("query_id", "mark", "dims", "packed")), pa.array(floors, pa.string())], ["g", "query_id", "mark", "dims", "packed", "floor"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, trees, floors, size = [], [], [], 0
            packed = column(b, "packed").to_pylist()
            for i, (own, d, p) in enumerate(zip(column(b, "query_id").to_pylist(), column(b, "dims").to_pylist(), packed, strict=True)):
                cells = top.value[d]
                floor, ok = cells.reached(own, unpack(p, d), k)
                asked = [g for c in ok.tolist() for g in range(cells.base[c], cells.base[c] + cells.trees[c])]
                for j in range(0, len(asked), most := max(1, SENT // len(p))):
                    part = asked[j : j + most]
                    which += [i] * len(part)
                    trees += part
                    floors += [None if floor is None else str(floor)] * len(part)
                    size += len(part) * len(p)
                    if size >= SENT:
                        yield batch(b, which, trees, floors)
                        which, trees, floors, size = [], [], [], 0
            yield batch(b, which, trees, floors)

    return queries.mapInArrow(run, "g int, query_id long, mark long, dims int, packed binary, floor string")


def spread(df: DataFrame, every: int, k: int, sample: int, group: int | None, key_column: str, vector: str) -> tuple[DataFrame, DataFrame, int] | None:
    """Vectors with their trees, queries with the trees that they have to ask, and the number of trees."""
    spark = df.sparkSession
    rows = materialise(quantised(df, key_column, vector))
    n = rows.count()
    if not n:
        return None
    chance = F.pmod(F.xxhash64("vec_id", F.lit("pivots")), F.lit(1 << 40)) / float(1 << 40)
    # Of every length, about its share of the sample, and one at least.
    lengths = {r[0]: r[1] for r in rows.groupBy("dims").agg(F.min_by("packed", "vec_id")).collect()}
    group = group or max(4096, min(131072, (1 << 23) // max(lengths)))
    head = rows.filter(chance < min(1.0, 2.0 * sample / n)).dropDuplicates(["vec_id", "packed"]).orderBy(F.xxhash64("vec_id", F.lit("pivots")), "vec_id", "packed").limit(sample).collect()
    top: dict[int, Cells] = {}
    for d, one in lengths.items():
        own = [r for r in head if r["dims"] == d]
        ids, x = (np.array([r["vec_id"] for r in own]), vectors([r["packed"] for r in own], d)) if own else (np.zeros(0, np.int64), vectors([one], d))
        top[d] = Cells(ids if own else np.array([-1]), x, max(1, min(sample, -(-4 * n // group))))
        if not own:  # this vector is a pivot, not a candidate that bounds scores
            top[d].ids, top[d].x = ids, x[:0]
    pivots = spark.sparkContext.broadcast(top)

    @frugal
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = column(b, "dims").to_numpy()
            cell, away, norm = np.zeros(len(dims), np.int64), np.zeros(len(dims)), np.zeros(len(dims))
            packed = column(b, "packed").to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                cell[at], away[at], norm[at] = pivots.value[d].nearest(vectors([packed[i] for i in at], d))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(norm)], [*b.schema.names, "cell", "away", "norm"])

    dealt = rows.mapInArrow(nearest, "vec_id long, dims int, packed binary, cell int, away double, norm double")
    # At most ``sample`` rows for each length.
    counts = [tuple(r) for r in dealt.groupBy("dims", "cell").agg(F.count(F.lit(1)), F.max("away"), F.max("norm")).collect()]
    n_trees = grouped_cells(counts, top, group)
    plan = spark.createDataFrame([(int(d), int(c), int(s), int(t)) for d, x in top.items() for c, s, t in zip(x.cells, x.base, x.trees, strict=True)], "dims int, cell int, _base int, _trees int")
    members = dealt.join(F.broadcast(plan), ["dims", "cell"])
    members = members.select((F.col("_base") + F.pmod(F.xxhash64("vec_id", F.lit("salt")), F.col("_trees"))).cast("int").alias("g"), "vec_id", "dims", "packed")
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("mark", F.xxhash64("packed")).dropDuplicates(["vec_id", "mark"]).withColumnRenamed("vec_id", "query_id")
    return members, sent(queries.select("query_id", "mark", "dims", "packed"), spark.sparkContext.broadcast(top), k), n_trees


def search_trees(k: int):
    """In a partition in order of tree, its vectors before its queries: each query's best in each tree."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, ids, packed, dims = None, None, [], [], 0
        for b in batches:
            g, block, asks = column(b, "g").to_numpy(), column(b, "b").to_numpy(), column(b, "asks").to_numpy(zero_copy_only=False)
            out: list[tuple[int, int, int, int, bytes]] = []
            for i, j in zip(*(x.tolist() for x in runs(g, block, asks)), strict=True):
                part, key = b.slice(i, j - i), (int(g[i]), int(block[i]))
                if key != now:
                    now, tree, ids, packed = key, None, [], []
                if not asks[i]:
                    ids.append(column(part, "id").to_numpy())
                    packed += column(part, "packed").to_pylist()
                    dims = column(part, "dims")[0].as_py()
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = MTree(np.concatenate(ids), vectors(packed, dims))
                    packed = []
                own, mark = (column(part, c).to_numpy() for c in ("id", "mark"))
                floors = [None if f is None else int(f) for f in column(part, "floor").to_pylist()]
                which, scores, found = tree.search_all(own, vectors(column(part, "packed").to_pylist(), dims), k, floors)
                whole = [int(s) for s in scores.tolist()]
                out += zip(own[which].tolist(), mark[which].tolist(), found.tolist(), [min(max(s, -(2**63)), 2**63 - 1) for s in whole], [sort_key(s) for s in whole], strict=True)
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["query_id", "mark", "vec_id", "score", "order"])

    return run


def top_k(df: DataFrame, every: int = 50, k: int = 5, sample: int = 1024, group: int | None = None, block: int = 65536, key_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every vector whose key is divisible by ``every``, its ``k`` best other vectors by integer inner product.

    Returns query_id, rank (from 1), vec_id, score.  Vectors that are null or empty, or
    hold null or non-finite components or such that reach 2^500 when scaled, take no
    part, nor do rows without a key; vectors of different lengths are not compared.
    Rows that repeat key and vector entirely count once; different vectors of one key
    each take part, as queries with ranks of their own, and never find each other.
    Ranks follow the exact scores; a score outside the range of a long is returned as
    the range's end.  ``sample`` bounds the pivots and the first candidates; without
    ``group``, a tree has up to 131 072 vectors and 64 MB of components.
    """
    spark = df.sparkSession
    made = spread(df, every, k, sample, group, key_column, vector)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    members, asked, trees = made
    blocks = asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    blocks = materialise(blocks)  # one row for each tree that is asked
    blocks = F.broadcast(blocks) if trees <= 1_000_000 else blocks
    left = members.join(blocks, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("b"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("mark"), "dims", "packed", F.lit(None).cast("string").alias("floor"))
    right = asked.join(blocks, "g").select("g", F.pmod(F.xxhash64("query_id", F.lit("block")), F.col("_blocks")).cast("int").alias("b"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "mark", "dims", "packed", "floor")
    both = left.unionByName(right).repartition(min(trees, 4096), "g", "b")  # large trees: a task each
    both = both.sortWithinPartitions("g", "b", "asks")
    found = both.mapInArrow(search_trees(k), "query_id long, mark long, vec_id long, score long, order binary")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("order"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
