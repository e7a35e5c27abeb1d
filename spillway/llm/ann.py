"""Operator 10: nearest neighbours by inner product, by low-dimensional stable projections.

Inner products become distances: vectors get one more component that brings them all to the
largest norm, queries are scaled to it. Gaussian (2-stable) projections to M dimensions then keep
the ratio of projected to true squared distance chi-square distributed with M degrees of freedom. Vectors of fewer
than M components are their own projection, with true distances, and nothing is missed.

The index: a kd-tree over the projections of at most SAMPLE rows deals all rows into cells, and a cell's rows make up
blocks of about BLOCK at most, each with the box of its projections. The blocks' boxes, at most about 2 * BLOCKS rows of
2 * M numbers, go to all tasks. Each block has a kd-tree of its own. A query first searches the block whose box is
nearest; with the k-th score found there it goes to those blocks alone whose boxes pass the test. In a
block it takes leaves in the order of their projected distance and verifies points on the original vectors. The
test, for blocks, leaves and points alike: a place so far in the projection that a point as near as the k-th found
would lie there with probability under 1 - P is passed over, and once that holds for the next leaf, the search stops.

A block gives back all that may be among its k best by score and vec_id, so ties between different vectors go to the
smaller vec_id whatever the blocks. n_verified is the number of different vectors, block by block, that a query was
held against.

Defined results: vectors null, zero, or holding null or non-finite components take no part, as
queries and as candidates; only vectors of one dimension meet; rows with a null vec_id take no part;
rows that share a vec_id are candidates of their own but never of a query with that id, and where they are queries what they find is
ranked together; ties go to the smaller vec_id; very long vectors are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

M = 16
P = 0.97

#: Rows whose projections lay out the cells, at most: those with the least hash of their id.
SAMPLE = 50_000

#: Rows of a block, on average at most, while there are at most BLOCKS of them.
BLOCK = 8_192
BLOCKS = 1 << 16

#: Queries that meet a block in one go, and those whose scores are held side by side.
QUERIES = 8_192
TOGETHER = 256
LEAF = 64

PROBES = "block long, n long, ids binary, vectors binary, floors binary"
FOUND = "query_id long, vec_id long, score double, verified long"


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """Distribution function for an even m."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), m) < p else (low, mid)
    return high


def projection(dim: int, m: int) -> np.ndarray:
    return np.eye(dim + 1) if dim < m else np.random.default_rng(dim).standard_normal((dim + 1, m))


def limit_of(dim: int, m: int, p: float) -> float:
    """What a point's projected squared distance is, in true ones, with probability p at most."""
    return 1.0 if dim < m else quantile(p, m)


def projected(vectors: np.ndarray, norm: float, m: int) -> np.ndarray:
    """Projections of candidates, each with the component that brings it to the norm."""
    g = projection(vectors.shape[1], m)
    rest = np.sqrt(np.maximum(0, norm * norm - (vectors * vectors).sum(axis=1)))
    return vectors @ g[:-1] + rest[:, None] * g[-1]


def asked(queries: np.ndarray, norm: float, m: int) -> np.ndarray:
    """Projections of queries, scaled to the norm."""
    return (queries * (norm / np.sqrt((queries * queries).sum(axis=1)))[:, None]) @ projection(queries.shape[1], m)[:-1]


def within(queries: np.ndarray, floors: np.ndarray, norm: float, limit: float) -> np.ndarray:
    """The squared projected distance up to which something better than a score may lie."""
    lengths = np.sqrt((queries * queries).sum(axis=1))
    apart = np.where(np.isneginf(floors), np.inf, 2 * norm * norm - 2 * norm * floors / lengths)
    return limit * np.maximum(0, apart) + 1e-9 * norm * norm


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least squared distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        x = q[:, d : d + 1]
        out += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
    return out


class KdTree:
    """Leaves of at most `leaf` points each, cut at medians of the widest dimension, with their boxes, and the cuts."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves, self.cuts = [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            width = np.ptp(points[at], axis=0) if len(at) else np.zeros(1)
            if len(at) <= leaf or not width.max() > 0:
                me = -1 - len(self.leaves)
                self.leaves.append(at)
            else:
                d = int(np.argmax(width))
                order = np.argpartition(points[at, d], len(at) // 2)
                me = len(self.cuts)
                self.cuts.append([d, float(points[at[order[len(at) // 2]], d]), 0, 0])
                todo += [(at[order[: len(at) // 2]], me, 2), (at[order[len(at) // 2 :]], me, 3)]
            if parent >= 0:
                self.cuts[parent][side] = me
        self.low = np.array([points[x].min(axis=0) for x in self.leaves]) if len(points) else np.zeros((1, points.shape[1]))
        self.high = np.array([points[x].max(axis=0) for x in self.leaves]) if len(points) else np.zeros((1, points.shape[1]))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all cuts each point lies."""
        out = np.zeros(len(points), np.int64)
        todo = [(np.arange(len(points)), 0 if self.cuts else -1)]
        while todo:
            at, node = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                d, value, left, right = self.cuts[node]
                less = points[at, d] < value
                todo += [(at[less], left), (at[~less], right)]
        return out


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, norm: float, floors: np.ndarray | None = None, m: int = M, p: float = P, step: int = 8):
    """(query id, vec id, score) of each query's k nearest found in one block, of those not under its floor; and the vectors verified for each query.
    Equal vectors are kept once while it searches."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    order = np.argsort(ids, kind="stable")
    _, first, same = np.unique(raw[order], return_index=True, return_inverse=True)
    own = vectors[order][first]
    by_vector = np.argsort(same, kind="stable")
    members, edge = ids[order][by_vector], np.r_[0, np.cumsum(np.bincount(same))]
    points = projected(own, norm, m)
    tree, limit = KdTree(points), limit_of(vectors.shape[1], m, p)
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    out: tuple = ([], [], [])
    verified = np.zeros(len(queries), np.int64)
    for at in range(0, len(queries), TOGETHER):
        part = slice(at, at + TOGETHER)
        score, kth = _scan(tree, points, own, queries[part], floors[part], min(len(own), k + 1), norm, limit, m, step)
        verified[part] = (score > -np.inf).sum(axis=1)
        least = kth - 1e-9 * norm * np.sqrt((queries[part] ** 2).sum(axis=1))
        for q, x, s, low in zip(query_ids[part].tolist(), queries[part], score, least, strict=True):
            found = np.flatnonzero((s >= low) & (s > -np.inf))
            exact = (own[found] * x).sum(axis=1)
            rows = sorted((-e, v) for e, u in zip(exact.tolist(), found.tolist(), strict=True) for v in members[edge[u] : min(edge[u + 1], edge[u] + k + 1)].tolist() if v != q)[:k]
            out[0].extend([q] * len(rows))
            out[1].extend([v for _, v in rows])
            out[2].extend([-e for e, _ in rows])
    return *out, verified


def _scan(tree: KdTree, points: np.ndarray, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, want: int, norm: float, limit: float, m: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the points that each query verifies, others -inf, and its least score that still counts."""
    score, best, kth = np.full((len(queries), len(own)), -np.inf), np.full((len(queries), want), -np.inf), floors.copy()
    q = asked(queries, norm, m)
    far = box_distances(q, tree.low, tree.high)
    turn = np.argsort(far, axis=1, kind="stable")
    reach, active = within(queries, kth, norm, limit), np.arange(len(queries))
    for at in range(0, len(tree.leaves), step):
        active = active[far[active, turn[active, at]] <= reach[active]]
        if not len(active):
            break
        chosen = turn[active, at : at + step]
        flat = np.argsort(chosen, axis=None, kind="stable")
        leaf_of, query_of = chosen.ravel()[flat], active[flat // chosen.shape[1]]
        cuts = np.flatnonzero(np.diff(leaf_of)) + 1
        for leaf, qs in zip(leaf_of[np.r_[0, cuts]], np.split(query_of, cuts), strict=True):
            here = tree.leaves[leaf]
            apart = ((q[qs][:, None, :] - points[here][None]) ** 2).sum(axis=2)
            got = np.where(apart <= reach[qs][:, None], queries[qs] @ own[here].T, -np.inf)
            score[qs[:, None], here[None]] = got
            hit = got.max(axis=1) > best[qs].min(axis=1)
            if hit.any():
                both = np.concatenate([best[qs[hit]], got[hit]], axis=1)
                best[qs[hit]] = -np.partition(-both, want - 1, axis=1)[:, :want]
        kth[active] = np.maximum(floors[active], best[active].min(axis=1))
        reach[active] = within(queries[active], kth[active], norm, limit)
    return score, kth


def usable(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    rows = embeddings.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(column), -1)


def _cells(rows: DataFrame, n: int, norm: float, m: int, sample: int, block: int) -> tuple[DataFrame, int]:
    """rows with their cell, from a tree over the projections of at most `sample` of them, which alone pass the driver; and a block's rows."""
    block = max(block, math.ceil(n / BLOCKS))

    def lay(it):
        for batch in it:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                points = projected(_matrix(batch.column("v").take(pa.array(np.flatnonzero(dims == dim)))), norm, m)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "m": pa.array([points.shape[1]], pa.int32()), "points": [points.tobytes()]})

    found: dict[int, list[np.ndarray]] = {}
    if n > block:
        for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).mapInArrow(lay, "dim int, m int, points binary").collect():
            found.setdefault(r["dim"], []).append(np.frombuffer(r["points"], "<f8").reshape(-1, r["m"]))
    few = sum(len(x) for parts in found.values() for x in parts)
    trees: dict[int, tuple[int, KdTree]] = {}
    for dim in sorted(found):
        trees[dim] = (sum(len(t.leaves) for _, t in trees.values()), KdTree(np.concatenate(found[dim]), max(1, few * block // (2 * n))))
    held = rows.sparkSession.sparkContext.broadcast(trees)

    def deal(it):
        for batch in it:
            dims = batch.column("dim").to_numpy()
            cell = np.full(batch.num_rows, -1, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in held.value:
                    at = np.flatnonzero(dims == dim)
                    first, tree = held.value[dim]
                    cell[at] = first + tree.leaf_of(projected(_matrix(batch.column("v").take(pa.array(at))), norm, m))
            yield batch.append_column("cell", pa.array(cell))

    return rows.mapInArrow(deal, "vec_id long, v array<double>, dim int, cell long"), block


def _index(rows: DataFrame, scratch: Scratch, n: int, norm: float, m: int, sample: int, block: int) -> DataFrame:
    """The rows as blocks, one row each: block, n, dim, ids, vectors, and the box of their projections."""
    dealt, block = _cells(rows, n, norm, m, sample, block)
    dealt = scratch.save(dealt, "dealt")
    parts = dealt.groupBy("cell", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    keyed = dealt.join(F.broadcast(parts), ["cell", "dim"]).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        vectors = _matrix(group.column("v"))
        points = projected(vectors, norm, m)
        raw = {"ids": group.column("vec_id").to_numpy().astype("<i8"), "vectors": vectors, "low": points.min(axis=0), "high": points.max(axis=0)}
        return pa.table({"dim": group.column("dim")[:1], "n": [group.num_rows], **{c: [x.tobytes()] for c, x in raw.items()}})

    packed = keyed.groupBy("cell", "dim", "part").applyInArrow(pack, "dim int, n long, ids binary, vectors binary, low binary, high binary")
    return scratch.save(packed.withColumn("block", F.monotonically_increasing_id()), "index")


def _probes(asking: DataFrame, boxes: dict, norm: float, m: int, p: float, home: bool) -> DataFrame:
    """Queries (vec_id, v, dim, floor) as rows of the blocks that they go to: with home the nearest one, else all others that may hold something over their floors."""
    held = asking.sparkSession.sparkContext.broadcast(boxes)

    def deal(it):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for batch in it:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                names, low, high = held.value[dim]
                every = np.flatnonzero(dims == dim)
                for i in range(0, len(every), 1024):
                    some = batch.take(pa.array(every[i : i + 1024]))
                    vectors, ids, floors = _matrix(some.column("v")), some.column("vec_id").to_numpy(), some.column("floor").to_numpy()
                    far = box_distances(asked(vectors, norm, m), low, high)
                    nearest_box = far.argmin(axis=1)
                    if home:
                        go = np.zeros(far.shape, bool)
                        go[np.arange(len(far)), nearest_box] = True
                    else:
                        go = far <= within(vectors, floors, norm, limit_of(dim, m, p))[:, None]
                        go[np.arange(len(far)), nearest_box] = False
                    rows = []
                    for b in np.flatnonzero(go.any(axis=0)).tolist():
                        at = np.flatnonzero(go[:, b])
                        rows.append((names[b], len(at), ids[at].astype("<i8").tobytes(), vectors[at].tobytes(), floors[at].astype("<f8").tobytes()))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PROBES.split(", ")])

    return asking.mapInArrow(deal, PROBES)


def _meet(index: DataFrame, probes: DataFrame, k: int, norm: float, m: int, p: float) -> DataFrame:
    """What the queries find in the blocks that they go to; for each of them and block also a row without vec_id that has `verified`.
    A block is sent once for each QUERIES that come to it."""
    sizes = probes.groupBy("block").agg(F.ceil(F.sum("n") / QUERIES).cast("int").alias("parts"))
    left = index.join(F.broadcast(sizes), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = probes.join(F.broadcast(sizes), "block").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int"))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], [], []]
        if left.num_rows:
            dim = left.column("dim")[0].as_py()
            read = lambda x, kind: np.frombuffer(x.as_py(), kind)
            ids, vectors = read(left.column("ids")[0], "<i8"), read(left.column("vectors")[0], "<f8").reshape(-1, dim)
            raw = [b"".join(x.as_py() for x in right.column(c)) for c in ("ids", "vectors", "floors")]
            q, x, floors = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], "<f8").reshape(-1, dim), np.frombuffer(raw[2], "<f8")
            *found, verified = search(ids, vectors, q, x, k, norm, floors, m, p)
            out = [found[0] + q.tolist(), found[1] + [None] * len(q), found[2] + [None] * len(q), [None] * len(found[0]) + verified.tolist()]
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    columns = ["block", "part", "dim", "ids", "vectors"]
    return left.select(*columns).groupBy("block", "part").cogroup(right.select("block", "part", "ids", "vectors", "floors").groupBy("block", "part")).applyInArrow(meet, FOUND)


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", m: int = M, p: float = P, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """The k nearest found of each vector whose id is divisible by `every`: query_id, rank, vec_id, score, n_verified."""
    scratch = Scratch(embeddings.sparkSession, "ann")
    rows = usable(embeddings, id_column, vector_column)
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, top = rows.agg(F.count("*"), F.max(squares)).first()
    norm = math.sqrt(top or 1.0)
    index = _index(rows, scratch, n, norm, m, sample, block)
    boxes: dict = {}
    for dim in index.select("block", "dim", "low", "high").orderBy("block").collect():
        boxes.setdefault(dim["dim"], []).append((dim["block"], np.frombuffer(dim["low"], "<f8"), np.frombuffer(dim["high"], "<f8")))
    boxes = {dim: (np.array([b for b, _, _ in x]), np.array([low for _, low, _ in x]), np.array([high for _, _, high in x])) for dim, x in boxes.items()}
    queries = rows.filter(F.col("vec_id") % every == 0)
    home = _probes(queries.withColumn("floor", F.lit(float("-inf"))), boxes, norm, m, p, True)
    first = scratch.save(_meet(index, scratch.save(home, "home"), k, norm, m, p), "first")
    # a query has at most k finds of its first block
    floors = first.filter("vec_id is not null").groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    floors = floors.select(F.col("query_id").alias("vec_id"), F.coalesce(F.get("s", F.lit(k - 1)), F.lit(float("-inf"))).alias("floor"))
    again = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = scratch.save(_probes(again, boxes, norm, m, p, False), "rest")
    found = first.unionByName(_meet(index, rest, k, norm, m, p))
    by = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(by.orderBy(F.desc_nulls_last("score"), "vec_id"))).withColumn("n_verified", F.sum("verified").over(by))
    return ranked.filter((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "n_verified")
