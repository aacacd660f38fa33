"""Exact top-k inner products by a Voronoi join.

Components become floor(64 * x). About sqrt(n) pivots, a bounded sample of the vectors, divide queries and data into cells
by the nearest pivot. With p the unit vector of a cell's pivot, a vector x is a = x.p along it and r = |x - a p| beside it, so

    q.x <= a(q) a(x) + r(q) r(x),

and the summary of a cell's queries (the range of a(q), the largest r(q)) bounds their scores with x.

1. Thresholds. Each query meets up to WITNESSES vectors of its cell, and of its neighbours where the cell holds too few. The
   k-th best score among them is one that the query reaches; the least of a cell's queries is the threshold of the cell.
2. Pairs of cells whose balls (pivot and radius) can't reach the threshold are left out as a whole; of the other cells
   only the vectors whose own bound reaches the threshold of one of a group's cells are sent to that group. Neighbouring
   cells of queries are one group, up to a core's share of all queries; where bounds exclude so little that vectors would go
   to more than SENT groups on average, groups are larger, up to BLOCK queries.
3. A group's vectors are dealt to as many parts as its cells' sizes call for. A task multiplies the queries of a cell with
   those of a part's vectors that can reach that cell's threshold, and the best k of each query's parts are ranked.

How much is left out depends on the data: clustered vectors go to few groups; where all directions are alike (random
vectors of many dimensions) no bound of this kind excludes much, and a vector goes to nearly every group.

Defined cases: null vectors or ids, empty vectors, and vectors with null or non-finite components take no part; every other
row is a candidate of all others, and a query if its id is, also where rows share an id; ties go to the smaller id; a vector
of another dimension than the query's is no candidate; components and scores beyond 63 bits are held at the limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

K, EVERY = 20, 20
#: Least and most pivots, vectors of a cell that queries meet first, queries in one block.
PIVOTS, WITNESSES, BLOCK = (4, 1024), 256, 4096
#: Least queries of a group that are worth a group of their own; groups that a vector is sent to on average.
FEW, SENT = 32, 3
#: Components in one part: a sixty-fourth of all, within these limits.
PART = (1 << 19, 1 << 22)
_SLACK = 1e-9
#: No score is less.
_LEAST = -(2.0**63)
#: Rows handled at once.
_STEP = 2048


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, dims, out = [], [], []
        column = batch.column("v")
        for k, vec in enumerate(batch.column("vec_id").to_pylist()):
            x = column[k].values
            if vec is None or x is None or not len(x) or x.null_count:
                continue
            x = np.floor(x.to_numpy(zero_copy_only=False).astype(np.float64) * 64)
            if np.isfinite(x).all():
                ids.append(vec)
                dims.append(len(x))
                out.append(np.clip(x, -(2.0**63), 2.0**63 - 1024).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _units(pivots: np.ndarray) -> np.ndarray:
    size = np.sqrt((pivots * pivots).sum(1, keepdims=True))
    return pivots / np.where(size > 0, size, 1)


def _grouped(shared, dim: int):
    """Cell, distance from its pivot, and parts along and beside the pivot of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        unit, half = _units(p), (p * p).sum(1) / 2
        for whole in batches:
            for lo in range(0, len(whole), _STEP):
                batch = whole.slice(lo, _STEP)
                x = _matrix(batch.column("v"), dim).astype(np.float64)
                g = (half - x @ p.T).argmin(1)
                d = np.sqrt(((x - p[g]) ** 2).sum(1)) * (1 + _SLACK)
                along = (x * unit[g]).sum(1)
                beside = np.sqrt(np.maximum((x * x).sum(1) - along * along, 0)) * (1 + _SLACK)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "vec_id", "v")), pa.array(g.astype(np.int32)), *map(pa.array, (d, along, beside))], ["rid", "vec_id", "v", "g", "d", "along", "beside"])

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of queries (a few at a time) with their exact scores."""
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * x.shape[1]
    if most < 2.0**52:
        q, x = q.astype(np.float64), x.astype(np.float64)
    step = max(1, (1 << 21) // len(x))
    for lo in range(0, len(q), step):
        if most < 2.0**62:
            yield lo, q[lo : lo + step] @ x.T
        else:  # whole numbers of any size
            yield lo, np.clip(q[lo : lo + step].astype(object) @ x.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _threshold(dim: int, k: int):
    """The least, over the queries, of the k-th best score with another row of those given."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        least, cells = -math.inf, left.column("i")[:1] if left.num_rows else right.column("i")[:1]
        if left.num_rows and right.num_rows > k:
            qid, xid, found = left.column("rid").to_numpy(), right.column("rid").to_numpy(), []
            for lo, s in _scores(_matrix(left.column("v"), dim), _matrix(right.column("v"), dim)):
                s = np.where(xid[None, :] == qid[lo : lo + len(s), None], -np.inf, s.astype(np.float64))
                found.append(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].min())
            least = float(min(found))
        return pa.table({"i": cells, "least": pa.array([least] if left.num_rows else [math.inf], pa.float64())})

    return run


@dataclass
class Cells:
    """What the driver knows of the cells: a few numbers of each, and of each pair."""

    pivots: np.ndarray
    held: np.ndarray  # vectors
    radius: np.ndarray
    asked: np.ndarray  # queries
    reach: np.ndarray  # of the queries from the pivot
    low: np.ndarray  # least and most of the queries along the pivot
    high: np.ndarray
    beside: np.ndarray

    def neighbours(self) -> np.ndarray:
        """Distances of pivots."""
        size = (self.pivots**2).sum(1)
        return size[:, None] + size - 2 * self.pivots @ self.pivots.T

    def homes(self, k: int) -> list[tuple[int, int]]:
        """(cell of witnesses, cell of queries): the cell itself and as many of the nearest as give k others."""
        near, out = self.neighbours(), []
        for i in np.flatnonzero(self.asked).tolist():
            got = 0
            for j in np.argsort(near[i], kind="stable").tolist() if self.held[i] <= k else [i]:
                got += int(min(self.held[j], WITNESSES))
                out.append((j, i))
                if got > 2 * k:
                    break
        return out

    def groups(self, cores: int, possible: np.ndarray) -> np.ndarray:
        """The group of each cell with queries (else -1): neighbours together, up to a core's share of the queries. Where that
        would send a vector to more than SENT groups on average, groups are larger, up to BLOCK queries."""
        block = min(BLOCK, max(FEW, -(-int(self.asked.sum()) // max(1, cores))))
        while True:
            group = self._neighbouring(block)
            sent = sum(int(self.held[possible[group == g].any(0)].sum()) for g in range(group.max() + 1))
            if block >= BLOCK or sent <= SENT * int(self.held.sum()):
                return group
            block = min(BLOCK, 2 * block)

    def _neighbouring(self, block: int) -> np.ndarray:
        group, near = np.full(len(self.held), -1), self.neighbours()
        left = set(np.flatnonzero(self.asked).tolist())
        at, number, size = (min(left) if left else None), 0, 0
        while left:
            left.discard(at)
            if size and size + self.asked[at] > block:
                number, size = number + 1, 0
            group[at], size = number, size + self.asked[at]
            if left:
                rest = np.fromiter(left, int)
                at = int(rest[near[at][rest].argmin()])
        return group

    def possible(self, least: np.ndarray) -> np.ndarray:
        """Whether a vector of cell j can reach the threshold of cell i."""
        size = np.sqrt((self.pivots**2).sum(1))
        most = self.pivots @ self.pivots.T + self.reach[:, None] * size + size[:, None] * self.radius + self.reach[:, None] * self.radius
        most = np.maximum(most, _LEAST)
        finite = np.where(np.isfinite(least), least, 0)
        return (most >= least[:, None] - _SLACK * (1 + np.abs(finite))[:, None]) & (self.held > 0) & (self.asked > 0)[:, None]

    def wanted(self, x: np.ndarray, cells: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether each vector can reach the threshold of each of the cells."""
        along, norm = x @ _units(self.pivots[cells]).T, (x * x).sum(1)
        side = np.sqrt(np.maximum(norm[:, None] - along * along, 0)) * self.beside[cells]
        most = np.maximum(np.maximum(along * self.low[cells], along * self.high[cells]) + side, _LEAST)
        return most >= least[cells] - _SLACK * (1 + np.abs(most) + np.sqrt(norm)[:, None] * self.beside[cells])


def _routed(shared, dim: int):
    """Each vector for every group (and each of its blocks) that it may matter to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, least, possible, group, blocks, parts = shared.value
        used = np.flatnonzero(group >= 0)
        used = used[np.argsort(group[used], kind="stable")]
        begin = np.searchsorted(group[used], np.arange(len(blocks)))
        possible = possible[used]
        for whole in batches:
            for lo in range(0, len(whole), _STEP):
                batch = whole.slice(lo, _STEP)
                x = _matrix(batch.column("v"), dim).astype(np.float64)
                wanted = cells.wanted(x, used, least) & possible[:, batch.column("g").to_numpy()].T
                row, g = np.nonzero(np.logical_or.reduceat(wanted, begin, axis=1))
                if not len(row):
                    continue
                many = blocks[g]
                b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, g = np.repeat(row, many), np.repeat(g, many)
                rid = batch.column("rid").to_numpy()
                part = ((rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                for a in range(0, len(row), 20_000):
                    r, own = row[a : a + 20_000], g[a : a + 20_000]
                    at = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.astype(np.int32)), pa.array(b[a : a + 20_000].astype(np.int32)), pa.array((part[r] % parts[own]).astype(np.int32)), *(batch.column(c).take(at) for c in ("rid", "vec_id", "v"))],
                        ["grp", "b", "part", "rid", "vec_id", "v"],
                    )

    return run


def _by_cell(own: np.ndarray, x: np.ndarray, cells: Cells, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries, whose cells are `own`, with the places of the vectors that can reach their thresholds: cell by cell,
    but for cells that most vectors can reach, which are taken together."""
    held = np.unique(own)
    wanted = np.concatenate([cells.wanted(x[lo : lo + _STEP].astype(np.float64), held, least) for lo in range(0, len(x), _STEP)])
    dense = wanted.mean(0) > 0.5
    if dense.any():
        yield np.flatnonzero(np.isin(own, held[dense])), np.flatnonzero(wanted[:, dense].any(1))
    for n in np.flatnonzero(~dense).tolist():
        some = np.flatnonzero(wanted[:, n])
        if len(some):
            yield np.flatnonzero(own == held[n]), some


def _solved(shared, dim: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("rid", "query_id", "vec_id", "other", "score")
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        cells, least, *_ = shared.value
        right = right.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
        qrid, qid, q = left.column("rid").to_numpy(), left.column("vec_id").to_numpy(), _matrix(left.column("v"), dim)
        xrid, xid, x = right.column("rid").to_numpy(), right.column("vec_id").to_numpy(), _matrix(right.column("v"), dim)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        for asked, some in _by_cell(left.column("g").to_numpy(), x, cells, least):
            for lo, scores in _scores(q[asked], x if len(some) == len(x) else x[some]):
                for at, s in zip(asked[lo : lo + len(scores)].tolist(), scores, strict=True):
                    keep = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]) if len(s) > k + 1 else np.arange(len(s))
                    keep = keep[xrid[some[keep]] != qrid[at]]
                    # equal scores stay in order of ids; ~ turns the order of whole numbers round without going over the limit
                    keep = keep[np.argsort(~s[keep] if s.dtype == np.int64 else -s[keep], kind="stable")[:k]]
                    found = some[keep]
                    for column, v in zip(out, (np.full(len(keep), qrid[at]), np.full(len(keep), qid[at]), xid[found], xrid[found], s[keep].astype(np.int64)), strict=True):
                        column.append(v)
        return pa.table({c: np.concatenate(v) for c, v in zip(names, out, strict=True)})

    return run


def top_k_join(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """For each vector (vec_id, embedding) whose id is divisible by `every`, the k others of the highest inner product:
    query_id, rank, vec_id, score; ties go to the smaller id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    # rows have their own numbers, made once, as they are written
    rows = stored(rows.mapInArrow(_clean, "vec_id long, dim int, v binary").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).filter("q > 0").orderBy("dim").collect()
    out = None
    for r in sizes:
        asked, data, shared = _dealt(rows.filter(F.col("dim") == r.dim).select("rid", "vec_id", "v"), r.dim, r.n, k, is_query)
        found = asked.groupBy("grp", "b", "part").cogroup(data.groupBy("grp", "b", "part")).applyInArrow(_solved(shared, r.dim, k), "rid long, query_id long, vec_id long, other long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id", "other")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pivots(rows: DataFrame, dim: int, n: int) -> np.ndarray:
    wanted = min(max(PIVOTS[0], math.isqrt(n)), PIVOTS[1])
    h = F.xxhash64("rid")
    # of a large table only as many rows as a hash lets through are looked at
    some = rows.filter(F.pmod(h, F.lit(1 << 30)) < int(4 * wanted / n * (1 << 30))) if n > 8 * wanted else rows
    found = [r.v for r in some.select("v", h.alias("h")).orderBy("h").limit(wanted).collect()] or [r.v for r in rows.select("v").limit(1).collect()]
    return np.unique(np.frombuffer(b"".join(map(bytes, found)), "<i8").reshape(-1, dim), axis=0).astype(np.float64)


def _summaries(grouped: DataFrame, pivots: np.ndarray, is_query) -> Cells:
    of = lambda c: F.when(is_query, F.col(c))
    facts = grouped.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.count_if(is_query).alias("q"), F.max(of("d")).alias("qr"), F.min(of("along")).alias("lo"), F.max(of("along")).alias("hi"), F.max(of("beside")).alias("b"))
    cells = Cells(pivots, *(np.zeros(len(pivots), t) for t in (int, float, int, float, float, float, float)))
    for f in facts.collect():
        cells.held[f.g], cells.radius[f.g], cells.asked[f.g] = f.n, f.r, f.q
        cells.reach[f.g], cells.low[f.g], cells.high[f.g], cells.beside[f.g] = (x or 0 for x in (f.qr, f.lo, f.hi, f.b))
    return cells


def _dealt(rows: DataFrame, dim: int, n: int, k: int, is_query) -> tuple[DataFrame, DataFrame, Broadcast]:
    """Queries and vectors by group, block and part, and what the tasks know of the cells."""
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    pivots = _pivots(rows, dim, n)
    grouped = stored(rows.mapInArrow(_grouped(share(pivots), dim), "rid long, vec_id long, v binary, g int, d double, along double, beside double"), "cells")
    cells = _summaries(grouped, pivots, is_query)
    blocks_of = np.maximum(1, -(-cells.asked // BLOCK))

    h = F.xxhash64("rid")
    homes = spark.createDataFrame([(j, i, int(blocks_of[i])) for j, i in cells.homes(k)], "g int, i int, blocks int")
    near = grouped.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(h))).filter(F.col("r") <= WITNESSES).select("g", "rid", "v")
    again = [F.col(c).alias(c) for c in ("rid", "v")]  # columns of their own, as both sides are of one table
    near = near.join(F.broadcast(homes), "g").select("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), *again)
    own = spark.createDataFrame([(i, int(blocks_of[i])) for i in np.flatnonzero(cells.asked).tolist()], "g int, blocks int")
    asked = grouped.filter(is_query).join(F.broadcast(own), "g").select(F.col("g").alias("i"), F.pmod(h, F.col("blocks")).cast("int").alias("b"), "rid", "v")
    found = asked.groupBy("i", "b").cogroup(near.groupBy("i", "b")).applyInArrow(_threshold(dim, k), "i int, least double")
    least = np.full(len(pivots), np.inf)
    for f in found.groupBy("i").agg(F.min("least").alias("least")).collect():
        least[f.i] = f.least

    possible = cells.possible(least)
    group = cells.groups(spark.sparkContext.defaultParallelism, possible)
    count = group.max() + 1
    blocks, parts = np.ones(count, int), np.ones(count, int)
    size = min(max(PART[0], n * dim // 64), PART[1])
    for g in range(count):
        blocks[g] = max(1, -(-int(cells.asked[group == g].sum()) // BLOCK))
        parts[g] = max(1, -(-int(cells.held[possible[group == g].any(0)].sum()) * dim // size))
    shared = share((cells, least, possible, group, blocks, parts))
    data = grouped.select("rid", "vec_id", "v", "g").mapInArrow(_routed(shared, dim), "grp int, b int, part int, rid long, vec_id long, v binary")
    places = spark.createDataFrame([(i, int(group[i]), int(blocks[group[i]]), int(parts[group[i]])) for i in np.flatnonzero(group >= 0).tolist()], "g int, grp int, blocks int, parts int")
    asked = grouped.filter(is_query).join(F.broadcast(places), "g")
    return asked.select("grp", F.pmod(h, F.col("blocks")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rid", "vec_id", "v", "g"), data, shared


def op10_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH c AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
