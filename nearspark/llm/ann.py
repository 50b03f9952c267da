"""Approximate nearest neighbours in low-dimensional stable projections.

Vectors are projected by a fixed Gaussian (2-stable) matrix. A kd-tree over a bounded
sample of the projected points cuts them into blocks; each block has its own kd-tree.
A query looks up its home block first. Its neighbours so far bound which other blocks can
hold a better one: for a vector at distance d the squared projected distance over d**2
follows a chi-square law, so points beyond the law's quantile times the k-th distance
need no visit. Inside a block, the points of the leaves within that distance are projected
neighbours, taken in order of projected distance and verified on the original vectors until
the same test holds for the next of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Projections. More of them make the stopping test sharper: fewer vectors are verified for the same recall.
DIMS = 32
#: Chance that the stopping test lets the k-th neighbour pass; nearer ones pass more surely.
SURE = 0.88
#: Vectors verified in a first step; each further step is twice as large.
STEP = 32
#: Projected vectors that the driver splits the space by; every vector is indexed.
SAMPLE = 50_000
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
LEAF = 64
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def chi2_quantile(p: float, m: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        cdf = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if cdf < p else (lo, x)
    return hi


def takes_part(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def split(points: np.ndarray, parts: int) -> list[tuple]:
    """A kd-tree as a list of nodes (axis, cut, left, right), or (block,) for a leaf; node 0 is the root."""
    nodes: list[tuple] = []
    blocks = 0

    def grow(own: np.ndarray, n: int) -> int:
        nonlocal blocks
        at = len(nodes)
        nodes.append(())
        spread = np.ptp(own, axis=0) if len(own) else np.zeros(1)
        axis = int(spread.argmax())
        if n <= 1 or spread[axis] == 0:
            nodes[at] = (blocks,)
            blocks += 1
            return at
        cut = float(np.quantile(own[:, axis], (n // 2) / n))
        left = own[:, axis] <= cut
        if left.all():
            cut = float(own[own[:, axis] < own[:, axis].max(), axis].max())
            left = own[:, axis] <= cut
        nodes[at] = (axis, cut, grow(own[left], n // 2), grow(own[~left], n - n // 2))
        return at

    grow(points, parts)
    return nodes


def block_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if len(nodes[at]) == 1:
            out[rows] = nodes[at][0]
        elif len(rows):
            axis, cut, lo, hi = nodes[at]
            left = points[rows, axis] <= cut
            todo += [(lo, rows[left]), (hi, rows[~left])]
    return out


def blocks_within(nodes: list[tuple], point: np.ndarray, radius2: float) -> list[int]:
    """Blocks whose box is within a squared distance of the point."""
    out, todo = [], [(0, np.zeros(len(point)))]
    while todo:
        at, gap = todo.pop()
        if len(nodes[at]) == 1:
            out.append(nodes[at][0])
            continue
        axis, cut, lo, hi = nodes[at]
        near, far = (lo, hi) if point[axis] <= cut else (hi, lo)
        todo.append((near, gap))
        away = gap.copy()
        away[axis] = max(away[axis], (point[axis] - cut) ** 2)
        if away.sum() <= radius2:
            todo.append((far, away))
    return out


class Block:
    """A block's vectors under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        order, leaves = [], []

        def grow(rows: np.ndarray) -> None:
            spread = np.ptp(points[rows], axis=0)
            if len(rows) <= LEAF:
                leaves.append(len(rows))
                order.append(rows)
                return
            by = np.argpartition(points[rows, spread.argmax()], len(rows) // 2)
            grow(rows[by[: len(rows) // 2]])
            grow(rows[by[len(rows) // 2 :]])

        grow(np.arange(len(ids)))
        at = np.concatenate(order)
        self.ids, self.vectors, self.points = ids[at], vectors[at], points[at]
        self.edge, self.verified = np.concatenate([[0], np.cumsum(leaves)]), 0
        self.low = np.minimum.reduceat(self.points, self.edge[:-1])
        self.high = np.maximum.reduceat(self.points, self.edge[:-1])

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, quantile: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest (squared distance, id) found, with squared distances up to ``bound`` at most."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        near = np.repeat((gap**2).sum(axis=1) <= quantile * bound, np.diff(self.edge)) & (self.ids != own)
        rows = np.flatnonzero(near)
        far = ((self.points[rows] - point) ** 2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], far[order]
        best, found, at, step = np.empty(0), np.empty(0, np.int64), 0, STEP
        while at < len(rows) and far[at] <= quantile * bound:
            end = min(at + step, int(np.searchsorted(far, quantile * bound, side="right")))
            d = ((self.vectors[rows[at:end]].astype(np.float64) - vector) ** 2).sum(axis=1)
            best, found = np.concatenate([best, d]), np.concatenate([found, self.ids[rows[at:end]]])
            pick = np.lexsort((found, best))[:k]
            best, found = best[pick], found[pick]
            if len(best) == k:
                bound = min(bound, best[-1])
            self.verified += end - at
            at, step = end, step * 2
        return best, found


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest found of every row for which ``queries`` holds: query_id, rank, vec_id, score (Euclidean distance).

    ``queries`` is a condition on ``id_col``. Rows take no part if their id or vector is
    null, the vector is zero or has null or non-finite components, or its length isn't the
    commonest (of equally common ones the smaller). Rows with a query's own id are not its
    candidates; otherwise repeated rows each count. Fewer candidates than k: all of them.
    An empty table gives no rows. Equal vectors are dealt over several blocks by id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).where("vec_id is not null").where(takes_part(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width, total = (widths[0].w, widths[0]["count"]) if widths else (1, 0)
    rows = rows.where(F.size("v") == width)
    matrix = np.random.default_rng(11).standard_normal((width, DIMS))
    quantile = chi2_quantile(SURE, DIMS)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    nodes = split(_matrix(sample.column("v"), width) @ matrix, -(-total // block_rows)) if total else [(0,)]
    held = spark.sparkContext.broadcast((matrix, nodes))  # nodes: two per BLOCK_ROWS vectors

    def project(batches):
        m, tree = held.value
        for b in batches:
            points = _matrix(b.column("v"), width) @ m
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), DIMS).cast(pa.list_(pa.float64())), pa.array(block_of(tree, points))], ["vec_id", "v", "p", "block"])

    kind = rows.schema["v"].dataType.simpleString()
    index = common.stage(rows.mapInArrow(project, f"vec_id long, v {kind}, p array<double>, block int"), "ann-index")
    asked = index.where(queries).withColumnRenamed("vec_id", "query_id")
    # a block that the cuts can't divide (equal points) is dealt out by id: parts per block
    parts = index.groupBy("block").agg(F.ceil(F.count("*") / (2 * block_rows)).cast("int").alias("parts"))

    def look(left: DataFrame) -> DataFrame:
        """left: query_id, v, p, block, bound. One task group per part of a block and chunk of its queries."""
        chunked = left.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
        q = left.join(chunked, "block").join(parts, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
        q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        q = q.select(*[F.col(x).alias(x) for x in ("block", "part", "chunk", "query_id", "v", "p", "bound")])  # apart from the index's own columns
        c = index.join(parts, "block").join(chunked, "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        c = c.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", "part", "chunk", "vec_id", "v", "p")

        def within(own: pa.Table, wanted: pa.Table) -> pa.Table:
            if not own.num_rows or not wanted.num_rows:
                return _OUT.empty_table()
            block = Block(own.column("vec_id").to_numpy(), _matrix(own.column("v"), width), _matrix(own.column("p"), DIMS))
            out = []
            asks = zip(wanted.column("query_id").to_pylist(), _matrix(wanted.column("v"), width).astype(np.float64), _matrix(wanted.column("p"), DIMS), wanted.column("bound").to_numpy())
            for query, v, p, bound in asks:
                d, ids = block.search(query, v, p, k, quantile, bound)
                out.append(pa.table([pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(np.sqrt(d))], schema=_OUT))
            return pa.concat_tables(out)

        keys = ["block", "part", "chunk"]
        return c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(within, "query_id long, vec_id long, score double")

    home = common.stage(look(asked.withColumn("bound", F.lit(float("inf")))), "ann-home")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    kth = home.withColumn("r", place).where(F.col("r") == k).groupBy("query_id").agg(F.min("score").alias("kth"))

    def reach(batches):
        _, tree = held.value
        for b in batches:
            points, homes = _matrix(b.column("p"), DIMS), b.column("block").to_pylist()
            bound = b.column("bound").to_numpy()
            hit = [[x for x in blocks_within(tree, p, quantile * t) if x != h] for p, h, t in zip(points, homes, bound)]
            at = np.repeat(np.arange(b.num_rows), [len(h) for h in hit])
            got = b.drop_columns(["block"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array([x for h in hit for x in h], pa.int32())], [*got.schema.names, "block"])

    bounded = asked.join(kth, "query_id", "left").select("query_id", "v", "p", "block", F.coalesce(F.col("kth") * F.col("kth"), F.lit(float("inf"))).alias("bound"))
    away = look(bounded.mapInArrow(reach, f"query_id long, v {kind}, p array<double>, bound double, block int"))
    near = home.unionByName(away).withColumn("rank", place).where(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
