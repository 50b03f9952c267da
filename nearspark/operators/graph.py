"""Graph index: one pruned neighbour graph per shard, searched by beams and reranked exactly.

Rows are dealt to shards around centroids; with several shards each row goes to its two
nearest, so that the shards overlap. A shard's graph is built in one task, whose memory the
number of shards bounds. Every row of a shard can be reached from the shard's entry (its
medoid). A query searches the shards nearest to it; found rows are ranked by exact
distances on the stored vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..plans.config import IndexConfig, SearchParams, infer_l_search
from . import cluster, exact, kernels

#: Rows of a shard at most on average: a task compares all pairs of a shard in blocks.
SHARD_ROWS = 20_000
BLOCK = 1024
TRAINED = 65_536
_FOUND = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("distance", pa.float64())])
#: Allowed rows up to which a filtered search looks at all of them instead of walking the graph.
FEW_ALLOWED = 10_000


def shards_for(rows: int, config: IndexConfig, copies: int = 2) -> int:
    """Shards, so that one shard's vectors, edges and work space stay within the memory budget and SHARD_ROWS."""
    each = config.dimension * 8 * 3 + config.max_degree * 8 * 3 + BLOCK * 8
    most = min(SHARD_ROWS, max(1, config.memory_budget // each))
    return 1 if rows <= most else -(-copies * rows // most)


def robust_prune(point: int, candidates: np.ndarray, v: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The nearest candidate first; then those that no chosen one is alpha times nearer to than the point is. Ties by position."""
    candidates = np.unique(candidates)
    candidates = candidates[candidates != point]
    if len(candidates) <= 1:
        return candidates
    d = ((v[candidates] - v[point]) ** 2).sum(axis=1)
    order = np.lexsort((candidates, d))
    candidates, d = candidates[order], d[order]
    own = v[candidates]
    between = kernels.distances(own, own, "l2")
    alive, out = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if alive[i]:
            out.append(i)
            if len(out) == degree:
                break
            alive &= alpha * alpha * between[i] > d
    return candidates[out]


def build_graph(v: np.ndarray, degree: int, width: int, alpha: float) -> tuple[list[np.ndarray], int]:
    """Neighbours of each row, at most ``degree``, and the entry, from which all rows can be reached."""
    n = len(v)
    entry = int(((v - v.mean(axis=0)) ** 2).sum(axis=1).argmin())
    near = min(width, n - 1)
    out: list[np.ndarray] = []
    for lo in range(0, n, BLOCK):
        d = kernels.distances(v[lo : lo + BLOCK], v, "l2")
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        at, _ = kernels.smallest(d, np.arange(n), near)
        out += [robust_prune(lo + i, row, v, degree, alpha) for i, row in enumerate(at)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(out):
        for j in row.tolist():
            back[j].append(i)
    for j in range(n):
        both = np.unique(np.concatenate([out[j], np.array(back[j], np.int64)]).astype(np.int64))
        out[j] = both if len(both) <= degree else robust_prune(j, both, v, degree, alpha)
    return repair(out, entry, v, degree), entry


def reachable(graph: list[np.ndarray], entry: int) -> np.ndarray:
    seen = np.zeros(len(graph), bool)
    seen[entry], level = True, np.array([entry])
    while len(level):
        near = np.unique(np.concatenate([graph[i] for i in level.tolist()])).astype(np.int64)
        level = near[~seen[near]]
        seen[level] = True
    return seen


def repair(graph: list[np.ndarray], entry: int, v: np.ndarray, degree: int) -> list[np.ndarray]:
    """Link each row that the entry doesn't reach from the nearest reached row.

    A row without room gives up its farthest neighbour, which the new one takes over: all that was reached still is.
    """
    while True:
        seen = reachable(graph, entry)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return graph
        new, hosts = int(lost[0]), np.flatnonzero(seen)
        host = int(hosts[((v[hosts] - v[new]) ** 2).sum(axis=1).argmin()])
        own = graph[host]
        if len(own) < degree:
            graph[host] = np.append(own, new)
            continue
        far = int(((v[own] - v[host]) ** 2).sum(axis=1).argmax())
        moved = own[far]
        graph[host] = np.append(np.delete(own, far), new)
        if moved not in graph[new]:  # nothing that is reached depends on the new row's own neighbours
            graph[new] = np.append(graph[new][: degree - 1], moved)


def bfs_order(graph: list[np.ndarray], entry: int) -> np.ndarray:
    """Rows in breadth-first order from the entry."""
    seen, order = np.zeros(len(graph), bool), [entry]
    seen[entry] = True
    for i in order:
        for j in graph[i].tolist():
            if not seen[j]:
                seen[j] = True
                order.append(j)
    return np.array(order)


def beam(q: np.ndarray, v: np.ndarray, graph: list[np.ndarray], entry: int, width: int, metric: str, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows found (of the allowed ones) and their distances, nearest first: the ``width`` best of a greedy search.

    The walk goes through rows that aren't allowed, too; it ends when the nearest open row is further than the worst of ``width`` kept ones.
    """
    first = float(kernels.distances(q[None], v[[entry]], metric)[0, 0])
    seen, heap = {entry}, [(first, entry)]
    walk, kept = [(-first, -entry)], []
    while heap:
        d, i = heapq.heappop(heap)
        if len(walk) >= width and d > -walk[0][0]:
            break
        if allowed is None or allowed[i]:
            kept.append((d, i))
        new = [j for j in graph[i].tolist() if j not in seen]
        if not new:
            continue
        seen.update(new)
        for e, j in zip(kernels.distances(q[None], v[new], metric)[0].tolist(), new):
            if len(walk) < width or e < -walk[0][0]:
                heapq.heappush(heap, (e, j))
                heapq.heappush(walk, (-e, -j))
                if len(walk) > width:
                    heapq.heappop(walk)
    kept = sorted(kept)[:width]
    return np.array([i for _, i in kept], np.int64), np.array([d for d, _ in kept])


class GraphIndex:
    """nodes: (shard, node, row_id, embedding, neighbors, entry). Immutable."""

    def __init__(self, config: IndexConfig, centroids: np.ndarray, nodes: DataFrame):
        self.config, self.centroids, self.nodes = config, centroids, nodes
        self.width = centroids.shape[1]  # one more than the dimension for inner products

    @classmethod
    def build(cls, vectors: DataFrame, config: IndexConfig) -> GraphIndex:
        """From ``vectors`` (row_id, embedding). Repeated row ids stand for rows of their own."""
        if config.index_type != "diskann":
            raise ValueError("a graph index has index type 'diskann'")
        d = config.dimension
        rows = exact.validate(vectors.select(F.col("row_id").cast("long"), V.preprocess(F.col("embedding"), config.metric).alias("embedding")), d)
        total = rows.count()
        if not total:
            raise ValueError("no vectors")
        if config.metric == "inner_product":
            # one more component gives all rows the same length: the largest inner products are then the nearest rows
            norm = V.norm_squared(F.col("embedding"))
            most = rows.agg(F.max(norm)).head()[0]
            rows = rows.withColumn("embedding", F.concat("embedding", F.array(F.sqrt(F.greatest(F.lit(most) - norm, F.lit(0.0))))))
            d += 1
        count = shards_for(total, config)
        sample = kernels.matrix(cluster.hash_sample(rows, min(total, TRAINED), config.seed).select("embedding").toArrow().column("embedding"), d)
        centroids = kernels.train_centroids(sample, count, config.seed) if count > 1 else sample.mean(axis=0, keepdims=True)
        held = rows.sparkSession.sparkContext.broadcast(centroids)  # one row per shard

        def deal(batches):
            for b in batches:
                dist = kernels.distances(kernels.matrix(b.column("embedding"), d), held.value, "l2")
                near = np.argsort(dist, axis=1, kind="stable")[:, :2]
                at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column("row_id").take(at), b.column("embedding").take(at)], ["shard", "row_id", "embedding"])

        degree, width, alpha = config.max_degree, config.build_l, config.alpha

        def grow(t: pa.Table) -> pa.Table:
            t = t.sort_by([("row_id", "ascending")])
            v = kernels.matrix(t.column("embedding"), d)
            graph, entry = build_graph(v, degree, width, alpha)
            off = np.concatenate([[0], np.cumsum([len(g) for g in graph])]).astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(graph).astype(np.int32) if off[-1] else np.empty(0, np.int32)))
            return pa.table([t.column("shard"), pa.array(np.arange(len(v), dtype=np.int32)), t.column("row_id"), t.column("embedding"), near, pa.array(np.arange(len(v)) == entry)], names=["shard", "node", "row_id", "embedding", "neighbors", "entry"])

        dealt = rows.mapInArrow(deal, "shard int, row_id long, embedding array<double>")
        nodes = dealt.groupBy("shard").applyInArrow(grow, "shard int, node int, row_id long, embedding array<double>, neighbors array<int>, entry boolean")
        return cls(config, centroids, nodes.persist())

    def metadata(self) -> dict:
        c = self.config
        rows = self.nodes.select("shard").count()
        return {"index_type": c.index_type, "dimension": c.dimension, "metric": c.metric, "shards": len(self.centroids), "total_nodes": rows, "max_degree": c.max_degree, "build_l": c.build_l, "alpha": c.alpha}

    def save(self, path: str) -> None:
        """Parquet, one folder per shard; centroids and settings beside it."""
        self.nodes.repartition("shard").sortWithinPartitions("shard", "node").write.partitionBy("shard").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        about = {k: str(v) for k, v in self.config.__dict__.items()}
        spark.createDataFrame([(i, c.tolist(), about) for i, c in enumerate(self.centroids)], "shard int, centroid array<double>, about map<string,string>").coalesce(1).write.parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("shard").collect()
        kinds = IndexConfig.__dataclass_fields__
        read = {"int": int, "float": float, "str": str, "bool": lambda x: x == "True"}
        config = IndexConfig(**{k: read[str(kinds[k].type)](v) for k, v in rows[0].about.items()})
        nodes = spark.read.schema("node int, row_id long, embedding array<double>, neighbors array<int>, entry boolean, shard int").parquet(f"{path}/nodes")
        return cls(config, np.array([r.centroid for r in rows]), nodes.select("shard", "node", "row_id", "embedding", "neighbors", "entry"))

    def reachability(self) -> DataFrame:
        """One row per shard: nodes, reachable (from its entry) and degree (the largest)."""

        def look(t: pa.Table) -> pa.Table:
            t = t.sort_by([("node", "ascending")])
            graph = [np.array(x, np.int64) for x in t.column("neighbors").to_pylist()]
            entry = t.column("entry").to_pylist().index(True)
            return pa.table([t.column("shard")[:1].combine_chunks(), pa.array([len(graph)], pa.int64()), pa.array([int(reachable(graph, entry).sum())], pa.int64()), pa.array([max(map(len, graph))], pa.int64())], names=["shard", "nodes", "reachable", "degree"])

        return self.nodes.select("shard", "node", "neighbors", "entry").groupBy("shard").applyInArrow(look, "shard int, nodes long, reachable long, degree long")

    def search(self, queries: DataFrame, params: SearchParams, allowed: DataFrame | None = None, shards: int = 4) -> DataFrame:
        """query_id, rank, row_id, distance of each query's k nearest found.

        Each query walks its ``shards`` nearest shards with a list of l_search rows. With ``allowed`` (row_id), a few allowed
        rows are all looked at; more of them let the list grow by the part of rows that isn't allowed.
        """
        if params.nprobe is not None:
            raise ValueError("nprobe belongs to inverted-list indexes")
        c, d, k = self.config, self.width, params.k
        width = max(k, params.l_search or infer_l_search(k))
        nodes = self.nodes.withColumn("allowed", F.lit(True))
        if allowed is not None:
            keep = allowed.where("row_id >= 0").select("row_id").distinct()
            own = self.nodes.join(keep, "row_id", "left_semi")
            matching, total = own.select("row_id").count(), self.nodes.count()
            if matching <= max(FEW_ALLOWED, k):
                rows = own.select("row_id", "embedding").dropDuplicates(["row_id", "embedding"])
                return exact.top_k(exact.knn(rows, self._queries(queries), k, c.metric).select("query_id", "row_id", "distance"), k, True)
            width, shards = min(total, -(-width * total // matching)), len(self.centroids)
            nodes = self.nodes.join(keep.withColumn("allowed", F.lit(True)), "row_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
        held = nodes.sparkSession.sparkContext.broadcast(self.centroids)

        def probe(batches):
            for b in batches:
                dist = kernels.distances(kernels.matrix(b.column("q"), d), held.value, "l2")
                near = np.argsort(dist, axis=1, kind="stable")[:, :shards]
                at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column("query_id").take(at), b.column("q").take(at)], ["shard", "query_id", "q"])

        def walk(own: pa.Table, asked: pa.Table) -> pa.Table:
            if not own.num_rows or not asked.num_rows:
                return _FOUND.empty_table()
            own = own.sort_by([("node", "ascending")])
            v, ids = kernels.matrix(own.column("embedding"), d), own.column("row_id").to_numpy()
            graph = [np.array(x, np.int64) for x in own.column("neighbors").to_pylist()]
            entry, may = own.column("entry").to_pylist().index(True), np.array(own.column("allowed").to_pylist())
            out = []
            for query, q in zip(asked.column("query_id").to_pylist(), kernels.matrix(asked.column("q"), d)):
                at, dist = beam(q, v, graph, entry, width, c.metric, None if may.all() else may)
                out.append(pa.table([np.full(len(at), query), ids[at], dist], schema=_FOUND))
            return pa.concat_tables(out)

        asked = self._queries(queries).mapInArrow(probe, "shard int, query_id long, q array<double>")
        found = nodes.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(walk, "query_id long, row_id long, distance double")
        return exact.top_k(found, k, True)

    def _queries(self, queries: DataFrame) -> DataFrame:
        rows = exact.validate(queries.select(F.col("query_id").cast("long"), V.preprocess(F.col("q"), self.config.metric).alias("q")), self.config.dimension, "q")
        return rows.withColumn("q", F.concat("q", F.array(F.lit(0.0)))) if self.width > self.config.dimension else rows
