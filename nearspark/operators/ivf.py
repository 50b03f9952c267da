"""Inverted-list indexes: raw, scalar-, product- and rotation-quantized, built and searched as Spark jobs.

A list is a group of rows with one list_id. A search joins the probed (query, list) pairs
with the lists, each list in parts of bounded size, and keeps k rows per query and part
before anything is shuffled by query.
"""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as V
from ..plans.config import IndexConfig, SearchParams, infer_nprobe, training_count
from . import cluster, exact, kernels

#: Rows of a list that one task scans; larger lists are dealt out by row id.
PART_ROWS = 200_000
_FOUND = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("distance", pa.float64())])


class Model:
    """What training leaves: centroids and codebooks."""

    def __init__(self, config: IndexConfig, sample: np.ndarray):
        self.config = config
        v = _unit(sample) if config.metric == "cosine" else sample
        self.centroids = kernels.train_centroids(v, config.nlist, config.seed)
        at, _ = kernels.nearest(v, self.centroids)
        rest = v - self.centroids[at]
        self.pq = self.rotation = self.rq = self.low = self.high = None
        if config.index_type == "ivf_sq":
            self.low, self.high = np.tile(rest.min(0), (config.nlist, 1)), np.tile(rest.max(0), (config.nlist, 1))
            for i in np.unique(at):
                self.low[i], self.high[i] = rest[at == i].min(0), rest[at == i].max(0)
        elif config.index_type == "ivf_pq":
            x = rest if config.metric == "l2" else v
            if config.use_opq:
                self.rotation = kernels.train_opq(x, config.pq_m, config.pq_bits, seed=config.seed)
                x = x @ self.rotation.T
            self.pq = kernels.ProductQuantizer.train(x, config.pq_m, config.pq_bits, config.seed)
        elif config.index_type == "ivf_rq":
            self.rq = kernels.RotatedQuantizer(config.dimension, config.rq_bits)

    def arrays(self) -> dict[str, np.ndarray]:
        """All that training has left, by name."""
        out = {k: v for k in ("centroids", "rotation", "low", "high") if (v := getattr(self, k)) is not None}
        return out | {f"book{i}": b for i, b in enumerate(self.pq.books if self.pq else [])}

    def digest(self) -> str:
        h = hashlib.sha256(json.dumps(self.config.__dict__, sort_keys=True).encode())
        for k, v in sorted(self.arrays().items()):
            h.update(k.encode() + repr(v.shape).encode() + np.ascontiguousarray(v, "<f8").tobytes())
        return h.hexdigest()

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, config: IndexConfig, raw: bytes) -> Model:
        m = cls.__new__(cls)
        with np.load(io.BytesIO(raw), allow_pickle=False) as got:
            m.config, m.centroids = config, got["centroids"]
            m.rotation, m.low, m.high = (got[k] if k in got else None for k in ("rotation", "low", "high"))
            books = [got[f"book{i}"] for i in range(sum(k.startswith("book") for k in got))]
        d, n = config.dimension, len(books)
        offsets = np.concatenate([[0], np.cumsum([d // n + (i < d % n) for i in range(n)])]).tolist() if n else []
        m.pq = kernels.ProductQuantizer(offsets, books, config.pq_bits) if n else None
        m.rq = kernels.RotatedQuantizer(d, config.rq_bits) if config.index_type == "ivf_rq" else None
        return m

    def turn(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation.T

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """list ids and one row of bytes per vector."""
        v = _unit(v) if self.config.metric == "cosine" else v
        at, _ = kernels.nearest(v, self.centroids)
        kind = self.config.index_type
        if kind == "ivf_flat":
            return at, v.astype("<f4").view(np.uint8).reshape(len(v), -1)
        rest = v - self.centroids[at]
        if kind == "ivf_sq":
            lo, hi = self.low[at], self.high[at]
            span = np.where(hi > lo, hi - lo, 1)
            return at, np.where(hi > lo, np.floor(np.clip((rest - lo) * 255 / span, 0, 255) + 0.5), 0).astype(np.uint8)
        if kind == "ivf_pq":
            codes = self.pq.encode(self.turn(rest if self.config.metric == "l2" else v))
            return at, kernels.pack4(codes) if self.config.pq_bits == 4 else codes
        levels, factors = self.rq.encode(rest)
        return at, np.concatenate([kernels.pack_planes(levels, self.config.rq_bits), factors.astype("<f4").view(np.uint8).reshape(len(v), -1)], axis=1)

    def score(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of one query to the rows of one list."""
        metric, kind, c = self.config.metric, self.config.index_type, self.centroids[at]
        q = _unit(q[None])[0] if metric == "cosine" else q
        if kind == "ivf_flat":
            return kernels.distances(q[None], np.ascontiguousarray(codes).view("<f4").astype(np.float64), metric)[0]
        if kind == "ivf_sq":
            lo, hi = self.low[at], self.high[at]
            return kernels.distances(q[None], c + np.where(hi > lo, lo + codes * (hi - lo) / 255, lo), metric)[0]
        if kind == "ivf_pq":
            codes = kernels.unpack4(codes) if self.config.pq_bits == 4 else codes
            d = self.pq.scan(self.pq.table(self.turn(q - c if metric == "l2" else q), metric), codes)
            return d / 2 if metric == "cosine" else d
        p = self.rq.padded // 8 * self.config.rq_bits
        levels, factors = kernels.unpack_planes(codes[:, :p], self.config.rq_bits).astype(np.float64), np.ascontiguousarray(codes[:, p:]).view("<f4").astype(np.float64)
        if metric == "l2":
            r = q - c
            return np.maximum(factors[:, 1] ** 2 + r @ r - 2 * self.rq.inner(self.rq.rotate(r[None])[0], levels, factors), 0)
        dot = q @ c + self.rq.inner(self.rq.rotate(q[None])[0], levels, factors)
        return -dot if metric == "inner_product" else 1 - dot


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.where(n > 0, v / np.where(n > 0, n, 1), v)


class IvfIndex:
    """lists: (list_id, row_id, code). Immutable; ``add`` and ``merge`` give new ones."""

    def __init__(self, model: Model, lists: DataFrame):
        self.model, self.lists = model, lists
        self.held = lists.sparkSession.sparkContext.broadcast(model)

    @classmethod
    def train(cls, vectors: DataFrame, config: IndexConfig) -> Model:
        """Train on a bounded hash-ordered sample of ``vectors`` (row_id, embedding)."""
        checked = exact.validate(vectors, config.dimension)
        sample = cluster.hash_sample(checked, training_count(vectors.count(), config.nlist), config.seed).select("embedding").toArrow()
        if not sample.num_rows:
            raise ValueError("no training vectors")
        return Model(config, kernels.matrix(sample.column("embedding"), config.dimension))

    @classmethod
    def build(cls, vectors: DataFrame, config: IndexConfig) -> IvfIndex:
        if config.index_type == "diskann":
            raise ValueError("a graph index is built by GraphIndex")
        model = cls.train(vectors, config)
        return cls(model, cls.encode(model, vectors).persist())  # searches read the lists several times

    @staticmethod
    def encode(model: Model, vectors: DataFrame) -> DataFrame:
        held, d = vectors.sparkSession.sparkContext.broadcast(model), model.config.dimension

        def run(batches):
            for b in batches:
                at, codes = held.value.encode(kernels.matrix(b.column("embedding"), d))
                raw = pa.array([row.tobytes() for row in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("row_id"), raw], ["list_id", "row_id", "code"])

        rows = exact.validate(vectors.select(F.col("row_id").cast("long"), "embedding"), d)
        return rows.mapInArrow(run, "list_id int, row_id long, code binary")

    def add(self, vectors: DataFrame) -> IvfIndex:
        return IvfIndex(self.model, self.lists.unionByName(self.encode(self.model, vectors)))

    def merge(self, other: IvfIndex) -> IvfIndex:
        """Lists of both, if both come from one trained model."""
        if self.model.digest() != other.model.digest():
            raise ValueError("only indexes of one model can be merged")
        return IvfIndex(self.model, self.lists.unionByName(other.lists))

    def metadata(self) -> dict:
        c = self.model.config
        return {"index_type": c.index_type, "dimension": c.dimension, "nlist": c.nlist, "metric": c.metric, "total_vectors": self.lists.count(), "pq_m": c.pq_m, "pq_bits": 8 if c.index_type == "ivf_sq" else c.pq_bits, "rq_bits": c.rq_bits}

    def save(self, path: str) -> None:
        """Parquet, one folder per list and rows in id order, so that a search reads the lists it probes; the model beside it."""
        spark = self.lists.sparkSession
        self.lists.repartition("list_id").sortWithinPartitions("list_id", "row_id").write.partitionBy("list_id").parquet(f"{path}/lists")
        about, config = json.dumps(self.metadata()), json.dumps(self.model.config.__dict__)
        spark.createDataFrame(pa.table({"metadata": [about], "config": [config], "model": pa.array([self.model.to_bytes()], pa.binary())})).coalesce(1).write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        """Open a folder that save() wrote."""
        row = spark.read.parquet(f"{path}/model").head()
        if row is None or {"metadata", "config", "model"} - set(row.asDict()):
            raise ValueError(f"{path} holds no index of a known format")
        index = cls(Model.from_bytes(IndexConfig(**json.loads(row.config)), row.model), spark.read.schema("row_id long, code binary, list_id int").parquet(f"{path}/lists"))
        if (n := index.lists.count()) != json.loads(row.metadata)["total_vectors"]:
            raise ValueError(f"the lists hold {n} rows, not as many as were written")
        return index

    def probe(self, queries: DataFrame, first: int, last: int) -> DataFrame:
        """query_id, q, list_id, probe_rank, coarse_distance of the lists at ranks first .. last - 1, nearest first."""
        held, d = self.held, self.model.config.dimension

        def run(batches):
            m = held.value
            for b in batches:
                q = kernels.matrix(b.column("q"), d)
                dist = kernels.distances(_unit(q) if m.config.metric == "cosine" else q, m.centroids, "l2")
                order = np.argsort(dist, axis=1, kind="stable")[:, first:last]
                w = order.shape[1]
                at = pa.array(np.repeat(np.arange(len(q)), w))
                ranks = np.tile(np.arange(first, first + w, dtype=np.int32), len(q))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("q").take(at), pa.array(order.ravel().astype(np.int32)), pa.array(ranks), pa.array(np.take_along_axis(dist, order, 1).ravel())], ["query_id", "q", "list_id", "probe_rank", "coarse_distance"])

        rows = exact.validate(queries.select(F.col("query_id").cast("long"), V.as_double(F.col("q")).alias("q")), d, "q")
        return rows.mapInArrow(run, "query_id long, q array<double>, list_id int, probe_rank int, coarse_distance double")

    def _scan(self, probes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
        held, d = self.held, self.model.config.dimension
        lists = lists.join(F.broadcast(probes.select("list_id").distinct()), "list_id", "left_semi")  # nlist numbers at most
        parts = lists.groupBy("list_id").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
        own = lists.join(parts, "list_id").select(F.col("list_id").alias("list_id"), F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"), "row_id", "code")
        asked = probes.join(parts, "list_id").select("list_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "q")

        def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
            if not rows.num_rows or not wanted.num_rows:
                return _FOUND.empty_table()
            ids = rows.column("row_id").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            at, out = rows.column("list_id")[0].as_py(), []
            for query, q in zip(wanted.column("query_id").to_pylist(), kernels.matrix(wanted.column("q"), d)):
                dist = held.value.score(q, at, codes)
                best, near = kernels.smallest(dist[None], ids, k)
                out.append(pa.table([np.full(best.shape[1], query), ids[best[0]], near[0]], schema=_FOUND))
            return pa.concat_tables(out)

        keys = ["list_id", "part"]
        return own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, row_id long, distance double")

    def search(self, queries: DataFrame, params: SearchParams, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, rank, row_id, distance. Without nprobe the width is inferred and doubles for queries that lack results."""
        if params.l_search is not None:
            raise ValueError("l_search belongs to graph indexes")
        c, lists = self.model.config, self.lists
        if allowed is not None:
            lists = exact.prefilter(lists, allowed)
        dedup = c.index_type in ("ivf_sq", "ivf_rq")
        if params.nprobe:
            return exact.top_k(self._scan(self.probe(queries, 0, min(params.nprobe, c.nlist)), lists, params.k), params.k, dedup)
        total = self.lists.count()
        matching = lists.count() if allowed is not None else total
        width = infer_nprobe(c.nlist, max(total, 1), params.k, matching if allowed is not None else None, params.max_filter_expansion)
        need, at, pending, found = min(params.k, matching), 0, queries, None
        while True:
            new = self._scan(self.probe(pending, at, width), lists, params.k)
            both = new if found is None else found.select("query_id", "row_id", "distance").unionByName(new)
            found = exact.top_k(both, params.k, dedup).persist()  # later rounds add to it
            if width >= c.nlist or not need:
                return found
            done = found.groupBy("query_id").count().where(F.col("count") >= need).select("query_id")
            pending = queries.join(done, "query_id", "left_anti")
            if not pending.limit(1).count():
                return found
            at, width = width, min(c.nlist, 2 * width)

    def search_max_codes(self, queries: DataFrame, k: int, nprobe: int, max_codes: int) -> DataFrame:
        """Scan lists in probe order until ``max_codes`` rows are seen; the last list is cut off in row order."""
        from pyspark.sql import Window

        sizes = self.lists.groupBy("list_id").agg(F.count("*").alias("n"))
        probes = self.probe(queries, 0, min(nprobe, self.model.config.nlist)).join(sizes, "list_id")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("probe_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        probes = probes.withColumn("room", F.lit(max_codes) - before).where("room > 0")
        placed = self.lists.withColumn("at", F.row_number().over(Window.partitionBy("list_id").orderBy("row_id")))
        held, d = self.held, self.model.config.dimension
        pairs = probes.select("query_id", "q", "list_id", "room").join(placed, "list_id").where("at <= room").select("query_id", "q", "list_id", "row_id", "code")

        def run(batches):
            for b in batches:
                q = kernels.matrix(b.column("q"), d)
                dist = [held.value.score(q[i], a, np.frombuffer(c, np.uint8)[None])[0] for i, (a, c) in enumerate(zip(b.column("list_id").to_pylist(), b.column("code").to_pylist()))]
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("row_id"), pa.array(dist, pa.float64())], _FOUND.names)

        return exact.top_k(pairs.mapInArrow(run, "query_id long, row_id long, distance double"), k)
