"""Clustering as DataFrame aggregations: assignment, Lloyd steps, coresets, balance, bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V
from . import kernels


def hash_sample(vectors: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """Exactly n rows (all, if fewer), the same in every run whatever the partitions."""
    return vectors.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(n)


def assign_nearest(vectors: DataFrame, centroids: DataFrame, most: int = 65_536, penalty: dict[int, float] | None = None) -> DataFrame:
    """``vectors`` with list_id and coarse_distance: the nearest centroid by squared L2 plus the list's penalty, ties to the lower id.

    centroids (list_id, centroid) are broadcast; more than ``most`` raise an error.
    """
    got = centroids.orderBy("list_id").limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError(f"more than {most} centroids")
    d = len(got.column("centroid")[0])
    extra = np.array([(penalty or {}).get(i, 0.0) for i in got.column("list_id").to_pylist()])
    held = vectors.sparkSession.sparkContext.broadcast((got.column("list_id").to_numpy(), kernels.matrix(got.column("centroid"), d), extra))

    def run(batches):
        ids, c, more = held.value
        for b in batches:
            cost = kernels.distances(kernels.matrix(b.column("embedding"), d), c, "l2") + more
            at = cost.argmin(axis=1)
            dist = cost[np.arange(len(at)), at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids[at].astype(np.int32)), pa.array(dist)], [*b.schema.names, "list_id", "coarse_distance"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kind}, list_id int, coarse_distance double")


def lloyd_step(assigned: DataFrame, weight: str | None = None) -> DataFrame:
    """New centroids (list_id, centroid): (weighted) means by component."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = assigned.select("list_id", w.alias("w"), F.posexplode(V.as_double(F.col("embedding"))).alias("i", "x"))
    mean = parts.groupBy("list_id", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return mean.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def repair_empty(centroids: DataFrame, sizes: DataFrame, nlist: int) -> DataFrame:
    """Empty lists take the centroids of the largest ones, moved apart by 1/1024; both halves stay near their donor."""
    ids = centroids.sparkSession.range(nlist).select(F.col("id").cast("int").alias("list_id"))
    full = ids.join(centroids, "list_id", "left")
    empty = full.where("centroid is null").withColumn("turn", F.row_number().over(Window.orderBy("list_id"))).select("list_id", "turn")
    donor = sizes.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("n"), "list_id"))).join(centroids, "list_id").select("turn", F.col("centroid").alias("from"))
    moved = empty.join(donor, "turn", "left").select("list_id", F.transform("from", lambda x, i: x * (1 + F.when(i % 2 == 0, 1.0).otherwise(-1.0) / 1024)).alias("centroid"))
    return full.where("centroid is not null").select("list_id", "centroid").unionByName(moved)


def coreset(vectors: DataFrame, k: int, d: int, chunk: int = 10_000, seed: int = 1234) -> DataFrame:
    """k weighted centroids of each chunk of a partition: (centroid, weight). The partial step of a two-step k-means.

    vectors: embedding, or the (centroid, weight) of earlier coresets, which are condensed further.
    """
    rows = vectors.select(F.col("centroid").alias("embedding"), "weight") if "weight" in vectors.columns else vectors.select("embedding", F.lit(1.0).alias("weight"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, chunk):
                v, w = kernels.matrix(b.column("embedding").slice(lo, chunk), d), b.column("weight").slice(lo, chunk).to_numpy()
                c = kernels.kmeans(v, min(k, len(v)), 15, seed, weight=w)
                n = np.bincount(kernels.nearest(v, c)[0], w, minlength=len(c))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, d, dtype=np.int32)), pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([flat, pa.array(n.astype(np.float64))], ["centroid", "weight"])

    return rows.mapInArrow(run, "centroid array<double>, weight double")


#: Weighted rows that the driver clusters; more are condensed in the executors first.
MOST_CORESET = 200_000


def finish_coreset(parts: DataFrame, k: int, seed: int = 1234) -> np.ndarray:
    """Weighted k-means over the coreset: k centroids. The driver sees MOST_CORESET rows at most."""
    parts = parts.where("weight > 0")
    head = parts.select(F.size("centroid").alias("d")).head()
    if head is None:
        raise ValueError("no training vectors")
    for _ in range(16):
        rows = parts.count()
        if rows <= MOST_CORESET:
            break
        # chunks of ten rows a centroid make a tenth of the rows
        parts = coreset(parts.repartition(max(1, rows // MOST_CORESET), "centroid"), k, head.d, 10 * k, seed).where("weight > 0").persist()
    got = parts.orderBy("centroid").limit(MOST_CORESET).toArrow()
    return kernels.kmeans(kernels.matrix(got.column("centroid"), head.d), k, seed=seed, weight=got.column("weight").to_numpy())


def balanced_assign(vectors: DataFrame, centroids: DataFrame, factor: float = 0.1, rounds: int = 3) -> DataFrame:
    """assign_nearest with factor * ln(list size) added to each list's distance; sizes come from the round before."""
    n = {r.list_id: 0 for r in centroids.select("list_id").collect()}
    rows = assign_nearest(vectors, centroids)
    for _ in range(rounds):
        n |= {r.list_id: r["count"] for r in rows.groupBy("list_id").count().collect()}
        rows = assign_nearest(vectors, centroids, penalty={i: factor * float(np.log(max(c, 1))) for i, c in n.items()})
    return rows


def sq_bounds(assigned: DataFrame) -> DataFrame:
    """Per list and component the least and greatest residual: (list_id, mins, maxs)."""
    parts = assigned.select("list_id", F.posexplode("residual").alias("i", "x")).groupBy("list_id", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = parts.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))
    return rows.select("list_id", F.transform("b", lambda s: s["lo"]).alias("mins"), F.transform("b", lambda s: s["hi"]).alias("maxs"))
