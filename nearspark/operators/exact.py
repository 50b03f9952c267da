"""Exact nearest neighbours, filters and padding.

``knn`` deals queries and rows to a grid of blocks and keeps each block's k best in numpy;
only k rows per query and block are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from . import kernels

#: Queries that one block of the grid holds.
QUERY_BLOCK = 2048
#: Queries up to which they are broadcast to every partition of the rows, and their bytes at most.
BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 64 << 20


def top_k(found: DataFrame, k: int, dedup: bool = False) -> DataFrame:
    """query_id, rank, row_id, distance of each query's k nearest; ties to the smaller row id. dedup: the best of each row id."""
    if dedup:
        found = found.groupBy("query_id", "row_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "distance")


def prefilter(vectors: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose id is allowed. Negative ids never match, as in the bitmap filters this stands for."""
    return vectors.join(allowed.where("row_id >= 0").select("row_id").distinct(), "row_id", "left_semi")


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """k nearest rows of every query. vectors: row_id, embedding; queries: query_id, q. All pairs are looked at, in blocks.

    Rows and queries with a null id or vector take no part; a vector of another length than
    the queries' commonest, or with a null or non-finite component, is an error.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    queries, vectors = queries.where("query_id is not null and q is not null"), vectors.where("row_id is not null and embedding is not null")
    # the queries are broadcast in blocks of checked size, one pass over the rows for each
    head = queries.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = head[0].d if head else 1
    queries = validate(queries.select("query_id", "q"), d, "q")
    vectors = validate(vectors.select("row_id", "embedding"), d) if head else vectors.select("row_id", "embedding").where("false")
    per = max(1, min(BROADCAST_QUERIES, BROADCAST_BYTES // (8 * max(d, 1))))
    total = queries.count()
    blocks = max(1, -(-total // per))
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = part.select(F.col("query_id").cast("long"), V.as_double(F.col("q")).alias("q")).toArrow()
        held = spark.sparkContext.broadcast((got.column("query_id").to_numpy(), kernels.matrix(got.column("q"), d)))

        def scan(batches, held=held):
            ids, q = held.value
            for batch in batches:
                v = kernels.matrix(batch.column("embedding"), d)
                rows = batch.column("row_id").to_numpy()
                for lo in range(0, len(ids), QUERY_BLOCK):
                    own = q[lo : lo + QUERY_BLOCK]
                    at, best = kernels.best(own, v, rows, k, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + QUERY_BLOCK], at.shape[1])), pa.array(rows[at].ravel()), pa.array(best.ravel())], ["query_id", "row_id", "distance"])

        one = vectors.select(F.col("row_id").cast("long"), V.as_double(F.col("embedding")).alias("embedding")).mapInArrow(scan, "query_id long, row_id long, distance double")
        found = one if found is None else found.unionByName(one)
    return top_k(found, k)


def padded(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows per query; missing ones have row_id -1 and the largest float as distance."""
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    full = slots.join(found, ["query_id", "rank"], "left")
    return full.select("query_id", "rank", F.coalesce("row_id", F.lit(-1).cast("long")).alias("row_id"), F.coalesce("distance", F.lit(3.4028234663852886e38)).alias("distance"))


def validate(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, V.check_vector(F.col(column), dimension))


def where_label(vectors: DataFrame, condition: Column) -> DataFrame:
    """Filter by any column before ranking, so that the condition reaches the scan."""
    return vectors.where(condition)
