"""Training on a stream: every micro-batch leaves a coreset, and centroids can be had from all of them at any time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators import cluster


def coreset_sink(path: str, k: int, d: int, seed: int = 1234) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: the weighted centroids of each batch (embedding) go to ``path``. A batch that is run again replaces its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        cluster.coreset(batch, k, d, seed=seed).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def centroids(spark: SparkSession, path: str, k: int, seed: int = 1234) -> np.ndarray:
    """k centroids of all batches so far."""
    return cluster.finish_coreset(spark.read.schema("centroid array<double>, weight double").parquet(path), k, seed)
