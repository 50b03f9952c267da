"""Trainer, Training, Writer and Reader: building, storing and opening an index of any type in steps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..plans.config import IndexConfig, SearchParams
from .graph import GraphIndex
from .ivf import IvfIndex, Model


class Trainer:
    """Collects training vectors (row_id, embedding) in any number of steps."""

    def __init__(self, config: IndexConfig):
        self.config, self.parts = config, []

    def add(self, vectors: DataFrame) -> Trainer:
        self.parts.append(vectors.select("row_id", "embedding"))
        return self

    def finish(self) -> Training:
        """A graph index learns nothing beforehand; the others need vectors."""
        if self.config.index_type == "diskann":
            return Training(self.config, None)
        if not self.parts:
            raise ValueError("no training vectors")
        return Training(self.config, IvfIndex.train(_union(self.parts), self.config))


class Training:
    def __init__(self, config: IndexConfig, model: Model | None):
        self.config, self.model = config, model


class Writer:
    """Takes vectors in any number of steps and writes one index of them."""

    def __init__(self, training: Training):
        self.training, self.parts = training, []

    def add(self, vectors: DataFrame) -> Writer:
        self.parts.append(vectors.select("row_id", "embedding"))
        return self

    def index(self) -> IvfIndex | GraphIndex:
        if not self.parts:
            raise ValueError("no vectors")
        rows, t = _union(self.parts), self.training
        return GraphIndex.build(rows, t.config) if t.model is None else IvfIndex(t.model, IvfIndex.encode(t.model, rows).persist())

    def write(self, path: str) -> None:
        self.index().save(path)


class Reader:
    """An index that was written, of whatever type."""

    def __init__(self, index: IvfIndex | GraphIndex):
        self.index = index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Reader:
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for kind, folder in ((IvfIndex, "model"), (GraphIndex, "centroids")):
            if there.exists(spark._jvm.org.apache.hadoop.fs.Path(fs, folder)):
                return cls(kind.load(spark, path))
        raise ValueError(f"{path} holds no index of a known format")

    def metadata(self) -> dict:
        return self.index.metadata()

    def metadata_frame(self) -> DataFrame:
        rows = self.index.lists if isinstance(self.index, IvfIndex) else self.index.nodes
        return rows.sparkSession.createDataFrame([(json.dumps(self.metadata()),)], "metadata string")

    def optimize_for_search(self) -> Reader:
        """Keep the stored rows in executors' memory, as far as there is room."""
        rows = self.index.lists if isinstance(self.index, IvfIndex) else self.index.nodes
        rows.persist()
        return self

    def warm_up(self) -> int:
        """Read all rows once; their number."""
        return (self.index.lists if isinstance(self.index, IvfIndex) else self.index.nodes).count()

    def search(self, queries: DataFrame, params: SearchParams, allowed: DataFrame | None = None) -> DataFrame:
        return self.index.search(queries, params, allowed)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
