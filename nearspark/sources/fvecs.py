"""fvecs and ivecs files: records of a 4-byte count and so many 4-byte floats or integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, path: str, kind: str, name: str, sql: str) -> DataFrame:
    """One row per record: file, position and values. Files are read whole, one per task; split large sets into several files."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                if not content:
                    continue
                d = int(np.frombuffer(content, "<i4", 1)[0])
                if d <= 0 or len(content) % (4 * (d + 1)):
                    raise ValueError(f"{file}: not a whole number of records of {d} values")
                rows = np.frombuffer(content, "<i4").reshape(-1, d + 1)
                if (rows[:, 0] != d).any():
                    raise ValueError(f"{file}: records differ in length")
                values = np.ascontiguousarray(rows[:, 1:]).view(kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, d, dtype=np.int32)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(np.arange(len(rows))), lists], ["file", "row_id", name])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, row_id long, {name} array<{sql}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "<f4", "embedding", "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "<i4", "neighbours", "int")


def to_fvecs(v: np.ndarray) -> bytes:
    head = np.full((len(v), 1), v.shape[1], "<i4")
    return np.concatenate([head, np.ascontiguousarray(v, "<f4").view("<i4")], axis=1).tobytes()
