"""Helpers shared by the operators: table access, staged tables and Arrow slicing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text that one numpy pass looks at; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch of texts, where the session has no setting of its own: a batch is held whole on both sides of a worker's pipe.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of the keys with more than a thousandth of the rows there are fewer than a thousand, so that they can be broadcast.
HOT_PART = 1000
#: Bits that a bitset has at most: 8 MB.
MOST_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Without it there is no place that every executor sees."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/nearspark"  # one machine: its own folder is shared by all
    return found


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, a folder for each value of ``by``, and read it again.

    This cuts lineage so that a lost executor costs a re-read, not a re-run. The
    tables are deleted when the driver ends, since lazy results may read them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # nothing reads the shuffle files of a table that has been written
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing lazy reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.staged_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``table`` that has their keys. The keys for which ``hot`` holds (few: see HOT_PART) are broadcast, so that their rows don't meet in one task."""
    few = F.broadcast(table.where(hot))
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(table.where(~hot), keys, how))


def bitset(keys: DataFrame, count: int) -> np.ndarray:
    """A bit for each of the longs of ``keys`` (one column), 16 bits a key within bounds; more keys than fit only make more alarms false."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(count, 1) - 1).bit_length()))
    slot = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    words = keys.select(slot.alias("slot")).groupBy(F.expr("slot >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitset(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def local(spark: SparkSession, schema: pa.Schema, rows: list[dict]) -> DataFrame:
    """A small table that the driver holds, without a Python task."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema))


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have BATCH_ROWS rows, unless it sets their size. It stays so, as lazy results read the setting when they run."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def trim() -> None:
    """Give freed memory back to the system, where its C library can: workers that wait between tasks otherwise keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def with_columns(docs: DataFrame, text_col: str, run: Callable, new: T.StructType, after: Callable = lambda: None) -> DataFrame:
    """``docs`` with the columns that ``run`` gives for each Arrow array of ``text_col``'s values (any names; columns named like new ones are replaced)."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in new.names]
    # numbered columns can't clash, and have no dots, which mapInArrow doesn't take
    rest = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = run(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], [*part.schema.names[:-1], *(f"n{i}" for i in range(len(found)))])
        after()  # a task
        trim()

    fields = [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields)]
    return rest.mapInArrow(mapped, T.StructType([*rest.schema.fields[:-1], *fields])).toDF(*names, *new.names)


def trimmed(run: Callable) -> Callable:
    """``run`` over a task's batches, giving freed memory back at the end."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def text_slices(batch: pa.RecordBatch, col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    column = batch.column(col)
    size = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty), a space after each, and the start of each (one more at the end)."""
    joined = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", " ")))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    off = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8) if joined.buffers()[2] else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]
