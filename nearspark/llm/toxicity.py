"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common, kernels as K

#: Hash space of the features; the weights broadcast are at most this many.
BITS = 22
#: Labelled rows that training uses at most, the first in hash order of their ids; each is used whole.
TRAIN_ROWS = 16_000
#: Bytes of their texts at most; a text that doesn't fit is passed over. What reaches the driver is less: numbers of supported features.
TRAIN_BYTES = 96_000_000
#: Training rows that a feature must be in.
SUPPORT = 4
HELD_OUT = 2
EPOCHS = 3
#: Bytes of features that the driver holds at a time.
PART_BYTES = 8_000_000


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs: words, pairs, triples and pairs that skip one word, hashed.

    Words are runs of letters with A-Z lowered, so marks and digits around a word don't hide it.
    """
    low = K.LOWER[data]
    w, row, _ = K.words(low, off, K.LETTER[low])
    got = [(w, row)]
    for gap in (1, 2):
        if len(w) > gap:
            same = row[:-gap] == row[gap:]
            got.append((K.mix(w[:-gap] * K._STEP[gap] + w[gap:] * K._STEP[gap + 2])[same], row[gap:][same]))
    if len(w) > 2:
        same = row[:-2] == row[2:]
        got.append((K.mix(w[:-2] * K._STEP[5] + w[1:-1] * K._STEP[6] + w[2:] * K._STEP[7])[same], row[2:][same]))
    h = np.concatenate([g[0] for g in got]) >> np.uint64(64 - BITS)
    return np.concatenate([g[1] for g in got]), h.astype(np.int64)


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row.astype(np.int64) << BITS | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


class Ftrl:
    """FTRL-proximal with per-coordinate rates and L1 sparsity; features are present or not."""

    def __init__(self, size: int, alpha: float = 2.4, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.z0 = self.n0 = 0.0

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.z0 / ((self.beta + np.sqrt(self.n0)) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self._weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        if abs(g) < 1e-4:
            return
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.z0 += g - (np.sqrt(self.n0 + g * g) - np.sqrt(self.n0)) / self.alpha * b
        self.n0 += g * g


def train(read: Callable[[], Iterator[tuple[np.ndarray, int]]], known: np.ndarray, epochs: int = EPOCHS, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, ascending, their weights, and the bias. ``read`` goes through the rows' features (of ``known``, ascending) and labels once. No rows: the bias alone."""
    place = np.zeros(1 << BITS, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    model = Ftrl(len(known), **options)
    for _ in range(epochs):
        for at, label in read():
            model.learn(place[at], label)
    kept = np.flatnonzero(np.abs(model.z) > model.l1)
    return known[kept], model._weights(kept).astype(np.float32), model.bias()


def bags(rows: DataFrame) -> DataFrame:
    """(row, label, features): the distinct features of each row's text (row, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch):
                row, at = _distinct(*features(*common.spaced(part.column("text"))))
                off = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("label"), pa.ListArray.from_arrays(pa.array(off), pa.array(at.astype(np.int32)))], ["row", "label", "features"])

    return rows.mapInArrow(common.trimmed(run), "row long, label int, features array<int>")


def _support(found: DataFrame, least: int) -> np.ndarray:
    """The features that at least ``least`` rows have, ascending: 2**BITS at most, which come to the driver as bits."""
    count = found.select(F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = count.groupBy(F.expr("f >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, f & 63)")).alias("bits"))
    words = common.stage(words, "toxicity-support").toArrow()
    mark = np.zeros(1 << BITS - 6, np.int64)
    mark[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.flatnonzero(np.unpackbits(mark.view(np.uint8), bitorder="little"))


def _only(found: DataFrame, known: np.ndarray) -> DataFrame:
    """``found`` without other features than ``known``."""
    held = found.sparkSession.sparkContext.broadcast(known.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[held.value] = True
        for b in batches:
            lists = b.column("features")
            at = lists.flatten().to_numpy()
            hit = keep[at]
            edge = np.concatenate([[0], np.cumsum(hit)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("label"), pa.ListArray.from_arrays(pa.array(edge), pa.array(at[hit]))], b.schema.names)

    return found.mapInArrow(common.trimmed(run), found.schema)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(row, label, text) of the training rows: at most ``rows`` labelled ids in hash order, and TRAIN_BYTES of text.

    Rows whose crc32(id) mod 4 is 2 are held out. Rows with a null label, id or text are left
    out, as are ids labelled both ways; rows repeated with one id and text count once.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(f"id is not null and label is not null and pmod(crc32(cast(id as string)), 4) != {HELD_OUT}")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(rows))  # at most ``rows`` ids
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null").withColumn("code", F.xxhash64("text"))
    # sizes first: texts are read again, and only those that fit
    sizes = text.join(known, "id").groupBy("id", "label", "code").agg(F.max(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("id"), "id", "code").limit(rows).toArrow()
    taken, left = [], TRAIN_BYTES
    for i, size in enumerate(sizes.column("size").to_pylist()):
        if size <= left:
            taken.append(i)
            left -= size
    chosen = sizes.select(["id", "label", "code"]).take(pa.array(taken, pa.int64())).append_column("row", pa.array(np.arange(len(taken))))
    return text.join(F.broadcast(spark.createDataFrame(chosen)), ["id", "code"]).select("row", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on the rows of sample(), in hash order of their numbers.

    Texts become features, and features without support go, in the executors. The driver goes through the
    rows part by part in each epoch, so that it never holds more than about PART_BYTES of their texts' features.
    """
    found = common.stage(bags(sample(docs, labels, id_col, text_col, label_col, rows)), "toxicity-bags")
    parts = max(1, -(-(found.agg(F.sum(F.size("features"))).head()[0] or 0) * 4 // PART_BYTES))
    known = _support(found, SUPPORT)
    dealt = _only(found, known).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    ready = common.stage(dealt.repartition(parts, "part"), "toxicity-rows", "part")
    common.unstage(found)

    def read() -> Iterator[tuple[np.ndarray, int]]:
        for p in range(parts):
            got = ready.where(F.col("part") == p).select("row", "label", "features").toArrow()
            lists = got.column("features").combine_chunks()
            row, label, edge, at = got.column("row").to_numpy(), got.column("label").to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy()
            # rows repeated with one id and text have one number, and count once
            for i in np.unique(K.mix(row.view(np.uint64)), return_index=True)[1].tolist():
                yield at[edge[i] : edge[i + 1]], int(label[i])

    model = train(read, known)
    common.unstage(ready)
    common.trim()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int) for every whole text.

    Null and empty texts get the bias's score; repeated rows are scored each; an empty
    table stays empty. Columns named score or predicted are replaced. Nothing is shuffled.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # at most 2**BITS weights, and L1 leaves few of them

    def run(texts: pa.Array) -> list[pa.Array]:
        at, weight, bias = held.value
        mark = np.zeros(1 << BITS, np.float32)
        mark[at] = weight
        row, feature = features(*common.spaced(texts))
        hit = mark[feature] != 0
        row, feature = _distinct(row[hit], feature[hit])
        total = np.bincount(row, mark[feature], len(texts)) + bias
        p = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return common.with_columns(docs, text_col, run, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """id, held_out, score and predicted of every document, learnt from ``labels``. A null id is not held out."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model, **options)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
