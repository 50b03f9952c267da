"""Recall, stability, percentiles and choices between measured candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: the part of expected (query_id, row_id) pairs that were found; 1 if none is expected. Negative ids don't count."""
    want = expected.where("row_id >= 0").select("query_id", "row_id").distinct()
    hits = want.join(found.select("query_id", "row_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "row_id"], "left")
    return hits.agg(F.coalesce(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), F.lit(1.0)).alias("recall"))


def stability(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: multiset overlap of two results over the rows of the larger."""
    turn = F.row_number().over(Window.partitionBy("query_id", "row_id").orderBy("rank"))
    a, b = (x.withColumn("turn", turn).select("query_id", "row_id", "turn") for x in (one, two))
    both = a.join(b, ["query_id", "row_id", "turn"]).agg(F.count("*").alias("both"))
    size = a.agg(F.count("*").alias("na")).join(b.agg(F.count("*").alias("nb")))
    return both.join(size).select(F.when(F.greatest("na", "nb") == 0, 1.0).otherwise(F.col("both") / F.greatest("na", "nb")).alias("stability"))


def percentile(df: DataFrame, column: str, p: int) -> DataFrame:
    """One row: the value at position (n - 1) * p / 100, rounded down, in ascending order (nulls left out); null if there is none.

    Quantile estimates with known error bound the values around it, so that only those few are sorted.
    """
    rows = df.select(F.col(f"`{column}`").alias("percentile")).where("percentile is not null")
    n = rows.count()
    if not n:
        return rows.agg(F.first("percentile").alias("percentile"))
    rank, off = (n - 1) * p // 100, 0.002
    lo, hi = rows.approxQuantile("percentile", [max(0.0, rank / n - off), min(1.0, rank / n + off)], off / 4)
    below = rows.where(F.col("percentile") < lo).count()
    if below > rank:  # an estimate of the lowest values
        lo, below = float("-inf"), 0
    return rows.where(F.col("percentile").between(lo, hi)).orderBy("percentile").offset(rank - below).limit(1)


def calibrate(search: Callable[[int], DataFrame], truth: DataFrame, target: float, start: int, most: int) -> int:
    """The first width of start, 2 * start, ... (``most`` at last) whose ``search`` reaches the target recall; ``most`` if none does."""
    width = start
    while width < most:
        if recall(search(width), truth).head().recall >= target:
            return width
        width *= 2
    return most


def clustered_rows(spark: SparkSession, n: int, d: int, clusters: int) -> DataFrame:
    """(row_id, embedding): rows around ``clusters`` points far apart, the same in every run."""
    part = lambda j: (F.col("id") % clusters) * 20.0 + 0.01 * j + 0.0001 * F.col("id")
    return spark.range(n).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(d - 1)), part).alias("embedding"))


def filter_matrix(vectors: DataFrame, parts: tuple[float, ...] = (0.0001, 0.001, 0.01, 0.1, 0.5, 1.0)) -> dict[float, DataFrame]:
    """Allowed row ids for each part of the rows, chosen by hash, a smaller part within the larger ones."""
    turn = F.pmod(F.xxhash64("row_id"), F.lit(1_000_000))
    return {p: vectors.where(turn < int(p * 1_000_000)).select("row_id") for p in parts}


def select_candidate(candidates: DataFrame, recall_at_least: float) -> DataFrame:
    """Of the candidates that reach the recall: fewest bytes, then shortest build, then best recall."""
    return candidates.where(F.col("recall") >= recall_at_least).orderBy("bytes", "build_s", F.desc("recall")).limit(1)
