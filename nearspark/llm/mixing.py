"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash (MD5 of its id). Per source, sizes are summed by hash bucket;
the bucket in which the running sum passes the source's budget is the only one that is
refined, twice, down to single hashes. What remains of the budget after the document at
the threshold is left out is spent the same way on documents small enough to fit
(nested thresholds). The choice is then a filter by the thresholds: nothing is sorted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import dedup
from .common import local, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
#: One row per source is held by the driver and broadcast; more sources than this raise an error.
MOST_SOURCES = 1_000_000
#: A nested pass takes documents of at most this part of what remains.
FITS = 4
PASSES = 3
_STATE = pa.schema([("s", pa.string()), ("budget", pa.float64()), ("b", pa.string()), ("below", pa.int64()), ("fits", pa.int64()), ("passed", pa.list_(pa.string()))])
_PLAN = pa.schema([("__s", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("whole", pa.int32()), ("cuts", pa.list_(pa.struct([("fits", pa.int64()), ("cut", pa.string())])))])


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> dict:
    """Target of each source: share of all sizes by weight; none above ``most`` times its size, the excess reshared by weight.

    ``sizes`` has the size of each source (None: no source); sources sort by code point, None last.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, active = share * sum(sizes.values()), {}, list(names)
    while active:
        total = sum(weight[s] for s in active)
        full = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in active}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        active = [s for s in active if s not in out]
    return out


def _thresholds(keys: DataFrame, budgets: dict[str, float], fits: dict[str, int], passed: dict[str, list[str]]) -> dict[str, tuple[str, int]]:
    """Per source the hash up to which its sizes stay within its budget, and what they come to.

    Only documents of size ``fits`` at most and with hashes beyond those of the passes before (``passed``) count.
    A source that stays within its budget altogether is left out. The driver sees one row per source at each level.
    """
    spark, width = keys.sparkSession, 3
    state = {s: (b, "", 0) for s, b in budgets.items()}  # budget, boundary bucket so far, size before it
    done: dict[str, tuple[str, int]] = {}
    while state:
        level = local(spark, _STATE, [{"s": s, "budget": float(b), "b": c, "below": n, "fits": fits[s], "passed": passed[s]} for s, (b, c, n) in state.items()])
        open_ = (F.col("size") <= F.col("fits")) & F.forall("passed", lambda c: F.col("key") > c)
        inside = keys.withColumn("b", F.substring("key", 1, width - 3)).join(F.broadcast(level), ["s", "b"]).where(open_)
        last = width > 6
        fine = inside.groupBy("s", "budget", "below", (F.col("key") if last else F.substring("key", 1, width)).alias("c")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("s").orderBy("c")) + F.col("below")
        fine = fine.withColumn("run", run)
        if last:
            fits = F.col("run") <= F.col("budget")
            found = fine.where(fits).groupBy("s").agg(F.max("c").alias("c"), F.max("run").alias("run")).collect()
            done = {s: (c, n) for s, (_, c, n) in state.items()} | {r.s: (r.c, r.run) for r in found}
            return done
        cut = fine.where("run > budget and run - size <= budget").select("s", "c", (F.col("run") - F.col("size")).alias("below")).collect()
        state = {r.s: (budgets[r.s], r.c, r.below) for r in cut}
        width += 3
    return done


class Plan:
    """The thresholds of each source; ``take`` gives a document's number of copies from its id, source and size alone."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE):
        self.spark, self.cols = docs.sparkSession, (id_col, text_col, source_col)
        s = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("n"))  # joins and groups don't treat null apart
        self.keys = stage(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), s.alias("s"), n_words(F.col(f"`{text_col}`")).alias("size"), _key(F.col(f"`{id_col}`")).alias("key")), "mix-keys")
        rows = self.keys.groupBy("s").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        sizes = {r.s[1:] if r.s[0] == "s" else None: r.size for r in rows}
        goal = targets(sizes, weights, share)
        self.rows = {}
        for name, target in goal.items():
            whole = min(int(target // sizes[name]), int(MOST_REPEATS)) if sizes[name] else 0
            self.rows["n" if name is None else "s" + name] = {"source_size": sizes[name], "target": target, "whole": whole, "left": target - whole * sizes[name], "cuts": []}
        for k in range(PASSES):
            need = {s: int(r["left"] // FITS) if k else 1 << 62 for s, r in self.rows.items() if r["left"] >= 1}
            found = _thresholds(self.keys, {s: self.rows[s]["left"] for s in need}, need, {s: [c["cut"] for c in self.rows[s]["cuts"]] for s in need})
            for s, fits in need.items():  # all that fit are within the budget where no threshold is found
                cut, spent = found.get(s, ("g", self.rows[s]["left"]))
                self.rows[s]["cuts"].append({"fits": fits, "cut": cut})
                self.rows[s]["left"] -= spent

    def _frame(self) -> DataFrame:
        return local(self.spark, _PLAN, [{"__s": s, "source_size": int(r["source_size"]), "target": float(r["target"]), "whole": r["whole"], "cuts": r["cuts"]} for s, r in self.rows.items()])

    def copies(self, df: DataFrame, s: Column, size: Column, key: Column) -> DataFrame:
        extra = F.exists("cuts", lambda c: (size <= c["fits"]) & (key <= c["cut"])).cast("int")
        return df.join(F.broadcast(self._frame()), s == F.col("__s")).withColumn("__copies", F.col("whole") + extra)

    def decisions(self) -> DataFrame:
        """id, size, source_size, target, taken (words the mix takes, repeats counted) of every document."""
        out = self.copies(self.keys, F.col("s"), F.col("size"), F.col("key"))
        return out.select(F.col("id").alias(self.cols[0]), "size", "source_size", "target", (F.col("size") * F.col("__copies")).alias("taken"))

    def mixed(self, docs: DataFrame) -> DataFrame:
        """``docs`` as the mix takes them: rows left out or repeated. No text is shuffled."""
        i, t, src = self.cols
        s = F.coalesce(F.concat(F.lit("s"), F.col(f"`{src}`")), F.lit("n"))
        rows = docs.select(dedup.as_row(docs), s.alias("__src"), n_words(F.col(f"`{t}`")).alias("size"), _key(F.col(f"`{i}`")).alias("key"))
        out = self.copies(rows, F.col("__src"), F.col("size"), F.col("key"))
        return out.select("row", F.explode(F.expr("array_repeat(0, __copies)")).alias("repeat")).select("row.*")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Decisions of a Plan over ``docs``.

    Null texts and texts without words have size 0 and take nothing; a source of size 0
    has target 0; a null source is a source of its own, sorted last; a null id hashes as
    the empty string; rows repeated with one id are taken or left together. An empty table
    gives no rows. A source's taken words differ from its target by less than
    the next document in hash order of at most 1/4 of the remainder, or by what no
    document fits into.
    """
    return Plan(docs, **options).decisions()


ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key, coalesce('s' || source, 'n') AS s FROM documents),
src AS (SELECT s, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM k GROUP BY s),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
             1.5 * sum(source_size) OVER () AS total FROM src),
o AS (SELECT *, coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
             sum(weight) OVER (ORDER BY source_size / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, 2.0 * source_size < (total - capped) * weight / rest AS is_full FROM o),
lv AS (SELECT any_value(total) - coalesce(sum(2.0 * source_size) FILTER (is_full), 0) AS remaining, sum(weight) FILTER (NOT is_full) AS weights FROM f),
t AS (SELECT s, source_size, CASE WHEN is_full THEN 2.0 * source_size ELSE remaining * weight / weights END::DOUBLE AS target FROM f, lv),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, floor(target / source_size)) END AS whole FROM t),
p0 AS (SELECT k.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS left1 FROM k JOIN b USING (s)),
p1 AS (SELECT *, left1 >= 1 AND sum(size) OVER (PARTITION BY s ORDER BY key) <= left1 AS in1 FROM p0),
q1 AS (SELECT *, left1 - coalesce(sum(size) FILTER (in1) OVER (PARTITION BY s), 0) AS left2 FROM p1),
p2 AS (SELECT *, left2 >= 1 AND NOT in1 AND size <= left2 // 4
         AND sum(CASE WHEN NOT in1 AND size <= left2 // 4 THEN size ELSE 0 END) OVER (PARTITION BY s ORDER BY key) <= left2 AS in2 FROM q1),
q2 AS (SELECT *, left2 - coalesce(sum(size) FILTER (in2) OVER (PARTITION BY s), 0) AS left3 FROM p2),
p3 AS (SELECT *, left3 >= 1 AND NOT in1 AND NOT in2 AND size <= left3 // 4 AND size <= left2 // 4
         AND sum(CASE WHEN NOT in1 AND NOT in2 AND size <= left3 // 4 AND size <= left2 // 4 THEN size ELSE 0 END) OVER (PARTITION BY s ORDER BY key) <= left3 AS in3 FROM q2)
SELECT doc_id, size, source_size, target, (size * (whole + (in1 OR in2 OR in3)::INT))::BIGINT AS taken FROM p3
"""
