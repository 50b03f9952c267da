"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass 1 counts the slots that hashes of normalised texts fall into, sixteen slots a row, and
keeps the slots hit twice as a bit table. Pass 2 tests every row against it: a row whose slot is hit only
once can't have a copy and passes straight through; only the others are grouped by
their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import HOT_PART, hot_join, stage, unstage

#: Bits a Bloom table may have; they are broadcast as arrays of words, 32 MB at most.
MOST_BITS = 1 << 28
BITS_A_KEY = 16
#: Words of a chunk: one row of a Bloom table.
CHUNK = 1024


def bloom_bits(rows: int) -> int:
    """Bits for so many rows: BITS_A_KEY each, as a power of two, within bounds. More rows than that only add false alarms."""
    return min(MOST_BITS, max(64 * CHUNK, 1 << (BITS_A_KEY * max(rows, 1) - 1).bit_length()))


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bloom(df: DataFrame, key: Column, bits: int, least: int = 1) -> DataFrame:
    """The bit table (chunk, words) of the slots that at least ``least`` rows of ``df`` hit. Counts are added up before rows are shuffled."""
    slots = df.select(_slot(key, bits).alias("slot")).groupBy("slot").count().where(F.col("count") >= least)
    words = slots.groupBy(F.expr("slot >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(CHUNK)).cast("int"), "bits")))  # CHUNK at most
    chunks = words.groupBy(F.floor(F.col("word") / CHUNK).alias("chunk")).agg(entries.alias("at"))
    return chunks.select("chunk", _dense(F.col("at")).alias("words"))


def _dense(at: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0).cast("long")))


def might_contain(df: DataFrame, key: Column, table: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: whether the slot of the key is set. The broadcast table is bounded by ``bits``."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    own = F.broadcast(table.select(F.col("chunk").alias("__chunk"), F.col("words").alias("__words")))
    rows = df.withColumn("__slot", _slot(key, bits)).join(own, F.expr(f"__slot div {64 * CHUNK}") == F.col("__chunk"), "left")
    hit = F.expr(f"getbit(get(__words, cast((__slot >> 6) % {CHUNK} as int)), cast(__slot & 63 as int)) = 1")
    return rows.select(*columns, F.coalesce(hit, F.lit(False)).alias(name))


def normalised(text: Column) -> Column:
    """The text (null: empty) without ASCII white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without ASCII white space; null and white-space-only
    texts equal the empty text. Of equal texts the row with most code points in its
    original text, then the smallest id (a null id is smallest) stays. Rows repeated with
    the same id and text are counted in group_size and all carry the id's decision;
    drop_copies lets one of them through. Other columns aren't read.
    """
    text = F.col(f"`{text_col}`")
    sha = F.sha2(normalised(text), 256)
    total = docs.count()
    # hashes are dealt to parts, each with a filter of its own that stays sparse however many rows there are
    parts = -(-max(total, 1) * BITS_A_KEY // MOST_BITS)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), sha.alias("sha"), F.char_length(F.coalesce(text, F.lit(""))).alias("n"))
    keys = stage(rows.withColumn("part", F.pmod(F.xxhash64("sha", F.lit(1)), F.lit(parts))), "dedup-keys", "part" if parts > 1 else None)
    seen = None
    for p in range(parts):
        own = keys.where(F.col("part") == p).drop("part") if parts > 1 else keys.drop("part")
        bits = bloom_bits(-(-total // parts))
        found = stage(might_contain(own, F.col("sha"), bloom(own, F.col("sha"), bits, least=2), bits, "maybe"), "dedup-seen")
        seen = found if seen is None else seen.unionByName(found)
    unstage(keys)
    groups = stage(
        seen.where("maybe").groupBy("sha").agg(F.count("*").alias("group_size"), F.min(F.struct(-F.col("n"), F.col("id"))).alias("best")).select("sha", "group_size", F.col("best.id").alias("keep_id")),
        "dedup-groups",
    )
    alone = seen.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    grouped = hot_join(seen.where("maybe").select("id", "sha"), groups, ["sha"], F.col("group_size") * HOT_PART > total)
    grouped = grouped.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(grouped).withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, every column, without the rows that exact_dedup drops.

    A second Bloom table over the ids that need a decision sends all other rows
    straight through, so their texts aren't shuffled or hashed again.
    """
    found = stage(exact_dedup(docs, id_col, text_col), "dedup-decisions")
    repeated = found.where("kept and group_size > 1").groupBy(F.col(f"`{id_col}`").alias("__id"), "text_sha256").count().where("count > 1")
    decide = stage(
        found.where("not kept").select(F.col(f"`{id_col}`").alias("__id"), F.col("text_sha256").alias("__sha"), F.lit(False).alias("__stay"))
        .unionByName(repeated.select("__id", F.col("text_sha256").alias("__sha"), F.lit(True).alias("__stay")))
        .dropDuplicates(["__id", "__sha"]),
        "dedup-decide",
    )
    bits = bloom_bits(decide.count())
    # the documents' own columns travel in one struct, so that their names can't clash with ours
    rows = docs.select(as_row(docs), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"))
    seen = might_contain(rows, F.col("key"), bloom(decide, F.coalesce(F.col("__id").cast("string"), F.lit("")), bits), bits, "maybe")
    straight = seen.where(~F.col("maybe")).select("row.*")
    hashed = seen.where("maybe").select("row", "id", F.sha2(normalised(F.col("text")), 256).alias("own"))
    joined = hashed.join(decide, F.col("id").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__sha")), "left")
    stays = joined.where("__stay is null").select("row.*")
    single = joined.where("__stay").dropDuplicates(["id", "own"]).select("row.*")
    return straight.unionByName(stays).unionByName(single)


def as_row(df: DataFrame) -> Column:
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("row")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that have one of ``ids`` (one column). Only rows that a Bloom table of the ids may hold are shuffled."""
    gone = stage(ids.toDF("__id").where("__id is not null").distinct(), "without")
    bits = bloom_bits(gone.count())
    seen = might_contain(docs.select(as_row(docs), F.col(f"`{id_col}`").alias("id")), F.col("id"), bloom(gone, F.col("__id"), bits), bits, "maybe")
    checked = seen.where("maybe").join(gone, F.col("id") == F.col("__id"), "left_anti")
    return seen.where(~F.col("maybe")).select("row.*").unionByName(checked.select("row.*"))


ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
