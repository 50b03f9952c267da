"""Sharding by balanced label propagation, with row counts at most one apart.

Documents with equal texts are linked. Every document starts in a hashed shard; in each
round every group that has no place yet wishes for the shard where most of it is among
those with room for it, and takes its place there if the groups before it leave room,
until all have places. A group larger than any room fills as few shards as it can. A last
step moves as few unlinked rows as needed from shards above their quota to shards below it.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import HOT_PART, hot_join, local, stage, unstage

SHARDS = 40
#: The driver places groups larger than this part of a shard, and groups that rounds have left once they are few: ``FEW`` a shard.
FEW = 64
#: Rows that one task ranks at about; ranks over more rows are dealt out by hash.
RANKED = 50_000


def dealt_rank(df: DataFrame, part: list[str], order: list[Column], rows: int, name: str, lead: Column | None = None, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: the rank from 0 of each row in its part, gapless; with ``weight``, the sum of it over the rows before.

    Rows are dealt to buckets by ``lead`` (a long, smaller first) and a hash of the first of ``order``; a bucket's
    rows are ranked in one task, offset by the counts of the buckets before it. So the
    order is by lead, bucket, then ``order``, and no task ranks a whole part.
    """
    buckets = max(1, min(4096, rows // RANKED))
    df = df.withColumns({"__lead": lead if lead is not None else F.lit(0).cast("long"), "__bucket": F.pmod(F.xxhash64(order[0]), F.lit(buckets))})
    keys = [*part, "__lead", "__bucket"]
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*part).orderBy("__lead", "__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("__n")).withColumn("__before", before).drop("__n")
    within = Window.partitionBy(*keys).orderBy(*order)
    own = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(within) - 1
    return df.withColumn("__own", own).join(counts, keys).withColumn(name, F.col("__before") + F.col("__own")).drop("__lead", "__bucket", "__own", "__before")


def fill(groups: list[tuple[str, int, dict[int, int]]], room: list[int]) -> dict[str, dict[int, int]]:
    """Rows that each group (name, rows, rows held by shard) puts into each shard; ``room`` is lessened by them.

    The largest remainder comes first. It goes whole where most of the group is among the
    shards with room for it; if there is none, it fills the roomiest shard and the rest comes again.
    """
    held, plan = {g: h for g, _, h in groups}, {g: {} for g, _, _ in groups}
    queue = [(-n, g) for g, n, _ in groups]
    heapify(queue)
    while queue:
        n, g = heappop(queue)
        fits = [k for k, r in enumerate(room) if r >= -n]
        if fits:
            k = max(fits, key=lambda k: (held[g].get(k, 0), -k))
        else:
            k = max(range(len(room)), key=lambda k: (room[k], held[g].get(k, 0), -k))
            heappush(queue, (n + room[k], g))
        plan[g][k] = min(-n, room[k])
        room[k] -= plan[g][k]
    return plan


def _moves(held: dict[int, int], goal: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(shard, first rank, rank after the last, new shard): as many rows as can stay do, the others fill the gaps in turn."""
    out = [(k, 0, min(c, goal[k]), k) for k, c in held.items() if goal.get(k)]
    gaps = [[k, n - held.get(k, 0)] for k, n in sorted(goal.items()) if n > held.get(k, 0)]
    for k, c in sorted(held.items()):
        at = min(c, goal.get(k, 0))
        while at < c:
            to, n = gaps[-1]
            take = min(n, c - at)
            out.append((k, at, at + take, to))
            at, gaps[-1][1] = at + take, n - take
            if take == n:
                gaps.pop()
    return out


def _collect(groups: DataFrame) -> list[tuple[str, int, dict[int, int]]]:
    return [(r.g, r.n, {h.shard: h.c for h in r.held}) for r in groups.collect()]


def _place(linked: DataFrame, quota: list[int]) -> DataFrame:
    """``linked`` (g, row, shard) with the shards that the groups take; none gets more rows than its quota."""
    spark, shards, room = linked.sparkSession, len(quota), list(quota)
    flows = linked.groupBy("g", "shard").agg(F.count("*").alias("c"))
    held = F.sort_array(F.collect_list(F.struct("c", F.xxhash64("g", "shard").alias("tie"), "shard")), asc=False)  # one entry a shard at most
    groups = stage(flows.groupBy("g").agg(F.sum("c").alias("n"), held.alias("held")), "shard-groups")
    # large groups come first: fewer than FEW a shard fit into the table
    known = _collect(groups.where(F.col("n") * FEW > max(quota)))
    plan = fill(known, room)
    left, settled, turn = groups.where(F.col("n") * FEW <= max(quota)), [], 0
    while (count := left.count()) > FEW * shards:
        # a round gives each wished-for shard one group at least; groups that fit nowhere are fewer than the shards
        rooms = F.array(*[F.lit(x).cast("long") for x in room])
        own = F.filter("held", lambda x: F.element_at(rooms, x["shard"] + 1) >= F.col("n"))
        other = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.element_at(rooms, k + 1) >= F.col("n"))
        any_ = F.when(F.size(other) > 0, F.get(other, F.pmod(F.xxhash64("g", F.lit(turn)), F.greatest(F.size(other), F.lit(1))).cast("int")))
        wish = left.withColumn("to", F.coalesce(F.get(own, 0)["shard"], any_, F.lit(-1)))
        ranked = dealt_rank(wish, ["to"], [F.col("g")], count // shards, "before", -F.floor(F.log2("n")), "n")
        enters = (F.col("to") >= 0) & (F.col("before") + F.col("n") <= F.when(F.col("to") >= 0, F.element_at(rooms, F.col("to") + 1)))
        ranked = stage(ranked.withColumn("enters", enters), "shard-round")
        settled.append(ranked.where("enters").select("g", "to"))
        for r in ranked.where("enters").groupBy("to").agg(F.sum("n").alias("n")).collect():
            room[r.to] -= r.n
        left, turn = ranked.where("NOT enters").select("g", "n", "held"), turn + 1
    last = _collect(left)
    plan |= fill(last, room)
    cut = [(g, h) for g, _, h in known + last if len(plan[g]) > 1]
    homes = local(spark, pa.schema([("g", pa.string()), ("to", pa.int32())]), [{"g": g, "to": next(iter(x)) if len(x) == 1 else -1} for g, x in plan.items()])
    moves = [{"g": g, "shard": k, "lo": lo, "hi": hi, "to": to} for g, h in cut for k, lo, hi, to in _moves(h, plan[g])]
    moves = local(spark, pa.schema([("g", pa.string()), ("shard", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("to", pa.int32())]), moves)
    rows = linked.join(F.broadcast(homes), "g", "left")  # 2 * FEW a shard at most
    out = rows.where("to >= 0").select("row", F.col("to").alias("shard"))
    if settled:
        small = settled[0]
        for x in settled[1:]:
            small = small.unionByName(x)
        out = out.unionByName(rows.where("to IS NULL").drop("to").join(small, "g").select("row", F.col("to").alias("shard")))
    if cut:
        most = max(max(h.values()) for _, h in cut)
        ranked = dealt_rank(rows.where("to < 0").drop("to"), ["g", "shard"], [F.col("turn"), F.col("row")], most, "r")
        out = out.unionByName(ranked.join(F.broadcast(moves), ["g", "shard"]).where("r >= lo AND r < hi").select("row", F.col("to").alias("shard")))
    return stage(out, "shard-linked-placed")


def propagate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: 0) plus 16; law is ``rows``: shards' row counts
    differ by one at most. slot counts from 0 in each shard without gaps. grown_shard is
    null, as it has no meaning under this law. Null and empty texts are linked to each
    other; a null id and repeated rows get places of their own; with fewer documents than
    shards the last shards are empty; an empty table gives no rows. Other columns aren't read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = stage(docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("g"), F.monotonically_increasing_id().alias("row")).withColumn("turn", F.xxhash64("id", "g")), "shard-rows")
    total = base.count()
    many = stage(base.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    # turn, a hash of id and text, decides all; row tells apart rows that are equal in both
    own = (F.pmod(F.xxhash64("turn"), F.lit(shards))).cast("int")
    state = stage(hot_join(base, many, ["g"], F.col("n") * HOT_PART > total, "left").withColumn("shard", own), "shard-start")
    unstage(base, many)
    linked = stage(state.where("n is not null").select("g", "row", "turn", "shard"), "shard-linked")
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    linked = _place(linked, quota)
    placed = state.where("n is null").select("id", "size", "text_crc32", "row", "turn", "shard", F.lit(0).cast("long").alias("tied"))
    placed = placed.unionByName(state.where("n is not null").drop("shard").join(linked, "row").select("id", "size", "text_crc32", "row", "turn", "shard", F.lit(1).cast("long").alias("tied")))
    placed = stage(placed, "shard-placed")
    count = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    # the first rows of a shard above its quota leave (unlinked rows come first) and fill the gaps in turn
    over = [max(0, count.get(k, 0) - quota[k]) for k in range(shards)]
    gaps, edge = [], 0
    for k in range(shards):
        gap = max(0, quota[k] - count.get(k, 0))
        gaps.append((edge, edge + gap, k))
        edge += gap
    pick = F.element_at(F.array(*[F.lit(x) for x in over]), F.col("shard") + 1)
    ranked = stage(dealt_rank(placed, ["shard"], [F.col("turn"), F.col("row")], total // shards, "r", F.col("tied")), "shard-ranked")
    starts, run = [], 0
    for x in over:
        starts.append(run)
        run += x
    turn = F.element_at(F.array(*[F.lit(x) for x in starts]), F.col("shard") + 1) + F.col("r")
    to = F.lit(None).cast("int")
    for lo, hi, k in gaps:
        if hi > lo:
            to = F.when((turn >= lo) & (turn < hi), F.lit(k)).otherwise(to)
    final = stage(ranked.withColumn("shard", F.when(F.col("r") < pick, to).otherwise(F.col("shard"))).drop("r"), "shard-final")
    out = dealt_rank(final, ["shard"], [F.col("turn"), F.col("row")], total // shards, "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
