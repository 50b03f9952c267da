"""N-gram Jaccard join: exact links of documents whose word shingles overlap, and their components.

Jaccard distance is a metric. Documents with equal shingle sets are one point; two points
are linked within distance 1/4 (``REACH``).

* Pivots: shingles are put in one global order (by hash, those in many prefixes last), and
  two linked points share a shingle of their prefixes in that order. Of all points with a
  prefix shingle, the one of smallest random priority is its pivot.
* Regions: a point belongs to the region of every pivot that its prefix shingles have, so
  any two linked points meet in a region. Points of a group of near copies share pivots,
  and a point is in few regions. Distances to pivots are measured exactly, or bounded from
  below by parity masks (each shingle that only one set has changes one bit at most).
  Points in reach of their pivot are linked through it and needn't be compared.
* Recursion: a large region chooses several pivots among the points that aren't connected
  with its own. Each point goes to the Voronoi cell of its nearest pivot, and boundary
  points also to every cell whose pivot is no more than twice the reach further away:
  by the triangle inequality, linked points then meet in a cell. Cells are divided again
  as long as that makes less to compare.
* In a small cell, points of different components are compared unless sizes, the
  triangle-inequality window of their distances to the pivot, or the masks prove them
  apart. The points, not the pairs, that no proof keeps apart go on with their whole sets,
  which one task measures against each other; what it has connected it needn't measure.

A pair is left out only by a proof or because its points are connected already. Shingles are
64-bit hashes; sets count as equal if their size and two sums of differently mixed hashes
agree (of a single shingle: two hashes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, dedup, kernels as K
from .common import stage, unstage

#: A shingle in more prefixes than this goes last in the global order.
CROWD = 64
#: Crowded shingles that are broadcast at most (8 bytes each); beyond that only the most crowded go last, which costs time, not links.
MOST_CROWDED = 2_000_000
PASSES = 2
NUM, DEN = 3, 4  # similarity of at least 75 / 100
REACH = 0.25
_EPS = 1e-9
_LAST = np.uint64(1 << 62)
_OTHER = np.uint64(0x5851F42D4C957F2D)
#: Bits of a parity mask: four a shingle, as a power of two within these bounds. Masks of longer sets prove less.
MASK_BITS = (256, 1 << 16)
#: Pairs to look at in a region from which on it is divided, pivots it is divided by, and points of a side that one task compares.
LARGE = 250_000
FAN = 8
SIDE = 2048
#: Shingles of a side that one task measures, about: 16 MB.
SHINGLES = 1 << 21
#: Pairs that numpy looks at together.
BLOCK = 1 << 18
#: What tells a task of compared points, and the columns of a point.
KEYS = ["cell", "i", "j"]
POINT = ["node", "n", "lo", "hi", "label"]
POINT_TYPES = "node long, n long, lo double, hi double, label long"


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))


def prefix_length(n: int) -> int:
    """Shingles, first in the global order, of which a set of n shares one with every set of similarity 3/4 or more."""
    return n - (NUM * n + DEN - 1) // DEN + 1 if n else 0


def _ranked(h: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """The place of each shingle in the global order, ascending. (Equal places of different shingles only make regions larger.)"""
    rank = h >> np.uint64(2)
    if len(crowded):
        at = np.minimum(np.searchsorted(crowded, rank), len(crowded) - 1)
        rank = np.where(crowded[at] == rank, rank | _LAST, rank)
    return np.sort(rank)


def _mask(h: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of the shingles has the low bits b."""
    bits = min(MASK_BITS[1], max(MASK_BITS[0], 1 << (4 * len(h) - 1).bit_length())) if len(h) else MASK_BITS[0]
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(mask: np.ndarray, words: int) -> np.ndarray:
    """A mask (or rows of masks) of fewer words: that of the same set with fewer low bits."""
    while mask.shape[-1] > words:
        half = mask.shape[-1] // 2
        mask = mask[..., :half] ^ mask[..., half:]
    return mask


def prefixes(docs: DataFrame, crowded: np.ndarray, n_words: int) -> DataFrame:
    """id, n (set size), a, b (128 bits of the set), mask, prefix."""
    held = docs.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = held.value
        for batch in batches:
            for part in common.text_slices(batch):
                h, _, first = K.shingles(*common.spaced(part.column("text")), n_words)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(x), dtype=np.uint64)]) for x in (h, h ^ _OTHER)]
                a, b = (x[first[1:]] - x[first[:-1]] for x in sums)
                if len(alone := np.flatnonzero(np.diff(first) == 1)):  # one shingle: 64 bits of a second hash
                    b[alone] = K.shingles(*common.spaced(part.column("text").take(pa.array(alone))), n_words, seed=1)[0]
                sets = [h[lo:hi] for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
                cut = [_ranked(x, crowd)[: prefix_length(len(x))] for x in sets]
                off = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array((np.concatenate(cut) if cut else np.empty(0, np.uint64)).view(np.int64)))
                longs = [np.diff(first).astype(np.int64), a.view(np.int64), b.view(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, longs), pa.array(map(_mask, sets), pa.binary()), lists], ["id", "n", "a", "b", "mask", "prefix"])

    return docs.mapInArrow(common.trimmed(run), "id long, n long, a long, b long, mask binary, prefix array<long>")


def _representatives(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per distinct set. Rows whose set has no copy pass straight through; a Bloom table tells most of them."""
    many = classes.where("copies > 1").select("n", "a", "b", "rep")
    bits = dedup.bloom_bits(many.count())
    seen = dedup.might_contain(rows.where("n > 0 and id is not null"), F.col("a"), dedup.bloom(many, F.col("a"), bits), bits, "__maybe")
    straight = seen.where("not __maybe").drop("__maybe")
    # only a representative's own row matches, so copies don't meet
    firsts = classes.select("n", "a", "b", F.col("rep").alias("id"))
    checked = seen.where("__maybe").drop("__maybe").join(firsts, ["id", "n", "a", "b"], "left_semi").dropDuplicates(["id", "a", "b"])
    return straight.unionByName(checked.select(*straight.columns))


def _postings(points: DataFrame, shared: np.ndarray) -> DataFrame:
    """(h, node) of the prefix shingles that may be in several prefixes."""
    held = points.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("prefix")
            h = lists.flatten().to_numpy()
            node = np.repeat(b.column("id").to_numpy(), np.diff(lists.offsets.to_numpy()))
            hit = common.in_bitset(held.value, h)
            yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(node[hit])], ["h", "node"])

    return points.select("id", "prefix").mapInArrow(common.trimmed(run), "h long, node long")


def _bounds(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """pairs (pivot, node) with n (the node's), lo (their distance at least), texts (how many pairs of sets their ids stand for) and maybe (whether they may be linked)."""
    one = info.select("node", "n", "mask")
    two = info.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("mask").alias("other"))
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("c"))
    both = common.hot_join(pairs.join(one, "node"), two.join(sizes, "pivot"), ["pivot"], F.col("c") * common.HOT_PART > max(pairs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("n").to_numpy() + b.column("m").to_numpy()
            low = np.minimum(b.column("n").to_numpy(), b.column("m").to_numpy())
            differ = total - 2 * low
            for i, (x, y) in enumerate(zip(b.column("mask"), b.column("other"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                words = min(len(x), len(y))
                differ[i] = max(differ[i], int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()))
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("node"), b.column("n"), pa.array(2 * differ / (total + differ)), pa.array(_may_link(total, differ))], ["pivot", "node", "n", "lo", "maybe"])

    found = both.mapInArrow(common.trimmed(run), "pivot long, node long, n long, lo double, maybe boolean")
    return found.groupBy("pivot", "node").agg(F.min("lo").alias("lo"), F.max("maybe").alias("maybe"), F.count("*").alias("texts"))


def _may_link(total: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of so many shingles in all, of which so many at least are in one set only, may be linked."""
    return DEN * (total - differ) >= NUM * (total + differ)


def _sets(docs: DataFrame, nodes: DataFrame, n_words: int) -> DataFrame:
    """(node, set) of the given nodes, from their texts; most others are turned away by a bitset before they are read."""
    held = docs.sparkSession.sparkContext.broadcast(common.bitset(nodes.select(F.xxhash64("node").alias("k")), nodes.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(common.in_bitset(held.value, batch.column("k").to_numpy())))
            for part in common.text_slices(batch):
                h, _, first = K.shingles(*common.spaced(part.column("text")), n_words)
                data = [h[lo:hi].tobytes() for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(data, pa.binary())], ["node", "set"])

    return docs.withColumn("k", F.xxhash64("id")).mapInArrow(common.trimmed(run), "node long, set binary").join(nodes, "node", "left_semi").distinct()


def _measure(pairs: DataFrame, docs: DataFrame, n_words: int) -> DataFrame:
    """pairs (pivot, node) with common and total, the sizes of their sets' intersection and union; of ids with several texts the nearest."""
    nodes = stage(pairs.select(F.explode(F.array("pivot", "node")).alias("node")).distinct(), "jaccard-nodes")
    sets = stage(_sets(docs, nodes, n_words), "jaccard-sets")
    one = sets.select("node", F.col("set").alias("sx"))
    two = sets.select(F.col("node").alias("pivot"), F.col("set").alias("sy"))
    both = pairs.select("pivot", "node").join(one, "node").join(two, "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common_, total = [], []
            for p, q in zip(batch.column("sx"), batch.column("sy")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                n = len(np.intersect1d(p, q, assume_unique=True))
                common_.append(n)
                total.append(len(p) + len(q) - n)
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("node"), pa.array(common_, pa.int64()), pa.array(total, pa.int64())], ["pivot", "node", "common", "total"])

    done = both.mapInArrow(common.trimmed(run), "pivot long, node long, common long, total long")
    best = done.groupBy("pivot", "node").agg(F.max(F.struct((F.col("common") / F.col("total")).alias("j"), "common", "total")).alias("m"))
    out = stage(best.select("pivot", "node", "m.common", "m.total"), "jaccard-measured")
    unstage(nodes, sets)
    return out


def _links(measured: DataFrame) -> DataFrame:
    return measured.where(F.col("common") * DEN >= F.col("total") * NUM).select(F.col("pivot").alias("x"), F.col("node").alias("y"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (x, y): the smallest node it is connected with. A staged table.

    Labels spread along links and through labels' own labels until nothing changes; each round is a staged table.
    """
    edges = stage(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    nodes = edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).withColumnRenamed("x", "node")
    labels = stage(nodes, "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stage(step.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        changed = new.where("old != label").limit(1).count()
        unstage(labels)
        labels = new
        if not changed:
            unstage(edges)
            out = new.select("node", "label")
            out.staged_path = new.staged_path
            return out


class _Known:
    """What has been found so far: links and labels, as staged tables."""

    def __init__(self, docs: DataFrame, info: DataFrame, links: DataFrame, n_words: int):
        self.docs, self.info, self.n_words, self.links = docs, info, n_words, links
        self.labels = None

    def look(self, pairs: DataFrame) -> DataFrame:
        """pairs (pivot, node) with lo and hi, between which their distance is. Those that may be linked are measured; labels are brought up to date."""
        bounds = stage(_bounds(pairs, self.info), "jaccard-bounds")
        new = _measure(bounds.where("maybe"), self.docs, self.n_words)
        self.take(_links(new))
        exact = new.select("pivot", "node", (1 - F.col("common") / F.col("total")).alias("d"))
        # an id that several texts have stands for several points, to which no distance holds
        one = F.col("texts") == 1
        out = bounds.join(exact, ["pivot", "node"], "left").select("pivot", "node", F.when(one, F.coalesce("d", "lo")).otherwise(0.0).alias("lo"), F.when(one & F.col("d").isNotNull(), F.col("d")).otherwise(1.0).alias("hi"))
        out = stage(out, "jaccard-distances")
        unstage(bounds)
        return out

    def take(self, new: DataFrame) -> None:
        grew = new.limit(1).count()
        self.links = self.links.unionByName(new)
        if grew or self.labels is None:
            if self.labels is not None:
                unstage(self.labels)
            self.labels = components(self.links)

    def weighed(self, cells: DataFrame) -> DataFrame:
        """cells (cell, pivot, node, lo, hi) with label, own (the label of the cell's pivot), and of the cell points, others (those of
        other labels) and work (pairs to look at). Cells without work are left out. A staged table."""
        rows = stage(cells.where("node != pivot").join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "jaccard-tagged")
        most = max(rows.count(), 1)
        # counts by label tell how many others there are, without a join of the rows
        counts = rows.groupBy("cell", "pivot", "label").agg(F.count("*").alias("c"))
        counts = counts.join(self.labels.select(F.col("node").alias("pivot"), F.col("label").alias("own")), "pivot", "left").withColumn("own", F.coalesce("own", "pivot"))
        sizes = counts.groupBy("cell", "own").agg(F.sum("c").alias("points"), F.sum(F.when(F.col("label") != F.col("own"), F.col("c")).otherwise(0)).alias("others"))
        sizes = stage(sizes.where("points > 1 and others > 0").withColumn("work", F.col("points") * F.col("others")), "jaccard-sizes")
        out = stage(common.hot_join(rows, sizes, ["cell"], F.col("points") * common.HOT_PART > most), "jaccard-weighed")
        unstage(rows, sizes)
        return out


def _work(cells: DataFrame) -> int:
    return cells.groupBy("cell").agg(F.first("work").alias("work")).agg(F.coalesce(F.sum("work"), F.lit(0)).cast("long")).head()[0]


def _divide(known: _Known, cells: DataFrame) -> DataFrame:
    """Voronoi cells (cell, pivot, node, lo, hi) of the points of each cell (cell, node, label, own) around pivots that its own pivot isn't connected with, with boundary points in several."""
    others = cells.where("label != own").groupBy("cell", F.pmod(F.xxhash64("label"), F.lit(FAN)).alias("turn")).agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("pivot"))
    pivots = others.select("cell", "pivot").distinct()
    pairs = stage(cells.select("cell", "node").join(pivots, "cell"), "jaccard-divided")
    far = known.look(pairs.where("pivot != node").select("pivot", "node").distinct())
    near = pairs.join(far, ["pivot", "node"], "left").withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.when(F.col("pivot") == F.col("node"), 0.0).otherwise(F.col("hi"))})
    home = near.groupBy("cell", "node").agg(F.min("hi").alias("home"), F.collect_list(F.struct("pivot", "lo", "hi")).alias("at"))  # FAN pivots at most
    spread = home.select("cell", "node", "home", F.explode("at").alias("p")).where(F.col("p.lo") <= F.col("home") + 2 * REACH + _EPS)
    out = stage(spread.select(F.xxhash64("cell", "p.pivot").alias("cell"), "p.pivot", "node", "p.lo", "p.hi"), "jaccard-cells")
    unstage(pairs, far)
    return out


def _dealt(rows: DataFrame, value: list[str]) -> DataFrame:
    """rows (cell, other, o, t, *value) as (cell, i, j, asks, other, *value), in tasks (cell, i, j), sorted: the others of a cell, in o parts, meet all its points, in t parts."""
    own = {s: F.pmod(F.xxhash64("node", F.lit(s)), F.col(s)).cast("int") for s in "ot"}
    all_ = {s: F.explode(F.sequence(F.lit(0), F.col(s) - 1)) for s in "ot"}
    left = rows.where("other").withColumn("i", own["o"]).withColumn("j", all_["t"])
    right = rows.withColumn("j", own["t"]).withColumn("i", all_["o"])
    both = [x.select(*KEYS, F.lit(asks).alias("asks"), "other", *value) for x, asks in ((left, True), (right, False))]
    return both[0].unionByName(both[1]).repartition(*KEYS).sortWithinPartitions(*KEYS)


def _by_task(run: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """``run`` for each task (cell, i, j) of sorted rows."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []  # one task's points of a cell at most, and one batch

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if waiting:
                t = pa.concat_tables([*waiting, t])
            k = [t.column(c).to_numpy() for c in KEYS]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in k])) + 1
            edges = [0, *cuts.tolist()]
            for lo, hi in zip(edges, edges[1:]):
                yield run(t.slice(lo, hi - lo))
            waiting = [t.slice(edges[-1])]
        if waiting:
            yield run(waiting[0])

    return common.trimmed(whole)


def _fitting(t: pa.Table, masks: list[np.ndarray], label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a task's rows, of labels that differ, that no proof keeps apart, and how many shingles at least are in one set only. Labels are read anew for every block."""
    asks, other, node, n, lo, hi = (t.column(c).to_numpy() for c in ("asks", "other", "node", "n", "lo", "hi"))
    words = np.array([len(m) for m in masks])
    tables = {}  # per width the masks that have it or, folded, twice of it: sets of sizes that fit have no others
    for w in np.unique(words).tolist():
        own = np.flatnonzero((words == w) | (words == 2 * w))
        place = np.zeros(len(node), np.int64)
        place[own] = np.arange(len(own))
        tables[w] = np.stack([_folded(masks[k], w) for k in own.tolist()]), place
    at, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
    block = max(1, BLOCK // max(len(at), 1))
    for p in range(0, len(ask), block):
        i = ask[p : p + block, None]
        # two others meet twice in a cell, each asking once: the smaller one's turn counts
        fits = (label[at] != label[i]) & (~other[at] | (node[at] > node[i])) & (DEN * np.minimum(n[at], n[i]) >= NUM * np.maximum(n[at], n[i]))
        fits &= (lo[at] <= hi[i] + REACH + _EPS) & (lo[i] <= hi[at] + REACH + _EPS)
        x, y = np.nonzero(fits)
        x, y = ask[p + x], at[y]
        width = np.minimum(words[x], words[y])
        found = [(np.empty(0, np.int64),) * 3]
        for w in np.unique(width).tolist():
            table, place = tables[w]
            u, v = x[width == w], y[width == w]
            for k in range(0, len(u), SIDE):
                c, d = u[k : k + SIDE], v[k : k + SIDE]
                differ = np.bitwise_count(table[place[c]] ^ table[place[d]]).sum(axis=1, dtype=np.int64)
                good = _may_link(n[c] + n[d], differ)
                found.append((c[good], d[good], differ[good]))
        yield tuple(np.concatenate(c) for c in zip(*found))


def _compare(cells: DataFrame, info: DataFrame) -> DataFrame:
    """The points (cell, other, node, n, lo, hi, label) that no proof keeps apart from every point of another component in their cell: a row a point, however many they are near to.

    cells: cell, node, lo, hi, label, own, points, others. Tasks have SIDE points of either side.
    """
    sides = {s: F.ceil(F.col(c) / SIDE).cast("int") for s, c in (("o", "others"), ("t", "points"))}
    rows = cells.join(info.select("node", "n", "mask"), "node").withColumns(sides | {"other": F.col("label") != F.col("own")})
    kept = ["cell", "other", *POINT]

    def run(t: pa.Table) -> pa.RecordBatch:
        masks = [np.frombuffer(m.as_buffer(), np.uint64) for m in t.column("mask").combine_chunks()]
        near = np.zeros(len(masks), bool)
        for x, y, _ in _fitting(t, masks, t.column("label").to_numpy()):
            near[x] = near[y] = True
        return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[near]) for c in kept], kept)

    return _dealt(rows, [*POINT, "mask"]).mapInArrow(_by_task(run), f"cell long, other boolean, {POINT_TYPES}").dropDuplicates(["cell", "node", "n"])


def _connect(near: DataFrame, docs: DataFrame, n_words: int) -> DataFrame:
    """Labels (x, y) that links between the points of ``near`` (as _compare gives them) connect, a row a label and task at most. A staged table.

    A task measures whole sets, the likeliest pairs first, and pairs that it has connected already not at all.
    """
    nodes = stage(near.select("node").distinct(), "jaccard-nodes")
    sets = stage(_sets(docs, nodes, n_words), "jaccard-sets")

    def parts(s: str, mine: Column) -> Column:
        return F.ceil(F.greatest(F.sum(mine.cast("int")) / SIDE, F.sum(F.when(mine, F.col("n")).otherwise(0)) / SHINGLES)).cast("int").alias(s)

    sizes = near.groupBy("cell").agg(parts("o", F.col("other")), parts("t", F.lit(True)), F.count("*").alias("c"))
    sizes = stage(sizes, "jaccard-sizes")
    rows = common.hot_join(near, sizes, ["cell"], F.col("c") * common.HOT_PART > max(near.count(), 1))
    rows = rows.join(sets, "node").where(F.octet_length("set") == 8 * F.col("n"))  # ids may have several texts

    def run(t: pa.Table) -> pa.RecordBatch:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set").combine_chunks()]
        n = np.array([len(x) for x in sets])
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(codes, np.cumsum(n)[:-1])
        marks = np.zeros(len(names), bool)
        first = t.column("label").to_numpy()
        label = first.copy()
        for x, y, differ in _fitting(t, [np.frombuffer(_mask(s), np.uint64) for s in sets], label):
            best = np.argsort(differ / (n[x] + n[y]), kind="stable")
            for k in range(0, len(best), SIDE):
                part = best[k : k + SIDE]
                part = part[label[x[part]] != label[y[part]]]
                for p, q in zip(x[part].tolist(), y[part].tolist()):
                    if label[p] == label[q]:
                        continue
                    marks[codes[p]] = True
                    both = int(np.count_nonzero(marks[codes[q]]))
                    marks[codes[p]] = False
                    if DEN * both >= NUM * (int(n[p] + n[q]) - both):
                        low, high = sorted((label[p], label[q]))
                        label[label == high] = low
        pairs = np.unique(np.stack([label, first])[:, label != first], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])

    links = stage(_dealt(rows, [*POINT, "set"]).mapInArrow(_by_task(run), "x long, y long"), "jaccard-connected")
    unstage(nodes, sets, sizes)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, crowd: int = CROWD, large: int = LARGE) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id it is connected with by links of similarity 3/4 or more).

    Null and word-free texts have no shingles and are linked with nothing; fewer than
    ``n_words`` words are one shingle. A null id takes no part and has a null component.
    Rows repeated with one id count as one document, linked by any of its texts. An empty
    table gives no rows. Other columns aren't read.
    """
    own = _own(docs, id_col, text_col)
    taking = own.where("id is not null")
    crowded, rows, points = np.empty(0, np.uint64), None, None
    for k in range(PASSES):
        if rows is not None:
            unstage(rows)
        rows = stage(prefixes(own, crowded, n_words), "jaccard-prefixes")
        if k == 0:
            classes = stage(rows.where("n > 0 and id is not null").groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "jaccard-classes")
        points = _representatives(rows, classes)
        lists = stage(points.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-lists")
        if k == PASSES - 1:
            break
        found = lists.where((F.col("c") > crowd) & (F.col("h") < int(_LAST))).orderBy(F.desc("c"), "h").limit(MOST_CROWDED - len(crowded)).select("h").toArrow()
        if not found.num_rows:
            break
        unstage(lists)
        crowded = np.sort(np.concatenate([crowded, found.column("h").to_numpy().astype(np.uint64)]))
    total = rows.count()
    posted = stage(_postings(points, common.bitset(lists.select("h"), lists.count())), "jaccard-postings")
    pivots = posted.groupBy("h").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("pivot")).where("c > 1")
    pivots = stage(pivots, "jaccard-pivots")
    regions = common.hot_join(posted, pivots, ["h"], F.col("c") * common.HOT_PART > max(total, 1)).where("node != pivot").select("pivot", "node").distinct()
    regions = stage(regions, "jaccard-regions")
    info = stage(points.select(F.col("id").alias("node"), "n", "mask"), "jaccard-masks")
    sized = stage(rows.select("id", "n", "a", "b"), "jaccard-sizes")
    unstage(rows, lists, posted, pivots)

    known = _Known(taking, info, _of_one_id(sized, classes), n_words)
    level = known.weighed(known.look(regions).withColumn("cell", F.col("pivot")))
    unstage(regions)
    final, levels = [], []
    while True:
        levels.append(level)
        big = level.where(F.col("work") > large)
        before = _work(big)
        if not before:
            final.append(level)
            break
        parts = known.weighed(_divide(known, big))
        levels.append(parts)
        if _work(parts) > 0.7 * before:  # cells that dividing doesn't make less work of stay whole
            final.append(level)
            break
        final.append(level.where(F.col("work") <= large))
        level = parts
    cells = final[0]
    for f in final[1:]:
        cells = cells.unionByName(f)
    # what dividing has linked needs no comparison
    if len(levels) > 1:
        cells = known.weighed(cells.select("cell", "pivot", "node", "lo", "hi"))
        levels.append(cells)
    near = stage(_compare(cells, info), "jaccard-near")
    known.take(_connect(near, taking, n_words))
    unstage(near, info, *levels)

    named = classes.join(known.labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "a", "b", "copies", F.coalesce("label", "rep").alias("component"))
    # documents without shingles, which are alike but not linked, don't meet
    plain = sized.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    linked = common.hot_join(sized.where("n > 0 and id is not null"), named, ["n", "a", "b"], F.col("copies") * common.HOT_PART > max(total, 1))
    return plain.unionByName(linked.select("id", "n", "component")).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _of_one_id(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (x, y) between the representatives of the texts of one id."""
    rows = sized.where("n > 0 and id is not null")
    several = rows.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    reps = rows.join(several, "id", "left_semi").distinct().join(classes, ["n", "a", "b"]).select("id", "rep")
    return reps.join(reps.groupBy("id").agg(F.min("rep").alias("x")), "id").select("x", F.col("rep").alias("y"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, every column, with one document (the smallest id) of each component. Rows with a null id stay."""
    found = stage(join(docs, id_col, text_col), "jaccard-found")
    return dedup.without(docs, found.where(F.col(f"`{id_col}`") != F.col("component_id")).select(F.col(f"`{id_col}`")), id_col)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
g AS (SELECT doc_id, len(sh)::BIGINT AS n, list_sort(sh) AS sh FROM s),
c AS (SELECT sh, any_value(n) AS n, min(doc_id) AS rep FROM g WHERE n > 0 GROUP BY sh),
p AS (SELECT rep, n, unnest(sh) AS x FROM c),
f AS (SELECT x FROM p GROUP BY x HAVING count(*) >= 2),
q AS (SELECT p.* FROM p JOIN f USING (x)),
i AS (SELECT a.rep AS r1, b.rep AS r2, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS k
      FROM q a JOIN q b ON a.x = b.x AND a.rep < b.rep AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT r1, r2 FROM i WHERE 100 * k >= 75 * (n1 + n2 - k)),
e AS (SELECT r1, r2 FROM l UNION ALL SELECT r2, r1 FROM l),
reach AS (SELECT rep AS node, rep AS low FROM c UNION SELECT e.r2, reach.low FROM reach JOIN e ON e.r1 = reach.node WHERE reach.low < e.r2),
m AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT g.doc_id, g.n AS n_shingles, coalesce(m.low, g.doc_id) AS component_id
FROM g LEFT JOIN c ON g.sh = c.sh AND g.n > 0 LEFT JOIN m ON m.node = c.rep
"""
