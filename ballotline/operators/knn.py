"""Exact nearest-neighbour joins: for each query its k nearest references by (squared distance, ref_id).

``brute`` compares every query with every reference; it is the check. ``nearest`` does so while the pairs
are few, and else builds an index and searches that. ``pruned`` does what the index is for, in joins and
aggregates:

1. Every query goes down the tree of its own partition (of the nearest one if it has none), at
   each step into the nearest box, to one leaf. Its k-th distance there bounds the search.
2. Boxes of partitions, at most 256 and broadcast, that may hold something as near are kept, then of
   those the boxes of nodes four levels further down, and so on to the leaves. A box stays while its lower bound is <= the k-th distance: with < a tie with a
   smaller id would be lost.
3. The remaining leaves join the references on (part_key, leaf_id); the nearest k of all win.

Pairs grow with queries times leaves that survive, not with the references. Fewer than k
references in the first leaf leave the search unbounded, which is slow but right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DIMS, EARLY_STOP, NEIGHBOURS, VECTOR
from ..functions.vectors import lower_bound, partition_key, squared_distance
from .partitions import BROADCAST_ROWS, boxes, with_leaves
from .tables import Written, sized

_FAR = 1 << 62
BUCKETS = 64
#: References that bound the distances of ``brute``, about.
SAMPLE = 2048
#: Most pairs of query and reference that ``nearest`` compares one by one; sf0.1 has half as many.
PAIRS = 1_000_000_000
#: References for each core below which they are dealt out anew: few bytes come in few partitions, but pairs are work.
SPREAD_ROWS = 100_000
#: Most pairs of query and leaf that are broadcast (about 150 bytes each).
WANTED_ROWS = 250_000
#: Most leaves whose ids are a filter of the references' scan.
LEAF_FILTER = 1000
#: Levels of splits that a step of a search goes down: 16 boxes below each.
FAN = 4
_BOX = [f"{side}{i}" for side in ("lo", "hi") for i in range(DIMS)]


def _renamed(refs: DataFrame, *keep: str) -> DataFrame:
    return refs.select("ref_id", "label", *keep, *[F.col(v).alias(f"r_{v}") for v in VECTOR])


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Rows (qid, ref_id, label, d2) with rank 1 to k of each query."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "ref_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def brute(queries: DataFrame, refs: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(qid, rank, ref_id, label, d2), the stated queries compared with all references. A check; ``pruned`` gives the same.

    Queries go in broadcast blocks of at most BROADCAST_ROWS. Pairs are never sorted or shuffled: about ``SAMPLE`` references, chosen by
    the hashes of their ids, bound each query's k-th distance (by minima of ``BUCKETS`` buckets), and only pairs within the bound leave the join.
    Null components give no distance, so that such rows are no neighbours; a qid that occurs twice counts as one query.
    """
    q = Written(queries.select("qid", *VECTOR).dropDuplicates(["qid"]), "queries").df
    n, blocks = refs.count(), max(1, -(-q.count() // BROADCAST_ROWS))
    r = _spread(_renamed(refs), n)
    some = r.where(F.pmod(F.xxhash64("ref_id"), F.lit(max(1, n // SAMPLE))) == 0)
    out = None
    for block in range(blocks):
        mine = q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        least = some.crossJoin(F.broadcast(mine)).groupBy("qid", F.pmod(F.xxhash64(F.lit(1), "ref_id"), F.lit(BUCKETS)).alias("bucket")).agg(F.min(squared_distance()).alias("least"))
        ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("least")))
        kth = ranked.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("least"))).alias("kth"))
        bounded = Written(mine.join(kth, "qid", "left").withColumn("bound", F.coalesce("kth", F.lit(_FAR))), "bounds").df
        near = r.join(F.broadcast(bounded), squared_distance() <= F.col("bound")).select("qid", "ref_id", "label", squared_distance().alias("d2"))
        out = near if out is None else out.union(near)
    return _nearest(out, k).select("qid", "rank", "ref_id", "label", "d2")


def _spread(refs: DataFrame, rows: int) -> DataFrame:
    cores = refs.sparkSession.sparkContext.defaultParallelism
    return refs.repartition(cores) if rows < cores * SPREAD_ROWS else refs


class Index:
    """References with part_key and leaf_id, and the boxes of partitions and leaves."""

    def __init__(self, refs: DataFrame, leaf_boxes: DataFrame | None = None, part_boxes: DataFrame | None = None) -> None:
        self.refs = refs
        self.leaves = leaf_boxes if leaf_boxes is not None else Written(boxes(refs, "part_key", "leaf_id"), "leaf-boxes").df
        self.parts = part_boxes if part_boxes is not None else Written(boxes(self._corners(), "part_key"), "part-boxes").df
        # boxes of the tree's nodes, FAN levels of splits at a time, so that a search never looks at all leaves of a partition
        node = lambda t: F.expr(f"shiftright(leaf_id, greatest(length(bin(leaf_id)) - 1 - {FAN * t}, 0))")
        deepest, rows = self.leaves.agg(F.max(F.length(F.bin("leaf_id")) - 1), F.sum("n")).first()
        deepest, self.rows = deepest or 0, rows or 0
        self.steps = []
        for t in range(1, max(1, -(-deepest // FAN)) + 1):
            rows = self._corners("leaf_id").withColumn("up", node(t - 1)).withColumn("down", node(t))
            box = boxes(rows, "part_key", "up", "down").drop("n").withColumnRenamed("part_key", "target")
            self.steps.append(sized(Written(box, "node-boxes").df, BROADCAST_ROWS))

    def _corners(self, *keep: str) -> DataFrame:
        """Both corners of every leaf's box: the boxes of these are those of nodes and partitions, without reading references again."""
        lo = self.leaves.select("part_key", *keep, *[F.col(f"lo{i}").alias(f"v{i}") for i in range(DIMS)])
        return lo.union(self.leaves.select("part_key", *keep, *[F.col(f"hi{i}").alias(f"v{i}") for i in range(DIMS)]))

    def partitions(self) -> DataFrame:
        return self.parts.select(F.col("part_key").alias("target"), *_BOX)


def _first_leaf(queries: DataFrame, index: Index) -> DataFrame:
    """(qid, part_key, leaf_id): the leaf reached by taking the nearest box at each step, from the query's own partition if it exists."""
    # 256 partitions at most: a broadcast of bounded size, and as many rows a query before the minimum
    near = queries.join(F.broadcast(index.partitions())).select("qid", "part_key", "target", lower_bound().alias("lb"))
    mine = (F.col("target") != F.col("part_key")).alias("other")
    at = near.groupBy("qid").agg(F.min(F.struct(mine, "lb", "target")).alias("best")).select("qid", F.col("best.target").alias("target"), F.lit(1).cast("long").alias("up"))
    for step in index.steps:
        met = queries.drop("part_key").join(at, "qid").join(step, ["target", "up"]).select("qid", "target", "down", lower_bound().alias("lb"))
        at = met.groupBy("qid").agg(F.min(F.struct("lb", "target", "down")).alias("best")).select("qid", F.col("best.target").alias("target"), F.col("best.down").alias("up"))
    return at.select("qid", F.col("target").alias("part_key"), F.col("up").alias("leaf_id"))


def _scan(wanted: DataFrame, index: Index) -> DataFrame:
    """(qid, ref_id, label, d2) of the references in the leaves of (qid, part_key, leaf_id, v0.., bound), as near as the bound.

    References are read where they lie while the leaves wanted are few enough to be broadcast (counted); else both sides meet by leaf.
    """
    held = Written(wanted, "wanted").df
    # what is wanted is known: at most 256 partitions, whose files alone are opened, and if few, leaves, by which row groups are skipped
    refs = index.refs.where(F.col("part_key").isin([r[0] for r in held.select("part_key").distinct().collect()]))
    leaves = held.select("leaf_id").distinct().limit(LEAF_FILTER + 1).collect()
    if len(leaves) <= LEAF_FILTER:
        refs = refs.where(F.col("leaf_id").isin([r[0] for r in leaves]))
    pairs = _spread(_renamed(refs, "part_key", "leaf_id"), index.rows).join(sized(held, WANTED_ROWS), ["part_key", "leaf_id"])
    return pairs.select("qid", "ref_id", "label", squared_distance().alias("d2"), "bound").where("d2 <= bound").drop("bound")


def pruned(queries: DataFrame, index: Index, k: int = NEIGHBOURS, early_stop: bool = False) -> DataFrame:
    """(qid, rank, ref_id, label, d2), equal to ``brute``. Queries have (qid, v0.., part_key), qid unique, no component null.

    ``early_stop`` ends the search of a query after its first leaf if its k-th squared distance is
    at most EARLY_STOP. That is approximate: a nearer reference elsewhere may be missed.
    """
    q = queries.select("qid", "part_key", *VECTOR).repartition(queries.sparkSession.sparkContext.defaultParallelism)
    first = Written(_first_leaf(q, index), "first-leaf").df
    start = first.join(q.drop("part_key"), "qid").withColumn("bound", F.lit(_FAR))
    found = Written(_nearest(_scan(start, index), k), "first-found").df
    kth = found.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("d2"))).alias("kth"))
    open_ = q.join(first.select("qid", F.col("part_key").alias("seen_part"), F.col("leaf_id").alias("seen_leaf")), "qid").join(kth, "qid", "left").withColumn("bound", F.coalesce("kth", F.lit(_FAR)))
    if early_stop:
        open_ = open_.where(F.col("bound") > EARLY_STOP)
    keep = ["qid", *VECTOR, "bound", "seen_part", "seen_leaf"]
    # the joins' few bytes come in few partitions, but each row is compared with up to 256 boxes
    open_ = open_.repartition(queries.sparkSession.sparkContext.defaultParallelism)
    near = open_.join(F.broadcast(index.partitions()), lower_bound() <= F.col("bound")).select(*keep, "target", F.lit(1).cast("long").alias("up"))
    for step in index.steps:
        near = near.join(step, ["target", "up"]).where(lower_bound() <= F.col("bound")).select(*keep, "target", F.col("down").alias("up"))
    near = near.where((F.col("target") != F.col("seen_part")) | (F.col("up") != F.col("seen_leaf")))
    more = _scan(near.select("qid", *VECTOR, "bound", F.col("target").alias("part_key"), F.col("up").alias("leaf_id")), index)
    both = found.select("qid", "ref_id", "label", "d2").union(more)
    return _nearest(both, k).select("qid", "rank", "ref_id", "label", "d2")


def nearest(queries: DataFrame, refs: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(qid, rank, ref_id, label, d2), the rows of ``brute`` at any size: beyond PAIRS pairs by ``pruned`` over an index of ``refs`` made for it.

    As there, rows with null components are no neighbours and have none, and a qid that occurs twice counts as one query.
    """
    if queries.count() * refs.count() <= PAIRS:
        return brute(queries, refs, k)
    q = Written(queries.select("qid", *VECTOR).dropDuplicates(["qid"]).dropna(subset=VECTOR).withColumn("part_key", partition_key()), "queries").df
    whole = refs.select("ref_id", *VECTOR, "label").dropna(subset=VECTOR).withColumn("part_key", partition_key())
    return pruned(q, Index(*with_leaves(whole)), k)
