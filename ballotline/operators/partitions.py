"""Partitions, bounding boxes and the tree of leaves over references.

Any tree gives exact searches; balance only decides how much is pruned. So the upper
splits come from a sample of at most ``SAMPLE_ROWS`` references, chosen by the hashes of their ids
(all of them, if there are no more), in which the driver halves the widest dimension of each node.
The references follow these splits by broadcast joins, a level at a time, in one pass.

Leaves still too large are split on, level by level for all of them at once: a pass with
partial aggregates for their boxes and one for the median of the widest dimension. A node
splits at a value, never between equal ones, and both sides get rows; rows alike in
all dimensions are split by a hash of their id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DIMS, LEAF_LIMITS, LEAF_SIZE, VECTOR
from ..functions.vectors import widest_dim
from .tables import Written, sized

#: Most rows of a split or box table that is broadcast (about 250 bytes each).
BROADCAST_ROWS = 50_000
MAX_LEVELS = 48
#: References from which the driver derives the upper splits: 15 numbers each.
SAMPLE_ROWS = 250_000


def boxes(rows: DataFrame, *keys: str) -> DataFrame:
    """Bounding box lo0.., hi0.. and number of rows n of each group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(v).alias(f"lo{i}") for i, v in enumerate(VECTOR)], *[F.max(v).alias(f"hi{i}") for i, v in enumerate(VECTOR)])


def histogram(rows: DataFrame, key: str = "part_key") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("label").alias("fraud"))


def _value(dim: Column) -> Column:
    """The value in a dimension given by a column."""
    out = F.lit(None).cast("int")
    for i, v in enumerate(VECTOR):
        out = F.when(dim == i, F.col(v)).otherwise(out)
    return out


def median_split(rows: DataFrame, key: str = "part_key", tie: str = "ref_id") -> DataFrame:
    """Adds ``side``: 0 for the first n div 2 rows of each group by its widest dimension, 1 for the others; ties by id."""
    box = Written(boxes(rows, key).select(key, "n", widest_dim().alias("dim")), "widest").df
    held = rows.join(sized(box, BROADCAST_ROWS), key).withColumn("__x", _value(F.col("dim")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__x", tie))
    return held.withColumn("side", F.when(rank <= F.floor(F.col("n") / 2), 0).otherwise(1)).drop("__x", "n")


def _splits(sample: np.ndarray, least: int) -> list[list[tuple[int, int, int, int]]]:
    """By level, (part_key, leaf_id, dim, cut): nodes of more than ``least`` sampled rows (part_key, v0..) halve their widest dimension."""
    levels, now = [], []
    order = np.argsort(sample[:, 0], kind="stable")
    rows = sample[order]
    for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []:
        now.append((int(part[0, 0]), 1, part[:, 1:]))
    while now:
        level, below = [], []
        for key, leaf, v in now:
            if len(v) <= least:
                continue
            lo, hi = v.min(0), v.max(0)
            dim = int((hi - lo).argmax())
            if lo[dim] == hi[dim]:
                continue
            x = v[:, dim]
            cut = min(int(np.partition(x, len(x) // 2)[len(x) // 2]), int(hi[dim]) - 1)
            level.append((key, leaf, dim, cut))
            below += [(key, leaf * 2, v[x <= cut]), (key, leaf * 2 + 1, v[x > cut])]
        if level:
            levels.append(level)
        now = below
    return levels


def _follow(at: DataFrame, cuts: DataFrame, tie: str) -> DataFrame:
    """One level down: ``cuts`` has (part_key, leaf_id, dim, cut, alike)."""
    right = F.when(F.col("alike"), F.pmod(F.xxhash64(tie, "leaf_id"), F.lit(2))).when(_value(F.col("dim")) > F.col("cut"), 1).otherwise(0)
    step = F.when(F.col("dim").isNull(), F.col("leaf_id")).otherwise(F.col("leaf_id") * 2 + right)
    return at.join(cuts, ["part_key", "leaf_id"], "left").withColumn("leaf_id", step).drop("dim", "cut", "alike")


def with_leaves(refs: DataFrame, leaf_size: int = LEAF_SIZE, tie: str = "ref_id") -> tuple[DataFrame, DataFrame]:
    """``refs`` with ``leaf_id``, the path of splits inside its partition (1 for the root, then a bit for each), and the leaves' boxes."""
    spark, leaf_size = refs.sparkSession, min(max(leaf_size, LEAF_LIMITS[0]), LEAF_LIMITS[1])
    every = max(1, -(-refs.count() // SAMPLE_ROWS))
    picked = refs.where(F.pmod(F.xxhash64(tie), F.lit(every)) == 0).select("part_key", *VECTOR)
    found = picked.limit(2 * SAMPLE_ROWS).toArrow()
    sample = np.stack([found.column(c).to_numpy() for c in found.column_names], 1).astype(np.int64)
    at = refs.withColumn("leaf_id", F.lit(1).cast("long"))
    for level in _splits(sample, max(leaf_size // every, 8) if every > 1 else leaf_size):
        cuts = spark.createDataFrame(level, "part_key int, leaf_id long, dim int, cut int").withColumn("alike", F.lit(False))
        at = _follow(at, F.broadcast(cuts) if len(level) <= BROADCAST_ROWS else cuts.hint("merge"), tie)
    at = Written(at, "leaves").df
    held = Written(boxes(at, "part_key", "leaf_id"), "leaf-boxes").df
    for _ in range(MAX_LEVELS):
        large = held.where(F.col("n") > leaf_size)
        if large.isEmpty():
            break
        pick = lambda side: F.coalesce(*[F.when(F.col("dim") == i, F.col(f"{side}{i}")) for i in range(DIMS)])
        dims = Written(large.withColumn("dim", widest_dim()).select("part_key", "leaf_id", "dim", pick("lo").alias("lo"), pick("hi").alias("hi")), "dims").df
        met = at.join(sized(dims, BROADCAST_ROWS), ["part_key", "leaf_id"])
        middle = met.groupBy("part_key", "leaf_id").agg(F.percentile_approx(_value(F.col("dim")), 0.5, F.lit(1000)).alias("mid"), F.first("dim").alias("dim"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        # below the largest value, so that both sides have rows; alike in all dimensions: a hash decides
        cuts = Written(middle.select("part_key", "leaf_id", "dim", F.least("mid", F.col("hi") - 1).alias("cut"), (F.col("lo") == F.col("hi")).alias("alike")), "cuts").df
        at = _follow(at, sized(cuts, BROADCAST_ROWS), tie)
        held = Written(boxes(at, "part_key", "leaf_id"), "leaf-boxes").df
    return at, held


def counts(refs: DataFrame, leaf_boxes: DataFrame, part_boxes: DataFrame) -> dict[str, int]:
    """How many references, leaves and partitions an index has."""
    return {"references": refs.count(), "leaves": leaf_boxes.count(), "partitions": part_boxes.count()}
