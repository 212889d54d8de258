"""Connected components by alternating large-star and small-star rounds.

Every round is an aggregation and a join on node ids; edges shrink to stars in
O(log^2 n) rounds. Partial aggregation keeps hubs cheap, and the joins have one
row per node on one side, so adaptive execution can split a hub's other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs (u, v), both directions for large stars, u > v for small ones."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = pairs.join(least, "u")
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node id of its component.

    Self loops, repeated edges and null ends are ignored; no edges give no rows.
    Raises if ``most`` rounds don't end it (each round at least halves long paths).
    """
    t = Table(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(),
        "edges",
    )
    mark = _mark(t.df)
    if not mark[0]:
        return t.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most):
        both = t.df.union(t.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = Table(_star(both, small=False), "large-star")
        nxt = Table(_star(large.df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small=True), "small-star")
        large.drop()
        t.drop()
        t, old, mark = nxt, mark, _mark(nxt.df)
        if mark == old:
            root = t.df.select("v").distinct()
            return t.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(root.select(F.col("v").alias("node"), F.col("v").alias("root")))
    raise RuntimeError(f"components did not settle in {most} rounds")
