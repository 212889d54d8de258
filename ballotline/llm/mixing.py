"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes and targets. A document's size is its number of words; targets share
   ``total`` x all words by weight and stop at ``most`` x the source's words, the
   excess reshared by weight (solved in closed form over the sources in the
   order in which they reach their stop).
2. Draws. Every document has a place on a 64-bit circle (a seeded hash); its
   source's places are cut into 1,024 blocks (more for very many shards), permuted by construction. A target
   of r x the source's words draws every block floor(r) times and, for the rest,
   the blocks up to a cut, which three rounds of 1,024-way histograms find
   exactly. The cut goes to whichever side of the crossing document is nearer.
3. Splitting tree. The drawn blocks of all sources are block quotas. A node of
   the tree hands floor(half) of its blocks to its left child; how many of each
   source is a multivariate hypergeometric draw (a seeded random order of the
   node's blocks, of which a histogram finds the middle, so that no task holds a node's blocks). The quotas stay exact at every node. At the leaves, shards,
   each source's permuted blocks are dealt out as disjoint ranges.
4. Local shuffle. Each shard's rows are ordered by another seeded hash.

DataFrame operations only. What is per document is one row of numbers; what is
per source or block is metadata: two rows a block. Reruns agree:
nothing depends on partitions. Rows alike in id, words and text share a place and
are drawn or left together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, word_count

#: Weights by source in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2
SEED = 7
#: Fewest shards, and words in one from which there are more.
SHARDS = 16
SHARD_WORDS = 50_000_000
#: Bits of a block's number, at least; there are so many blocks for each shard and more.
_BITS = 10
_SPARE = 8
_CUT_BITS = 10
_LEVELS = 3
#: Most nodes of a tree level that are broadcast (about 40 bytes each).
NODES = 100_000


def _cell(place: Column, level: int, bits: int) -> Column:
    """Bits of a place: cells of level 1 are blocks, each further level cuts a cell in 1,024."""
    return F.shiftrightunsigned(place, 64 - bits - _CUT_BITS * (level - 1))


def _dimensions(words: int, shards: int | None) -> tuple[int, int]:
    """(shards, bits of a block's number) for a mix of so many words."""
    n = shards or max(SHARDS, -(-words // SHARD_WORDS))
    return n, min(max(_BITS, (n * _SPARE).bit_length()), 24)


def sizes(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """One row (id, src, size, place) a document. Null text: size 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name")).alias("src"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.lit("place"), F.col(id_col), F.xxhash64(body)).alias("place"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(src, source_size, target, epochs, rest): the words to take, as full passes and a rest below one pass."""
    by = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy("src")
    w = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(every) - 1) % len(weights) + 1))
    stop = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "src")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("stop", stop).withColumn("all", F.sum("source_size").over(whole) * F.lit(float(total)))
    w = w.withColumn("rate", (F.col("all") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that stays below its stop fixes the words for each unit of weight
    w = w.withColumn("rate", F.min(F.when(F.col("stop") / F.col("weight") >= F.col("rate"), F.struct(F.col("stop") / F.col("weight"), "rate"))).over(whole)["rate"])
    w = w.withColumn("target", F.least("stop", F.coalesce(F.col("weight") * F.col("rate"), F.col("stop"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return w.withColumn("epochs", epochs).select("src", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def cuts(sized: DataFrame, goals: DataFrame, bits: int = _BITS) -> DataFrame:
    """(src, cut): in the last pass a source's documents at places up to ``cut`` (unsigned order) are drawn; null: none."""
    open_ = goals.where("rest > 0").select("src", "rest")
    rows = sized.where("size > 0")
    for level in range(1, _LEVELS + 1):
        cell = _cell(F.col("place"), level, bits)
        by = rows.withColumn("cell", cell).groupBy("src", "cell").agg(F.sum("size").alias("n"))
        order = Window.partitionBy("src").orderBy("cell")
        met = by.join(open_, "src").withColumn("upto", F.sum("n").over(order)).withColumn("left", F.col("rest") - F.col("upto") + F.col("n"))
        # the cell that holds the crossing document, and what remains to be taken in it
        found = met.where("left >= 0 AND upto >= rest").groupBy("src").agg(F.min(F.struct("cell", "left")).alias("c")).select("src", F.col("c.cell").alias("at"), F.col("c.left").alias("rest"))
        found = Table(found, "cut").df
        rows = rows.join(found.select("src", "at"), "src").where(cell == F.col("at")).drop("at")
        open_ = found.select("src", "rest", "at")
    last = rows.groupBy("src", "place").agg(F.sum("size").alias("n")).join(open_, "src")
    flipped = F.col("place").bitwiseXOR(F.lit(-(1 << 63)))
    order = Window.partitionBy("src").orderBy(flipped)
    last = last.withColumn("upto", F.sum("n").over(order)).withColumn("off", F.abs(F.col("upto") - F.col("rest"))).withColumn("key", flipped)
    # taking nothing of the cell is the other choice: then the cut is the place before the cell
    first = F.shiftleft(F.col("at"), 64 - bits - _CUT_BITS * (_LEVELS - 1)).bitwiseXOR(F.lit(-(1 << 63)))
    best = last.groupBy("src").agg(F.min(F.struct("off", "key")).alias("b"), F.first("rest").alias("rest"), F.first(first).alias("first"))
    return best.select("src", F.when(F.col("b.off") < F.col("rest"), F.col("b.key")).otherwise(F.when(F.col("first") > F.lit(-(1 << 63)), F.col("first") - 1)).alias("cut"))


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(src, shard, quota) from (src, quota): block quotas dealt out among ``shards`` by the splitting tree.

    Every source's quotas sum to what it had, and shards differ by at most one block a level.
    """
    at = quotas.select("src", F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("quota").cast("long").alias("quota"))
    for level in range(max(shards - 1, 0).bit_length()):
        block = at.where("quota > 0").select("src", "lo", "hi", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("k"))
        block = block.withColumn("h", F.xxhash64(F.lit(seed), F.lit("tree"), F.lit(level), "lo", "src", "k")).withColumn("cell", F.shiftrightunsigned("h", 52))
        # in the random order by h, the first half goes left: a histogram of 4,096 cells a node finds the cell of the middle, whose blocks alone are ranked
        w = Window.partitionBy("lo")
        by = block.groupBy("lo", "hi", "cell").agg(F.count("*").alias("n"))
        by = by.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("want", F.expr("sum(n) OVER (PARTITION BY lo) * (hi - lo - (hi - lo) div 2) div (hi - lo)"))
        edge = by.where("upto >= want").groupBy("lo").agg(F.min(F.struct("cell", (F.col("want") - F.col("upto") + F.col("n")).alias("need"))).alias("edge"))
        # a row for each node: at most as many as shards
        met = block.join(F.broadcast(edge) if shards <= NODES else edge, "lo")
        tied = met.where("cell = edge.cell").withColumn("rank", F.row_number().over(w.orderBy("h", "src", "k"))).withColumn("left", F.col("rank") <= F.col("edge.need")).drop("rank")
        block = met.where("cell <> edge.cell").withColumn("left", F.col("cell") < F.col("edge.cell")).union(tied)
        mid = F.expr("hi - (hi - lo) div 2")
        one = F.col("hi") - F.col("lo") <= 1
        to_lo = F.when(one | F.col("left"), F.col("lo")).otherwise(mid)
        to_hi = F.when(one | ~F.col("left"), F.col("hi")).otherwise(mid)
        at = Table(block.select("src", to_lo.alias("a"), to_hi.alias("b")).groupBy("src", F.col("a").alias("lo"), F.col("b").alias("hi")).agg(F.count("*").alias("quota")), "tree").df
    return at.select("src", F.col("lo").alias("shard"), "quota")


def plan(docs: DataFrame, id_col: str, text: str, source: str, shards: int | None, weights: tuple[int, ...], total: float, most: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Per document (id, src, size, place) as written; per source its goal and cut; per drawn block (src, block, epoch, shard); bits of a block's number."""
    sized = Table(sizes(docs, id_col, text, source, seed), "sizes").df
    goals = Table(targets(sized, weights, total, most), "targets").df
    words = goals.agg(F.sum("target")).first()[0]
    shards, bits = _dimensions(int(words or 0), shards)
    goals = Table(goals.join(cuts(sized, goals, bits), "src", "left"), "goals").df
    return sized, goals, blocks(goals, shards, seed, bits), bits


def blocks(goals: DataFrame, shards: int, seed: int, bits: int = _BITS) -> DataFrame:
    """(src, block, epoch, shard) of every drawn block; the cut's block is drawn in part."""
    whole = 1 << bits
    last = F.coalesce(_cell(F.col("cut").bitwiseXOR(F.lit(-(1 << 63))), 1, bits) + 1, F.lit(0).cast("long"))
    held = goals.select("src", (F.col("epochs") * whole + last).alias("quota"))
    dealt = split_tree(held, shards, seed)
    upto = F.sum("quota").over(Window.partitionBy("src").orderBy("shard"))
    dealt = dealt.withColumn("start", upto - F.col("quota"))
    # a source's drawn blocks in a permuted order of their own, so that passes don't line up with shards
    drawn = held.where("quota > 0").select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("k"))
    drawn = drawn.withColumn("turn", F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), F.lit("turn"), "src", "k"), "k")) - 1)
    ranges = dealt.select("src", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("turn"))
    return drawn.join(ranges, ["src", "turn"]).select("src", (F.col("k") % whole).alias("block"), F.floor(F.col("k") / whole).cast("long").alias("epoch"), "shard")


def _copies() -> Column:
    drawn = F.coalesce(F.col("place").bitwiseXOR(F.lit(-(1 << 63))) <= F.col("cut"), F.lit(False))
    return F.col("epochs") + drawn.cast("long")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """One row a document: (id, size, source_size, target, taken, shards), shards the shard of each copy by pass.

    Null texts have size 0 and take nothing; a null source is a source of its own,
    the last. Repeated rows are documents of their own with equal results. Other
    columns are ignored; an empty table gives no rows; if all sizes are 0, targets are 0.
    """
    sized, goals, drawn, bits = plan(docs, id_col, text, source, shards, weights, total, most, seed)
    per_block = drawn.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("at"))
    held = sized.withColumn("block", _cell(F.col("place"), 1, bits)).join(goals, "src").join(per_block, ["src", "block"], "left")
    copies = F.when(F.col("size") > 0, _copies()).otherwise(F.lit(0).cast("long"))
    return held.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
        F.when(copies > 0, F.slice(F.transform("at", lambda x: x["shard"]), F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<bigint>")).alias("shards"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed rows: the columns of ``docs``, mix_epoch and mix_shard, one row for each copy drawn.

    Shards are ranges of output partitions, each in a seeded order of its own. A
    column of ``docs`` named like one of the two new ones is replaced.
    """
    _, goals, drawn, bits = plan(docs, id_col, text, source, shards, weights, total, most, seed)
    names = [c for c in docs.columns if c not in ("mix_epoch", "mix_shard")]
    body = F.coalesce(F.col(text), F.lit(""))
    src = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))
    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), src.alias("src"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.lit("place"), F.col(id_col), F.xxhash64(body)).alias("place"))
    per_block = drawn.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("at"))
    held = held.where("size > 0").withColumn("block", _cell(F.col("place"), 1, bits)).join(goals, "src").join(per_block, ["src", "block"])
    out = held.select("row", "place", F.explode(F.slice("at", F.lit(1), _copies().cast("int"))).alias("at"))
    turn = F.xxhash64(F.lit(seed), F.lit("local"), "at.shard", "at.epoch", "place")
    out = out.withColumn("turn", turn).repartitionByRange(F.col("at.shard"), F.col("turn")).sortWithinPartitions("at.shard", "turn")
    return out.select(*[F.col("row")[n].alias(n) for n in names], F.col("at.epoch").alias("mix_epoch"), F.col("at.shard").alias("mix_shard"))
