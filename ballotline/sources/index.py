"""The index as Parquet: references by partition, boxes, risk table, and a manifest that is checked on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DIMS, LEAF_SIZE, MCC_SLOTS, SCALE, VECTOR
from ..functions.vectors import partition_key
from ..operators.knn import Index
from ..operators.partitions import counts, with_leaves

FORMAT = "ballotline-index-1"


def build_index(refs: DataFrame, leaf_size: int = LEAF_SIZE) -> Index:
    """An index of (ref_id, v0.., label) rows, not written."""
    held = refs.select("ref_id", *VECTOR, "label").withColumn("part_key", partition_key())
    return Index(*with_leaves(held, leaf_size))


def write_index(index: Index, mcc_risk: DataFrame, path: str) -> None:
    """Writes an index. References of a leaf lie together, so that reading a leaf skips the other row groups."""
    spark = mcc_risk.sparkSession
    rows = index.refs.repartitionByRange("part_key", "leaf_id").sortWithinPartitions("part_key", "leaf_id", "ref_id")
    rows.write.partitionBy("part_key").parquet(f"{path}/references")
    for name, df in (("leaf_boxes", index.leaves), ("part_boxes", index.parts), ("mcc_risk", mcc_risk)):
        df.write.parquet(f"{path}/{name}")
    n = counts(index.refs, index.leaves, index.parts)
    manifest = spark.range(1).select(F.lit(FORMAT).alias("format"), F.lit(SCALE).alias("scale"), F.lit(DIMS).alias("dims"), *[F.lit(v).cast("long").alias(k) for k, v in n.items()])
    manifest.write.json(f"{path}/manifest")  # last: an index without it isn't whole


def read_index(spark: SparkSession, path: str) -> tuple[Index, DataFrame]:
    """The index and risk table at ``path``. Raises ValueError if the manifest doesn't fit them."""
    kinds = "format STRING, scale INT, dims INT, references LONG, leaves LONG, partitions LONG"
    m = spark.read.schema(kinds).json(f"{path}/manifest").first()
    refs = spark.read.parquet(f"{path}/references").withColumn("part_key", F.col("part_key").cast("int"))
    leaves, parts, risk = (spark.read.parquet(f"{path}/{t}") for t in ("leaf_boxes", "part_boxes", "mcc_risk"))
    if m is None or m.format != FORMAT:
        raise ValueError(f"{path} is no index of format {FORMAT}")
    if (m.scale, m.dims) != (SCALE, DIMS):
        raise ValueError(f"{path} has scale {m.scale} and {m.dims} dimensions, not {SCALE} and {DIMS}")
    found = counts(refs, leaves, parts)
    wrong = [k for k, v in found.items() if m[k] != v]
    if wrong:
        raise ValueError(f"{path} has other numbers of {', '.join(wrong)} than its manifest says")
    if risk.where(~F.col("slot").between(0, MCC_SLOTS - 1)).limit(1).count():
        raise ValueError(f"{path} has codes beyond the {MCC_SLOTS} slots")
    return Index(refs, leaves, parts), risk
