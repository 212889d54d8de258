"""References and lookups: JSON files in, quantized DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DIMS, MCC_RISK, NORMALIZATION_SCHEMA, REFERENCE_SCHEMA
from ..functions.numbers import quantize
from ..functions.vectors import mcc_slot


def load_references(spark: SparkSession, path: str) -> DataFrame:
    """(vector, label) of a JSON array, gzipped or not. Such a file can't be split: read it once, then write Parquet."""
    return spark.read.schema(REFERENCE_SCHEMA).option("multiLine", True).json(path)


def quantize_references(references: DataFrame, vector: str = "vector", is_fraud=None) -> DataFrame:
    """Adds v0 to v13 and label (1: fraud). Components are FLOATs, those after the 14th aren't read."""
    fraud = F.col("label") == "fraud" if is_fraud is None else is_fraud
    rest = [c for c in references.columns if c not in (vector, "label")]
    return references.select(*rest, *[quantize(F.col(vector)[i].cast("float")).alias(f"v{i}") for i in range(DIMS)], F.when(fraud, 1).otherwise(0).cast("int").alias("label"))


def load_mcc_risk(spark: SparkSession, path: str) -> DataFrame:
    """(slot, mcc_risk_q) of a JSON object of codes and risks; keys that are no numbers are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "MAP<STRING, FLOAT>")).alias("code", "risk"))
    return risk_table(raw)


def default_mcc_risk(spark: SparkSession) -> DataFrame:
    return risk_table(spark.createDataFrame(sorted(MCC_RISK.items()), "code STRING, risk DOUBLE").withColumn("risk", F.col("risk").cast("float")))


def risk_table(raw: DataFrame) -> DataFrame:
    """Codes share 1,024 slots; of codes in one slot the largest counts."""
    code = F.col("code").try_cast("long")
    held = raw.where(code.isNotNull() & (code >= 0)).select(mcc_slot(code).alias("slot"), code.alias("code"), quantize(F.col("risk")).alias("q"))
    return held.groupBy("slot").agg(F.max(F.struct("code", "q"))["q"].alias("mcc_risk_q"))


def load_normalization(spark: SparkSession, path: str) -> DataFrame:
    """The seven constants of a file, only to be compared with those in use."""
    return spark.read.schema(NORMALIZATION_SCHEMA).option("multiLine", True).json(path)
