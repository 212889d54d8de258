"""The vote of the neighbours and the decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NEIGHBOURS


def vote(neighbours: DataFrame) -> DataFrame:
    """(qid, fraud_count): frauds among the neighbours found; missing ones count as legitimate."""
    return neighbours.groupBy("qid").agg(F.sum("label").cast("int").alias("fraud_count"))


def decide(queries: DataFrame, votes: DataFrame) -> DataFrame:
    """``queries`` with fraud_count, approved and fraud_score. Rows without a vote (no references, invalid) are approved with 0."""
    count = F.coalesce(F.col("fraud_count"), F.lit(0))
    out = queries.join(votes, "qid", "left").withColumn("fraud_count", count)
    return out.withColumn("approved", F.col("fraud_count") < 3).withColumn("fraud_score", F.col("fraud_count") / F.lit(float(NEIGHBOURS)))


def response(decided: DataFrame) -> DataFrame:
    """Adds ``response``, the JSON answer."""
    return decided.withColumn("response", F.to_json(F.struct("approved", "fraud_score")))
