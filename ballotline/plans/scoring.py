"""Scoring as one plan: JSON bodies in, decisions out; and the offline build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LEAF_SIZE
from ..operators.knn import Index, brute, pruned
from ..operators.payload import extract, raw_features, vectors
from ..operators.tables import Written
from ..operators.vote import decide, response, vote
from ..sources.index import build_index, write_index
from ..sources.references import load_mcc_risk, load_references, quantize_references


def build(spark: SparkSession, references: str, mcc_risk: str, out: str, leaf_size: int = LEAF_SIZE) -> None:
    """References and risks from files to an index at ``out``. Ids number the references in the file's order."""
    rows = load_references(spark, references).withColumn("ref_id", F.monotonically_increasing_id())
    rows = Written(quantize_references(rows), "references").df
    write_index(build_index(rows, leaf_size), load_mcc_risk(spark, mcc_risk), out)


def score(bodies: DataFrame, index: Index, mcc_risk: DataFrame, body: str = "body", strategy: str = "pruned", early_stop: bool = False) -> DataFrame:
    """(qid, valid, fraud_count, approved, fraud_score, response) of each body; qid is unique.

    strategy: "pruned", or "brute" for a check. Invalid bodies are approved with 0.
    """
    raw = Written(raw_features(extract(bodies.select("qid", F.col(body).alias("body")), "body"), mcc_risk).drop("body"), "features").df
    q = vectors(raw.where("valid"), ("qid",))
    near = brute(q, index.refs) if strategy == "brute" else pruned(q, index, early_stop=early_stop)
    return response(decide(raw.select("qid", "valid"), vote(near)))
