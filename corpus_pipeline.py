"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last with the columns of
``documents``. Toxic documents go; repeated chunks and runs of lines go from the texts; one document of each
group of near duplicates stays; documents that hold benchmark items go; the last stage draws
the mix, a row for each copy, with its pass and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballotline.llm import decontam, linededup, mixing, simhash, toxicity
from ballotline.llm.common import new_path, remove, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.apply(docs, runs=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: SQL can't express a trained model, rolling hashes or fingerprints; tests/llm/test_pipeline.py compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix. Of what the stages write, only their results' last one and the last stage's tables stay, which the rows returned read."""
    docs, last = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():  # a stage's own tables go when its result is written
            out = stage(spark, docs, sf_dir)
            path = new_path(spark, f"pipeline-{name}")
            out.write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
