"""Scoring of a stream of bodies: each micro-batch is scored against the fixed index. Batches don't depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import Index
from ..operators.tables import scratch
from ..plans.scoring import score


def score_stream(bodies: DataFrame, index: Index, mcc_risk: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts a query that writes the decisions of (qid, body) rows to ``out``, a folder for each batch.

    A batch that runs again after a failure replaces its own folder, so every body is answered once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        with scratch():  # a batch's intermediate tables go with it
            score(rows, index, mcc_risk).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = bodies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
