"""Eval records as a stream: each micro-batch is upserted into the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from screenlake.operators.upserts import ingest_evals
from screenlake.schemas import EVAL_RECORD
from screenlake.stages import numbered
from screenlake.store import Store


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVAL_RECORD).json(folder)


def start(records: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Takes what is there and stops. A batch that is run again upserts the same keys, so nothing is counted twice."""
    def take(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        rows = numbered(batch, ["paper_id", "eval_id"], "seq")
        runs, evals, _counts = ingest_evals(store.read("eval_runs"), store.read("evals"), rows)
        store.commit({"eval_runs": runs, "evals": evals}, check=False)

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
