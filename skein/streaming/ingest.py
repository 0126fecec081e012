"""Streaming ingest: micro-batches of graph events append to a log that folds into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators.graph import Graph


def append_batch(batch: DataFrame, batch_id: int, log_path: str) -> None:
    """Writes one micro-batch under its own partition; a repeated batch overwrites itself, so replays add nothing.

    Events keep the order of their seq; batches follow each other.
    """
    placed = batch.select([c.split()[0] for c in schema.INGEST_LOG.split(", ")])
    placed.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id:012d}")


def start(events: DataFrame, log_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs a stream of INGEST_LOG rows into the log at `log_path`."""
    return events.writeStream.foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, log_path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The log with one order over all batches: batch first, then seq within it."""
    rows = spark.read.schema(schema.INGEST_LOG + ", batch long").parquet(log_path)
    return rows.withColumn("seq", F.shiftleft(F.col("batch"), 40) + F.col("seq")).drop("batch")


def graph(spark: SparkSession, log_path: str) -> Graph:
    return Graph.from_log(read_log(spark, log_path))
