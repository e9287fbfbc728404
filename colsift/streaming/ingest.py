"""Streaming ingestion of new tables into a lake and its block synopses.

Vectors arrive as parquet files; every micro-batch is cleaned, placed into the fixed routing
of the lake and appended, and its synopses are appended beside. Synopses merge by least and
greatest values, so the summary of the lake is the merge of all appended ones and no batch
reads older vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colsift.functions import segments as S
from colsift.functions.distance import usable
from colsift.operators.blocks import summarise, with_stats


def route(stats: str, thresholds: list[float]):
    """Block id: one bit a segment, set where its mean is at or above the threshold."""
    bits = [F.when(F.col(stats)[i]["mu"] >= t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(thresholds)]
    return sum(bits[1:], bits[0]).cast("long")


def place(vectors: DataFrame, ends: list[int], thresholds: list[float]) -> DataFrame:
    return with_stats(vectors, ends).withColumn("block_id", route("stats", thresholds))


def ingest(spark: SparkSession, source: str, schema: str, lake: str, checkpoint: str, dim: int, ends: list[int], thresholds: list[float], once: bool = True) -> StreamingQuery:
    """Append new vectors of ``source`` to ``lake``; a batch that is run again overwrites its own folder."""

    def append(batch: DataFrame, epoch: int) -> None:
        clean = batch.where(usable(F.col("vec_values"), dim)).select("table_id", "set_id", "pos", F.col("vec_values").alias("v"))
        placed = place(clean, ends, thresholds).persist()
        placed.write.mode("overwrite").parquet(f"{lake}/vectors/batch={epoch}")
        summarise(placed, ends).write.mode("overwrite").parquet(f"{lake}/blocks/batch={epoch}")
        placed.unpersist()

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def summaries(spark: SparkSession, lake: str, ends: list[int]) -> DataFrame:
    """Synopses of the whole lake: the merge of its batches'."""
    parts = spark.read.parquet(f"{lake}/blocks")
    return parts.groupBy("block_id").agg(F.sum("n").alias("n"), S.merge_synopses("syn", ends).alias("syn"))
