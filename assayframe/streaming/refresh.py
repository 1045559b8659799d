"""Totals and item counts kept current from a stream of outcome records.

Each micro-batch is reduced by key and merged into a small state table, written
anew under the batch's number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ("passes", "cells")


def tally(responses: DataFrame) -> DataFrame:
    """Passes and cells of each model and of each item."""
    def of(kind: str, key: str) -> DataFrame:
        return responses.groupBy("suite_id", F.lit(kind).alias("kind"), F.col(key).alias("name")).agg(F.sum("passed").cast("long").alias("passes"), F.count(F.lit(1)).alias("cells"))

    return of("model", "model").unionByName(of("item", "item_id"))


def merge(batch: DataFrame, batch_id: int, path: str) -> None:
    """Adds a batch's tallies to those of the batch before (for ``foreachBatch``)."""
    spark = batch.sparkSession
    now = tally(batch)
    if batch_id:
        now = now.unionByName(state(spark, path, batch_id - 1))
    now.groupBy("suite_id", "kind", "name").agg(*[F.sum(c).alias(c) for c in COUNTS]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def state(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch={batch_id}")


def start(responses: DataFrame, path: str, checkpoint: str):
    """Runs over a streaming DataFrame of responses until all that is there is merged."""
    return responses.writeStream.foreachBatch(lambda df, n: merge(df, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
