"""Alignment files as they arrive, routed batch by batch.

A stream of file names (one a row, such as a text folder that an upstream job
appends to) is read with Structured Streaming; each micro-batch's files are
read, routed and written as an append to a table partitioned by key. The
checkpoint keeps which files were done; a batch that runs again replaces its
own rows, so that each file counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats
from ..sources import bam

Router = Callable[[DataFrame], DataFrame]


def names(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file names from text files in ``folder``."""
    return spark.readStream.format("text").load(folder).filter(F.trim("value") != "").select(F.trim("value").alias("path"))


def route_arrivals(stream: DataFrame, router: Router, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write (path, ordinal, key, flag, ref_id, n_bytes) of all arriving files to ``out``/batch=N."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # the names of one batch
        if not paths:
            return
        routed = router(bam.read_bam(spark, ",".join(sorted(paths)), ["path", "flag", "pos", "n_bytes"]))
        rows = routed.withColumn("key", F.explode("keys")).select("path", "ordinal", "key", "flag", "ref_id", "n_bytes")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def running_stats(spark: SparkSession, out: str) -> DataFrame:
    """Counters of each key over all batches so far."""
    return stats.output_stats(spark.read.parquet(out))
