"""Event-time summaries of an unbounded event source; an extra, as the batch inventory has no streaming operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_root


def tumbling_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and sum per window and kind; works on static and streaming frames alike."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("window_start"), kind, "n", "total")
    )


def run_once(spark: SparkSession, folder: str, pattern: str, schema, build) -> DataFrame:
    """Drives every file present now through a streaming plan and returns all its windows, also those still open at the last event.

    State and result lie in the shared folder, so no rows pass the driver and a lost executor's state is read again.
    """
    base = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    built = build(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result")

    query = built.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(built.schema).parquet(f"{base}/result")
