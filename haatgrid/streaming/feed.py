"""Price and event feeds as Structured Streaming; an extension, as batch pipelines have no counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import shared_dir


def windowed_counts(stream: DataFrame, time: str, by: list[str], value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and totals per window and group; records later than ``late`` are left out by the watermark where the sink appends."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def first_receipts(stream: DataFrame, time: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Records without repeats of the keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it gave. Complete mode keeps the last batch."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
