"""Pages and events as streams: deliveries of one page in a bounded time count once, counts by window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, folder: str, like: str, files: int = 100) -> DataFrame:
    """Parquet page files as they arrive in ``folder``, with the schema of the table ``like``."""
    schema = spark.read.parquet(like).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once(pages: DataFrame, late: str = "30 days", key: str = "page_id", time: str = "ingested_at") -> DataFrame:
    """Each page's first delivery; state older than ``late`` is dropped, so a repetition after it counts again."""
    return pages.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, kind: str, time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``start, kind, n`` of tumbling windows of event time; rows later than ``late`` are dropped."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def write_once(stream: DataFrame, folder: str, checkpoint: str):
    """Runs until everything that is there is written as Parquet; started again it goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
