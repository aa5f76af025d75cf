"""Dictionary deliveries as a stream: parse what arrives, keep each delivery once, count late ones by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_deliveries(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(stream: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Each key once within the watermark, so that state stays bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def per_window(stream: DataFrame, at: str, key: str, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """(key, starts, n): events of each tumbling window; closed windows only, once the watermark passed them."""
    w = F.window(F.col(at), width)
    return stream.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("starts"), "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    s = F.session_window(F.col(at), gap)
    return stream.withWatermark(at, late).groupBy(s, key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("starts"), F.col("session_window.end").alias("ends"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there now as Parquet, exactly once over restarts."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
