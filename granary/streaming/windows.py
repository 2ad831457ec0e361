"""An extension over batch: observations that arrive late, in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observation_stream(spark: SparkSession, path: str, schema, max_files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_means(stream: DataFrame, time: str, key: str, value: str, width: str = "5 days", late: str = "10 days") -> DataFrame:
    """Mean and count of each entity and window; rows later than `late` are left out."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(F.window("_t", width), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select("window.start", "window.end", key, "mean", "n")
