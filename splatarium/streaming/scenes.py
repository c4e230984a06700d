"""Scenes that arrive as streams.

Filters and row-local changes are plain projections, so a pipeline of them runs
on a streaming DataFrame as it is. Histograms and bounds run as streaming
aggregates with the range given, since a range cannot be taken from rows that are
still to come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scene import Scene
from ..scene_format import SceneFormat


def stream_scene(spark: SparkSession, path: str, schema: StructType, fmt: SceneFormat, files_per_trigger: int = 100) -> Scene:
    """New Parquet files of a folder, as they come."""
    return Scene(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path), fmt)


def windowed_histogram(df: DataFrame, time: str, values: dict[str, Column], n_bins: int, lo: float, hi: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, channel, bin, count): counts by event time; rows later than the
    watermark are left out, and closed windows leave the state."""
    width = (hi - lo) / n_bins
    pairs = F.array(*[F.struct(F.lit(k).alias("channel"), v.cast("double").alias("v")) for k, v in values.items()])
    rows = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(F.col(time), F.explode(pairs).alias("p")).filter("p.v is not null")
    at = F.least(F.greatest(F.floor((F.col("p.v") - lo) / width), F.lit(0)), F.lit(n_bins - 1))
    return rows.groupBy(F.window(time, window).alias("window"), F.col("p.channel").alias("channel"), at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def append_to(df: DataFrame, path: str, checkpoint: str):
    """Writes a stream's rows to a Parquet folder, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
