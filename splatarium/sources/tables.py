"""Scenes in Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..scene import Scene
from ..scene_format import POS, SceneFormat


def read_scene(spark: SparkSession, path: str, fmt: SceneFormat) -> Scene:
    return Scene(spark.read.parquet(path), fmt)


def write_scene(scene: Scene, path: str, cell: float | None = None, compression: str = "zstd") -> None:
    """Writes a scene; with a cell size, rows that lie together stand together,
    so that the statistics of a row group let spatial filters skip it."""
    df = scene.df
    if cell:
        # interleaved bits of the cell's coordinates: a curve through space
        at = [F.greatest(F.floor(F.col(c) / cell).cast("long") + (1 << 20), F.lit(0)) for c in POS]
        code = F.lit(0).cast("long")
        for bit in range(21):
            for k, c in enumerate(at):
                code = code.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + k))
        df = df.withColumn("_code", code).repartitionByRange("_code").sortWithinPartitions("_code").drop("_code")
    df.write.mode("overwrite").option("compression", compression).parquet(path)
