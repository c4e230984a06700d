from pyspark.sql import functions as F

from splatarium.operators import stats
from splatarium.plans.pipeline import Pipeline
from splatarium.plans.fixtures import scene_l
from splatarium.scene import Scene
from splatarium.streaming import scenes

SF = "/root/testdata/sf0.001"


def test_pipeline_on_a_stream(spark, tmp_path):
    batch = scene_l(spark, SF)
    batch.df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scenes.stream_scene(spark, str(tmp_path / "in"), batch.df.schema, batch.format, files_per_trigger=1)
    p = Pipeline().min_opacity(0.5).within_sphere(4.0).brightness(1.2).translate((1, 0, 0))
    scenes.append_to(p(stream).df, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(p(batch).df).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == p(batch).df.count()


def test_windowed_histogram(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", F.col("value").alias("opacity"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counts = scenes.windowed_histogram(stream, "ts", stats.opacity_values(), 10, 0.0, 100.0, "1 day")
    q = counts.writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hist").agg(F.sum("count")).first()[0] == events.filter("opacity is not null").count()
    assert isinstance(Scene(stream).df.isStreaming, bool)
