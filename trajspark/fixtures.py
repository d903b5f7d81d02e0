"""The supplied tables as the domain's: a 10 x 10 grid of crosses, its roads, logs and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.network import directed_edges
from .sources.pickers import class_speed


def cross(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(100).select(i.cast("int").alias("cross_id"), (100.0 * (i % 10)).alias("x"), (100.0 * F.floor(i / 10)).alias("y"))


def road(spark: SparkSession) -> DataFrame:
    """Right and upward neighbours; direction and class come from the start cross."""
    i = F.col("id").cast("int")
    x, y = 100.0 * (i % 10), 100.0 * F.floor(i / 10)
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    right = spark.range(100).where("id % 10 < 9").select((2 * i).alias("road_id"), i.alias("start_cross"), (i + 1).alias("end_cross"), F.array(point(x, y), point(x + 100, y)).alias("geom"))
    up = spark.range(90).select((2 * i + 1).alias("road_id"), i.alias("start_cross"), (i + 10).alias("end_cross"), F.array(point(x, y), point(x, y + 100)).alias("geom"))
    s = F.col("start_cross")
    both = right.unionByName(up).withColumn("direction", F.when(s % 7 == 3, 1).when(s % 7 == 5, 2).otherwise(3)).withColumn("class", 2 + s % 4)
    return both.withColumn("speed", class_speed("class")).withColumn("geo_length", F.lit(100.0))


def edge(spark: SparkSession) -> DataFrame:
    return directed_edges(road(spark))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def traj_data(spark: SparkSession, sf_dir: str, crosses: int = 100) -> DataFrame:
    """(traj_id, seq, cross_id, ts): a user's events in order; with fewer crosses, transitions are denser."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("traj_id"), F.col("event_id").alias("seq"), (_k() % crosses).alias("cross_id"), "ts")


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, seq, ts, x, y): positions around the crosses."""
    k = _k()
    x = 100.0 * (k % 10) + F.floor("value") % 41 - 20
    y = 100.0 * F.floor(k / 10) + (7 * F.col("event_id")) % 41 - 20
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("traj_id"), F.col("event_id").alias("seq"), "ts", x.cast("double").alias("x"), y.cast("double").alias("y"))


def traj_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = traj_data(spark, sf_dir).groupBy("traj_id").agg(F.min(F.to_date("ts")).alias("date"))
    return days.select(F.col("traj_id").alias("id"), "date", F.col("traj_id").alias("car_id"), F.lit(0).alias("sub_id"))


def hot_crosses(spark: SparkSession, top: int = 6) -> DataFrame:
    return spark.range(top).select(F.col("id").cast("int").alias("cross_id"))
