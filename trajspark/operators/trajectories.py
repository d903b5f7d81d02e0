"""Selections and projections of trajectories (traj_id, seq, cross_id, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEEKDAYS = "dayofweek(date) IN (2, 3, 4, 5, 6)"

def _order():
    return W.partitionBy("traj_id").orderBy("seq")


def select_ids(meta: DataFrame, where: str = "true") -> DataFrame:
    """Trajectories that a predicate on their metadata accepts, with their date."""
    return meta.where(F.expr(where)).select("id", "date")


def points_of(data: DataFrame, ids: DataFrame) -> DataFrame:
    """The points of the given trajectories, by one join."""
    return data.join(ids.select(F.col("id").alias("traj_id")), "traj_id", "left_semi")


def trajectory_slice(data: DataFrame, meta: DataFrame, date: str, car_id: int, sub_id: int, start: int, count: int) -> DataFrame:
    """`count` points from offset `start` of the trajectory of a date, car and part, in order of seq."""
    chosen = meta.where((F.col("date") == F.to_date(F.lit(date))) & (F.col("car_id") == car_id) & (F.col("sub_id") == sub_id)).select(F.col("id").alias("traj_id"))
    numbered = data.join(chosen, "traj_id").withColumn("_n", F.row_number().over(W.partitionBy("traj_id").orderBy("seq")) - 1)
    return numbered.where((F.col("_n") >= start) & (F.col("_n") < start + count)).drop("_n")


def keep_hot(data: DataFrame, hot: DataFrame) -> DataFrame:
    """Points on hot crosses; their order stays in seq."""
    return data.join(hot.select("cross_id"), "cross_id", "left_semi")


def trim_to_hot(data: DataFrame, hot: DataFrame) -> DataFrame:
    """Points from the first to the last one on a hot cross; trajectories without one go."""
    marked = data.join(hot.select("cross_id", F.lit(True).alias("_hot")).distinct(), "cross_id", "left")
    at = F.when(F.col("_hot"), F.col("seq"))
    whole = W.partitionBy("traj_id")
    kept = marked.withColumn("_a", F.min(at).over(whole)).withColumn("_b", F.max(at).over(whole)).where("seq BETWEEN _a AND _b")
    return kept.select(*data.columns)


def original_ids(path: DataFrame, index: DataFrame) -> DataFrame:
    """A path (.., cross_index, ..) with original cross ids from (cross_index, cross_id)."""
    return path.join(index, "cross_index").drop("cross_index")


def long_enough(data: DataFrame, more_than: int = 5) -> DataFrame:
    """Trajectories of more points than a number."""
    return data.withColumn("_n", F.count("*").over(W.partitionBy("traj_id"))).where(F.col("_n") > more_than).drop("_n")


def without_repeats(data: DataFrame) -> DataFrame:
    """A point equal to the one before it, in cross and time, goes."""
    same = F.col("cross_id").eqNullSafe(F.lag("cross_id").over(_order())) & F.col("ts").eqNullSafe(F.lag("ts").over(_order()))
    return data.withColumn("_same", same).where("NOT _same").drop("_same")


def on_map(data: DataFrame, crosses: DataFrame) -> DataFrame:
    """Points with their coordinates."""
    return data.join(crosses.select("cross_id", "x", "y"), "cross_id")


def virtual_edge_endpoints(edges: DataFrame, crosses: DataFrame) -> DataFrame:
    """(id, start, end, x1, y1, x2, y2) of virtual edges."""
    a = crosses.select(F.col("cross_id").alias("start"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = crosses.select(F.col("cross_id").alias("end"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "start").join(b, "end").select("id", "start", "end", "x1", "y1", "x2", "y2")
