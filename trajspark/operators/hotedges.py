"""Transitions between hot crosses, their plausibility and trimming into virtual edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order():
    return W.partitionBy("traj_id").orderBy("seq")

#: A plausible speed is at most three times the road's, and this many m/s.
SPEED_FACTOR, SPEED_MOST = 3.0, 33.3


def hot_transitions(data: DataFrame, hot: DataFrame) -> DataFrame:
    """(traj_id, c1, c2, enter, leave, cost_ms): moves from one hot cross to another.

    A run of points on one hot cross has the time midway between its first and last. A run that
    reaches the trajectory's end doesn't count. When the same hot cross comes again after others,
    its first run stays the anchor; the anchor moves on to the first run of a different hot cross.
    """
    marked = data.join(hot.select("cross_id", F.lit(True).alias("hot")).distinct(), "cross_id", "left")
    new = F.when(F.lag("cross_id").over(_order()) == F.col("cross_id"), 0).otherwise(1)
    numbered = marked.withColumn("run", F.sum(F.coalesce(new, F.lit(1))).over(_order())).withColumn("_last", F.max("seq").over(W.partitionBy("traj_id")))
    spans = numbered.groupBy("traj_id", "run").agg(F.first("cross_id").alias("cross_id"), F.max(F.coalesce("hot", F.lit(False))).alias("hot"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b"), F.max("seq").alias("end"), F.max("_last").alias("last"))
    stops = spans.where("hot AND (end < last)").withColumn("mid", F.col("a") + F.floor((F.col("b") - F.col("a")) / 2))
    by_run = W.partitionBy("traj_id").orderBy("run")
    anchors = stops.withColumn("_p", F.lag("cross_id").over(by_run)).where("_p IS NULL OR _p <> cross_id")
    moves = anchors.select("traj_id", F.col("cross_id").alias("c1"), F.lead("cross_id").over(by_run).alias("c2"), F.col("mid").alias("t1"), F.lead("mid").over(by_run).alias("t2")).where("c2 IS NOT NULL")
    return moves.select("traj_id", "c1", "c2", F.timestamp_micros("t1").alias("enter"), F.timestamp_micros("t2").alias("leave"), F.floor((F.col("t2") - F.col("t1")) / 1000).alias("cost_ms"))


def transition_counts(moves: DataFrame) -> DataFrame:
    return moves.groupBy("c1", "c2").agg(F.count("*").alias("n"))


def plausible(moves: DataFrame, routes: DataFrame) -> DataFrame:
    """Moves that took longer than driving fast would: cost over floor(length / speed) seconds.

    routes (src, dst, length, speed) has the shortest path of each distinct pair; without a path
    nothing bounds the cost from below but an infinite length, so such moves go.
    """
    speed = F.least(F.col("speed") * SPEED_FACTOR, F.lit(SPEED_MOST))
    least = F.floor(F.try_divide(F.col("length"), speed)) * 1000
    bounds = routes.select(F.col("src").alias("c1"), F.col("dst").alias("c2"), least.alias("_least"))
    return moves.join(bounds, ["c1", "c2"]).where("cost_ms > _least").drop("_least")


def virtual_edges(moves: DataFrame, share: float, more_than: int) -> DataFrame:
    """The cheapest floor(n * share) moves of each pair, where these are more than a number; with the edge's id.

    Ids number the pairs in order; an edge is a pair of hot crosses, so there are few.
    """
    pair = W.partitionBy("c1", "c2")
    ranked = moves.withColumn("_n", F.count("*").over(pair)).withColumn("_r", F.row_number().over(pair.orderBy("cost_ms", "traj_id", "enter")))
    kept = ranked.withColumn("_keep", F.floor(F.col("_n") * F.lit(share))).where((F.col("_r") <= F.col("_keep")) & (F.col("_keep") > more_than))
    ids = kept.select("c1", "c2").distinct().withColumn("id", F.row_number().over(W.orderBy("c1", "c2")) - 1)
    return kept.drop("_n", "_r", "_keep").join(ids, ["c1", "c2"])


def edge_summary(records: DataFrame) -> DataFrame:
    """(c1, c2, n, mean_cost in ms)"""
    return records.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.avg("cost_ms").alias("mean_cost"))
