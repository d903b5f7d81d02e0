"""Turn phases of crosses, their entropy and rank, and turn counts of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import direction


def _order():
    return W.partitionBy("traj_id").orderBy("seq")

#: Entropies below this are rounding and count as 0.
LEAST_ENTROPY = 1e-6


def runs(data: DataFrame) -> DataFrame:
    """The first point of every run of one cross."""
    return data.withColumn("_p", F.lag("cross_id").over(_order())).where("_p IS NULL OR _p <> cross_id").drop("_p")


def phase_counts(data: DataFrame) -> DataFrame:
    """(cross_id, c_in, c_out, n): how often each way through a cross is taken; U-turns count."""
    triples = runs(data).select("cross_id", F.lag("cross_id").over(_order()).alias("c_in"), F.lead("cross_id").over(_order()).alias("c_out"))
    return triples.where("c_in IS NOT NULL AND c_out IS NOT NULL").groupBy("cross_id", "c_in", "c_out").agg(F.count("*").alias("n"))


def cross_entropy(phases: DataFrame) -> DataFrame:
    """(cross_id, total, entropy in bits) of phase counts: sum(n log n) turns one pass into the entropy."""
    n = F.col("n").cast("double")
    total = phases.groupBy("cross_id").agg(F.sum("n").alias("total"), F.sum(n * F.log2(n)).alias("_nlogn"))
    entropy = F.log2(F.col("total").cast("double")) - F.col("_nlogn") / F.col("total")
    return total.select("cross_id", "total", F.when(entropy < LEAST_ENTROPY, 0.0).otherwise(entropy).alias("entropy"))


def rank_crosses(details: DataFrame, by: str = "entropy") -> DataFrame:
    """Ranks from 0: by total squared times entropy, or by total; one row per cross of the map, so small."""
    total = F.col("total").cast("double")
    value = total * total * F.col("entropy") if by == "entropy" else total
    # Rounded, so that sums in another order rank the same; ties go to the smaller cross.
    rank = F.row_number().over(W.orderBy(F.desc("_v"), "cross_id")) - 1
    return details.withColumn("_v", F.round(value, 6)).withColumn("rank", rank).drop("_v")


def _turns(data: DataFrame, skip: bool) -> DataFrame:
    at = lambda c, k: F.lag(c, k).over(_order())
    rows = data.select("traj_id", F.col("x").alias("cx"), F.col("y").alias("cy"), at("x", 1).alias("bx"), at("y", 1).alias("by"), at("x", 2).alias("ax"), at("y", 2).alias("ay")).where("ax IS NOT NULL")
    if skip:
        rows = rows.where("NOT (ax = cx AND ay = cy) AND NOT (bx = cx AND by = cy) AND NOT (ax = bx AND ay = by)")
    return rows.select("traj_id", direction(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")).alias("turn"))


def turn_totals(located: DataFrame, compat: bool = False) -> DataFrame:
    """One row (left, right, straight) over all triples that neither repeat a place nor turn back.

    With compat, a left turn counts as straight too.
    """
    count = lambda cond: F.coalesce(F.sum(F.when(cond, 1)), F.lit(0)).cast("long")
    t = F.col("turn")
    straight = t.isin(0, -1) if compat else t == 0
    return _turns(located, True).agg(count(t == -1).alias("left"), count(t == 1).alias("right"), count(straight).alias("straight"))


def turn_score(located: DataFrame, left: int = 2, right: int = 1, straight: int = 0) -> DataFrame:
    """(traj_id, turns): weighted turns over all triples; 0 for a trajectory of under three points."""
    weight = F.when(F.col("turn") == 1, right).when(F.col("turn") == -1, left).otherwise(straight)
    scores = _turns(located, False).groupBy("traj_id").agg(F.sum(weight).cast("long").alias("turns"))
    return located.select("traj_id").distinct().join(scores, "traj_id", "left").select("traj_id", F.coalesce("turns", F.lit(0)).alias("turns"))
