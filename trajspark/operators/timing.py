"""When each cross was passed: times spread over matched paths in proportion to length over speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def estimate_time(paths: DataFrame, points: DataFrame, roads: DataFrame) -> DataFrame:
    """(traj_id, seq, cross_id, ts) from matched paths (traj_id, seq, seq2, valid, entities).

    A lone point is passed at the later time, if it is a cross. Otherwise each entity takes its
    nominal time, scaled so that they fill the interval, and ends at a cross in whole
    milliseconds, cut off. The first entity also gives its start cross at the earlier time; a last
    whole road ends exactly at the later time, as does a lone part that ends on a cross; a last part
    gives nothing. A cross and time equal to the one before goes. Paths that have t1 and t2, the microseconds at
    their ends, aren't joined with the points.
    """
    us = points.select("traj_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    timed = paths.where("valid")
    if not {"t1", "t2"} <= set(paths.columns):
        timed = timed.join(us.withColumnRenamed("us", "t1"), ["traj_id", "seq"]).join(us.select("traj_id", F.col("seq").alias("seq2"), F.col("us").alias("t2")), ["traj_id", "seq2"])
    timed = timed.select("traj_id", "seq", "t1", "t2", "entities").repartition("traj_id")  # dealt once, before it is spread out
    each = timed.select("traj_id", "seq", "t1", "t2", F.size("entities").alias("n"), F.posexplode("entities").alias("pos", "e"))
    speed = roads.select(F.col("road_id").alias("_road"), "speed")
    each = each.join(speed, F.col("e.road_id") == F.col("_road"), "left")
    nominal = F.coalesce(F.try_divide(F.col("e.length"), F.col("speed")), F.lit(0.0)) * 1000
    path = W.partitionBy("traj_id", "seq")
    each = each.withColumn("ms", nominal).withColumn("all_ms", F.sum("ms").over(path))
    each = each.withColumn("part_ms", F.col("ms") * F.coalesce(F.try_divide((F.col("t2") - F.col("t1")) / 1000.0, F.col("all_ms")), F.lit(0.0)))
    each = each.withColumn("offset", F.sum("part_ms").over(path.orderBy("pos")))
    first, last = F.col("pos") == 0, F.col("pos") == F.col("n") - 1
    kind, a, b = F.col("e.kind"), F.col("e.from_cross"), F.col("e.to_cross")
    later = F.when(last, F.col("t2")).otherwise(F.col("t1") + F.floor("offset") * 1000)
    passed = lambda when, order, cross, t: F.when(when & cross.isNotNull(), F.struct(F.lit(order).alias("k"), cross.alias("cross_id"), t.alias("us")))
    events = F.array(
        passed((kind != "point") & first, 0, a, F.col("t1")),
        passed((kind == "point") | (kind == "road") | ((kind == "part") & first), 1, b, F.when(kind == "point", F.col("t2")).otherwise(later)),
    )
    rows = each.select("traj_id", "seq", "pos", F.explode(F.filter(events, lambda v: v.isNotNull())).alias("v")).select("traj_id", "seq", "pos", "v.*")
    order = W.partitionBy("traj_id").orderBy("seq", "pos", "k")
    same = (F.lag("cross_id").over(order) == F.col("cross_id")) & (F.lag("us").over(order) == F.col("us"))
    kept = rows.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same")
    return kept.select("traj_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "cross_id", F.timestamp_micros("us").alias("ts"))


def estimation_cost(entities: DataFrame, roads: DataFrame) -> DataFrame:
    """(path_id, cost_ms) of path entities (path_id, pos, kind, road_id, length): the sum of length over speed."""
    joined = entities.join(roads.select("road_id", "speed"), "road_id", "left")
    return joined.groupBy("path_id").agg((F.sum(F.coalesce(F.try_divide("length", "speed"), F.lit(0.0))) * 1000).alias("cost_ms"))


def spread_time(entities: DataFrame, roads: DataFrame, spans: DataFrame) -> DataFrame:
    """(path_id, pos, cross_id, tod_us): a span (path_id, start_us, end_us) over whole roads.

    Every step is cut to whole milliseconds before it is added up. A part of a road is an error.
    """
    joined = entities.join(roads.select("road_id", "speed"), "road_id").join(spans, "path_id")
    whole = W.partitionBy("path_id")
    ms = F.when(F.col("kind") == "road", F.try_divide("length", "speed") * 1000).otherwise(F.raise_error(F.lit("only whole roads can be interpolated")).cast("double"))
    scaled = joined.withColumn("ms", ms).withColumn("k", F.try_divide(F.expr("(end_us - start_us) div 1000"), F.sum("ms").over(whole)))
    step = F.floor(F.col("ms") * F.col("k")) * 1000
    tod = F.col("start_us") + F.sum("step").over(whole.orderBy("pos"))
    return scaled.withColumn("step", step).select("path_id", "pos", F.col("to_cross").alias("cross_id"), tod.alias("tod_us"))
