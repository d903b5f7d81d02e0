"""Range and nearest-road joins over a grid of square cells.

A point is sent to the cells that its search square covers, a road or cross to those that its
envelope covers; a pair that meets in several cells is kept in the first of them only. A point whose
place is null or not finite is near nothing: it has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from .lineage import cut

CELL = 50.0


def _cells(box: Column, cell: float) -> Column:
    at = lambda v: F.floor(v / cell)
    xs, ys = F.sequence(at(box["xmin"]), at(box["xmax"])), F.sequence(at(box["ymin"]), at(box["ymax"]))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def placed(points: DataFrame) -> DataFrame:
    """Points with finite coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(finite("x") & finite("y"))


#: A search that found nothing goes on with so many times the radius.
WIDER = 4


def indexed(items: DataFrame, box: Column, cell: float = CELL) -> DataFrame:
    """items with a row for each cell of their box, and the box itself: the index side of a range join."""
    return items.withColumn("box", box).withColumn("cell", F.explode(_cells(F.col("box"), cell)))


def _in_reach(points: DataFrame, items: DataFrame, radius: Column, cell: float) -> DataFrame:
    """points x items whose boxes meet the square of the radius; every pair once."""
    left = placed(points).withColumn("_r", radius).withColumn("_square", G.range_box(G.point("x", "y"), F.col("_r"))).withColumn("_cell", F.explode(_cells(F.col("_square"), cell)))
    joined = left.join(items, F.col("_cell") == F.col("cell"))
    first = lambda a, b: F.floor(F.greatest(F.col("_square")[a], F.col("box")[a]) / cell) == F.col("cell")[b]
    return joined.where(first("xmin", "cx") & first("ymin", "cy"))


def cross_range(points: DataFrame, crosses: DataFrame, radius: float, cell: float = CELL) -> DataFrame:
    """points (traj_id, seq, x, y) with the crosses at most radius away, numbered by (distance, cross_id)."""
    at = crosses.select("cross_id", G.point("x", "y").alias("p"))
    items = indexed(at, F.struct(F.col("p.x").alias("xmin"), F.col("p.y").alias("ymin"), F.col("p.x").alias("xmax"), F.col("p.y").alias("ymax")), cell)
    near = _in_reach(points, items, F.lit(float(radius)), cell).withColumn("dist", G.distance(G.point("x", "y"), "p")).where(F.col("dist") <= radius)
    rank = F.row_number().over(W.partitionBy("traj_id", "seq").orderBy("dist", "cross_id"))
    return near.select("traj_id", "seq", "cross_id", "dist", rank.alias("rn"))


def road_range(points: DataFrame, roads: DataFrame, radius: float | Column, cell: float = CELL) -> DataFrame:
    """points with the roads at most radius away, numbered by (distance, road_id).

    A road whose envelope only touches the search square is left out, as by an index that asks for
    boxes that overlap or cover one another.
    """
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    items = indexed(roads.select("road_id", "geom", "start_cross", "end_cross", "direction", "speed"), G.envelope("geom"), cell)
    near = _in_reach(points, items, radius, cell).where(G.boxes_meet("_square", "box"))
    near = near.withColumn("near", G.nearest(G.point("x", "y"), "geom")).withColumn("dist", F.sqrt("near.d2")).where(F.col("dist") <= F.col("_r"))
    rank = F.row_number().over(W.partitionBy("traj_id", "seq").orderBy("dist", "road_id"))
    return near.withColumn("rn", rank).drop("_r", "_square", "_cell", "cell", "box")


def nearest_road(points: DataFrame, roads: DataFrame, radius: float = CELL, cell: float = CELL) -> DataFrame:
    """The nearest road of every point: ranges that widen, cells with them, until each point has one. None without roads."""
    out, rest = None, placed(points)
    if roads.where(F.size("geom") > 1).isEmpty():
        return road_range(points, roads, radius, cell)
    while True:
        found = cut(road_range(rest, roads, radius, max(cell, radius)).where("rn = 1"))
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select("traj_id", "seq"), ["traj_id", "seq"], "left_anti")
        if rest.isEmpty():
            return out
        radius *= WIDER


def nearest_project(points: DataFrame, roads: DataFrame, radius: float = CELL) -> DataFrame:
    """(traj_id, seq, road_id, dist, pp): the projection of every point on its nearest road."""
    found = nearest_road(points, roads, radius)
    return found.select("traj_id", "seq", "road_id", "dist", G.make_project_point(G.point("x", "y"), "geom", "road_id", "start_cross", "end_cross", F.col("near")).alias("pp"))


def within_box(crosses: DataFrame, box: Column) -> DataFrame:
    """Crosses strictly inside a box."""
    return crosses.where(G.within(G.point("x", "y"), box))


def nearby_hot(points: DataFrame, hot: DataFrame, most: float = 1000.0, cell: float = 500.0) -> DataFrame:
    """points (id, x, y) with the hot crosses strictly in the square of min(1.1 x nearest distance, most)."""
    at = hot.select("cross_id", G.point("x", "y").alias("p"))
    reach, nearest, rest = cell, None, placed(points)
    box = F.struct(F.col("p.x").alias("xmin"), F.col("p.y").alias("ymin"), F.col("p.x").alias("xmax"), F.col("p.y").alias("ymax"))
    items = indexed(at, box, cell)
    if placed(hot).isEmpty():
        return points.select("id").join(at.select("cross_id"), F.lit(False))
    while True:
        found = _in_reach(rest, indexed(at, box, reach), F.lit(reach), reach).withColumn("dist", G.distance(G.point("x", "y"), "p")).where(F.col("dist") <= reach).groupBy("id").agg(F.min("dist").alias("nearest"))
        found = cut(found)
        nearest = found if nearest is None else nearest.unionByName(found)
        rest = rest.join(found, "id", "left_anti")
        if rest.isEmpty():
            break
        reach *= WIDER
    sized = points.join(nearest, "id").withColumn("reach", F.least(1.1 * F.col("nearest"), F.lit(most)))
    inside = _in_reach(sized, items, F.col("reach"), cell)
    return inside.where(G.within("p", F.col("_square"))).select("id", "cross_id")
