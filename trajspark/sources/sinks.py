"""Where results go: CSV of timed paths, layers for maps, tables of virtual edges, status lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.weights import pattern_text
from .shapefile import LINE, POINT, POLYGON, write_shapefile


def write_timed_paths(paths: DataFrame, folder: str) -> None:
    """One CSV folder per log and valid range: lines cross,time with six places."""
    row = F.concat_ws(",", "cross_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    one = paths.select("traj_id", "range_id", "seq", row.alias("value"))
    one.repartition("traj_id", "range_id").sortWithinPartitions("traj_id", "range_id", "seq").select("traj_id", "range_id", "value").write.mode("overwrite").partitionBy("traj_id", "range_id").text(folder)


def range_stem(ranges: DataFrame) -> DataFrame:
    """(traj_id, range_id, suffix): no suffix for the only range of a log, else -i."""
    n = F.count("*").over(W.partitionBy("traj_id"))
    return ranges.select("traj_id", "range_id", F.when(n == 1, "").otherwise(F.concat(F.lit("-"), F.col("range_id").cast("string"))).alias("suffix"))


def write_named_paths(paths: DataFrame, folder: str) -> None:
    """One CSV folder per log and valid range, named by the log and the range's suffix."""
    stems = range_stem(paths.select("traj_id", "range_id").distinct())
    row = F.concat_ws(",", "cross_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    named = paths.join(stems, ["traj_id", "range_id"]).select(F.concat(F.col("traj_id").cast("string"), "suffix").alias("log"), "seq", row.alias("value"))
    named.repartition("log").sortWithinPartitions("log", "seq").select("log", "value").write.mode("overwrite").partitionBy("log").text(folder)


def _points(rows: DataFrame) -> DataFrame:
    return rows.withColumn("geom", F.array(G.point("x", "y"))).drop("x", "y")


def write_cross_rank(ranked: DataFrame, crosses: DataFrame, path: str) -> int:
    """Point layer RANK, INDEX, COUNT, ENTROPY."""
    rows = ranked.join(crosses, "cross_id").orderBy("rank").select(F.col("rank").cast("int").alias("RANK"), F.col("cross_id").alias("INDEX"), F.col("total").cast("long").alias("COUNT"), F.col("entropy").alias("ENTROPY"), "x", "y")
    return write_shapefile(_points(rows), path, kind=POINT)


def _lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("geom", F.array(G.point("x1", "y1"), G.point("x2", "y2"))).drop("x1", "y1", "x2", "y2")


def write_virtual_edges(edges: DataFrame, path: str) -> int:
    """Line layer START, END, DBID, COUNT of (id, start, end, count, x1, y1, x2, y2)."""
    rows = edges.orderBy("id").select(F.col("start").alias("START"), F.col("end").alias("END"), F.col("id").alias("DBID"), F.col("count").alias("COUNT"), "x1", "y1", "x2", "y2")
    return write_shapefile(_lines(rows), path, kind=LINE)


def virtual_edge_tables(records: DataFrame, type_id: int, rank_type: str, top: int, count_filter: int, data_use: float, comments: str = "") -> dict[str, DataFrame]:
    """The type, metadata and data tables of trimmed records (c1, c2, id, enter, leave, cost_ms)."""
    spark = records.sparkSession
    kind = spark.createDataFrame([(type_id, rank_type, top, count_filter, data_use, comments)], "`id` int, `rank-type` string, `top` int, `count-filter` int, `data-use` double, `comments` string")
    meta = records.select("id", F.col("c1").alias("start"), F.col("c2").alias("end")).distinct().withColumn("type", F.lit(type_id)).withColumn("pattern", F.lit(None).cast("string"))
    order = W.partitionBy("metadata_id").orderBy("cost", "enter")
    data = records.select(F.col("id").alias("metadata_id"), "enter", "leave", F.col("cost_ms").alias("cost")).withColumn("n", F.row_number().over(order) - 1)
    data = data.withColumn("vclass", F.lit(None).cast("int")).withColumn("eclass", F.lit(None).cast("int"))
    return {"virtual_edge_type": kind, "virtual_edge_metadata": meta, "virtual_edge_data": data}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def with_patterns(metadata: DataFrame, bands: DataFrame) -> DataFrame:
    """Metadata with pattern texts of (edge, bands) written back by id."""
    new = bands.select(F.col("edge").alias("id"), pattern_text(F.col("bands")).alias("_pattern"))
    return metadata.join(new, "id", "left").withColumn("pattern", F.coalesce("_pattern", "pattern")).drop("_pattern")


def matched_layer(paths: DataFrame, roads: DataFrame) -> DataFrame:
    """A row per road of a matched path, with the attributes of its transition and its line in order of travel."""
    each = paths.select("traj_id", "seq", "c1", "c2", "v", "ft", "gps_distance", "seconds_between", F.col("length").alias("path_length"), F.col("speed").alias("weight_speed"), F.col("mean_speed").alias("avg_speed"), F.posexplode("entities").alias("pos", "e")).where("e.road_id IS NOT NULL")
    lines = roads.select(F.col("road_id").alias("_road"), "geom", "start_cross")
    joined = each.join(lines, F.col("e.road_id") == F.col("_road"))
    return joined.select("traj_id", "seq", "pos", F.col("e.road_id").alias("road"), F.col("e.length").alias("length"), "c1", "c2", "v", "ft", "gps_distance", F.col("seconds_between").alias("interval"), "path_length", "weight_speed", "avg_speed", G.road_geometry("geom", "start_cross", F.coalesce("e.from_cross", "start_cross")).alias("geom"))


def trajectory_points(data: DataFrame, crosses: DataFrame) -> DataFrame:
    """Point rows INDEX, TIME of timed paths."""
    located = data.join(crosses.select("cross_id", "x", "y"), "cross_id")
    return _points(located.select("traj_id", "seq", F.col("cross_id").alias("INDEX"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("TIME"), "x", "y"))


def trajectory_lines(data: DataFrame, crosses: DataFrame) -> DataFrame:
    """Line rows between neighbouring points of trajectories."""
    located = data.join(crosses.select("cross_id", "x", "y"), "cross_id")
    order = W.partitionBy("traj_id").orderBy("seq")
    rows = located.select("traj_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).where("x2 IS NOT NULL")
    return _lines(rows)


def rank_points(rank: DataFrame, crosses: DataFrame) -> DataFrame:
    """Point rows of a rank list."""
    return _points(rank.join(crosses.select("cross_id", "x", "y"), "cross_id"))


def box_polygon(boxes: DataFrame) -> DataFrame:
    """Closed rings of boxes (.., box)."""
    b = lambda x, y: G.point(F.col(f"box.{x}"), F.col(f"box.{y}"))
    ring = F.array(b("xmin", "ymin"), b("xmin", "ymax"), b("xmax", "ymax"), b("xmax", "ymin"), b("xmin", "ymin"))
    return boxes.withColumn("geom", ring).drop("box")


def write_layer(rows: DataFrame, path: str, kind: int = LINE) -> int:
    return write_shapefile(rows, path, kind=kind)


def write_boxes(boxes: DataFrame, path: str) -> int:
    return write_shapefile(box_polygon(boxes), path, kind=POLYGON)


def foot_graph_layer(foot: DataFrame, crosses: DataFrame) -> DataFrame:
    """Line rows START, END, DBID, COUNT of footmarks on the graph (edge, src, dst, n)."""
    a = crosses.select(F.col("cross_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = crosses.select(F.col("cross_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rows = foot.join(a, "src").join(b, "dst")
    return _lines(rows.select(F.col("src").alias("START"), F.col("dst").alias("END"), F.col("edge").alias("DBID"), F.col("n").alias("COUNT"), "x1", "y1", "x2", "y2"))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """Evaluation rows as text: (straight,left,right), then the metrics."""
    from ..operators.evaluate import METRICS

    head = F.concat(F.lit("("), F.concat_ws(",", "straight", "left", "right"), F.lit(")"))
    return metrics.select(F.concat_ws(",", head, *[F.col(m).cast("string") for m in METRICS]).alias("value"))


def status(points: DataFrame, votes: DataFrame, more_than: int = 5, seconds: float | None = None) -> DataFrame:
    """(traj_id, status[, seconds]): too short, match fail or finished; seconds of the whole batch where they are given."""
    sizes = points.groupBy("traj_id").agg(F.count("*").alias("n"))
    done = votes.select("traj_id").distinct().withColumn("_done", F.lit(True))
    told = sizes.join(done, "traj_id", "left").select("traj_id", F.when(F.col("n") <= more_than, "too short").when(F.col("_done"), "finished").otherwise("match fail").alias("status"))
    return told if seconds is None else told.withColumn("seconds", F.lit(float(seconds)))
