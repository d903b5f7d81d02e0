"""Queries over sources, sinks, lookups, geometry and routes, each with its SQL where SQL can express it.

Those of files write the fixtures with a sink to the shared folder and read them back with a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixtures as fx
from . import queries as base
from .functions import geometry as G
from .functions import weights
from .operators import clustering, footmark, hotedges, network, phases, routing, timedep, timing, trajectories
from .operators.lineage import shared_path
from .plans import pipelines
from .queries import _PARTS, _PATTERN, _footmark_sql, _r, _with
from .queries import ORACLE_SQL as _BASE_SQL
from .sources import pickers, sinks, tables, text
from .sources.shapefile import POINT, POLYGON, hot_ranking, read_shapefile, write_shapefile
from .streaming.logs import log_stream


def _layer(spark: SparkSession) -> DataFrame:
    """A road layer, written and read: every fifth road is bent, every eleventh has a parallel, one-way and of class 4."""
    at = lambda c, i: F.element_at("geom", i)[c]
    bend = G.point((at("x", 1) + at("x", 2)) / 2 + 30, (at("y", 1) + at("y", 2)) / 2 + 40)
    road = fx.road(spark)
    bent = road.withColumn("geom", F.when(F.col("road_id") % 5 == 0, F.array(F.element_at("geom", 1), bend, F.element_at("geom", 2))).otherwise(F.col("geom")))
    second = road.where("road_id % 11 == 0").withColumn("road_id", F.col("road_id") + 1000).withColumn("direction", F.lit(1)).withColumn("class", F.lit(4))
    rows = bent.unionByName(second).orderBy("road_id")
    code = F.when(F.col("direction") == 1, 2).when(F.col("direction") == 2, 3).otherwise(4)
    known = {2: F.concat(F.lit("R"), "road_id"), 6: code, 18: F.concat(F.lit("X"), "start_cross"), 19: F.concat(F.lit("X"), "end_cross"), 20: F.col("class")}
    path = shared_path(spark, "roads").removeprefix("file://").removeprefix("file:")
    write_shapefile(rows.select(*[known.get(i, F.lit("")).cast("string").alias(f"c{i}") for i in range(21)], "geom"), path)
    return read_shapefile(spark, path)


def layer_roads(spark, sf_dir):
    _, roads = network.load_network(_layer(spark), pickers.by_sid, pickers.road_attributes)
    return roads.select("road_id", "sid", "direction", *_r("speed", "geo_length"), "start_cross", "end_cross")


def layer_crosses(spark, sf_dir):
    crosses, _ = network.load_network(_layer(spark), pickers.by_sid, pickers.road_attributes)
    return crosses.select("cross_id", "key", "x", "y")


def layer_by_geometry(spark, sf_dir):
    _, roads = network.load_network(_layer(spark), pickers.by_geometry, pickers.plain)
    return roads.select("road_id", "direction", "start_cross", "end_cross")


def gps_files(spark, sf_dir):
    """Logs as text files by date and car, and back."""
    path = shared_path(spark, "logs")
    line = F.concat_ws(",", F.lit("a"), F.date_format("ts", text.TIME), F.lit("b"), F.lit("c"), F.col("x").cast("string"), F.col("y").cast("string"))
    rows = fx.gps(spark, sf_dir).select("traj_id", "seq", F.lit("2024").alias("day"), line.alias("value"))
    rows.repartition("traj_id").sortWithinPartitions("traj_id", "seq").select("day", "traj_id", "value").write.partitionBy("day", "traj_id").text(path)
    back = text.with_car(text.read_gps(spark, path))
    return back.select(F.regexp_extract("car_id", r"(\d+)$", 1).cast("long").alias("traj_id"), "seq", F.regexp_extract("date", r"(\d+)$", 1).alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "x", "y")


def streamed_logs(spark, sf_dir):
    """The same files, as a stream that ends with them."""
    path, out = shared_path(spark, "logs"), shared_path(spark, "streamed")
    line = F.concat_ws(",", F.lit("a"), F.date_format("ts", text.TIME), F.lit("b"), F.lit("c"), F.col("x").cast("string"), F.col("y").cast("string"))
    logs = fx.gps(spark, sf_dir).groupBy("traj_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("value")))).alias("rows"))  # the rows of one log
    logs.select(F.array_join(F.transform("rows", lambda r: r["value"]), "\n").alias("value")).repartition(4).write.option("lineSep", "\n\n").text(path)
    whole = log_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "progress")).trigger(availableNow=True).start()
    whole.awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.min("ts").cast("string").alias("first"))


def _log_of(pattern: str):
    return F.regexp_extract("file", pattern, 1)


def timed_path_files(spark, sf_dir):
    path = shared_path(spark, "timed")
    sinks.write_timed_paths(base._dense(spark, sf_dir).withColumn("range_id", F.lit(0)), path)
    back = text.read_timed_path(spark, path)
    return back.select(_log_of(r"traj_id=(\d+)").cast("long").alias("traj_id"), "seq", "cross_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


def timed_path_names(spark, sf_dir):
    """Logs of one range carry their own name, others a suffix."""
    path = shared_path(spark, "named")
    ranges = F.when(F.col("traj_id") % 2 == 0, F.lit(0)).otherwise((F.col("seq") % 3).cast("int"))
    sinks.write_named_paths(base._dense(spark, sf_dir).withColumn("range_id", ranges), path)
    return text.read_timed_path(spark, path).groupBy(_log_of(r"log=([^/]+)/").alias("log")).agg(F.count("*").alias("n"), F.sum("cross_id").alias("crosses"))


def one_timed_path(spark, sf_dir):
    return tables.timed_path(base._dense(spark, sf_dir), 3).select("seq", "cross_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


def _rank_layer(spark, sf_dir):
    ranked = phases.rank_crosses(phases.cross_entropy(phases.phase_counts(base._dense(spark, sf_dir))))
    path = shared_path(spark, "rank").removeprefix("file://").removeprefix("file:")
    sinks.write_cross_rank(ranked, fx.cross(spark), path)
    return read_shapefile(spark, path)


def rank_layer(spark, sf_dir):
    at = F.element_at("geom", 1)
    return _rank_layer(spark, sf_dir).select(F.col("f0").cast("int").alias("rank"), F.col("f1").cast("int").alias("cross_id"), F.col("f2").cast("long").alias("total"), F.round(F.col("f3").cast("double"), 6).alias("entropy"), at["x"].alias("x"), at["y"].alias("y"))


def rank_layer_top(spark, sf_dir):
    return hot_ranking(_rank_layer(spark, sf_dir), 5)


def rank_list(spark, sf_dir):
    path = shared_path(spark, "ranks")
    phases.cross_entropy(base.phase_counts(spark, sf_dir)).select("cross_id", "total", F.round("entropy", 6).alias("entropy")).write.csv(path)
    return sinks.rank_points(text.read_rank(spark, path), fx.cross(spark)).select("cross_id", "count", "entropy", F.element_at("geom", 1)["x"].alias("x"))


def _work() -> list[str]:
    return text.make_work_list([f"/data/in/{d}/{c}/{c}-0.txt" for d in ("20240101", "20240102") for c in (3, 5)], "out/")


def work_list(spark, sf_dir):
    lines = ["# made", "", *_work(), "  "]
    return spark.createDataFrame(text.work_list(lines), "input string, output string")


def config(spark, sf_dir):
    found = text.read_config(text.config_text().replace("window=50", "window=200"))
    return spark.createDataFrame([(found.mean, found.deviation, found.radius, found.limit, found.beta, found.window)], "mean double, deviation double, radius double, `limit` int, beta double, `window` int")


def _edge_records(spark, sf_dir):
    return hotedges.virtual_edges(base._moves(spark, sf_dir), 0.8, 20)


def _quarter_bands(spark, sf_dir):
    given = base._records(spark, sf_dir).withColumn("eclass", F.floor(F.hour("enter") / 6).cast("int"))
    return clustering.pattern_bands(clustering.cost_patterns(given))


def _database(spark, sf_dir) -> str:
    folder = shared_path(spark, "database")
    made = sinks.virtual_edge_tables(_edge_records(spark, sf_dir), 1, "entropy", base.HOT, 20, 0.8)
    made["virtual_edge_metadata"] = sinks.with_patterns(made["virtual_edge_metadata"], _quarter_bands(spark, sf_dir))
    sinks.write_tables(made, folder)
    return folder


def virtual_edge_rows(spark, sf_dir):
    """The data table, written and read."""
    return tables.read_table(spark, "virtual_edge_data", _database(spark, sf_dir)).select(F.col("metadata_id").cast("int").alias("edge"), "n", "cost")


def edges_of_type(spark, sf_dir):
    meta = tables.read_table(spark, "virtual_edge_metadata", _database(spark, sf_dir))
    return tables.edges_of_type(meta, 1).select(F.col("id").cast("int").alias("id"), "start", "end", "pattern")


def high_level_map(spark, sf_dir):
    """The layer of virtual edges and the patterns of the database, loaded as the high-level graph."""
    records = _edge_records(spark, sf_dir)
    ends = trajectories.virtual_edge_endpoints(records.select(F.col("id").cast("int").alias("id"), F.col("c1").alias("start"), F.col("c2").alias("end")).distinct(), fx.cross(spark))
    counts = records.groupBy(F.col("id").cast("int").alias("id")).agg(F.count("*").cast("int").alias("count"))
    layer = shared_path(spark, "edges").removeprefix("file://").removeprefix("file:")
    sinks.write_virtual_edges(ends.join(counts, "id"), layer)
    meta = tables.read_table(spark, "virtual_edge_metadata", _database(spark, sf_dir))
    _, edges = tables.load_high_level_map(spark, layer, meta)
    return edges.select("edge", "src", "dst", "count", F.size("bands").alias("n_bands"), F.aggregate("bands", F.lit(0).cast("long"), lambda s, b: s + b["cost_ms"]).alias("cost_ms"))


def high_level_crosses(spark, sf_dir):
    records = _edge_records(spark, sf_dir)
    ends = trajectories.virtual_edge_endpoints(records.select(F.col("id").cast("int").alias("id"), F.col("c1").alias("start"), F.col("c2").alias("end")).distinct(), fx.cross(spark))
    layer = shared_path(spark, "edges").removeprefix("file://").removeprefix("file:")
    sinks.write_virtual_edges(ends.withColumn("count", F.lit(1)), layer)
    hot, _ = tables.load_high_level_map(spark, layer, tables.read_table(spark, "virtual_edge_metadata", _database(spark, sf_dir)))
    return hot


def classes_written_back(spark, sf_dir):
    """Classes of every other record, written back by id; the rest keep theirs."""
    kept = base._records(spark, sf_dir).select(F.monotonically_increasing_id().alias("row"), "*").withColumn("id", F.col("edge") * 1_000_000 + F.col("id")).drop("row")
    old = kept.withColumn("vclass", F.lit(7)).withColumn("eclass", F.lit(8))
    new = kept.where("id % 2 = 0").select("id", (F.col("id") % 3).cast("int").alias("vclass"), (F.col("id") % 5).cast("int").alias("eclass"))
    return clustering.updated(old, new).select("id", "vclass", "eclass")


def pattern_texts(spark, sf_dir):
    one = spark.createDataFrame([(0, _PATTERN)], "edge int, pattern string").select("edge", weights.parse_pattern(F.col("pattern")).alias("bands"))
    return one.select("edge", weights.pattern_text(F.col("bands")).alias("pattern"))


def all_trajectories(spark, sf_dir):
    return trajectories.select_ids(fx.traj_metadata(spark, sf_dir)).select("id")


def contained_roads(spark, sf_dir):
    return network.contained(fx.road(spark), spark.range(0, 400, 7).withColumnRenamed("id", "road_id").select(F.col("road_id").cast("int").alias("road_id")), "road_id")


def contained_classes(spark, sf_dir):
    return network.contained(fx.road(spark), spark.range(8).select(F.col("id").cast("int").alias("class")), "class")


def lookup_roads(spark, sf_dir):
    items = fx.road(spark).withColumn("kind", F.col("class")).select("road_id", "kind", "start_cross")
    return network.lookup(items, "kind", "road_id", spark.range(2, 6).select(F.col("id").cast("int").alias("kind"))).select("kind", "road_id", "start_cross")


def road_of_edges(spark, sf_dir):
    return network.road_of_edges(fx.edge(spark), fx.road(spark).select("road_id", "class", "direction")).select("src", "dst", "road_id", "class", "direction")


def edge_classes(spark, sf_dir):
    return network.with_edge_property(fx.edge(spark), fx.road(spark), "class").select("src", "dst", "road_id", "class")


def original_crosses(spark, sf_dir):
    path = fx.traj_data(spark, sf_dir).select("traj_id", "seq", F.col("cross_id").alias("cross_index"))
    index = spark.range(100).select(F.col("id").cast("int").alias("cross_index"), (1000 - F.col("id")).cast("int").alias("cross_id"))
    return trajectories.original_ids(path, index).select("traj_id", "seq", "cross_id")


def road_parts(spark, sf_dir):
    """The part of every road between the projections of two points beside it."""
    at = lambda c, i: F.element_at("geom", i)[c]
    start, end = G.point(at("x", 1) + 25, at("y", 1) + 10), G.point(at("x", 2) - 5, at("y", 2) - 30)
    part = fx.road(spark).withColumn("part", G.make_part_of_road(start, end, F.col("geom"), F.col("road_id"), F.col("start_cross"), F.col("end_cross")))
    line = G.part_geometry(F.col("part.start"), F.col("part.end"), F.col("geom"))
    return part.withColumn("line", line).select("road_id", F.col("part.start.param").alias("from"), F.col("part.end.param").alias("to"), F.col("part.length").alias("length"), F.size("line").alias("n"), F.element_at("line", 1)["x"].alias("x1"), F.element_at("line", -1)["y"].alias("y2"))


def cross_places(spark, sf_dir):
    return fx.cross(spark).withColumn("p", G.cross_project_point("cross_id", "x", "y")).select("p.*")


def path_lines(spark, sf_dir):
    """The line of a road and back, and that of two roads after one another, without the point they share."""
    a = fx.road(spark).select(F.col("end_cross").alias("via"), F.col("start_cross").alias("src"), F.col("geom").alias("g1"))
    b = fx.road(spark).select(F.col("start_cross").alias("via"), "end_cross", F.col("geom").alias("g2"))
    both = a.join(b, "via").withColumn("line", G.joined_lines(F.array("g1", "g2"))).withColumn("back", G.joined_lines(F.array(G.road_geometry("g2", "via", "end_cross"), G.road_geometry("g1", "src", "via"))))
    first = lambda c: F.element_at(c, 1)
    return both.select("src", "via", F.col("end_cross").alias("dst"), F.size("line").alias("n"), G.length("line").alias("length"), first("line")["x"].alias("x1"), first("line")["y"].alias("y1"), first("back")["x"].alias("x2"), first("back")["y"].alias("y2"))


def well_known_text(spark, sf_dir):
    made = fx.road(spark).select("road_id", G.to_wkt("geom").alias("wkt"))
    back = made.withColumn("line", G.from_wkt("wkt"))
    return back.select("road_id", "wkt", F.size("line").alias("n"), F.element_at("line", 1)["x"].alias("x1"), F.element_at("line", 2)["y"].alias("y2"))


def box_predicates(spark, sf_dir):
    box = F.struct(F.lit(500.0).alias("xmin"), F.lit(600.0).alias("ymin"), F.lit(200.0).alias("xmax"), F.lit(300.0).alias("ymax"))
    p = G.point("x", "y")
    right = fx.cross(spark).withColumn("box", G.correct(box))
    return right.select("cross_id", G.within(p, F.col("box")).alias("within"), G.covered_by(p, F.col("box")).alias("covered"), G.covered_by(p, G.expand(F.col("box"), F.lit(100.0))).alias("expanded"))


def box_layer(spark, sf_dir):
    """Search boxes of the first trajectories, as a polygon layer."""
    path = shared_path(spark, "boxes").removeprefix("file://").removeprefix("file:")
    sinks.write_boxes(_boxes(spark, sf_dir).orderBy("query_id"), path)
    back = read_shapefile(spark, path)
    return back.select(F.col("f0").cast("long").alias("query_id"), F.size("geom").alias("n"), F.element_at("geom", 1)["x"].alias("xmin"), F.element_at("geom", 3)["y"].alias("ymax"))


def _boxes(spark, sf_dir):
    on_map = trajectories.on_map(fx.traj_data(spark, sf_dir), fx.cross(spark))
    few = on_map.withColumn("_n", F.row_number().over(W.partitionBy("traj_id").orderBy("seq"))).where("_n <= 3")
    return timedep.search_box(few.select(F.col("traj_id").alias("query_id"), "x", "y"))


def search_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir).select("query_id", "box.*")


def trajectory_point_rows(spark, sf_dir):
    rows = sinks.trajectory_points(fx.traj_data(spark, sf_dir), fx.cross(spark))
    return rows.select("traj_id", "seq", F.col("INDEX").alias("cross_id"), F.col("TIME").alias("time"), F.element_at("geom", 1)["x"].alias("x"), F.element_at("geom", 1)["y"].alias("y"))


def trajectory_line_layer(spark, sf_dir):
    path = shared_path(spark, "lines").removeprefix("file://").removeprefix("file:")
    sinks.write_layer(sinks.trajectory_lines(fx.traj_data(spark, sf_dir), fx.cross(spark)).orderBy("traj_id", "seq"), path)
    return read_shapefile(spark, path).select(F.col("f0").cast("long").alias("traj_id"), F.col("f1").cast("long").alias("seq"), F.element_at("geom", 2)["x"].alias("x2"), F.element_at("geom", 2)["y"].alias("y2"))


def cross_layer(spark, sf_dir):
    path = shared_path(spark, "crosses").removeprefix("file://").removeprefix("file:")
    sinks.write_layer(fx.cross(spark).select("cross_id", F.array(G.point("x", "y")).alias("geom")).orderBy("cross_id"), path, POINT)
    return read_shapefile(spark, path).select("record", F.col("f0").cast("int").alias("cross_id"), F.element_at("geom", 1)["x"].alias("x"))


def foot_layer(spark, sf_dir):
    foot = footmark.on_graph(base.footmark_merged(spark, sf_dir), base._graph(spark, sf_dir))
    rows = sinks.foot_graph_layer(foot, fx.cross(spark))
    return rows.select(F.col("START").alias("start"), F.col("END").alias("end"), F.col("DBID").alias("edge"), F.col("COUNT").alias("n"), F.element_at("geom", 1)["x"].alias("x1"), F.element_at("geom", 2)["x"].alias("x2"))


def statuses(spark, sf_dir):
    points = fx.gps(spark, sf_dir)
    return sinks.status(points, points.where("traj_id % 3 <> 0").select("traj_id"), 60)


def edge_weights(spark, sf_dir):
    """Costs and arrivals of the graph's edges at three times of day."""
    times = spark.range(3).select((F.col("id") * 30_000_000_000).alias("t_us"))
    return timedep.weigh(base._graph(spark, sf_dir).join(F.broadcast(times), F.lit(True)), F.col("t_us")).select("edge", "t_us", "cost_ms", "arrival_us")


def estimation_costs(spark, sf_dir):
    entities = fx.edge(spark).select(F.col("src").cast("long").alias("path_id"), F.lit(0).alias("pos"), F.lit("road").alias("kind"), "road_id", F.col("weight").alias("length"))
    return timing.estimation_cost(entities, fx.road(spark)).select("path_id", *_r("cost_ms"))


def routed_speeds(spark, sf_dir):
    """Speed, time and crosses of the paths that route_crosses finds."""
    order = W.partitionBy("traj_id").orderBy("seq")
    pairs = fx.traj_data(spark, sf_dir).select(F.col("cross_id").alias("src"), F.lead("cross_id").over(order).alias("dst")).where("dst IS NOT NULL AND cross_id <> dst")
    found = routing.route_crosses(fx.road(spark), pairs).where("valid")
    return found.select("src", "dst", *_r("speed", "seconds"), F.array_join("crosses", ",").alias("crosses"))


def routed_astar(spark, sf_dir):
    """The lengths by A*."""
    order = W.partitionBy("traj_id").orderBy("seq")
    pairs = fx.traj_data(spark, sf_dir).select(F.col("cross_id").alias("src"), F.lead("cross_id").over(order).alias("dst")).where("dst IS NOT NULL")
    return routing.route_crosses(fx.road(spark), pairs, fx.cross(spark)).select("src", "dst", "length", "valid")


def _hot_grid(spark):
    return fx.cross(spark).where("cross_id % 9 = 4")


def endpoint_edges(spark, sf_dir):
    """Temporary edges that join cold crosses with the hot ones around them."""
    none = spark.createDataFrame([(10, 4, 13, [(0, 1, 2)])], f"edge int, src int, dst int, bands {weights.BANDS}")
    ends = fx.cross(spark).where("cross_id % 9 <> 4").select(F.col("cross_id").alias("id"), "cross_id", "x", "y", (F.col("cross_id") % 2 == 0).alias("outgoing"))
    found = timedep.attach_endpoints(none, _hot_grid(spark), fx.road(spark), ends)
    return found.select(F.col("id").cast("int").alias("id"), "edge", "src", "dst", F.element_at("bands", 1)["cost_ms"].alias("cost_ms"))


def attached_paths(spark, sf_dir):
    """Paths between ends that are not hot, over a graph of the hot crosses' neighbours."""
    hot = _hot_grid(spark)
    pairs = hot.select(F.col("cross_id").alias("c1")).join(hot.select(F.col("cross_id").alias("c2")), F.abs(F.col("c1") - F.col("c2")).isin(9, 18))
    graph = pipelines.flat_edges(pairs.withColumn("mean_cost", (F.col("c1") * 100 + F.col("c2")).cast("double")))
    queries = spark.range(6).select(F.col("id").alias("query_id"), (F.col("id") * 3).cast("int").alias("src"), (95 - F.col("id")).cast("int").alias("dst"), F.lit(0).cast("long").alias("t0_us"), F.lit(3_000_000_000).alias("latest_us"))
    return pipelines.attached_paths(graph, hot, fx.cross(spark), fx.road(spark), queries, 10).select("query_id", "k", "arrival_us", F.array_join("path.cross_id", ",").alias("path"))


def learned_edges(spark, sf_dir):
    """The whole plan from trajectories to the edges of the high-level graph."""
    found = pipelines.learn_edges(base._dense(spark, sf_dir), fx.hot_crosses(spark, base.HOT), fx.road(spark), 0.8, 20)
    return found.select(F.col("edge").cast("int").alias("edge"), "src", "dst", "count")


QUERIES = {f.__name__: f for f in (
    layer_roads, layer_crosses, layer_by_geometry, gps_files, streamed_logs, timed_path_files, timed_path_names, one_timed_path, rank_layer, rank_layer_top, rank_list, work_list, config,
    virtual_edge_rows, edges_of_type, high_level_map, high_level_crosses, classes_written_back, pattern_texts, all_trajectories, contained_roads, contained_classes, lookup_roads, road_of_edges,
    edge_classes, original_crosses, road_parts, cross_places, path_lines, well_known_text, box_predicates, box_layer, search_boxes, trajectory_point_rows, trajectory_line_layer, cross_layer,
    foot_layer, statuses, edge_weights, estimation_costs, routed_speeds, routed_astar, endpoint_edges, attached_paths, learned_edges,
)}


_MORE = {
    "rec": """ends AS (SELECT r.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM road r JOIN c a ON a.cross_id = start_cross JOIN c b ON b.cross_id = end_cross),
listed AS (SELECT road_id AS n, start_cross, end_cross, direction, class, CASE WHEN road_id % 5 = 0
    THEN sqrt(((x2 - x1) / 2 + 30) ** 2 + ((y2 - y1) / 2 + 40) ** 2) + sqrt(((x2 - x1) / 2 - 30) ** 2 + ((y2 - y1) / 2 - 40) ** 2) ELSE 100 END AS geo_length FROM ends
  UNION ALL SELECT road_id + 1000, start_cross, end_cross, 1, 4, 100 FROM ends WHERE road_id % 11 = 0),
rec AS (SELECT *, (row_number() OVER (ORDER BY n) - 1)::INTEGER AS road_id FROM listed),
seen AS (SELECT cross_id, (row_number() OVER (ORDER BY min(s)) - 1)::INTEGER AS number FROM (SELECT start_cross AS cross_id, 2 * road_id AS s FROM rec UNION ALL SELECT end_cross, 2 * road_id + 1 FROM rec) GROUP BY 1)""",
    "all_hops": "all_hops AS (SELECT cross_id AS src, cross_id AS dst, 0 AS h FROM c UNION SELECT all_hops.src, edge.dst, h + 1 FROM all_hops JOIN edge ON edge.src = all_hops.dst WHERE h < 30)",
    "routes": """far AS (SELECT src, dst, min(h) AS h FROM all_hops GROUP BY ALL),
before AS (SELECT a.src, a.dst, min(e.src) AS via FROM far a JOIN edge e ON e.dst = a.dst JOIN far b ON b.src = a.src AND b.dst = e.src AND b.h = a.h - 1 GROUP BY ALL),
walk AS (SELECT src, dst, dst AS at, 0 AS back FROM before UNION ALL SELECT w.src, w.dst, b.via, back + 1 FROM walk w JOIN before b ON b.src = w.src AND b.dst = w.at),
leg AS (SELECT w.src, w.dst, back, b.via AS u, w.at AS v, (SELECT min(road_id) FROM edge e WHERE e.src = b.via AND e.dst = w.at) AS road_id FROM walk w JOIN before b ON b.src = w.src AND b.dst = w.at),
routes AS (SELECT src, dst, 100.0::DOUBLE * count(*) AS length, sum(speed) / count(*) AS speed, sum(100 / speed) AS seconds, src || ',' || string_agg(v, ',' ORDER BY back DESC) AS crosses FROM leg JOIN road USING (road_id) GROUP BY src, dst)""",
    "bands": """recs AS (SELECT edge, t1, cost_ms, row_number() OVER (PARTITION BY edge ORDER BY t1, traj_id) AS id, t1 % 86400000000 AS us, t1 % 86400000000 // 21600000000 AS q FROM trimmed JOIN ids USING (c1, c2)),
band AS (SELECT edge, q, arg_min(us, (us // 1000000) * 1000000 + id) AS begin_us, floor(avg(cost_ms) / 1000 * 1000)::BIGINT AS cost FROM recs GROUP BY edge, q),
texts AS (SELECT edge, count(*) AS n, sum(floor(cost / 1000.0::DOUBLE * 1000))::BIGINT AS cost_ms,
  string_agg(strftime(make_timestamp(CASE WHEN f THEN 0 ELSE begin_us END), '%H:%M:%S') || '-' || CASE WHEN l THEN '24:00:00' ELSE strftime(make_timestamp(ends), '%H:%M:%S') END || ':' || (cost / 1000.0::DOUBLE)::VARCHAR, chr(10) ORDER BY q) AS pattern
  FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY q) = 1 AS f, row_number() OVER (PARTITION BY edge ORDER BY q DESC) = 1 AS l, lead(begin_us) OVER (PARTITION BY edge ORDER BY q) AS ends FROM band) GROUP BY edge)""",
    "boxes": """three AS (SELECT traj_id AS query_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY seq) AS n FROM d JOIN c USING (cross_id)) WHERE n <= 3),
boxes AS (SELECT query_id, min(x) - g AS xmin, min(y) - g AS ymin, max(x) + g AS xmax, max(y) + g AS ymax FROM (SELECT *, least(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w) AS g FROM three WINDOW w AS (PARTITION BY query_id)) GROUP BY query_id, g)""",
}


def _sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join({**_PARTS, **_MORE}[p] for p in parts) + "\n"


_ALL_PAIRS = "SELECT DISTINCT cross_id AS src, dst FROM (SELECT cross_id, lead(cross_id) OVER (PARTITION BY traj_id ORDER BY seq) AS dst FROM d)"
_EDGES = ("ev", "dense", "moves", "trimmed")
_ROUTES = ("c", "road", "edge", "all_hops", "routes")

ORACLE_SQL = {
    "layer_roads": _sql("c", "road", "rec") + "SELECT road_id, 'R' || n AS sid, direction, round(CASE class WHEN 4 THEN 70 WHEN 3 THEN 50 WHEN 2 THEN 40 ELSE 30 END / 3.6::DOUBLE, 6) AS speed, round(geo_length, 6) AS geo_length, a.number AS start_cross, b.number AS end_cross FROM rec JOIN seen a ON a.cross_id = start_cross JOIN seen b ON b.cross_id = end_cross",
    "layer_crosses": _sql("c", "road", "rec") + "SELECT number AS cross_id, 'X' || cross_id AS key, x, y FROM seen JOIN c USING (cross_id)",
    "layer_by_geometry": _sql("c", "road", "rec") + "SELECT road_id, 3 AS direction, a.number AS start_cross, b.number AS end_cross FROM rec JOIN seen a ON a.cross_id = start_cross JOIN seen b ON b.cross_id = end_cross",
    "gps_files": _sql("ev", "gps") + "SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS seq, '2024' AS day, epoch_us(date_trunc('second', ts)) AS ts_us, x, y FROM gps",
    "timed_path_files": _sql("ev", "dense") + "SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY seq) - 1 AS seq, cross_id, epoch_us(ts) AS ts_us FROM dense",
    "timed_path_names": _sql("ev", "dense") + "SELECT log, count(*) AS n, sum(cross_id)::BIGINT AS crosses FROM (SELECT cross_id, traj_id || CASE WHEN traj_id % 2 = 0 OR count(DISTINCT seq % 3) OVER (PARTITION BY traj_id) = 1 THEN '' ELSE '-' || (seq % 3) END AS log FROM dense) GROUP BY 1",
    "one_timed_path": _sql("ev", "dense") + "SELECT seq, cross_id, epoch_us(ts) AS ts_us FROM dense WHERE traj_id = 3",
    "rank_layer": _sql("c", "ev", "dense", "triples") + "SELECT (row_number() OVER (ORDER BY round(total::DOUBLE * total * entropy, 6) DESC, cross_id) - 1)::INTEGER AS rank, cross_id, total, round(entropy, 6) AS entropy, x, y FROM detail JOIN c USING (cross_id)",
    "rank_layer_top": _sql("ev", "dense", "triples") + "SELECT * FROM (SELECT (row_number() OVER (ORDER BY round(total::DOUBLE * total * entropy, 6) DESC, cross_id) - 1)::INTEGER AS rank, cross_id FROM detail) WHERE rank < 5",
    "rank_list": _sql("c", "ev", "dense", "triples") + 'SELECT cross_id, total AS "count", round(entropy, 6) AS entropy, x FROM detail JOIN c USING (cross_id)',
    "work_list": "SELECT '/data/in/' || d || '/' || c || '/' || c || '-0.txt' AS input, 'out/' || d || '/' || c || '/' || c || '-0.txt' AS output FROM (VALUES ('20240101'), ('20240102')) a(d), (VALUES (3), (5)) b(c)",
    "config": 'SELECT 5.0::DOUBLE AS mean, 20.0::DOUBLE AS deviation, 100.0::DOUBLE AS radius, 5 AS "limit", 5000.0::DOUBLE AS beta, 200 AS "window"',
    "virtual_edge_rows": _sql(*_EDGES) + "SELECT edge, (row_number() OVER (PARTITION BY edge ORDER BY cost_ms, t1) - 1)::INTEGER AS n, cost_ms AS cost FROM trimmed JOIN ids USING (c1, c2)",
    "edges_of_type": _sql(*_EDGES, "bands") + 'SELECT edge AS id, c1 AS start, c2 AS "end", pattern FROM ids JOIN texts USING (edge)',
    "high_level_map": _sql(*_EDGES, "bands") + 'SELECT edge, c1 AS src, c2 AS dst, (SELECT count(*) FROM trimmed t WHERE t.c1 = ids.c1 AND t.c2 = ids.c2)::INTEGER AS "count", n::INTEGER AS n_bands, cost_ms FROM ids JOIN texts USING (edge)',
    "high_level_crosses": _sql("c", *_EDGES) + "SELECT * FROM c WHERE cross_id IN (SELECT c1 FROM ids UNION SELECT c2 FROM ids)",
    "classes_written_back": _sql(*_EDGES) + ", numbered_rows AS (SELECT edge::BIGINT * 1000000 + row_number() OVER (PARTITION BY edge ORDER BY t1, traj_id) AS id FROM trimmed JOIN ids USING (c1, c2))\nSELECT id, (CASE WHEN id % 2 = 0 THEN id % 3 ELSE 7 END)::INTEGER AS vclass, (CASE WHEN id % 2 = 0 THEN id % 5 ELSE 8 END)::INTEGER AS eclass FROM numbered_rows",
    "pattern_texts": "SELECT 0 AS edge, '00:00:00-07:00:00:30.5' || chr(10) || '07:00:00-09:30:00:95.0' || chr(10) || '09:30:00-17:00:00:42.25' || chr(10) || '17:00:00-24:00:00:61.0' AS pattern",
    "all_trajectories": "SELECT DISTINCT user_id AS id FROM events",
    "contained_roads": _with("road") + "SELECT road_id FROM road WHERE road_id % 7 = 0",
    "contained_classes": _with("road") + "SELECT DISTINCT class FROM road WHERE class < 8",
    "lookup_roads": _with("road") + "SELECT class AS kind, max(road_id) AS road_id, arg_max(start_cross, road_id) AS start_cross FROM road GROUP BY 1",
    "road_of_edges": _with("road", "edge") + "SELECT src, dst, road_id, class, direction FROM edge JOIN road USING (road_id)",
    "edge_classes": _with("road", "edge") + "SELECT src, dst, road_id, class FROM edge JOIN road USING (road_id)",
    "original_crosses": _with("ev", "d") + "SELECT traj_id, seq, (1000 - cross_id)::INTEGER AS cross_id FROM d",
    "road_parts": _sql("c", "road") + """SELECT road_id, CASE WHEN across THEN 25.0 ELSE 10.0 END::DOUBLE AS "from", CASE WHEN across THEN 95.0 ELSE 70.0 END::DOUBLE AS "to", CASE WHEN across THEN 70.0 ELSE 60.0 END::DOUBLE AS length, 2 AS n,
  CASE WHEN across THEN a.x + 25 ELSE a.x END AS x1, CASE WHEN across THEN b.y ELSE b.y - 30 END AS y2
FROM (SELECT *, road_id % 2 = 0 AS across FROM road) r JOIN c a ON a.cross_id = start_cross JOIN c b ON b.cross_id = end_cross""",
    "cross_places": _sql("c") + "SELECT 'cross' AS type, cross_id AS \"index\", 0.0::DOUBLE AS param, x, y FROM c",
    "path_lines": _sql("c", "road") + "SELECT p.start_cross AS src, p.end_cross AS via, q.end_cross AS dst, 3 AS n, 200.0::DOUBLE AS length, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM road p JOIN road q ON q.start_cross = p.end_cross JOIN c a ON a.cross_id = p.start_cross JOIN c b ON b.cross_id = q.end_cross",
    "well_known_text": _sql("c", "road") + "SELECT road_id, 'LINESTRING(' || a.x || ' ' || a.y || ',' || b.x || ' ' || b.y || ')' AS wkt, 2 AS n, a.x AS x1, b.y AS y2 FROM road JOIN c a ON a.cross_id = start_cross JOIN c b ON b.cross_id = end_cross",
    "box_predicates": _sql("c") + 'SELECT cross_id, x > 200 AND x < 500 AND y > 300 AND y < 600 AS "within", x BETWEEN 200 AND 500 AND y BETWEEN 300 AND 600 AS covered, x BETWEEN 100 AND 600 AND y BETWEEN 200 AND 700 AS expanded FROM c',
    "box_layer": _sql("c", "ev", "d", "boxes") + "SELECT query_id, 5 AS n, xmin, ymax FROM boxes",
    "search_boxes": _sql("c", "ev", "d", "boxes") + "SELECT * FROM boxes",
    "trajectory_point_rows": _sql("c", "ev", "d") + "SELECT traj_id, seq, cross_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, x, y FROM d JOIN c USING (cross_id)",
    "trajectory_line_layer": _sql("c", "ev", "d") + "SELECT * FROM (SELECT traj_id, seq, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM d JOIN c USING (cross_id) WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) WHERE x2 IS NOT NULL",
    "cross_layer": _sql("c") + "SELECT cross_id::BIGINT AS record, cross_id, x FROM c",
    "foot_layer": _sql("c", *_EDGES).rstrip() + ",\n" + _footmark_sql(True) + ",\n" + _footmark_sql(False).split(",\n", 2)[2] + ', foot AS (SELECT query_id, c1, c2, sum(n)::BIGINT AS n FROM (SELECT * FROM foot_out WHERE n > 5 UNION ALL SELECT * FROM foot_in WHERE n > 5) GROUP BY ALL)\nSELECT c1 AS start, c2 AS "end", edge, n, a.x AS x1, b.x AS x2 FROM foot JOIN ids USING (c1, c2) JOIN c a ON a.cross_id = c1 JOIN c b ON b.cross_id = c2',
    "statuses": "SELECT user_id AS traj_id, CASE WHEN count(*) <= 60 THEN 'too short' WHEN user_id % 3 <> 0 THEN 'finished' ELSE 'match fail' END AS status FROM events GROUP BY 1",
    "edge_weights": _sql(*_EDGES) + "SELECT edge, t * 30000000000 AS t_us, cost AS cost_ms, t * 30000000000 + cost * 1000 AS arrival_us FROM (SELECT edge, floor(avg(cost_ms))::BIGINT AS cost FROM trimmed JOIN ids USING (c1, c2) GROUP BY 1), range(3) r(t)",
    "estimation_costs": _sql("road", "edge") + "SELECT src::BIGINT AS path_id, round(sum(weight / speed) * 1000, 6) AS cost_ms FROM edge JOIN road USING (road_id) GROUP BY 1",
    "routed_speeds": _sql(*_ROUTES, "ev", "d") + f"SELECT src, dst, round(speed, 6) AS speed, round(seconds, 6) AS seconds, crosses FROM ({_ALL_PAIRS}) JOIN routes USING (src, dst) WHERE src <> dst",
    "routed_astar": _sql("c", "road", "edge", "all_hops", "ev", "d") + f"SELECT src, dst, coalesce(100.0::DOUBLE * min(h), 'Infinity'::DOUBLE) AS length, min(h) IS NOT NULL AS valid FROM ({_ALL_PAIRS}) p LEFT JOIN all_hops USING (src, dst) WHERE dst IS NOT NULL GROUP BY src, dst",
    "endpoint_edges": _sql(*_ROUTES) + """, near AS (SELECT p.cross_id AS id, h.cross_id FROM (SELECT a.cross_id, any_value(a.x) AS x, any_value(a.y) AS y, least(1000, 1.1 * min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))) AS r FROM c a, c b WHERE a.cross_id % 9 <> 4 AND b.cross_id % 9 = 4 GROUP BY a.cross_id) p
  JOIN c h ON h.cross_id % 9 = 4 AND abs(h.x - p.x) < r AND abs(h.y - p.y) < r),
pair AS (SELECT id, CASE WHEN id % 2 = 0 THEN id ELSE cross_id END AS src, CASE WHEN id % 2 = 0 THEN cross_id ELSE id END AS dst FROM near)
SELECT id, (10 + row_number() OVER (PARTITION BY id ORDER BY src, dst))::INTEGER AS edge, src, dst, floor(seconds * 1000)::BIGINT AS cost_ms FROM pair JOIN routes USING (src, dst)""",
    "learned_edges": _sql(*_ROUTES, "ev", "dense", "moves") + """, able AS (SELECT m.*, (t2 - t1) // 1000 AS cost_ms FROM moves m JOIN routes r ON r.src = c1 AND r.dst = c2 WHERE (t2 - t1) // 1000 > floor(r.length / least(3 * r.speed, 33.3)) * 1000),
cheap AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY c1, c2) AS n, row_number() OVER (PARTITION BY c1, c2 ORDER BY cost_ms, traj_id, t1) AS r FROM able) WHERE r <= floor(n * 0.8) AND floor(n * 0.8) > 20)
SELECT (row_number() OVER (ORDER BY c1, c2) - 1)::INTEGER AS edge, c1 AS src, c2 AS dst, count(*) AS "count" FROM cheap GROUP BY c1, c2""",
    "streamed_logs": _sql("ev", "gps") + "SELECT count(*) AS n, sum(x) AS x, sum(y) AS y, strftime(min(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS first FROM gps",
}

_CANDIDATES = ", rolled AS" + _BASE_SQL["match_candidates"].split(", rolled AS", 1)[1].split("SELECT traj_id, seq, cand, road_id", 1)[0].rstrip()
_TRANSITIONS = """, cand AS (SELECT k.traj_id, k.seq, cand, k.road_id, px, py, 100 * t AS along, t IN (0, 1) AS here, CASE t WHEN 0 THEN k.start_cross ELSE k.end_cross END AS own, r.start_cross, r.end_cross, r.direction, r.speed
  FROM kept k JOIN road r USING (road_id) WHERE cand < 5),
leave AS (SELECT traj_id, seq, cand, own AS a, 0 AS off FROM cand WHERE here UNION ALL SELECT traj_id, seq, cand, end_cross, 100 - along FROM cand WHERE NOT here AND direction & 1 <> 0 UNION ALL SELECT traj_id, seq, cand, start_cross, along FROM cand WHERE NOT here AND direction & 2 <> 0),
reach AS (SELECT traj_id, seq, cand, own AS b, 0 AS off FROM cand WHERE here UNION ALL SELECT traj_id, seq, cand, start_cross, along FROM cand WHERE NOT here AND direction & 1 <> 0 UNION ALL SELECT traj_id, seq, cand, end_cross, 100 - along FROM cand WHERE NOT here AND direction & 2 <> 0),
hop AS (SELECT * FROM (SELECT traj_id, seq, lead(seq) OVER w AS seq2, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS gone, (lead(epoch_us(ts)) OVER w - epoch_us(ts)) // 1000000 AS took FROM gps WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) WHERE seq2 IS NOT NULL),
way AS (SELECT * FROM (SELECT s.traj_id, s.seq, l.cand AS c1, e.cand AS c2, l.off AS off1, e.off AS off2, f.h, l.off + 100.0::DOUBLE * f.h + e.off AS length, coalesce(t.speed, 0) AS through,
    row_number() OVER (PARTITION BY s.traj_id, s.seq, l.cand, e.cand ORDER BY l.off + 100.0::DOUBLE * f.h + e.off, l.a, e.b) AS n
  FROM hop s JOIN leave l ON l.traj_id = s.traj_id AND l.seq = s.seq JOIN reach e ON e.traj_id = s.traj_id AND e.seq = s.seq2 JOIN far f ON f.src = l.a AND f.dst = e.b LEFT JOIN routes t ON t.src = l.a AND t.dst = e.b) WHERE n = 1),
pair AS (SELECT s.traj_id, s.seq, s.gone, s.took, p.cand AS c1, q.cand AS c2, p.speed AS speed1, q.speed AS speed2, p.px = q.px AND p.py = q.py AS same, NOT p.here AND NOT q.here AND p.road_id = q.road_id AS one, p.along AS along1, q.along AS along2, p.direction
  FROM hop s JOIN cand p ON p.traj_id = s.traj_id AND p.seq = s.seq JOIN cand q ON q.traj_id = s.traj_id AND q.seq = s.seq2),
found AS (SELECT pair.*, CASE WHEN same THEN 0 WHEN one THEN CASE WHEN direction = 3 OR (direction = 1 AND along1 <= along2) OR (direction = 2 AND along1 >= along2) THEN abs(along1 - along2) ELSE 0 END ELSE way.length END AS length,
    CASE WHEN same THEN 0 WHEN one THEN speed1 ELSE (off1 * speed1 + off2 * speed2 + 100 * h * through) / nullif(way.length, 0) END AS own
  FROM pair LEFT JOIN way USING (traj_id, seq, c1, c2)),
told AS (SELECT *, CASE WHEN length > 0 THEN own ELSE 0 END AS speed, CASE WHEN took <> 0 THEN coalesce(length, 'Infinity'::DOUBLE) / took ELSE 'Infinity'::DOUBLE END AS mean FROM found)
SELECT traj_id, seq, c1, c2, CASE WHEN length IS NULL THEN '-Infinity'::DOUBLE ELSE round(least(((gone + 1) / (length + 1)) ** 2, sqrt((length + 1) / (gone + 1))), 6) END AS v,
  CASE WHEN coalesce(speed, 0) = 0 THEN 1.0 ELSE round(speed / (abs(mean - speed) + speed), 6) END::DOUBLE AS ft FROM told"""
_PASS = """, score AS (SELECT traj_id, seq, c1, c2, v * ft AS s FROM moved),
place AS MATERIALIZED (SELECT traj_id, seq, cand, round(greatest(1e-8, exp(-(dist - 5) * (dist - 5) / 800) / (sqrt(2 * pi()) * 20)), 9) AS e, dense_rank() OVER (PARTITION BY traj_id ORDER BY seq) AS pos FROM kept WHERE cand < 5),
gain AS MATERIALIZED (SELECT p.traj_id, p.pos, c1, c2, q.e * s AS g FROM score JOIN place p ON p.traj_id = score.traj_id AND p.seq = score.seq AND p.cand = c1 JOIN place q ON q.traj_id = p.traj_id AND q.pos = p.pos + 1 AND q.cand = c2),
pass AS MATERIALIZED (SELECT traj_id, pos, cand, e AS f, -1 AS prev FROM place WHERE pos = 1
  UNION ALL SELECT traj_id, pos + 1, c2, m.f, -m.n FROM (SELECT p.traj_id, p.pos, g.c2, max({'f': p.f + g.g, 'n': -g.c1}) AS m FROM pass p JOIN gain g ON g.traj_id = p.traj_id AND g.pos = p.pos AND g.c1 = p.cand GROUP BY ALL)),
ending AS (SELECT traj_id, pos, -max({'f': f, 'n': -cand}).n AS cand, max(f) AS f FROM pass WHERE (traj_id, pos) IN (SELECT traj_id, max(pos) FROM place GROUP BY 1) GROUP BY ALL),
trace AS (SELECT traj_id, pos, cand FROM ending WHERE f > '-Infinity'::DOUBLE UNION ALL SELECT t.traj_id, t.pos - 1, p.prev FROM trace t JOIN pass p ON p.traj_id = t.traj_id AND p.pos = t.pos AND p.cand = t.cand WHERE t.pos > 1)
SELECT t.traj_id, p.seq, t.cand::INTEGER AS cand FROM trace t JOIN place p USING (traj_id, pos, cand)"""
_FLAT = """, w AS (SELECT c1, c2, floor(avg(cost_ms))::BIGINT * 1000 AS cost FROM trimmed GROUP BY ALL)"""

#: SQL of queries of the other module that needs the routes or the graph.
ROUTE_SQL = {
    "transition_scores": _sql(*_ROUTES, "ev", "gps", "near") + _CANDIDATES + _TRANSITIONS,
    "st_match": _sql(*_ROUTES, "ev", "gps", "near") + _CANDIDATES + _TRANSITIONS.replace("FROM found)\nSELECT traj_id, seq, c1, c2, CASE", "FROM found),\nmoved AS (SELECT traj_id, seq, c1, c2, CASE")+ ")" + _PASS,
    "earliest_arrival": _sql(*_EDGES) + _FLAT + """, trip AS (SELECT i::INTEGER AS src, i::INTEGER AS dst, 0::BIGINT AS cost, 0 AS h FROM range(6) t(i) UNION SELECT trip.src, w.c2, trip.cost + w.cost, h + 1 FROM trip JOIN w ON w.c1 = trip.dst WHERE h < 5)
SELECT i AS query_id, (i % 6)::INTEGER AS src, (i // 6)::INTEGER AS dst, i * 60000000 AS t0_us, i * 60000000 + (SELECT min(cost) FROM trip WHERE trip.src = i % 6 AND trip.dst = i // 6)::BIGINT AS arrival_us FROM range(36) t(i)""",
    "k_shortest": _sql(*_EDGES) + _FLAT + """, trip AS (SELECT i AS query_id, i::INTEGER AS stop, 0::BIGINT AS arrival_us, [i::INTEGER] AS path FROM range(6) t(i)
  UNION ALL SELECT query_id, w.c2, arrival_us + w.cost, list_append(path, w.c2) FROM trip JOIN w ON w.c1 = trip.stop WHERE NOT list_contains(path, w.c2) AND trip.stop <> (query_id + 2) % 6)
SELECT query_id, k, arrival_us, path FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY arrival_us) - 1)::INTEGER AS k, arrival_us, array_to_string(path, ',') AS path FROM trip WHERE stop = (query_id + 2) % 6)
WHERE k < 8 AND (k = 0 OR arrival_us <= 80000000000)""",
    "plausible_transitions": _sql(*_ROUTES, "ev", "dense", "moves") + "SELECT c1, c2, count(*) AS n FROM moves JOIN routes r ON r.src = c1 AND r.dst = c2 WHERE (t2 - t1) // 1000 > floor(r.length / least(3 * r.speed, 33.3)) * 1000 GROUP BY ALL",
    "spread_times": _sql(*_ROUTES, "ev", "d") + f""", step AS (SELECT l.src, l.dst, v, (count(*) OVER (PARTITION BY l.src, l.dst) - 1 - back)::INTEGER AS pos, 100 / speed * 1000 AS ms, sum(100 / speed * 1000) OVER (PARTITION BY l.src, l.dst) AS total
  FROM ({_ALL_PAIRS}) p JOIN leg l ON l.src = p.src AND l.dst = p.dst AND p.src <> p.dst JOIN road USING (road_id))
SELECT src::BIGINT * 100 + dst AS path_id, pos, v AS cross_id, sum(floor(ms * (59999 / total))::BIGINT * 1000) OVER (PARTITION BY src, dst ORDER BY pos)::BIGINT AS tod_us FROM step""",
    "lcs_rate": _sql("ev", "dense") + """, line AS (SELECT traj_id, list(cross_id ORDER BY seq) AS a FROM dense GROUP BY 1),
pair AS (SELECT p.traj_id, p.a, q.a AS b FROM line p JOIN line q ON q.traj_id = p.traj_id + 1),
row_ AS (SELECT traj_id, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS r FROM pair
  UNION ALL SELECT p.traj_id, i + 1, list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(1, j + 2), lambda k: CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN r[k - 1] + 1 ELSE r[k] END)))
  FROM row_ JOIN pair p USING (traj_id) WHERE i < len(a))
SELECT traj_id, r[len(b) + 1]::INTEGER AS lcs, round(2.0::DOUBLE * r[len(b) + 1] / (len(a) + len(b)), 6) AS rate FROM row_ JOIN pair USING (traj_id) WHERE i = len(a)""",
}
