"""Queries over the supplied tables, with the SQL of those that SQL can express.

Doubles are rounded to six places on both sides. The SQL is written independently of the plans: brute-force
joins for spatial queries, recursion for shortest paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import weights
from .functions.geometry import point
from .operators import clustering, evaluate, footmark, hotedges, matching, network, phases, routing, spatial, timedep, timing, trajectories, whole_logs
from .operators.matching import MatchParameters
from .plans import pipelines

#: Crosses that dense trajectories use, and those of them that count as hot.
DENSE, HOT = 12, 6
RADIUS = 30.0
MATCH = MatchParameters()


def _r(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _dense(spark, sf_dir):
    return fx.traj_data(spark, sf_dir, DENSE)


def phase_counts(spark, sf_dir):
    return phases.phase_counts(_dense(spark, sf_dir))


def cross_entropy_rank(spark, sf_dir):
    ranked = phases.rank_crosses(phases.cross_entropy(phase_counts(spark, sf_dir)))
    return ranked.select(F.col("rank").cast("int").alias("rank"), "cross_id", "total", *_r("entropy"))


def cross_count_rank(spark, sf_dir):
    ranked = phases.rank_crosses(phases.cross_entropy(phase_counts(spark, sf_dir)), "count")
    return ranked.select(F.col("rank").cast("int").alias("rank"), "cross_id", "total")


def _located(spark, sf_dir):
    return trajectories.on_map(fx.traj_data(spark, sf_dir), fx.cross(spark))


def turn_totals(spark, sf_dir):
    return phases.turn_totals(_located(spark, sf_dir))


def turn_totals_compat(spark, sf_dir):
    return phases.turn_totals(_located(spark, sf_dir), compat=True)


def turn_score(spark, sf_dir):
    return phases.turn_score(_located(spark, sf_dir))


def weekday_trajectories(spark, sf_dir):
    return trajectories.select_ids(fx.traj_metadata(spark, sf_dir), trajectories.WEEKDAYS).select("id", F.col("date").cast("string").alias("date"))


def weekday_points(spark, sf_dir):
    ids = weekday_trajectories(spark, sf_dir)
    return trajectories.points_of(fx.traj_data(spark, sf_dir), ids).groupBy("traj_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def trajectory_slice(spark, sf_dir):
    return trajectories.trajectory_slice(fx.traj_data(spark, sf_dir), fx.traj_metadata(spark, sf_dir), "2024-01-01", 3, 0, 2, 20).select("seq", "cross_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


def hot_points(spark, sf_dir):
    return trajectories.keep_hot(fx.traj_data(spark, sf_dir), fx.hot_crosses(spark, 30)).select("traj_id", "seq", "cross_id")


def trimmed_points(spark, sf_dir):
    return trajectories.trim_to_hot(fx.traj_data(spark, sf_dir), fx.hot_crosses(spark, 5)).select("traj_id", "seq", "cross_id")


def long_logs(spark, sf_dir):
    return trajectories.long_enough(fx.gps(spark, sf_dir), 60).groupBy("traj_id").agg(F.count("*").alias("n"))


def distinct_points(spark, sf_dir):
    return trajectories.without_repeats(fx.traj_data(spark, sf_dir, 3)).groupBy("traj_id").agg(F.count("*").alias("n"))


def edge_list(spark, sf_dir):
    return fx.edge(spark)


def successors(spark, sf_dir):
    return network.successors(fx.edge(spark), fx.cross(spark))


def predecessors(spark, sf_dir):
    return network.predecessors(fx.edge(spark), fx.cross(spark))


def _pairs(spark):
    i = F.col("id").cast("int")
    return spark.range(100).select(i.alias("src"), F.explode(F.array(i + 1, i + 10, i - 1, i - 10, (i * 7 + 3) % 100)).alias("dst"))


def find_road_oneway(spark, sf_dir):
    return network.find_road_oneway(fx.edge(spark), _pairs(spark))


def find_road_any(spark, sf_dir):
    return network.find_road_any(fx.edge(spark), _pairs(spark))


def network_sizes(spark, sf_dir):
    return network.sizes(fx.cross(spark), fx.road(spark), fx.edge(spark))


def edge_properties(spark, sf_dir):
    return network.with_edge_property(fx.edge(spark), fx.road(spark), "seconds", "weight / speed").select("src", "dst", "road_id", *_r("seconds"))


def property_lookup(spark, sf_dir):
    return network.property_index(fx.road(spark).withColumn("kind", F.col("class")), "kind", "road_id")


def cross_range(spark, sf_dir):
    return spatial.cross_range(fx.gps(spark, sf_dir), fx.cross(spark), RADIUS).select("traj_id", "seq", "cross_id", *_r("dist"), "rn")


def road_range(spark, sf_dir):
    return spatial.road_range(fx.gps(spark, sf_dir), fx.road(spark), RADIUS).select("traj_id", "seq", "road_id", *_r("dist"), "rn")


def nearest_project(spark, sf_dir):
    found = spatial.nearest_project(fx.gps(spark, sf_dir), fx.road(spark))
    return found.select("traj_id", "seq", "road_id", F.col("pp.type").alias("type"), F.round("pp.x", 6).alias("x"), F.round("pp.y", 6).alias("y"), F.round("pp.param", 6).alias("param"))


def nearby_hot(spark, sf_dir):
    hot = fx.cross(spark).where("cross_id % 9 = 4")
    points = fx.cross(spark).where("cross_id % 9 <> 4").select(F.col("cross_id").alias("id"), "x", "y")
    return spatial.nearby_hot(points, hot)


def box_crosses(spark, sf_dir):
    box = F.struct(F.lit(100.0).alias("xmin"), F.lit(150.0).alias("ymin"), F.lit(500.0).alias("xmax"), F.lit(650.0).alias("ymax"))
    return spatial.within_box(fx.cross(spark), box)


def match_candidates(spark, sf_dir):
    found = matching.match_candidates(fx.gps(spark, sf_dir), fx.road(spark))
    return found.select("traj_id", "seq", F.col("cand").cast("int").alias("cand"), "road_id", F.round("emission", 9).alias("emission"))


def hot_transitions(spark, sf_dir):
    return hotedges.transition_counts(hotedges.hot_transitions(_dense(spark, sf_dir), fx.hot_crosses(spark, HOT)))


def _moves(spark, sf_dir):
    return hotedges.hot_transitions(_dense(spark, sf_dir), fx.hot_crosses(spark, HOT))


def plausible_transitions(spark, sf_dir):
    moves = _moves(spark, sf_dir)
    routes = routing.route_crosses(fx.road(spark), moves.select(F.col("c1").alias("src"), F.col("c2").alias("dst")))
    return hotedges.transition_counts(hotedges.plausible(moves, routes))


def virtual_edges_trimmed(spark, sf_dir):
    summary = hotedges.edge_summary(hotedges.virtual_edges(_moves(spark, sf_dir), 0.8, 20))
    return summary.select("c1", "c2", "n", F.round("mean_cost", 3).alias("mean_cost"))


def virtual_edge_endpoints(spark, sf_dir):
    kept = hotedges.virtual_edges(_moves(spark, sf_dir), 0.8, 20).select("id", F.col("c1").alias("start"), F.col("c2").alias("end")).distinct()
    return trajectories.virtual_edge_endpoints(kept.withColumn("id", F.col("id").cast("int")), fx.cross(spark))


def shortest_paths(spark, sf_dir):
    """All distances from four crosses, by the loop of joins."""
    return routing.relaxed_distances(fx.edge(spark), fx.cross(spark).where("cross_id IN (0, 37, 55, 99)"))


def routed_crosses(spark, sf_dir):
    """Lengths of the shortest paths between all pairs that follow one another on a trajectory, by searches."""
    order = W.partitionBy("traj_id").orderBy("seq")
    pairs = fx.traj_data(spark, sf_dir).select(F.col("cross_id").alias("src"), F.lead("cross_id").over(order).alias("dst")).where("dst IS NOT NULL")
    return routing.route_crosses(fx.road(spark), pairs).select("src", "dst", "length", "valid")


def _candidates(spark, sf_dir):
    points = fx.gps(spark, sf_dir)
    return points, matching.match_candidates(points, fx.road(spark), MATCH).persist()


def transition_scores(spark, sf_dir):
    points, found = _candidates(spark, sf_dir)
    return matching.transitions(points, found, fx.road(spark)).select("traj_id", "seq", "c1", "c2", *_r("v", "ft"))


def st_match(spark, sf_dir):
    """One pass over emissions and scores rounded to nine and six places: ties are then the same wherever they are made."""
    points, found = _candidates(spark, sf_dir)
    moves = matching.transitions(points, found, fx.road(spark)).withColumns({c: F.round(c, 6) for c in ("v", "ft")})
    return matching.st_match(found.withColumn("emission", F.round("emission", 9)), moves)


def ivmm_match(spark, sf_dir):
    found = pipelines.match_logs(fx.gps(spark, sf_dir), fx.road(spark), MATCH)
    return found.votes.where("chosen").select("traj_id", "seq", "cand", "vote")


def match_ranges(spark, sf_dir):
    return pipelines.match_logs(fx.gps(spark, sf_dir), fx.road(spark), MATCH).ranges


def timed_path(spark, sf_dir):
    return pipelines.match_logs(fx.gps(spark, sf_dir), fx.road(spark), MATCH).timed


def _records(spark, sf_dir):
    kept = hotedges.virtual_edges(_moves(spark, sf_dir), 0.8, 20)
    order = W.partitionBy("id").orderBy("enter", "traj_id")
    return kept.select(F.col("id").cast("int").alias("edge"), F.row_number().over(order).cast("long").alias("id"), "enter", "cost_ms")


def cost_classes(spark, sf_dir):
    return clustering.cost_classes(_records(spark, sf_dir)).select("edge", "id", "vclass", "eclass")


def cost_patterns(spark, sf_dir):
    """Patterns of given classes: a quarter of the day each."""
    given = _records(spark, sf_dir).withColumn("eclass", F.floor(F.hour("enter") / 6).cast("int"))
    return clustering.cost_patterns(given).select("edge", "begin_us", "end_us", *_r("seconds"))


def learned_patterns(spark, sf_dir):
    return clustering.cost_patterns(clustering.cost_classes(_records(spark, sf_dir))).select("edge", "begin_us", "end_us", *_r("seconds"))


_PATTERN = "00:10:00-07:00:00:30.5\n07:00:00-09:30:00:95\n09:30:00-17:00:00:42.25\n17:00:00-23:00:00:61"


def weight_at(spark, sf_dir):
    # Patterns are parsed once an edge, then joined to the times.
    edges = spark.createDataFrame([(0, _PATTERN)], "edge int, pattern string").select("edge", weights.parse_pattern(F.col("pattern")).alias("bands")).persist()
    bands = F.col("bands")
    t = F.expr("((hour(ts) * 60 + minute(ts)) * 60 + second(ts)) * 1000000L").alias("t_us")
    times = fx.traj_data(spark, sf_dir).select("traj_id", "seq", t, (F.col("seq") * 0).cast("int").alias("edge")).join(edges, "edge")
    return times.select("traj_id", "seq", "t_us", weights.weight_at(bands, F.col("t_us")).alias("compat"), weights.weight_at(bands, F.col("t_us"), "containing").alias("containing"))


def _graph(spark, sf_dir):
    return pipelines.flat_edges(hotedges.edge_summary(hotedges.virtual_edges(_moves(spark, sf_dir), 0.8, 20)))


def earliest_arrival(spark, sf_dir):
    queries = spark.range(HOT * HOT).select(F.col("id").alias("query_id"), (F.col("id") % HOT).cast("int").alias("src"), F.floor(F.col("id") / HOT).cast("int").alias("dst"), (F.col("id") * 60_000_000).alias("t0_us"))
    return timedep.earliest_arrival(_graph(spark, sf_dir), queries).select("query_id", "src", "dst", "t0_us", "arrival_us")


def k_shortest(spark, sf_dir):
    queries = spark.range(HOT).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("src"), ((F.col("id") + 2) % HOT).cast("int").alias("dst"), F.lit(0).cast("long").alias("t0_us"), F.lit(80_000_000_000).alias("latest_us"))
    return timedep.k_shortest_paths(_graph(spark, sf_dir), queries, 8).select("query_id", "k", "arrival_us", F.col("path.cross_id").alias("path")).withColumn("path", F.array_join("path", ","))


def _foot_queries(spark):
    box = F.struct(F.lit(-1.0).alias("xmin"), F.lit(-1.0).alias("ymin"), F.lit(1101.0).alias("xmax"), F.lit(901.0).alias("ymax"))
    return spark.range(3).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("start_cross"), (F.col("id") + 3).cast("int").alias("end_cross"), F.lit(40_000).alias("seconds"), box.alias("box"))


def _foot(spark, sf_dir, outward):
    located = trajectories.on_map(_dense(spark, sf_dir), fx.cross(spark))
    return footmark.footmarks(located, _foot_queries(spark), fx.hot_crosses(spark, HOT), outward)


def footmark_out(spark, sf_dir):
    return _foot(spark, sf_dir, True)


def footmark_in(spark, sf_dir):
    return _foot(spark, sf_dir, False)


def footmark_merged(spark, sf_dir):
    return footmark.merged(_foot(spark, sf_dir, True), _foot(spark, sf_dir, False), 5)


def _sequences(spark, sf_dir):
    ordered = F.sort_array(F.collect_list(F.struct("seq", "cross_id")))
    return _dense(spark, sf_dir).groupBy("traj_id").agg(F.transform(ordered, lambda v: v["cross_id"]).alias("crosses"))


def lcs_rate(spark, sf_dir):
    """Every trajectory against the next one."""
    a = _sequences(spark, sf_dir)
    b = a.select((F.col("traj_id") - 1).alias("traj_id"), F.col("crosses").alias("other"))
    pairs = a.join(b, "traj_id")
    return pairs.select("traj_id", evaluate.lcs_length(F.col("crosses"), F.col("other")).alias("lcs"), F.round(evaluate.lcs_rate(F.col("crosses"), F.col("other")), 6).alias("rate"))


def restore_metrics(spark, sf_dir):
    """Metrics over candidates given by the orders table."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    given = o.select((F.col("o_custkey") % 50).cast("long").alias("query_id"), k, ((k * 7) % 100 / 100.0).alias("lcs_rate"), ((k * 13) % 100 / 100.0).alias("lcs_rate_hot"), (k % 4).alias("lefts_hot"), (k % 3).alias("rights_hot"), (k % 5).alias("straights_hot"), F.array((k % 20).cast("int"), (k % 30).cast("int")).alias("crosses"), F.array((k % 6).cast("int")).alias("crosses_hot"))
    given = given.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("o_orderkey")) - 1).drop("o_orderkey")
    q = given.select("query_id").distinct()
    truth = q.select("query_id", F.lit(0.5).alias("base_rate"), F.lit(0.4).alias("base_rate_hot"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i).alias("crosses"), F.array(*[F.lit(i) for i in range(3)]).alias("crosses_hot"))
    grid = spark.createDataFrame([(s, l, r) for s in (0, 1) for l in (0, 2) for r in (0, 1)], "straight int, left int, right int")
    out = evaluate.restore_metrics(given, truth, grid)
    return out.select("query_id", "straight", "left", "right", F.col("n_candidate"), F.col("contains_shortest"), *[F.round(m, 6).alias(m) for m in evaluate.METRICS if m not in ("n_candidate", "contains_shortest")])


def window_study(spark, sf_dir):
    """Matched crosses of all logs under windows of 2 and 5 points, against the unbounded one."""
    points = fx.gps(spark, sf_dir)
    roads = fx.road(spark)
    order = W.partitionBy("traj_id").orderBy("seq")
    found = matching.match_candidates(whole_logs.with_steps(points.repartition("traj_id"), order).sortWithinPartitions("traj_id", "seq"), roads, MATCH)
    paths = None
    for w in (-1, 2, 5):
        paths_ = matching.whole_paths(whole_logs.matched(found, roads, MatchParameters(window=w), True)).repartition("traj_id")
        each = paths_.where("valid").select("traj_id", "seq", F.posexplode("entities").alias("pos", "e")).select("traj_id", "seq", "pos", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("e.from_cross").alias("c")), F.struct(F.lit(1).alias("k"), F.col("e.to_cross").alias("c")))).alias("v")).where("v.c IS NOT NULL")
        previous = F.lag("v.c").over(W.partitionBy("traj_id", "seq").orderBy("pos", "v.k"))
        kept = each.withColumn("_p", previous).where("_p IS NULL OR _p <> v.c")
        line = F.sort_array(F.collect_list(F.struct("seq", "pos", "v.k", "v.c")))
        own = kept.groupBy("traj_id").agg(F.transform(line, lambda s: s["c"]).alias("crosses")).withColumn("window", F.lit(w))
        paths = own if paths is None else paths.unionByName(own)
    return evaluate.window_study(paths).select("window", *_r("avg_rate"))


def restored(spark, sf_dir):
    """The whole restoration of a few slices over the graph that the trajectories teach."""
    # A thousandth of the time: the events' days become minutes, as slices of a day need.
    epoch = F.lit("2024-01-01 00:00:00").cast("timestamp")
    quick = F.timestamp_micros(F.unix_micros(epoch) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(epoch)) / 1000))
    # Every ninth cross, so that boxes around paths have an inside.
    data = _dense(spark, sf_dir).withColumn("ts", quick).withColumn("cross_id", F.col("cross_id") * 9)
    hot, crosses = fx.hot_crosses(spark, HOT).withColumn("cross_id", F.col("cross_id") * 9), fx.cross(spark)
    numbered = data.join(hot, "cross_id").withColumn("_n", F.row_number().over(W.partitionBy("traj_id").orderBy("seq")))
    spans = numbered.where("_n IN (1, 6)").groupBy("traj_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).where("first_seq < last_seq")
    queries = spans.select(F.col("traj_id").alias("query_id"), "traj_id", "first_seq", "last_seq")
    moves = hotedges.hot_transitions(data, hot)
    graph = pipelines.flat_edges(hotedges.edge_summary(hotedges.virtual_edges(moves, 0.8, 20)))
    grid = spark.createDataFrame([(0, 2, 1)], "straight int, left int, right int")
    return pipelines.restore(data, queries, graph, hot, crosses, grid, more_than=1)


def spread_times(spark, sf_dir):
    """Nominal times of the routes between neighbouring points, stretched over a prime number of ms: cuts to whole ms don't hang on rounding."""
    order = W.partitionBy("traj_id").orderBy("seq")
    pairs = fx.traj_data(spark, sf_dir).select(F.col("cross_id").alias("src"), F.lead("cross_id").over(order).alias("dst")).where("dst IS NOT NULL AND cross_id <> dst")
    routes = routing.route_crosses(fx.road(spark), pairs).where("valid").withColumn("path_id", F.col("src").cast("long") * 100 + F.col("dst"))
    entities = routes.select("path_id", F.posexplode("entities").alias("pos", "e")).select("path_id", "pos", "e.*")
    spans = routes.select("path_id", F.lit(0).cast("long").alias("start_us"), F.lit(59_999_000).cast("long").alias("end_us"))
    return timing.spread_time(entities, fx.road(spark), spans).select("path_id", "pos", "cross_id", "tod_us")


QUERIES = {f.__name__: f for f in (
    cross_entropy_rank, cross_count_rank, phase_counts, turn_totals, turn_totals_compat, turn_score, weekday_trajectories, weekday_points, trajectory_slice, hot_points, trimmed_points,
    long_logs, distinct_points, edge_list, successors, predecessors, find_road_oneway, find_road_any, network_sizes, edge_properties, property_lookup, cross_range, road_range, nearest_project,
    nearby_hot, box_crosses, match_candidates, hot_transitions, plausible_transitions, virtual_edges_trimmed, virtual_edge_endpoints, shortest_paths, routed_crosses, transition_scores, st_match,
    ivmm_match, match_ranges, timed_path, cost_classes, cost_patterns, learned_patterns, weight_at, earliest_arrival, k_shortest, footmark_out, footmark_in, footmark_merged, lcs_rate,
    restore_metrics, window_study, restored, spread_times,
)}


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(_PARTS[p] for p in parts) + "\n"


_PARTS = {
    "c": "c AS (SELECT i::INTEGER AS cross_id, 100.0::DOUBLE * (i % 10) AS x, 100.0::DOUBLE * (i // 10) AS y FROM range(100) t(i))",
    "road": """road AS (
  SELECT *, CASE start_cross % 7 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 3 END AS direction, 2 + start_cross % 4 AS class,
    CASE 2 + start_cross % 4 WHEN 4 THEN 70 WHEN 3 THEN 50 WHEN 2 THEN 40 ELSE 30 END / 3.6::DOUBLE AS speed
  FROM (SELECT (2 * i)::INTEGER AS road_id, i::INTEGER AS start_cross, (i + 1)::INTEGER AS end_cross FROM range(100) t(i) WHERE i % 10 < 9
    UNION ALL SELECT (2 * i + 1)::INTEGER, i::INTEGER, (i + 10)::INTEGER FROM range(90) t(i)))""",
    "edge": """edge AS (
  SELECT start_cross AS src, end_cross AS dst, road_id, 100.0::DOUBLE AS weight FROM road WHERE direction & 1 <> 0
  UNION ALL SELECT end_cross, start_cross, road_id, 100.0::DOUBLE FROM road WHERE direction & 2 <> 0)""",
    "ev": "ev AS (SELECT user_id AS traj_id, event_id AS seq, json_extract_string(props, '$.k')::INTEGER AS k, ts, value FROM events)",
    "d": "d AS (SELECT traj_id, seq, k AS cross_id, ts FROM ev)",
    "dense": f"dense AS (SELECT traj_id, seq, k % {DENSE} AS cross_id, ts FROM ev)",
    "gps": "gps AS (SELECT traj_id, seq, ts, (100.0 * (k % 10) + floor(value)::BIGINT % 41 - 20)::DOUBLE AS x, (100.0 * (k // 10) + (7 * seq) % 41 - 20)::DOUBLE AS y FROM ev)",
    "meta": "meta AS (SELECT traj_id AS id, min(ts)::DATE AS date FROM d GROUP BY 1)",
    "triples": """runs AS (SELECT * FROM (SELECT *, lag(cross_id) OVER (PARTITION BY traj_id ORDER BY seq) AS p FROM dense) WHERE p IS NULL OR p <> cross_id),
triples AS (SELECT cross_id, lag(cross_id) OVER (PARTITION BY traj_id ORDER BY seq) AS c_in, lead(cross_id) OVER (PARTITION BY traj_id ORDER BY seq) AS c_out FROM runs),
phase AS (SELECT cross_id, c_in, c_out, count(*) AS n FROM triples WHERE c_in IS NOT NULL AND c_out IS NOT NULL GROUP BY ALL),
detail AS (
  SELECT cross_id, sum(n)::BIGINT AS total, CASE WHEN -sum(n / t * log2(n / t)) < 1e-6 THEN 0 ELSE -sum(n / t * log2(n / t)) END AS entropy
  FROM (SELECT cross_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY cross_id)::DOUBLE AS t FROM phase) GROUP BY cross_id)""",
    "turn": """located AS (SELECT d.traj_id, d.seq, c.x, c.y FROM d JOIN c USING (cross_id)),
three AS (SELECT traj_id, x AS cx, y AS cy, lag(x) OVER w AS bx, lag(y) OVER w AS b_y, lag(x, 2) OVER w AS ax, lag(y, 2) OVER w AS ay FROM located WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
turn AS (
  SELECT *, CASE WHEN n1 > 0 AND n2 > 0 AND dot / (n1 * n2) <= 1 AND acos(least(1, greatest(-1, dot / (n1 * n2)))) < radians(30) THEN 0 WHEN det < 0 THEN 1 ELSE -1 END AS turn
  FROM (SELECT *, sqrt(ux * ux + uy * uy) AS n1, sqrt(vx * vx + vy * vy) AS n2, ux * vx + uy * vy AS dot, ux * vy - uy * vx AS det
    FROM (SELECT *, bx - ax AS ux, b_y - ay AS uy, cx - bx AS vx, cy - b_y AS vy FROM three WHERE ax IS NOT NULL)))""",
    "near": """line AS (SELECT r.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM road r JOIN c a ON a.cross_id = start_cross JOIN c b ON b.cross_id = end_cross),
near AS (
  SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2) AS dist
  FROM (SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py
    FROM (SELECT g.traj_id, g.seq, g.x, g.y, l.road_id, start_cross, end_cross, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / 10000.0)) AS t
      FROM gps g JOIN line l ON least(x1, x2) <= x + 150 AND greatest(x1, x2) >= x - 150 AND least(y1, y2) <= y + 150 AND greatest(y1, y2) >= y - 150)))""",
    "moves": f"""numbered AS (SELECT *, sum(new) OVER (PARTITION BY traj_id ORDER BY seq) AS run, max(seq) OVER (PARTITION BY traj_id) AS last
  FROM (SELECT *, CASE WHEN lag(cross_id) OVER (PARTITION BY traj_id ORDER BY seq) = cross_id THEN 0 ELSE 1 END AS new FROM dense)),
stop AS (SELECT traj_id, run, any_value(cross_id) AS cross_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM numbered GROUP BY traj_id, run HAVING any_value(cross_id) < {HOT} AND max(seq) < any_value(last)),
anchor AS (SELECT * FROM (SELECT *, lag(cross_id) OVER (PARTITION BY traj_id ORDER BY run) AS p FROM stop) WHERE p IS NULL OR p <> cross_id),
moves AS (SELECT * FROM (SELECT traj_id, cross_id AS c1, lead(cross_id) OVER w AS c2, a + (b - a) // 2 AS t1, lead(a + (b - a) // 2) OVER w AS t2 FROM anchor WINDOW w AS (PARTITION BY traj_id ORDER BY run)) WHERE c2 IS NOT NULL)""",
    "trimmed": """trimmed AS (SELECT * FROM (SELECT *, (t2 - t1) // 1000 AS cost_ms, count(*) OVER (PARTITION BY c1, c2) AS n, row_number() OVER (PARTITION BY c1, c2 ORDER BY (t2 - t1) // 1000, traj_id, t1) AS r FROM moves)
  WHERE r <= floor(n * 0.8) AND floor(n * 0.8) > 20),
ids AS (SELECT c1, c2, (row_number() OVER (ORDER BY c1, c2) - 1)::INTEGER AS edge FROM (SELECT DISTINCT c1, c2 FROM trimmed))""",
    "hops": """hops AS (SELECT cross_id AS src, cross_id AS dst, 0 AS h FROM c WHERE cross_id IN (0, 37, 55, 99)
  UNION SELECT hops.src, edge.dst, h + 1 FROM hops JOIN edge ON edge.src = hops.dst WHERE h < 30)""",
}
_FIND = "pairs AS (SELECT i::INTEGER AS src, unnest([i + 1, i + 10, i - 1, i - 10, (i * 7 + 3) % 100])::INTEGER AS dst FROM range(100) t(i))"


def _footmark_sql(outward: bool) -> str:
    opens, closes, order, sign = ("s", "e", "seq", 1) if outward else ("e", "s", "seq DESC", -1)
    side = "out" if outward else "in"
    return f"""q AS (SELECT i AS query_id, i::INTEGER AS s, (i + 3)::INTEGER AS e FROM range(3) t(i)),
pts AS (SELECT q.*, dense.*, x, y, epoch_us(ts) AS us FROM q JOIN dense ON true JOIN c USING (cross_id)),
seg_{side} AS (SELECT *, sum((cross_id = {opens})::INTEGER) OVER (PARTITION BY query_id, traj_id ORDER BY {order}) AS g FROM pts),
ok_{side} AS (SELECT *, min((cross_id = {opens} OR (abs(us - us0) < 50000000000 AND x > -1 AND x < 1101 AND y > -1 AND y < 901))::INTEGER) OVER (PARTITION BY query_id, traj_id, g ORDER BY {order}) AS ok,
  coalesce(sum((cross_id = {closes})::INTEGER) OVER (PARTITION BY query_id, traj_id, g ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM (SELECT *, first_value(us) OVER (PARTITION BY query_id, traj_id, g ORDER BY {order}) AS us0 FROM seg_{side} WHERE g > 0)),
kept_{side} AS (SELECT query_id, cross_id AS c1, lead(cross_id) OVER (PARTITION BY query_id, traj_id, g ORDER BY seq) AS c2 FROM ok_{side} WHERE ok = 1 AND ended = 0 AND cross_id < {HOT}),
foot_{side} AS (SELECT query_id, c1, c2, count(*) AS n FROM kept_{side} WHERE c2 IS NOT NULL GROUP BY ALL)"""


def _metrics_sql() -> str:
    mean = lambda cond, v: f"round(coalesce(avg({v}) FILTER ({cond}), 'NaN'::DOUBLE), 6)"
    share = lambda cond: f"round(count(*) FILTER ({cond}) / count(*)::DOUBLE, 6)"
    return f"""WITH given AS (
  SELECT (o_custkey % 50)::BIGINT AS query_id, o_orderkey AS k0, (o_orderkey * 7) % 100 / 100.0::DOUBLE AS r, (o_orderkey * 13) % 100 / 100.0::DOUBLE AS rh, o_orderkey % 4 AS lefts, o_orderkey % 3 AS rights, o_orderkey % 5 AS straights,
    [o_orderkey % 20, o_orderkey % 30] AS crosses, o_orderkey % 6 AS hot FROM orders),
grid AS (SELECT s::INTEGER AS straight, l::INTEGER AS "left", g::INTEGER AS "right" FROM (VALUES (0), (1)) a(s), (VALUES (0), (2)) b(l), (VALUES (0), (1)) e(g)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, straight, "left", "right" ORDER BY lefts * "left" + rights * "right" + straights * straight, k0) AS p FROM given, grid) WHERE p <= 10)
SELECT query_id, straight, "left", "right", count(*) AS n_candidate, max((r = 0.5 AND rh = 0.4)::INTEGER) AS contains_shortest, 0.5::DOUBLE AS lcs_rate, 0.4::DOUBLE AS lcs_rate_hot,
  max(r) AS best_lcs_rate, max(rh) AS best_lcs_rate_hot, round(avg(r), 6) AS mean_lcs_rate, round(avg(rh), 6) AS mean_lcs_rate_hot,
  {share("r > 0.5")} AS better_share, {share("rh > 0.4")} AS better_share_hot, {share("r >= 0.5")} AS not_bad_share, {share("rh >= 0.4")} AS not_bad_share_hot,
  {mean("r > 0.5", "r")} AS better_mean, {mean("rh > 0.4", "rh")} AS better_mean_hot, {mean("r >= 0.5", "r")} AS not_bad_mean, {mean("rh >= 0.4", "rh")} AS not_bad_mean_hot,
  round(len(list_filter(list_distinct(flatten(list(crosses))), lambda v: v < 10)) / 10.0::DOUBLE, 6) AS cover, round(count(DISTINCT hot) FILTER (hot < 3) / 3.0::DOUBLE, 6) AS cover_hot
FROM top GROUP BY query_id, straight, "left", "right\""""


_RANGE = f"least(x1, x2) < x + {RADIUS} AND greatest(x1, x2) > x - {RADIUS} AND least(y1, y2) < y + {RADIUS} AND greatest(y1, y2) > y - {RADIUS}"

ORACLE_SQL = {
    "phase_counts": _with("ev", "dense", "triples") + "SELECT cross_id, c_in, c_out, n FROM phase",
    "cross_entropy_rank": _with("ev", "dense", "triples") + "SELECT (row_number() OVER (ORDER BY round(total::DOUBLE * total * entropy, 6) DESC, cross_id) - 1)::INTEGER AS rank, cross_id, total, round(entropy, 6) AS entropy FROM detail",
    "cross_count_rank": _with("ev", "dense", "triples") + "SELECT (row_number() OVER (ORDER BY total DESC, cross_id) - 1)::INTEGER AS rank, cross_id, total FROM detail",
    "turn_totals": _with("c", "ev", "d", "turn") + "SELECT count(*) FILTER (turn = -1) AS \"left\", count(*) FILTER (turn = 1) AS \"right\", count(*) FILTER (turn = 0) AS straight FROM turn WHERE NOT (n1 = 0) AND NOT (n2 = 0) AND NOT (ax = cx AND ay = cy)",
    "turn_totals_compat": _with("c", "ev", "d", "turn") + "SELECT count(*) FILTER (turn = -1) AS \"left\", count(*) FILTER (turn = 1) AS \"right\", count(*) FILTER (turn <> 1) AS straight FROM turn WHERE NOT (n1 = 0) AND NOT (n2 = 0) AND NOT (ax = cx AND ay = cy)",
    "turn_score": _with("c", "ev", "d", "turn") + "SELECT d.traj_id, coalesce(any_value(t.s), 0)::BIGINT AS turns FROM d LEFT JOIN (SELECT traj_id, sum(CASE turn WHEN 1 THEN 1 WHEN -1 THEN 2 ELSE 0 END) AS s FROM turn GROUP BY 1) t USING (traj_id) GROUP BY d.traj_id",
    "weekday_trajectories": _with("ev", "d", "meta") + "SELECT id, date::VARCHAR AS date FROM meta WHERE dayofweek(date) BETWEEN 1 AND 5",
    "weekday_points": _with("ev", "d", "meta") + "SELECT traj_id, count(*) AS n, min(seq) AS first_seq FROM d WHERE traj_id IN (SELECT id FROM meta WHERE dayofweek(date) BETWEEN 1 AND 5) GROUP BY 1",
    "trajectory_slice": _with("ev", "d", "meta") + "SELECT seq, cross_id, epoch_us(ts) AS ts_us FROM d JOIN meta ON id = traj_id WHERE traj_id = 3 AND date = DATE '2024-01-01' ORDER BY seq LIMIT 20 OFFSET 2",
    "hot_points": _with("ev", "d") + "SELECT traj_id, seq, cross_id FROM d WHERE cross_id < 30",
    "trimmed_points": _with("ev", "d") + "SELECT traj_id, seq, cross_id FROM d JOIN (SELECT traj_id, min(seq) AS a, max(seq) AS b FROM d WHERE cross_id < 5 GROUP BY 1) USING (traj_id) WHERE seq BETWEEN a AND b",
    "long_logs": "SELECT user_id AS traj_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60",
    "distinct_points": _with("ev") + "SELECT traj_id, count(*) AS n FROM (SELECT *, k % 3 AS cross_id, lag(k % 3) OVER w AS p, lag(ts) OVER w AS t FROM ev WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) WHERE NOT coalesce(p = cross_id AND t = ts, false) GROUP BY 1",
    "edge_list": _with("road", "edge") + "SELECT * FROM edge",
    "successors": _with("road", "edge") + "SELECT src AS cross_id, road_id, dst AS next_cross FROM edge",
    "predecessors": _with("road", "edge") + "SELECT dst AS cross_id, road_id, src AS previous_cross FROM edge",
    "find_road_oneway": _with("road", "edge") .rstrip() + ",\n" + _FIND + " SELECT p.src, p.dst, coalesce((SELECT min(road_id) FROM edge e WHERE e.src = p.src AND e.dst = p.dst), -1)::INTEGER AS road_id FROM pairs p",
    "find_road_any": _with("road", "edge").rstrip() + ",\n" + _FIND + " SELECT p.src, p.dst, coalesce((SELECT min(road_id) FROM edge e WHERE e.src = p.src AND e.dst = p.dst), (SELECT min(road_id) FROM edge e WHERE e.src = p.dst AND e.dst = p.src), -1)::INTEGER AS road_id FROM pairs p",
    "network_sizes": _with("c", "road", "edge") + "SELECT (SELECT count(*) FROM c) AS cross_size, (SELECT count(*) FROM road) AS road_size, (SELECT count(*) FROM edge) AS edge_size",
    "edge_properties": _with("road", "edge") + "SELECT src, dst, road_id, round(weight / speed, 6) AS seconds FROM edge JOIN road USING (road_id)",
    "property_lookup": _with("road") + "SELECT class AS kind, max(road_id) AS road_id FROM road GROUP BY 1",
    "cross_range": _with("c", "ev", "gps") + f"SELECT traj_id, seq, cross_id, round(dist, 6) AS dist, row_number() OVER (PARTITION BY traj_id, seq ORDER BY dist, cross_id)::INTEGER AS rn FROM (SELECT traj_id, seq, cross_id, sqrt((gps.x - c.x) ** 2 + (gps.y - c.y) ** 2) AS dist FROM gps, c) WHERE dist <= {RADIUS}",
    "road_range": _with("c", "road", "ev", "gps", "near") + f"SELECT traj_id, seq, road_id, round(dist, 6) AS dist, row_number() OVER (PARTITION BY traj_id, seq ORDER BY dist, road_id)::INTEGER AS rn FROM near WHERE dist <= {RADIUS} AND ({_RANGE})",
    "nearest_project": _with("c", "road", "ev", "gps", "near") + "SELECT traj_id, seq, road_id, CASE WHEN t IN (0, 1) THEN 'cross' ELSE 'road' END AS type, round(px, 6) AS x, round(py, 6) AS y, round(100 * t, 6) AS param FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY dist, road_id) AS rn FROM near) WHERE rn = 1",
    "nearby_hot": _with("c") + "SELECT p.cross_id AS id, h.cross_id FROM (SELECT a.cross_id, any_value(a.x) AS x, any_value(a.y) AS y, least(1000, 1.1 * min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))) AS r FROM c a, c b WHERE a.cross_id % 9 <> 4 AND b.cross_id % 9 = 4 GROUP BY a.cross_id) p JOIN c h ON h.cross_id % 9 = 4 AND abs(h.x - p.x) < r AND abs(h.y - p.y) < r",
    "box_crosses": _with("c") + "SELECT * FROM c WHERE x > 100 AND x < 500 AND y > 150 AND y < 650",
    "match_candidates": _with("c", "road", "ev", "gps", "near") + """, rolled AS (SELECT *, lag(px) OVER w AS lx, lag(py) OVER w AS ly FROM near WHERE dist <= 100 AND ((least(x1, x2) < x + 100 AND greatest(x1, x2) > x - 100 AND least(y1, y2) < y + 100 AND greatest(y1, y2) > y - 100)
  OR (least(x1, x2) >= x - 100 AND greatest(x1, x2) <= x + 100 AND least(y1, y2) >= y - 100 AND greatest(y1, y2) <= y + 100)) WINDOW w AS (PARTITION BY traj_id, seq ORDER BY dist, road_id)),
kept AS (SELECT *, (row_number() OVER (PARTITION BY traj_id, seq ORDER BY dist, road_id) - 1)::INTEGER AS cand FROM rolled WHERE lx IS NULL OR abs(lx - px) > 1e-9 OR abs(ly - py) > 1e-9)
SELECT traj_id, seq, cand, road_id, round(greatest(1e-8, exp(-(dist - 5) * (dist - 5) / 800) / (sqrt(2 * pi()) * 20)), 9) AS emission FROM kept WHERE cand < 5""",
    "hot_transitions": _with("ev", "dense", "moves") + "SELECT c1, c2, count(*) AS n FROM moves GROUP BY ALL",
    "virtual_edges_trimmed": _with("ev", "dense", "moves", "trimmed") + "SELECT c1, c2, count(*) AS n, round(avg(cost_ms), 3) AS mean_cost FROM trimmed GROUP BY ALL",
    "virtual_edge_endpoints": _with("c", "ev", "dense", "moves", "trimmed") + 'SELECT edge AS id, c1 AS start, c2 AS "end", a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ids JOIN c a ON a.cross_id = c1 JOIN c b ON b.cross_id = c2',
    "shortest_paths": _with("c", "road", "edge", "hops") + "SELECT src, dst, 100.0::DOUBLE * min(h) AS dist FROM hops GROUP BY ALL",
    "routed_crosses": _with("c", "road", "edge", "ev", "d").rstrip() + ",\nall_hops AS (SELECT cross_id AS src, cross_id AS dst, 0 AS h FROM c UNION SELECT all_hops.src, edge.dst, h + 1 FROM all_hops JOIN edge ON edge.src = all_hops.dst WHERE h < 26),\n" + "pairs AS (SELECT DISTINCT src, dst FROM (SELECT cross_id AS src, lead(cross_id) OVER (PARTITION BY traj_id ORDER BY seq) AS dst FROM d) WHERE dst IS NOT NULL)\nSELECT src, dst, coalesce(100.0::DOUBLE * min(h), 'Infinity'::DOUBLE) AS length, min(h) IS NOT NULL AS valid FROM pairs LEFT JOIN all_hops USING (src, dst) GROUP BY src, dst",
    "cost_patterns": _with("ev", "dense", "moves", "trimmed") + """, rec AS (SELECT edge, t1, cost_ms, row_number() OVER (PARTITION BY edge ORDER BY t1, traj_id) AS id, t1 % 86400000000 AS us, t1 % 86400000000 // 21600000000 AS q FROM trimmed JOIN ids USING (c1, c2)),
band AS (SELECT edge, q, arg_min(us, (us // 1000000) * 1000000 + id) AS begin_us, avg(cost_ms) / 1000 AS seconds FROM rec GROUP BY edge, q)
SELECT edge, begin_us, coalesce(lead(begin_us) OVER (PARTITION BY edge ORDER BY q), 86400000000) AS end_us, round(seconds, 6) AS seconds FROM band""",
    "weight_at": _with("ev") + """, t AS (SELECT traj_id, seq, ((hour(ts) * 60 + minute(ts)) * 60 + second(ts)) * 1000000::BIGINT AS t_us FROM ev)
SELECT traj_id, seq, t_us, (CASE WHEN t_us <= 0 THEN 30500 WHEN t_us <= 25200000000 THEN 95000 WHEN t_us <= 34200000000 THEN 42250 ELSE 61000 END)::BIGINT AS compat,
  (CASE WHEN t_us < 25200000000 THEN 30500 WHEN t_us < 34200000000 THEN 95000 WHEN t_us < 61200000000 THEN 42250 ELSE 61000 END)::BIGINT AS containing FROM t""",
    "footmark_out": _with("c", "ev", "dense").rstrip() + ",\n" + _footmark_sql(True) + " SELECT * FROM foot_out",
    "footmark_in": _with("c", "ev", "dense").rstrip() + ",\n" + _footmark_sql(False) + " SELECT * FROM foot_in",
    "footmark_merged": _with("c", "ev", "dense").rstrip() + ",\n" + _footmark_sql(True) + ",\n" + _footmark_sql(False).split(",\n", 2)[2] + " SELECT query_id, c1, c2, sum(n)::BIGINT AS n FROM (SELECT * FROM foot_out WHERE n > 5 UNION ALL SELECT * FROM foot_in WHERE n > 5) GROUP BY ALL",
    "restore_metrics": _metrics_sql(),
}
