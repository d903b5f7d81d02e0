"""The toolkit's three programs as plans: match logs, learn virtual edges, restore sparse trajectories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.weights import constant
from ..operators import clustering, evaluate, footmark, hotedges, matching, phases, routing, timedep, timing, trajectories
from ..operators.lineage import cut
from ..operators.matching import DEFAULTS, MatchParameters


@dataclass
class Matched:
    votes: DataFrame
    paths: DataFrame
    ranges: DataFrame
    timed: DataFrame
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Frees what is kept for reuse; the results can still be made again."""
        for df in self.held:
            df.unpersist()


def match_logs(points: DataFrame, roads: DataFrame, parameters: MatchParameters = DEFAULTS, more_than: int = 5, keep: bool = False) -> Matched:
    """Logs (traj_id, seq, ts, x, y) of more than a number of points, as timed paths over crosses.

    Each result is made from the points, which costs no storage; with `keep`, what all have in common is kept for several.
    """
    usable = trajectories.long_enough(points.repartition("traj_id"), more_than)
    whole = lambda spelled: matching.match_whole(usable, roads, parameters, spelled)
    spelled = whole(True)
    if keep:
        spelled = spelled.persist()
    plain = spelled if keep else whole(False)
    paths = matching.whole_paths(spelled)
    votes = plain.select("traj_id", "seq", "cand", "vote", "fvalue", "chosen")
    return Matched(votes, paths, matching.whole_ranges(plain), timing.estimate_time(paths, usable, roads), (spelled,) if keep else ())


def hot_ranking(data: DataFrame, top: int, by: str = "entropy") -> DataFrame:
    """(cross_id, rank) of the hot crosses."""
    return phases.rank_crosses(phases.cross_entropy(phases.phase_counts(data)), by).where(F.col("rank") < top).select("cross_id", "rank")


def learn_edges(data: DataFrame, hot: DataFrame, roads: DataFrame, share: float, more_than: int) -> DataFrame:
    """(edge, src, dst, count, bands) of virtual edges: plausible, trimmed, classed moves between hot crosses."""
    moves = hotedges.hot_transitions(data, hot).persist()
    routes = routing.route_crosses(roads, moves.select(F.col("c1").alias("src"), F.col("c2").alias("dst")))
    kept = hotedges.virtual_edges(hotedges.plausible(moves, routes), share, more_than)
    order = W.partitionBy("id").orderBy("enter", "traj_id")
    records = kept.select(F.col("id").alias("edge"), F.row_number().over(order).cast("long").alias("id"), "enter", "cost_ms")
    bands = clustering.pattern_bands(clustering.cost_patterns(clustering.cost_classes(records)))
    ends = kept.groupBy(F.col("id").alias("edge"), F.col("c1").alias("src"), F.col("c2").alias("dst")).agg(F.count("*").alias("count"))
    return ends.join(bands, "edge")


def flat_edges(summary: DataFrame) -> DataFrame:
    """(edge, src, dst, bands) with the mean cost at any time, numbered in order of (c1, c2)."""
    number = (F.row_number().over(W.orderBy("c1", "c2")) - 1).cast("int")
    return summary.select(number.alias("edge"), F.col("c1").alias("src"), F.col("c2").alias("dst"), constant(F.col("mean_cost")).alias("bands"))


def restore(data: DataFrame, queries: DataFrame, edges: DataFrame, hot: DataFrame, crosses: DataFrame, weights: DataFrame, most: int = evaluate.MOST_CANDIDATES, mode: str = "compat", more_than: int = footmark.LEAST_COUNT) -> DataFrame:
    """Metrics of restored candidates for queries (query_id, traj_id, first_seq, last_seq).

    The true slice, from its first to its last hot cross, gives start, end and duration; the shortest path on the graph gives the box and the rates
    to beat. Footmarks of all trajectories in the box choose the edges that candidates may use; k
    shortest paths over them, as late as a hundredth of the acceptable duration, are the candidates.
    """
    located = trajectories.on_map(data, crosses)
    truth = data.join(queries, "traj_id").where("seq BETWEEN first_seq AND last_seq").withColumn("traj_id", F.col("query_id"))
    truth = trajectories.trim_to_hot(truth, hot)
    tod = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000))
    is_hot = hot.select("cross_id", F.lit(True).alias("_hot")).distinct()
    true_rows = truth.join(is_hot, "cross_id", "left")
    line = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("seq", "cross_id")))), lambda v: v["cross_id"])
    slices = true_rows.withColumn("tod", tod).groupBy("query_id").agg(
        F.min_by("cross_id", "seq").alias("start_cross"), F.max_by("cross_id", "seq").alias("end_cross"), F.min_by("tod", "seq").alias("t0_us"), F.max_by("tod", "seq").alias("t1_us"),
        line(F.lit(True)).alias("crosses"), line(F.col("_hot")).alias("crosses_hot"),
    ).withColumn("seconds", F.expr("(t1_us - t0_us) div 1000000")).persist()
    base = timedep.earliest_arrival(edges, slices.select("query_id", F.col("start_cross").alias("src"), F.col("end_cross").alias("dst"), "t0_us"), mode).where("path IS NOT NULL")
    base = cut(base)  # a row for each query, read several times
    on_path = base.select("query_id", F.explode("path.cross_id").alias("cross_id")).join(crosses, "cross_id")
    boxes = timedep.search_box(on_path)
    foot_queries = slices.join(boxes, "query_id").select("query_id", "start_cross", "end_cross", "seconds", "box")
    foot = footmark.merged(footmark.footmarks(located, foot_queries, hot, True), footmark.footmarks(located, foot_queries, hot, False), more_than)
    own = footmark.on_graph(foot, edges).join(edges.select("edge", "bands"), "edge")
    graphs = own.groupBy("query_id").agg(F.collect_list(F.struct(F.col("edge").cast("int").alias("edge"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "bands")).alias("overlay"))
    acceptable = F.floor(F.col("seconds") * footmark.DURATION_FACTOR) * 1_000_000
    asked = slices.join(graphs, "query_id").select("query_id", F.col("start_cross").cast("int").alias("src"), F.col("end_cross").cast("int").alias("dst"), "t0_us", (F.col("t1_us") + F.floor(acceptable / 100)).alias("latest_us"), "overlay")
    found = timedep.k_shortest_paths(edges.limit(0), asked, most, mode)
    scored = score_candidates(found, slices, hot, crosses)
    of_base = base.select("query_id", F.col("path.cross_id").alias("_path")).join(slices.select("query_id", "crosses", "crosses_hot"), "query_id")
    hots = hot.agg(F.collect_set("cross_id").alias("_hots"))
    of_base = of_base.join(hots, F.lit(True)).withColumn("_hot_path", F.filter("_path", lambda c: F.array_contains("_hots", c)))
    known = of_base.select("query_id", evaluate.lcs_rate(F.col("crosses"), F.col("_path")).alias("base_rate"), evaluate.lcs_rate(F.col("crosses_hot"), F.col("_hot_path")).alias("base_rate_hot"), "crosses", "crosses_hot")
    return evaluate.restore_metrics(scored, known, weights)


def attached_paths(edges: DataFrame, hot: DataFrame, crosses: DataFrame, roads: DataFrame, queries: DataFrame, most: int = evaluate.MOST_CANDIDATES, mode: str = "compat") -> DataFrame:
    """k shortest paths for queries (query_id, src, dst, t0_us, latest_us) whose ends need not be hot.

    A cold end is joined to the hot crosses around it by temporary edges, of its query alone.
    """
    at = lambda end, outgoing: queries.select(F.col("query_id").alias("id"), F.col(end).alias("cross_id"), F.lit(outgoing).alias("outgoing"))
    named = lambda df, sign: df.withColumn("id", F.col("id") * 2 + sign)
    ends = named(at("src", True), 0).unionByName(named(at("dst", False), 1)).join(crosses.select("cross_id", "x", "y"), "cross_id")
    own = timedep.attach_endpoints(edges, hot, roads, ends).withColumn("query_id", F.floor(F.col("id") / 2).cast("long"))
    number = (F.row_number().over(W.partitionBy("query_id").orderBy("id", "edge")) - 1).cast("int")
    most_edge = edges.agg(F.coalesce(F.max("edge"), F.lit(-1)).cast("int").alias("_most"))
    own = own.join(most_edge, F.lit(True)).withColumn("edge", F.col("_most") + 1 + number)
    overlays = own.groupBy("query_id").agg(F.collect_list(F.struct("edge", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "bands")).alias("overlay"))  # the hot crosses around two ends
    return timedep.k_shortest_paths(edges, queries.join(overlays, "query_id", "left").select("query_id", "src", "dst", "t0_us", "latest_us", "overlay"), most, mode)


def score_candidates(found: DataFrame, slices: DataFrame, hot: DataFrame, crosses: DataFrame) -> DataFrame:
    """Candidates (query_id, k, path) with LCS rates and turn counts of their hot crosses."""
    is_hot = hot.select("cross_id", F.lit(True).alias("_hot")).distinct()
    each = found.select("query_id", "k", F.posexplode("path.cross_id").alias("seq", "cross_id")).join(is_hot, "cross_id", "left")
    line = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("seq", "cross_id")))), lambda v: v["cross_id"])
    lines = each.groupBy("query_id", "k").agg(line(F.lit(True)).alias("crosses"), line(F.col("_hot")).alias("crosses_hot"))
    located = each.where("_hot").join(crosses.select("cross_id", "x", "y"), "cross_id").withColumn("traj_id", F.concat_ws(":", "query_id", "k"))
    turns = phases._turns(located, False).groupBy("traj_id").agg(*[F.sum(F.when(F.col("turn") == t, 1).otherwise(0)).alias(name) for t, name in ((-1, "lefts_hot"), (1, "rights_hot"), (0, "straights_hot"))])
    joined = lines.withColumn("traj_id", F.concat_ws(":", "query_id", "k")).join(turns, "traj_id", "left").fillna(0, ["lefts_hot", "rights_hot", "straights_hot"])
    true = slices.select("query_id", F.col("crosses").alias("_true"), F.col("crosses_hot").alias("_true_hot"))
    rated = joined.join(true, "query_id")
    return rated.select("query_id", "k", evaluate.lcs_rate(F.col("_true"), F.col("crosses")).alias("lcs_rate"), evaluate.lcs_rate(F.col("_true_hot"), F.col("crosses_hot")).alias("lcs_rate_hot"), "lefts_hot", "rights_hot", "straights_hot", "crosses", "crosses_hot")
