"""Map matching by interactive voting, and its single-pass variant.

Candidates, emissions and transitions are tables: all logs at once, distinct pairs of places
routed once. Only the voting over one log, which is sequential, runs as a grouped kernel. `match_whole`
makes candidates, transitions and votes of whole logs where they are, and deals no more than points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import whole_logs
from .lineage import cut
from .routing import route_points
from .spatial import nearest_road, placed, road_range


def _order():
    return W.partitionBy("traj_id").orderBy("seq")


@dataclass(frozen=True)
class MatchParameters:
    """The defaults."""

    mean: float = 5.0
    deviation: float = 20.0
    radius: float = 100.0
    limit: int = 5
    beta: float = 5000.0
    window: int = 50


DEFAULTS = MatchParameters()
LEAST_EMISSION = 1e-8
GROWTH = 1.1


def match_candidates(points: DataFrame, roads: DataFrame, parameters: MatchParameters = DEFAULTS) -> DataFrame:
    """(traj_id, seq, ts, x, y, cand, road_id, dist, pp, emission): up to `limit` places per point.

    The search radius grows by a tenth until a road is in it. In order of distance, a place is kept
    if it differs from the last one kept, so roads that meet at one cross count once. A point whose place is
    null or not finite has no candidates. Other columns of points stay, after these; on a map that a worker may
    hold, rows stay in the order of the points.
    """
    if whole_logs.fits(roads):
        return whole_logs.candidates(points, roads, parameters, LEAST_EMISSION)
    return joined_candidates(points, roads, parameters)


def joined_candidates(points: DataFrame, roads: DataFrame, parameters: MatchParameters = DEFAULTS) -> DataFrame:
    """match_candidates by joins, for a map of any size."""
    radius = parameters.radius
    others = [c for c in points.columns if c not in ("traj_id", "seq", "ts", "x", "y")]
    found = road_range(points, roads, radius).persist()
    far = placed(points).join(found.select("traj_id", "seq").distinct(), ["traj_id", "seq"], "left_anti")
    if not far.isEmpty():
        near = nearest_road(far, roads, radius).select("traj_id", "seq", F.col("dist").alias("_nearest"))
        times = F.ceil(F.log(F.col("_nearest") / radius) / math.log(GROWTH) - 1e-9)
        sized = far.join(near, ["traj_id", "seq"]).withColumn("_radius", radius * F.pow(F.lit(GROWTH), F.greatest(times, F.lit(0))))
        sized = cut(sized.withColumn("_scale", F.ceil(F.log2(F.col("_radius") / radius) / 2).cast("int")))
        for r in sized.select("_scale").distinct().collect():  # a row for each power of four; cells grow with the radius
            part = road_range(sized.where(F.col("_scale") == r["_scale"]), roads, F.col("_radius"), radius * 4.0 ** r["_scale"])
            found = found.unionByName(part.drop("_nearest", "_radius", "_scale"))
    found = found.withColumn("pp", G.make_project_point(G.point("x", "y"), "geom", "road_id", "start_cross", "end_cross", F.col("near")))
    # "Differs from the last kept" is "differs from the one before": equal neighbours form runs.
    by_rank = W.partitionBy("traj_id", "seq").orderBy("rn")
    previous = F.lag("pp").over(by_rank)
    kept = found.withColumn("_new", previous.isNull() | ~G.same_point(previous, "pp")).where("_new")
    kept = kept.withColumn("cand", F.row_number().over(by_rank) - 1).where(F.col("cand") < parameters.limit)
    off = F.col("dist") - parameters.mean
    normal = F.exp(-off * off / (2 * parameters.deviation**2)) / (math.sqrt(2 * math.pi) * parameters.deviation)
    return kept.select("traj_id", "seq", "ts", "x", "y", "cand", "road_id", "dist", "pp", F.greatest(normal, F.lit(LEAST_EMISSION)).alias("emission"), *others)


def steps(points: DataFrame) -> DataFrame:
    """(traj_id, seq, seq2, gps_distance, seconds) between neighbouring points; seconds are whole."""
    nxt = lambda c: F.lead(c).over(_order())
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = points.withColumn("_us", micros).select("traj_id", "seq", nxt("seq").alias("seq2"), F.hypot(nxt("x") - F.col("x"), nxt("y") - F.col("y")).alias("gps_distance"), (nxt("_us") - F.col("_us")).alias("_us"))
    return rows.where("seq2 IS NOT NULL").select("traj_id", "seq", "seq2", "gps_distance", F.expr("_us div 1000000").alias("seconds"))


def transitions(points: DataFrame, candidates: DataFrame, roads: DataFrame) -> DataFrame:
    """(traj_id, seq, seq2, c1, c2, v, ft, ...) of all pairs of candidates of neighbouring points."""
    a = candidates.select("traj_id", "seq", F.col("cand").alias("c1"), F.col("pp").alias("p"))
    b = candidates.select("traj_id", F.col("seq").alias("seq2"), F.col("cand").alias("c2"), F.col("pp").alias("q"))
    pairs = steps(points).join(a, ["traj_id", "seq"]).join(b, ["traj_id", "seq2"])
    routes = route_points(roads, pairs, False)
    d, l = F.col("gps_distance") + 1, F.col("length") + 1
    v = F.when(F.col("valid"), F.least(F.pow(d / l, F.lit(2.0)), F.sqrt(l / d))).otherwise(F.lit(float("-inf")))
    still = F.col("speed") == 0
    mean = F.when(F.col("seconds_between") != 0, F.try_divide(F.col("length"), F.col("seconds_between").cast("double"))).otherwise(F.lit(float("inf")))
    ft = F.when(still, 1.0).otherwise(F.try_divide(F.col("speed"), F.abs(F.col("mean_speed") - F.col("speed")) + F.col("speed")))
    joined = pairs.withColumnRenamed("seconds", "seconds_between").join(routes, ["p", "q"]).withColumn("mean_speed", mean)
    return joined.select("traj_id", "seq", "seq2", "c1", "c2", v.alias("v"), ft.alias("ft"), "gps_distance", "seconds_between", "length", "speed", "mean_speed", "valid", "p", "q")


def window(i: int, w: int, n: int) -> tuple[int, int]:
    """Points [begin, end) that vote on point i; all of them for a width of 0 or less."""
    return (0, n) if w <= 0 else (max(0, i - w), min(i + w, n))


def focus_weights(xy: np.ndarray, begin: int, end: int, i: int, beta: float) -> np.ndarray:
    """Weights of the steps m -> m + 1 of a window: by the distance from i to the step's other point."""
    m = np.arange(begin, end - 1)
    far = xy[np.where(i <= m, m + 1, m)] - xy[i]
    return np.exp(-(far**2).sum(axis=1) / beta**2)


def forced_sequences(emission: list[np.ndarray], scores: list[np.ndarray], weights: np.ndarray, begin: int, end: int, focus: int) -> tuple[np.ndarray, np.ndarray]:
    """For every candidate k of the focus: the best value through k (-1 if none) and its candidates.

    A max-plus recursion that keeps a row for each k, so all of them cost one pass. The first of
    equal values wins, as in a scan with strict comparison. focus -1 forces nothing (one row). The
    first point has the weight of the first step.
    """
    rows = len(emission[focus]) if focus >= 0 else 1
    first = weights[0] if len(weights) else 1.0
    f = np.repeat((first * emission[begin])[None, :], rows, axis=0)
    free = np.eye(rows, dtype=bool)
    before: list[np.ndarray] = []
    dead = np.zeros(rows, bool)
    if begin == focus:
        f = np.where(free, f, -np.inf)
    for at in range(begin + 1, end):
        gain = weights[at - 1 - begin] * emission[at][None, :] * scores[at - 1]
        total = f[:, :, None] + gain[None, :, :]
        before.append(total.argmax(axis=1))
        f = total.max(axis=1)
        if at == focus:
            f = np.where(free, f, -np.inf)
        dead |= np.isneginf(f).all(axis=1)
    last = f.argmax(axis=1)
    value = np.where(dead, -1.0, f[np.arange(rows), last])
    chosen = np.empty((rows, end - begin), np.int64)
    chosen[:, -1] = last
    for back in range(len(before) - 1, -1, -1):
        chosen[:, back] = before[back][np.arange(rows), chosen[:, back + 1]]
    return value, chosen


def vote(emission: list[np.ndarray], scores: list[np.ndarray], xy: np.ndarray, parameters: MatchParameters) -> tuple[list[int], list[np.ndarray], list[np.ndarray]] | None:
    """(winner per point, votes, values), or None if no candidate of some point can be passed."""
    n = len(emission)
    votes = [np.zeros(len(e), np.int64) for e in emission]
    values = [np.full(len(e), -1.0) for e in emission]
    for i in range(n):
        begin, end = window(i, parameters.window, n)
        value, chosen = forced_sequences(emission, scores, focus_weights(xy, begin, end, i, parameters.beta), begin, end, i)
        feasible = value >= 0
        if not feasible.any():
            return None
        for at in range(begin, end):
            np.add.at(votes[at], chosen[feasible, at - begin], 1)
        values[i] = value
    winners = [int(np.lexsort((-np.arange(len(v)), f, v))[-1]) for v, f in zip(votes, values)]
    return winners, votes, values


def single_pass(emission: list[np.ndarray], scores: list[np.ndarray]) -> list[int] | None:
    value, chosen = forced_sequences(emission, scores, np.ones(max(0, len(emission) - 1)), 0, len(emission), -1)
    return None if value[0] < 0 else chosen[0].tolist()


def _ragged(points: pd.DataFrame, steps_: pd.DataFrame):
    """(seqs, emission per point, v * ft per step, coordinates) of one log."""
    points = points.sort_values(["seq", "cand"])
    groups = [g for _, g in points.groupby("seq", sort=True)]
    place = {g.seq.iloc[0]: i for i, g in enumerate(groups)}
    emission = [g.emission.to_numpy() for g in groups]
    scores = [np.full((len(a), len(b)), -np.inf) for a, b in zip(emission, emission[1:])]
    for seq, c1, c2, v, ft in zip(steps_.seq, steps_.c1, steps_.c2, steps_.v, steps_.ft):
        scores[place[seq]][c1, c2] = v * ft
    return [g.seq.iloc[0] for g in groups], emission, scores, np.array([[g.x.iloc[0], g.y.iloc[0]] for g in groups])


MATCHED = "traj_id long, seq long, cand int, vote long, fvalue double, chosen boolean"


def ivmm_votes(candidates: DataFrame, moves: DataFrame, parameters: MatchParameters = DEFAULTS) -> DataFrame:
    """(traj_id, seq, cand, vote, fvalue, chosen) of every candidate; a log that can't be matched has no rows.

    A log is one group: logs are bounded by a vehicle's day. A log of one point has no steps; its
    nearest-valued candidate wins.
    """

    def one(points: pd.DataFrame, steps_: pd.DataFrame) -> pd.DataFrame:
        columns = ["traj_id", "seq", "cand", "vote", "fvalue", "chosen"]
        if points.empty:
            return pd.DataFrame(columns=columns)
        seqs, emission, scores, xy = _ragged(points, steps_)
        found = vote(emission, scores, xy, parameters)
        if found is None:
            return pd.DataFrame(columns=columns)
        rows = [(points.traj_id.iloc[0], s, k, v[k], f[k], k == w) for s, w, v, f in zip(seqs, *found) for k in range(len(v))]
        return pd.DataFrame(rows, columns=columns)

    a = candidates.select("traj_id", "seq", "cand", "emission", "x", "y")
    b = moves.select(*[F.col(c).alias(c) for c in ("traj_id", "seq", "c1", "c2", "v", "ft")])  # ids of its own
    return a.groupBy("traj_id").cogroup(b.groupBy("traj_id")).applyInPandas(one, MATCHED)


def st_match(candidates: DataFrame, moves: DataFrame) -> DataFrame:
    """(traj_id, seq, cand): one pass with unit weights and no vote."""

    def one(points: pd.DataFrame, steps_: pd.DataFrame) -> pd.DataFrame:
        if points.empty:
            return pd.DataFrame(columns=["traj_id", "seq", "cand"])
        seqs, emission, scores, _ = _ragged(points, steps_)
        chosen = single_pass(emission, scores)
        return pd.DataFrame([(points.traj_id.iloc[0], s, k) for s, k in zip(seqs, chosen or [])], columns=["traj_id", "seq", "cand"])

    a = candidates.select("traj_id", "seq", "cand", "emission", "x", "y")
    b = moves.select(*[F.col(c).alias(c) for c in ("traj_id", "seq", "c1", "c2", "v", "ft")])  # ids of its own
    return a.groupBy("traj_id").cogroup(b.groupBy("traj_id")).applyInPandas(one, "traj_id long, seq long, cand int")


def match_whole(points: DataFrame, roads: DataFrame, parameters: MatchParameters = DEFAULTS, spelled: bool = True) -> DataFrame:
    """(traj_id, seq, cand, vote, fvalue, chosen, ...) of every candidate, with the step to the next point's winner where it won.

    The same as match_candidates, transitions, ivmm_votes and matched_paths in turn. Without `spelled`,
    entities are null.
    """
    whole = whole_logs.with_steps(points.repartition("traj_id"), _order()).sortWithinPartitions("traj_id", "seq")
    return whole_logs.matched(match_candidates(whole, roads, parameters), roads, parameters, spelled)


def whole_paths(matched: DataFrame) -> DataFrame:
    """The paths of match_whole's rows: those of matched_paths, and t1 and t2, microseconds at both ends."""
    return matched.where("chosen AND c1 IS NOT NULL").select("traj_id", "seq", *whole_logs.STEP_COLUMNS, "entities")


def whole_ranges(matched: DataFrame) -> DataFrame:
    """valid_ranges of match_whole's rows, made where they are."""
    return whole_logs.ranges(matched.where("chosen AND c1 IS NOT NULL"))


def matched_paths(votes: DataFrame, moves: DataFrame, roads: DataFrame) -> DataFrame:
    """(traj_id, seq, seq2, entities, valid, ...): the paths between the winners of neighbouring points.

    Only these paths are spelled out; for the scores of all candidates their lengths were enough.
    """
    won = votes.where("chosen").select("traj_id", "seq", "cand")
    a = won.withColumnRenamed("cand", "c1")
    b = won.select("traj_id", F.col("seq").alias("seq2"), F.col("cand").alias("c2"))
    won_moves = moves.join(a, ["traj_id", "seq", "c1"]).join(b, ["traj_id", "seq2", "c2"])
    spelled = route_points(roads, won_moves).select("p", "q", "entities")
    return won_moves.join(spelled, ["p", "q"]).drop("p", "q")


def valid_ranges(paths: DataFrame) -> DataFrame:
    """(traj_id, range_id, first_seq, last_seq): maximal runs of valid paths, as spans of points."""
    new = F.when(F.lag("valid").over(_order()) & (F.lag("seq2").over(_order()) == F.col("seq")), 0).otherwise(1)
    numbered = paths.select("traj_id", "seq", "seq2", "valid", F.when(F.col("valid"), F.coalesce(new, F.lit(1))).otherwise(0).alias("_new"))
    grouped = numbered.withColumn("range_id", F.sum("_new").over(_order()) - 1).where("valid")
    return grouped.groupBy("traj_id", "range_id").agg(F.min("seq").alias("first_seq"), F.max("seq2").alias("last_seq"))
