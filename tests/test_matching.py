import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark import fixtures as fx
from trajspark.operators import matching, timing
from trajspark.operators.matching import MatchParameters
from trajspark.plans import pipelines
from trajspark.sources import sinks


def tiny(seed, sizes):
    rng = np.random.default_rng(seed)
    emission = [rng.uniform(0.1, 1, n) for n in sizes]
    scores = [rng.choice([0.0, 0.5, 1.0, -np.inf], (a, b), p=[0.1, 0.4, 0.4, 0.1]) for a, b in itertools.pairwise(sizes)]
    return emission, scores, rng.uniform(0, 3000, (len(sizes), 2))


def brute(emission, scores, weights, begin, end, focus, k):
    """Best value over all sequences through candidate k of the focus, -1 if none is possible."""
    best = -math.inf
    for seq in itertools.product(*[range(len(emission[i])) for i in range(begin, end)]):
        if focus >= 0 and seq[focus - begin] != k:
            continue
        f = (weights[0] if len(weights) else 1.0) * emission[begin][seq[0]]
        for i in range(begin + 1, end):
            f += weights[i - 1 - begin] * emission[i][seq[i - begin]] * scores[i - 1][seq[i - 1 - begin], seq[i - begin]]
        best = max(best, f)
    return -1.0 if math.isinf(best) else best


@pytest.mark.parametrize("seed", range(8))
def test_forced_sequences(seed):
    emission, scores, xy = tiny(seed, [2, 3, 1, 3, 2])
    for focus in range(-1, 5):
        begin, end = (0, 5) if focus < 0 else matching.window(focus, 2, 5)
        weights = np.ones(end - begin - 1) if focus < 0 else matching.focus_weights(xy, begin, end, focus, 5000.0)
        value, chosen = matching.forced_sequences(emission, scores, weights, begin, end, focus)
        for k in range(len(value)):
            assert value[k] == pytest.approx(brute(emission, scores, weights, begin, end, focus, k))
            if value[k] >= 0 and focus >= 0:
                assert chosen[k][focus - begin] == k


def test_window_and_weights():
    assert matching.window(3, 2, 10) == (1, 5) and matching.window(0, 5, 3) == (0, 3) and matching.window(4, -1, 9) == (0, 9)
    xy = np.array([[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]])
    w = matching.focus_weights(xy, 0, 3, 1, 10.0)
    assert w == pytest.approx([math.exp(-0.25), math.exp(-0.25)])


def test_vote_fails_as_a_whole():
    emission = [np.array([0.5]), np.array([0.5]), np.array([0.5])]
    blocked = [np.array([[1.0]]), np.array([[-np.inf]])]
    assert matching.vote(emission, blocked, np.zeros((3, 2)), MatchParameters()) is None
    assert matching.single_pass(emission, blocked) is None
    winners, votes, _ = matching.vote(emission, [np.array([[1.0]])] * 2, np.zeros((3, 2)), MatchParameters())
    assert winners == [0, 0, 0] and [v.tolist() for v in votes] == [[3], [3], [3]]


def log(spark, points, step=10.0, traj=1):
    t0 = datetime(2024, 1, 1, 8)
    return spark.createDataFrame([(traj, i, t0 + timedelta(seconds=step * i), float(x), float(y)) for i, (x, y) in enumerate(points)], "traj_id long, seq long, ts timestamp, x double, y double")


def test_a_straight_drive(spark):
    """Along y = 0 with noise, past the crosses 1, 2 and 3 of the grid."""
    points = [(50, 4), (90, -3), (140, 5), (190, 2), (240, -4), (290, 3), (340, 1)]
    found = pipelines.match_logs(log(spark, points), fx.road(spark), MatchParameters(radius=30.0, limit=3))
    timed = [(r.cross_id, r.ts) for r in found.timed.orderBy("seq").collect()]
    assert [c for c, _ in timed] == [1, 2, 3]
    assert all(a < b for (_, a), (_, b) in itertools.pairwise(timed))
    t0 = datetime(2024, 1, 1, 8)
    assert timed[0][1] == t0 + timedelta(seconds=12.38)  # a fifth of the way, on the slower of two roads
    assert [tuple(r) for r in found.ranges.collect()] == [(1, 0, 0, 6)]
    assert {r.status for r in sinks.status(log(spark, points), found.votes).collect()} == {"finished"}
    short = pipelines.match_logs(log(spark, points[:5]), fx.road(spark))
    assert short.timed.count() == 0 and {r.status for r in sinks.status(log(spark, points[:5]), short.votes).collect()} == {"too short"}


def test_candidates_collapse_at_a_cross(spark):
    got = matching.match_candidates(log(spark, [(100, 0), (100, 40)]), fx.road(spark), MatchParameters(radius=60.0, limit=5)).orderBy("seq", "cand").collect()
    first = [r for r in got if r.seq == 0]
    assert len([r for r in first if r.dist == 0]) == 1 and first[0].pp.type == "cross" and first[0].pp["index"] == 1
    assert [r.cand for r in first] == list(range(len(first)))
    assert first[0].emission == pytest.approx(math.exp(-25 / 800) / (math.sqrt(2 * math.pi) * 20))


def test_candidates_far_from_roads(spark):
    (r,) = matching.match_candidates(log(spark, [(-500, 0)]), fx.road(spark), MatchParameters(limit=1)).collect()
    assert r.dist == 500.0 and r.emission == matching.LEAST_EMISSION


def test_transition_formulas(spark):
    points = log(spark, [(20, 0), (80, 0), (80, 0)])
    points = points.withColumn("ts", F.when(F.col("seq") == 2, F.lit(datetime(2024, 1, 1, 8, 0, 10))).otherwise(F.col("ts")))  # no time between the last two
    found = matching.match_candidates(points, fx.road(spark), MatchParameters(radius=15.0, limit=1))
    a, b = matching.transitions(points, found, fx.road(spark)).orderBy("seq").collect()
    speed = 40 / 3.6
    assert a.v == pytest.approx(1.0) and a.ft == pytest.approx(speed / (abs(6.0 - speed) + speed)) and a.length == 60
    assert (b.length, b.ft, b.v) == (0.0, 1.0, 1.0)


def paths(spark, rows):
    return spark.createDataFrame(rows, "traj_id long, seq long, seq2 long, valid boolean, entities array<struct<kind:string,road_id:int,from_cross:int,to_cross:int,length:double>>")


def test_time_rules(spark):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    points = spark.createDataFrame([(1, i, at(10 * i)) for i in range(7)], "traj_id long, seq long, ts timestamp")
    roads = spark.createDataFrame([(0, 10.0), (1, 5.0)], "road_id int, speed double")
    part, road, point = (lambda a, b, n, r=0: ("part", r, a, b, n)), (lambda a, b, n, r=0: ("road", r, a, b, n)), (lambda c: ("point", None, c, c, 0.0))
    rows = [
        (1, 0, 1, True, [point(5)]),
        (1, 1, 2, True, [part(5, None, 30.0)]),
        (1, 2, 3, True, [part(None, None, 30.0)]),
        (1, 3, 4, True, [part(None, 6, 30.0), road(6, 7, 100.0, 1), part(7, None, 20.0)]),
        (1, 4, 5, True, [part(None, 8, 30.0)]),
        (1, 5, 6, True, [road(8, 9, 100.0), road(9, 10, 100.0)]),
    ]
    got = [(r.cross_id, r.ts) for r in timing.estimate_time(paths(spark, rows), points, roads).orderBy("seq").collect()]
    # The lone point at 10 s; the start of the part, also at 10 s, repeats it; 3 of 25 s, 23 of 25 s; a lone part ends at 50 s, where the next road starts.
    assert got == [(5, at(10)), (6, at(31.2)), (7, at(39.2)), (8, at(50)), (9, at(55)), (10, at(60))]


def test_spread_time(spark):
    entities = spark.createDataFrame([(1, 0, "road", 0, 1, 2, 100.0), (1, 1, "road", 1, 2, 3, 100.0)], "path_id long, pos int, kind string, road_id int, from_cross int, to_cross int, length double")
    roads = spark.createDataFrame([(0, 10.0), (1, 5.0)], "road_id int, speed double")
    spans = spark.createDataFrame([(1, 1_000_000, 10_000_999)], "path_id long, start_us long, end_us long")
    got = {r.pos: r.tod_us for r in timing.spread_time(entities, roads, spans).collect()}
    assert got == {0: 4_000_000, 1: 10_000_000}
    assert timing.estimation_cost(entities, roads).first().cost_ms == pytest.approx(30_000)
    with pytest.raises(Exception, match="only whole roads"):
        timing.spread_time(entities.withColumn("kind", F.lit("part")), roads, spans).collect()


def test_ranges_split_at_invalid_paths(spark):
    rows = [(1, i, i + 1, ok, []) for i, ok in enumerate([True, True, False, True])]
    got = {tuple(r) for r in matching.valid_ranges(paths(spark, rows)).select("traj_id", "first_seq", "last_seq").collect()}
    assert got == {(1, 0, 2), (1, 3, 4)}
    random.seed(0)
