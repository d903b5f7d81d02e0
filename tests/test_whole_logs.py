import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark import fixtures as fx
from trajspark.operators import matching, timing, trajectories, whole_logs
from trajspark.operators.matching import MatchParameters
from trajspark.plans import pipelines

from .test_matching import tiny

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("window", [-1, 1, 2, 50])
def test_votes_of_padded_logs(seed, window, monkeypatch):
    monkeypatch.setattr(whole_logs, "_POINTERS", [1, 8_000_000][seed % 2])  # one focus at a time, or all
    logs = [tiny(seed * 10 + i, sizes) for i, sizes in enumerate(([2, 3, 1, 3, 2, 4], [3, 1, 2, 2], [2, 2], [3]))]
    emission, scores, xy = np.full((4, 6, 4), -np.inf), np.full((4, 5, 4, 4), -np.inf), np.zeros((4, 6, 2))
    for i, (e, s, p) in enumerate(logs):
        xy[i, : len(p)] = p
        for m, one in enumerate(e):
            emission[i, m, : len(one)] = one
        for m, one in enumerate(s):
            scores[i, m, : one.shape[0], : one.shape[1]] = one
    votes, values = whole_logs.vote_together(emission, scores, xy, np.array([6, 4, 2, 1]), window, 5000.0)
    for i, (e, s, p) in enumerate(logs):
        want = matching.vote(e, s, p, MatchParameters(window=window))
        assert (want is not None) == all((values[i, m, : len(one)] >= 0).any() for m, one in enumerate(e))
        if want:
            assert [v.tolist() for v in want[1]] == [votes[i, m, : len(one)].tolist() for m, one in enumerate(e)]
            assert [v.tolist() for v in want[2]] == [values[i, m, : len(one)].tolist() for m, one in enumerate(e)]


def test_whole_logs_give_what_the_joins_give(spark):
    """With points far from the map and without a place."""
    seq, traj = F.col("seq"), F.col("traj_id")
    x = F.when(seq % 97 == 5, F.col("x") + 5000.0).when((traj % 11 == 3) & (seq % 50 == 7), F.lit(None)).when((traj % 13 == 4) & (seq % 60 == 8), F.lit(float("nan"))).otherwise(F.col("x"))
    points, roads, p = trajectories.long_enough(fx.gps(spark, SF), 5).withColumn("x", x).persist(), fx.road(spark), MatchParameters(window=5, limit=3)
    rows = lambda df, names: sorted(tuple(map(str, r)) for r in df.select(*[F.round(c, 9).alias(c) if dict(df.dtypes)[c] == "double" else c for c in names.split()]).collect())
    found = matching.joined_candidates(points, roads, p).persist()
    moves = matching.transitions(points, found, roads).persist()
    votes = matching.ivmm_votes(found, moves, p).persist()
    paths = matching.matched_paths(votes, moves, roads).persist()
    new = pipelines.match_logs(points, roads, p)
    pairs = (
        (found, matching.match_candidates(points, roads, p), "traj_id seq cand road_id dist pp emission"),
        (votes, new.votes, "traj_id seq cand vote fvalue chosen"),
        (paths, new.paths, "traj_id seq seq2 c1 c2 v ft gps_distance seconds_between length speed mean_speed valid entities"),
        (matching.valid_ranges(paths), new.ranges, "traj_id range_id first_seq last_seq"),
        (timing.estimate_time(paths, points, roads), new.timed, "traj_id seq cross_id ts"),
    )
    for old, made, names in pairs:
        want = rows(old, names)
        assert want and rows(made, names) == want


def test_candidates_on_bent_roads(spark):
    """Lines of several segments, closed ones and one that is a point among them."""
    lines = [(1, [(0, 0), (30, 40), (100, 0)]), (2, [(100, 0), (100, 50), (100, 50), (0, 0)]), (3, [(0, 0), (60, 0), (0, 0)]), (4, [(10.0, 10)]), (5, [(-900, 300), (-700, 500), (900, 800)])]
    rows = [(i, 10 * i, 10 * i + 1, [(float(x), float(y)) for x, y in g], 3, 10.0) for i, g in lines]
    roads = spark.createDataFrame(rows, "road_id int, start_cross int, end_cross int, geom array<struct<x:double,y:double>>, direction int, speed double")
    rng = np.random.default_rng(1)
    places = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.uniform(-60, 160, (60, 2)), rng.uniform(-9000, 9000, (10, 2)), [(0, 0), (100, 50), (30, 40)]]).round(1))]
    points = spark.createDataFrame(places, "traj_id long, seq long, x double, y double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    p = MatchParameters(radius=20.0)
    rows = lambda df: sorted((r.seq, r.cand, r.road_id, round(r.dist, 9), tuple(r.pp), round(r.emission, 12)) for r in df.collect())
    want = rows(matching.joined_candidates(points, roads, p))
    assert len({r[0] for r in want}) == 73 and rows(matching.match_candidates(points, roads, p)) == want


def test_matching_deals_points_only(spark):
    """No pair of candidates is joined, dealt or kept."""
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = pipelines.match_logs(fx.gps(spark, SF), fx.road(spark))
    for df in (found.votes, found.ranges, found.paths):
        assert df.count() > 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan.split("Initial Plan")[0]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == kept


def test_ranges_are_made_where_the_paths_are(spark):
    """Points are dealt once, and not the paths."""
    found = pipelines.match_logs(fx.gps(spark, SF), fx.road(spark))
    for df in (found.ranges, found.votes):
        assert df.count() > 0
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") == 1


@pytest.mark.parametrize("rows", [1, 2, 3, 10_000])
def test_ranges_over_batches(spark, rows):
    """Paths with gaps and invalid ones, in logs that batches cut anywhere."""
    rng = np.random.default_rng(rows)
    paths = [(t, 10 * i, 10 * (i + 1 + int(rng.random() < 0.2)), bool(rng.random() < 0.7)) for t in [7, 3, 11, 5, *range(20, 40)] for i in range(rng.integers(1, 12)) if rng.random() < 0.9]
    paths += [(50, i, i + 1, False) for i in range(5)] + [(51, i, i + 1, True) for i in range(5)]
    df = spark.createDataFrame(paths, "traj_id long, seq long, seq2 long, valid boolean").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = sorted(map(tuple, whole_logs.ranges(df).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = sorted(map(tuple, matching.valid_ranges(df).collect()))
    assert want and got == want and whole_logs.ranges(df.limit(0)).count() == 0


def test_window_study_keeps_nothing(spark):
    from trajspark.queries import QUERIES

    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    rates = {r.window: r.avg_rate for r in QUERIES["window_study"](spark, SF).collect()}
    assert set(rates) == {2, 5} and 0.9 < rates[2] <= rates[5] <= 1
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == kept
