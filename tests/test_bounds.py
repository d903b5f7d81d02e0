"""Places that are missing or far away, temporary crosses, and a stream against a batch."""

import math
import random

import numpy as np
import pytest

from trajspark import fixtures as fx
from trajspark.operators import matching, routing, spatial
from trajspark.operators.timedep import HighLevelGraph
from trajspark.sources.text import read_gps
from trajspark.streaming.logs import log_stream

PLACES = "traj_id long, seq long, ts timestamp_ntz, x double, y double"


def test_null_nan_and_far_points(spark):
    points = spark.createDataFrame([(1, 0, None, 10.0, 5.0), (1, 1, None, None, 5.0), (1, 2, None, 1.0, math.nan), (1, 3, None, 1e6, 1e6), (1, 4, None, math.inf, 0.0)], PLACES)
    found = {r.seq: (r.road_id, round(r.dist, 3)) for r in spatial.nearest_project(points, fx.road(spark)).collect()}
    assert set(found) == {0, 3} and found[0] == (0, 5.0)
    assert abs(found[3][1] - math.hypot(1e6 - 900, 1e6 - 900)) < 1
    assert {r.seq for r in matching.match_candidates(points, fx.road(spark)).collect()} == {0, 3}


def test_measured_paths_are_those_of_points(spark):
    roads = fx.road(spark).collect()
    network = routing.Network(roads)
    random.seed(1)

    def place():
        r = random.choice(roads)
        (a, b), t = r.geom, random.randrange(1, 100)
        if random.random() < 0.3:
            return {"type": "cross", "index": r.start_cross, "param": 0.0, "x": a.x, "y": a.y}
        return {"type": "road", "index": r.road_id, "param": float(t), "x": a.x + (b.x - a.x) * t / 100, "y": a.y + (b.y - a.y) * t / 100}

    p, q = [place() for _ in range(800)], [place() for _ in range(800)]
    p[:50] = q[:50]
    for i in range(50, 200):
        if p[i]["type"] == "road":
            q[i] = {**p[i], "param": 50.0, "x": p[i]["x"] + 0.001}
    columns = lambda rows: {c: np.array([r[c] for r in rows], object if c == "type" else np.int64 if c == "index" else float) for c in routing._FIELDS}
    for a, b, got in zip(p, q, zip(*network.measured(columns(p), columns(q)))):
        entities = network.points(a, b)
        assert np.allclose(got[:3], (routing.length_of(entities), network.speed(entities), network.seconds(entities))) and bool(got[3]) == bool(entities)


def test_temporary_crosses_and_shared_graph():
    graph = HighLevelGraph([(0, 1, 2, [(0, 1, 5)])])
    more = graph.with_overlay([(1, 9, 1, [(0, 1, 5)])], [(9, 0.5, 0.5)])
    assert more.places == {9: (0.5, 0.5)} and [c for c, _ in more.earliest(9, 0, 2)] == [9, 1, 2] and not graph.has_cross(9)
    for crosses in ([(1, 0.0, 0.0)], [(9, 0.0, 0.0), (9, 1.0, 1.0)]):
        with pytest.raises(ValueError):
            graph.with_overlay([], crosses)


def test_stream_ends_a_log_where_a_batch_does(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a,2024-01-01 08:00:00,b,c,1,2\n\na,2024-01-01 08:00:05,b,c,3,4\nbroken\na,2024-01-01 08:00:09,b,c,5,6\n")
    (tmp_path / "in" / "2.txt").write_text("broken\na,2024-01-01 08:00:09,b,c,5,6\n")
    log_stream(spark, f"{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted((r.seq, r.ts, r.x, r.y) for r in df.collect())
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(read_gps(spark, f"{tmp_path}/in")) and len(rows(read_gps(spark, f"{tmp_path}/in"))) == 2
