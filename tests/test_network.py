import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trajspark import fixtures as fx
from trajspark.operators import network, routing, spatial
from trajspark.sources import pickers
from trajspark.sources.shapefile import LINE, POINT, hot_ranking, read_shapefile, write_shapefile


def roads_of(spark, rows):
    return spark.createDataFrame([(i, a, b, d, s, float(n), [(0.0, 0.0), (float(n), 0.0)]) for i, (a, b, d, s, n) in enumerate(rows)], "road_id int, start_cross int, end_cross int, direction int, speed double, geo_length double, geom array<struct<x:double,y:double>>")


def plain_distances(rows, n):
    best = [[math.inf] * n for _ in range(n)]
    for i in range(n):
        best[i][i] = 0
    for a, b, d, _, w in rows:
        for flag, u, v in ((1, a, b), (2, b, a)):
            if d & flag:
                best[u][v] = min(best[u][v], w)
    for k, i, j in itertools.product(range(n), repeat=3):
        best[i][j] = min(best[i][j], best[i][k] + best[k][j])
    return best


def random_roads(seed, n=9, m=22):
    random.seed(seed)
    return [(random.randrange(n), random.randrange(n), random.choice([1, 2, 3]), random.choice([5.0, 10.0]), random.randint(1, 9)) for _ in range(m)]


def test_loop_and_search_agree_with_all_pairs(spark):
    rows = random_roads(1)
    roads, want = roads_of(spark, rows), plain_distances(rows, 9)
    pairs = spark.createDataFrame(list(itertools.product(range(9), repeat=2)), "src int, dst int")
    found = {(r.src, r.dst): r for r in routing.route_crosses(roads, pairs).collect()}
    looped = {(r.src, r.dst): r.dist for r in routing.relaxed_distances(network.directed_edges(roads), pairs.select(F.col("src").alias("cross_id")).distinct()).collect()}
    for (a, b), r in found.items():
        assert r.length == want[a][b] and looped.get((a, b), math.inf) == want[a][b]
        assert r.valid == math.isfinite(want[a][b])
        if r.valid and a != b:
            assert r.crosses[0] == a and r.crosses[-1] == b and sum(e.length for e in r.entities) == r.length
    bounded = routing.relaxed_distances(network.directed_edges(roads), pairs.select(F.col("src").alias("cross_id")).distinct(), bound=6.0).collect()
    assert {(r.src, r.dst) for r in bounded} == {(a, b) for a, b in found if want[a][b] <= 6}


def test_places():
    """A square of one-way and two-way roads of length 10, places given by their offset."""
    from collections import namedtuple

    R = namedtuple("R", "road_id start_cross end_cross direction speed geo_length")
    net = routing.Network([R(0, 0, 1, 3, 5.0, 10.0), R(1, 1, 2, 1, 5.0, 10.0), R(2, 2, 3, 2, 10.0, 10.0), R(3, 0, 3, 3, 5.0, 10.0)])
    place = lambda road, m: {"type": "road", "index": road, "param": m, "x": road * 100.0 + m, "y": 0.0}
    cross = lambda c: {"type": "cross", "index": c, "param": 0.0, "x": -c * 1.0, "y": 5.0}
    assert net.points(place(1, 2.0), place(1, 7.0)) == [("part", 1, None, None, 5.0)]
    back = net.points(place(1, 7.0), place(1, 2.0))  # against the direction: the end point alone
    assert back == [("point", None, None, None, 0.0)] and routing.length_of(back) == 0
    assert net.points(place(2, 7.0), place(2, 2.0)) == [("part", 2, None, None, 5.0)]
    assert net.points(cross(1), cross(1)) == [("point", None, 1, 1, 0.0)]
    way = net.points(place(0, 4.0), place(1, 3.0))
    assert way == [("part", 0, None, 1, 6.0), ("part", 1, 1, None, 3.0)] and routing.crosses_on(way) == [1]
    assert routing.length_of(net.points(place(1, 3.0), cross(3))) == math.inf and net.points(place(1, 3.0), cross(3)) == []
    assert net.points(cross(3), place(2, 4.0)) == [("part", 2, 3, None, 6.0)]
    assert net.speed(way) == pytest.approx(5.0) and net.seconds(way) == pytest.approx(9 / 5)
    longer = net.points(place(3, 5.0), place(1, 1.0))
    assert routing.length_of(longer) == 16.0 and [e[0] for e in longer] == ["part", "road", "part"]


def test_lookups(spark):
    edges = network.directed_edges(roads_of(spark, [(0, 1, 3, 5.0, 4), (0, 1, 1, 5.0, 2), (1, 2, 2, 5.0, 3)]))
    pairs = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (5, 6)], "src int, dst int")
    get = lambda df: {(r.src, r.dst): r.road_id for r in df.collect()}
    assert get(network.find_road_oneway(edges, pairs)) == {(0, 1): 0, (1, 0): 0, (1, 2): -1, (2, 1): 2, (5, 6): -1}
    assert get(network.find_road_any(edges, pairs)) == {(0, 1): 0, (1, 0): 0, (1, 2): 2, (2, 1): 2, (5, 6): -1}
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "cross_id int, sid string")
    assert {(r.sid, r.cross_id) for r in network.property_index(items, "sid", "cross_id").collect()} == {("a", 2), ("b", 1)}
    assert network.lookup(items, "sid", "cross_id", spark.createDataFrame([("a",)], "sid string")).first().cross_id == 2
    with pytest.raises(Exception, match="no sid z"):
        network.lookup(items, "sid", "cross_id", spark.createDataFrame([("z",)], "sid string")).collect()
    assert network.contained(items, spark.createDataFrame([("a",), ("z",)], "sid string"), "sid").count() == 1


def layer(spark):
    attributes = [["x", "y", f"road{i}", "d", "e", "f", code, *"abcdefghijk", front, back, kind] for i, (code, front, back, kind) in enumerate([("2", "A", "B", "4"), ("3", "B", "C", "3"), ("0", "A", "C", "9")])]
    geoms = [[(0.0, 0.0), (3.0, 4.0)], [(3.0, 4.0), (3.0, 10.0)], [(0.0, 0.0), (0.0, 10.0), (3.0, 10.0)]]
    return spark.createDataFrame([(g, *a) for g, a in zip(geoms, attributes)], "geom array<struct<x:double,y:double>>, " + ", ".join(f"a{i} string" for i in range(len(attributes[0]))))


def test_road_layer_round_trip(spark, tmp_path):
    path = f"{tmp_path}/roads"
    assert write_shapefile(layer(spark).coalesce(1), path) == 3
    for identity in (pickers.by_geometry, pickers.by_sid):
        crosses, roads = network.load_network(read_shapefile(spark, path), identity, pickers.road_attributes)
        got = {r.road_id: (r.start_cross, r.end_cross, r.direction, r.sid, round(r.speed, 6), r.geo_length) for r in roads.collect()}
        assert got == {0: (0, 1, 1, "road0", round(70 / 3.6, 6), 5.0), 1: (1, 2, 2, "road1", round(50 / 3.6, 6), 6.0), 2: (0, 2, 3, "road2", round(30 / 3.6, 6), 13.0)}
        assert {(r.cross_id, r.x, r.y) for r in crosses.collect()} == {(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 3.0, 10.0)}
    with pytest.raises(Exception, match="missing"):
        read_shapefile(spark, f"{tmp_path}/missing").collect()


def test_point_layer(spark, tmp_path):
    rows = spark.createDataFrame([(0, 7, [(1.5, 2.5)]), (1, 9, [(3.0, 4.0)]), (2, 8, [(5.0, 6.0)])], "RANK int, INDEX int, geom array<struct<x:double,y:double>>").coalesce(1)
    write_shapefile(rows, f"{tmp_path}/rank.shp", kind=POINT)
    back = read_shapefile(spark, f"{tmp_path}/rank.shp")
    assert {(r.rank, r.cross_id) for r in hot_ranking(back, 2).collect()} == {(0, 7), (1, 9)}
    assert [(p.x, p.y) for r in back.orderBy("record").collect() for p in r.geom] == [(1.5, 2.5), (3.0, 4.0), (5.0, 6.0)]
    assert LINE != POINT


def test_far_points_find_a_road(spark):
    points = spark.createDataFrame([(1, 1, 5000.0, 5000.0), (1, 2, 10.0, 20.0)], "traj_id long, seq long, x double, y double")
    got = {r.seq: (r.road_id, round(r.dist, 6)) for r in spatial.nearest_project(points, fx.road(spark)).collect()}
    assert got[1][1] == round(math.hypot(4100, 4100), 6) and got[2] == (1, 10.0)
    assert spatial.nearest_road(points, fx.road(spark).limit(0)).count() == 0
