"""Shortest paths on the static road graph.

`relaxed_distances` is a loop of joins that assumes nothing about the graph's size. `Network` holds
a map of bounded size in each worker and answers searches one by one: `route_crosses` and
`route_points` deal distinct origin-destination pairs by their origin, so one search tree serves all
its destinations. Of parallel roads the shortest counts (lowest road_id on ties), for the cost and for
the road reported. Equal paths: the lower predecessor id wins. An invalid path has no entities and
infinite length.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORWARD, BACKWARD = 1, 2
#: Roads that a worker may hold (about 520 bytes each); a larger map must be cut or relaxed by joins.
MOST_ROADS = 2_000_000
#: Crosses that the search trees of a worker hold together.
_TREE_CROSSES = 1_000_000
#: Tasks that the pairs of one origin may reach.
SPREAD = 4


def relaxed_distances(edges: DataFrame, sources: DataFrame, bound: float | None = None) -> DataFrame:
    """(src, dst, dist) from every source cross (cross_id) to all crosses within the bound.

    Each round relaxes the edges of the pairs that the last one improved, until there are none. Rounds are
    checkpointed. A negative weight is an error.
    """
    from .lineage import cut

    best = cut(sources.select(F.col("cross_id").alias("src"), F.col("cross_id").alias("dst"), F.lit(0.0).alias("dist")).distinct())
    frontier = best
    step = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).select(F.col("src").alias("dst"), F.col("dst").alias("next"), "weight")
    if not step.where("weight < 0").isEmpty():
        raise ValueError("a road of negative length")
    while not frontier.isEmpty():
        offered = frontier.join(step, "dst").groupBy("src", "next").agg(F.min(F.col("dist") + F.col("weight")).alias("offer"))
        if bound is not None:
            offered = offered.where(F.col("offer") <= bound)
        offered = offered.select(F.col("src").alias("s"), F.col("next").alias("d"), "offer")
        merged = best.join(offered, (best.src == offered.s) & (best.dst == offered.d), "full_outer")
        merged = cut(merged.select(F.coalesce("src", "s").alias("src"), F.coalesce("dst", "d").alias("dst"), F.least("dist", "offer").alias("dist"), (F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))).alias("better")))
        best, frontier = merged.select("src", "dst", "dist"), merged.where("better").select("src", "dst", "dist")
    return best


class Tree:
    """Dijkstra from one cross, carried on only as far as it is asked."""

    def __init__(self, network: Network, source: int):
        self.network, self.done, self.before = network, {}, {source: None}
        self.best, self.heap = {source: 0.0}, [(0.0, source)]

    def distance(self, target: int) -> float:
        while target not in self.done and self.heap:
            d, u = heapq.heappop(self.heap)
            if u in self.done:
                continue
            self.done[u] = d
            for v, (w, _) in self.network.out.get(u, {}).items():
                new, old = d + w, self.best.get(v, math.inf)
                if v not in self.done and (new < old or (new == old and self.before[v] is not None and u < self.before[v])):
                    self.best[v], self.before[v] = new, u
                    heapq.heappush(self.heap, (new, v))
        return self.done.get(target, math.inf)

    def path(self, target: int) -> list[int]:
        """Crosses to the target, both ends included; empty if it can't be reached."""
        if math.isinf(self.distance(target)):
            return []
        out = [target]
        while self.before[out[-1]] is not None:
            out.append(self.before[out[-1]])
        return out[::-1]


def astar(network: Network, places: dict[int, tuple[float, float]], a: int, b: int) -> list[int]:
    """Crosses of a shortest path by A* with straight distances, which roads can't undercut; empty without one."""
    far = lambda c: math.dist(places[c], places[b])
    best, before, done, heap = {a: 0.0}, {a: None}, set(), [(far(a), a)]
    while heap:
        _, u = heapq.heappop(heap)
        if u == b:
            out = [b]
            while before[out[-1]] is not None:
                out.append(before[out[-1]])
            return out[::-1]
        if u in done:
            continue
        done.add(u)
        for v, (w, _) in network.out.get(u, {}).items():
            if v not in done and best[u] + w < best.get(v, math.inf):
                best[v], before[v] = best[u] + w, u
                heapq.heappush(heap, (best[v] + far(v), v))
    return []


class Network:
    """Roads and their adjacency in one process. roads: rows (road_id, start_cross, end_cross, direction, speed, geo_length)."""

    def __init__(self, roads):
        self.roads = {r.road_id: (r.start_cross, r.end_cross, r.direction, r.speed, r.geo_length) for r in roads}
        self.out: dict[int, dict[int, tuple[float, int]]] = {}
        for i in sorted(self.roads):
            a, b, direction, _, length = self.roads[i]
            for flag, u, v in ((FORWARD, a, b), (BACKWARD, b, a)):
                if direction & flag and (v not in self.out.setdefault(u, {}) or length < self.out[u][v][0]):
                    self.out[u][v] = (length, i)
        self._trees: dict[int, Tree] = {}
        self._sums: dict[tuple[int, int], tuple[float, float, float]] = {}
        self._table = None

    def __getstate__(self):
        return {**self.__dict__, "_trees": {}, "_sums": {}, "_table": None}

    def tree(self, source: int) -> Tree:
        if source not in self._trees:
            while self._trees and sum(len(t.best) for t in self._trees.values()) > _TREE_CROSSES:
                self._trees.pop(next(iter(self._trees)))
            self._trees[source] = Tree(self, source)
        return self._trees[source]

    def whole(self, crosses: list[int]) -> list[tuple]:
        """Entities ("road", road, from, to, length) of a list of crosses."""
        return [("road", self.out[u][v][1], u, v, self.out[u][v][0]) for u, v in itertools.pairwise(crosses)]

    def crosses(self, a: int, b: int) -> list[tuple]:
        """Entities from cross to cross; a cross to itself is one point."""
        return [("point", None, a, a, 0.0)] if a == b else self.whole(self.tree(a).path(b))

    def exits(self, p) -> dict[int, tuple]:
        """Crosses by which one leaves a place, with the part of the road up to them (None from a cross)."""
        if p["type"] == "cross":
            return {p["index"]: None}
        a, b, direction, _, length = self.roads[p["index"]]
        out = {}
        if direction & FORWARD:
            out[b] = ("part", p["index"], None, b, length - p["param"])
        if direction & BACKWARD:
            out[a] = ("part", p["index"], None, a, p["param"])
        return out

    def entries(self, p) -> dict[int, tuple]:
        """Crosses by which one reaches a place, with the part of the road from them."""
        if p["type"] == "cross":
            return {p["index"]: None}
        a, b, direction, _, length = self.roads[p["index"]]
        out = {}
        if direction & FORWARD:
            out[a] = ("part", p["index"], a, None, p["param"])
        if direction & BACKWARD:
            out[b] = ("part", p["index"], b, None, length - p["param"])
        return out

    def points(self, p, q) -> list[tuple]:
        """Entities from place to place (structs type, index, param, x, y); empty if there is no way.

        Equal places are one point. On one road, the part between them where its direction allows;
        against it, just the end point. Otherwise the best way out, through and in.
        """
        if p["x"] == q["x"] and p["y"] == q["y"]:
            return [("point", None, *_cross_of(p), 0.0)]
        if p["type"] == q["type"] == "cross":
            return self.crosses(p["index"], q["index"])
        if p["type"] == q["type"] == "road" and p["index"] == q["index"]:
            direction = self.roads[p["index"]][2]
            legal = direction == FORWARD | BACKWARD or (p["param"] <= q["param"] if direction == FORWARD else p["param"] >= q["param"])
            return [("part", p["index"], None, None, abs(p["param"] - q["param"]))] if legal else [("point", None, *_cross_of(q), 0.0)]
        best = (math.inf, 0, 0)
        leave, reach = self.exits(p), self.entries(q)
        for (a, first), (b, last) in itertools.product(leave.items(), reach.items()):
            best = min(best, ((first[4] if first else 0.0) + self.tree(a).distance(b) + (last[4] if last else 0.0), a, b))
        if math.isinf(best[0]):
            return []
        _, a, b = best
        return [e for e in (leave[a], *self.whole(self.tree(a).path(b)), reach[b]) if e]

    def between(self, a: int, b: int) -> tuple[float, float, float]:
        """(length, sum of length x speed, sum of length / speed) of the shortest path."""
        if (a, b) not in self._sums:
            if len(self._sums) >= _TREE_CROSSES:
                self._sums.clear()
            parts = [(e[4], self.roads[e[1]][3]) for e in self.whole(self.tree(a).path(b))]
            self._sums[a, b] = self.tree(a).distance(b), sum(n * v for n, v in parts), sum(n / v for n, v in parts)
        return self._sums[a, b]

    def measured(self, p: dict, q: dict) -> tuple[np.ndarray, ...]:
        """(length, speed, seconds, valid) of the paths that points() gives, for arrays type, index, param, x, y of places."""
        if self._table is None:
            ids = np.array(sorted(self.roads), np.int64)
            rows = [self.roads[i] for i in ids.tolist()]
            self._table = ids, *(np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, np.int64, np.int64, float, float)))
        ids, start, end, direction, speed, length = self._table
        n = len(p["x"])
        sides = []
        for place, forward, backward in ((p, end, start), (q, start, end)):
            on_road = place["type"] == "road"
            at = np.minimum(np.searchsorted(ids, place["index"]), max(len(ids) - 1, 0))
            along, rest = place["param"], (length[at] if len(ids) else 0.0) - place["param"]
            first, second = (rest, along) if place is p else (along, rest)
            none = np.full(n, np.inf)
            flags = direction[at] if len(ids) else np.zeros(n, np.int64)
            v = np.where(on_road, speed[at], 1.0) if len(ids) else np.ones(n)
            cross = lambda ends: np.where(on_road, ends[at], place["index"]) if len(ids) else place["index"]  # noqa: B023, E731
            sides.append((on_road, at, v, [(cross(forward), np.where(on_road, np.where(flags & FORWARD, first, none), 0.0)), (cross(backward), np.where(on_road & ((flags & BACKWARD) != 0), second, none))]))
        (p_road, p_at, p_speed, leave), (q_road, q_at, q_speed, reach) = sides
        best, best_a, best_b, out_p, out_q = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for (a, x), (b, y) in itertools.product(leave, reach):
            open_ = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
            starts, ends, which = _distinct(a[open_], b[open_])
            distance = np.array([self.tree(i).distance(j) for i, j in zip(starts, ends)], float)
            cost = np.full(n, np.inf)
            cost[open_] = x[open_] + distance[which] + y[open_]
            better = (cost < best) | ((cost == best) & np.isfinite(cost) & ((a < best_a) | ((a == best_a) & (b < best_b))))
            best, best_a, best_b, out_p, out_q = (np.where(better, new, old) for new, old in ((cost, best), (a, best_a), (b, best_b), (x, out_p), (y, out_q)))
        here = (p["x"] == q["x"]) & (p["y"] == q["y"])
        same = ~here & p_road & q_road & (p["index"] == q["index"])
        routed = ~here & ~same & np.isfinite(best)
        starts, ends, which = _distinct(best_a[routed], best_b[routed])
        sums = np.array([self.between(i, j) for i, j in zip(starts, ends)], float).reshape(-1, 3)[which]
        total, weighted, seconds = np.where(routed, best, np.inf), np.zeros(n), np.zeros(n)
        weighted[routed] = sums[:, 1] + out_p[routed] * p_speed[routed] + out_q[routed] * q_speed[routed]
        seconds[routed] = sums[:, 2] + out_p[routed] / p_speed[routed] + out_q[routed] / q_speed[routed]
        if same.any():
            flags, step = direction[p_at[same]], q["param"][same] - p["param"][same]
            legal = (flags == FORWARD | BACKWARD) | np.where(flags == FORWARD, step >= 0, step <= 0)
            part = np.where(legal, np.abs(step), 0.0)
            total[same], weighted[same], seconds[same] = part, part * p_speed[same], part / p_speed[same]
        total[here] = 0.0
        return total, np.divide(weighted, total, out=np.zeros(n), where=np.isfinite(total) & (total > 0)), seconds, here | same | routed

    def speed(self, entities: list[tuple]) -> float:
        """Mean speed weighted by length; 0 where the length is 0 or there is no path."""
        total = length_of(entities)
        if not entities or total == 0:
            return 0.0
        return sum(e[4] / total * self.roads[e[1]][3] for e in entities if e[1] is not None)

    def seconds(self, entities: list[tuple]) -> float:
        """Nominal time at the roads' speeds."""
        return sum(e[4] / self.roads[e[1]][3] for e in entities if e[1] is not None)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Distinct pairs of crosses, which are ints of 32 bits, and the place of each given pair among them."""
    keys, which = np.unique((a << 32) | (b & 0xFFFFFFFF), return_inverse=True)
    return (keys >> 32).tolist(), keys.astype(np.int32).tolist(), which


def _cross_of(p) -> tuple:
    return (p["index"], p["index"]) if p["type"] == "cross" else (None, None)


def length_of(entities: list[tuple]) -> float:
    """Total length; infinite for an invalid (empty) path."""
    return sum(e[4] for e in entities) if entities else math.inf


def crosses_on(entities: list[tuple]) -> list[int]:
    """Cross ids along a path, one that repeats its predecessor left out."""
    out: list[int] = []
    for _, _, a, b, _ in entities:
        for c in (a, b):
            if c is not None and (not out or out[-1] != c):
                out.append(c)
    return out


def shared_network(roads: DataFrame):
    """A broadcast Network, after a check that the map is within MOST_ROADS."""
    rows = roads.select("road_id", "start_cross", "end_cross", "direction", "speed", "geo_length").limit(MOST_ROADS + 1).collect()
    if len(rows) > MOST_ROADS:
        raise ValueError(f"the map has over {MOST_ROADS} roads: cut it, or use relaxed_distances")
    return roads.sparkSession.sparkContext.broadcast(Network(rows))


ENTITY = "struct<kind:string,road_id:int,from_cross:int,to_cross:int,length:double>"
ROUTED = f"length double, speed double, seconds double, valid boolean, crosses array<int>, entities array<{ENTITY}>"
_NAMES = ["length", "speed", "seconds", "valid", "crosses", "entities"]


def _routed(network: Network, entities: list[tuple]) -> tuple:
    named = [dict(zip(("kind", "road_id", "from_cross", "to_cross", "length"), e)) for e in entities]
    return length_of(entities), network.speed(entities), network.seconds(entities), bool(entities), crosses_on(entities), named


def route_crosses(roads: DataFrame, pairs: DataFrame, crosses: DataFrame | None = None) -> DataFrame:
    """(src, dst, length, speed, seconds, valid, crosses, entities) of the distinct pairs (src, dst).

    By one Dijkstra tree for each src, or, where crosses (cross_id, x, y) are given, by A* for each pair. A* may
    choose another of several paths of equal length.
    """
    shared = shared_network(roads)
    places = None if crosses is None else {r.cross_id: (r.x, r.y) for r in crosses.select("cross_id", "x", "y").limit(2 * MOST_ROADS).collect()}  # ends of at most MOST_ROADS roads

    def found(network: Network, a: int, b: int) -> list[tuple]:
        return network.crosses(a, b) if places is None or a == b else network.whole(astar(network, places, a, b))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(a, b, *_routed(shared.value, found(shared.value, a, b))) for a, b in zip(part.src.tolist(), part.dst.tolist())]
            yield pd.DataFrame(rows, columns=["src", "dst", *_NAMES])

    return pairs.select(F.col("src").cast("int"), F.col("dst").cast("int")).distinct().repartition("src").sortWithinPartitions("src").mapInPandas(run, f"src int, dst int, {ROUTED}")


PLACE = "struct<type:string,index:int,param:double,x:double,y:double>"


_FIELDS = ("type", "index", "param", "x", "y")


def route_points(roads: DataFrame, pairs: DataFrame, spelled: bool = True) -> DataFrame:
    """(p, q, length, speed, seconds, valid[, crosses, entities]) of the distinct pairs of places (p, q).

    Pairs are dealt by the road or cross of their origin, over SPREAD tasks each so that one origin with a large
    share of all pairs doesn't fill one, and searched in its order. Without `spelled`, only the four numbers
    of each path are made, a batch at a time.
    """
    shared = shared_network(roads)
    origin = [F.col("p.type"), F.col("p.index")]
    distinct = pairs.select("p", "q").distinct().repartition(*origin, F.pmod(F.hash("q"), F.lit(SPREAD))).sortWithinPartitions(*origin)
    if spelled:

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = [(p, q, *_routed(shared.value, shared.value.points(p, q))) for p, q in zip(part.p, part.q)]
                yield pd.DataFrame(rows, columns=["p", "q", *_NAMES])

        return distinct.mapInPandas(run, f"p {PLACE}, q {PLACE}, {ROUTED}")
    names = [f"{s}_{c}" for s in "pq" for c in _FIELDS]
    flat = distinct.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "pq" for c in _FIELDS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = lambda s: {c: np.array(batch.column(f"{s}_{c}").to_pylist(), object if c == "type" else np.int64 if c == "index" else float) for c in _FIELDS}  # noqa: B023, E731
            found = shared.value.measured(place("p"), place("q"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*names, *_NAMES[:4]])

    kinds = ("string", "int", "double", "double", "double")
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds * 2)) + f", {ROUTED.split(', crosses')[0]}"
    place = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in _FIELDS]).alias(s)
    return flat.mapInArrow(measure, schema).select(place("p"), place("q"), *_NAMES[:4])
