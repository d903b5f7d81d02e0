"""The high-level graph of hot crosses with time-dependent edges: overlays, earliest arrival, k shortest paths.

An edge's weight is looked up at the time of departure. Searches label each cross once, in order of
arrival, so where leaving later would arrive earlier the result is that of label setting.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import weights
from .routing import route_crosses
from .spatial import nearby_hot

MOST_EDGES = 5_000_000


class HighLevelGraph:
    """Virtual edges (edge, src, dst, bands) in one process; successors in order of edge."""

    def __init__(self, edges, mode: str = "compat"):
        self.mode, self.out, self.ends, self.base, self.places = mode, {}, {}, None, {}
        for e, a, b, bands in sorted(edges, key=lambda r: r[0]):
            self._add(e, a, b, bands)

    def _add(self, e: int, a: int, b: int, bands) -> None:
        self.out.setdefault(a, []).append((e, b, [tuple(x) for x in bands]))
        self.out.setdefault(b, [])
        self.ends[e] = (a, b)

    def has_cross(self, c: int) -> bool:
        return c in self.out or c in self.places or (self.base is not None and self.base.has_cross(c))

    def has_edge(self, e: int) -> bool:
        return e in self.ends or (self.base is not None and self.base.has_edge(e))

    def outgoing(self, c: int) -> list:
        """Edges (edge, to, bands) from a cross, lasting ones first."""
        return (self.base.outgoing(c) if self.base else []) + self.out.get(c, [])

    def with_overlay(self, edges, crosses=()) -> HighLevelGraph:
        """This graph and one query's temporary crosses (id, x, y) and edges; the lasting part is shared, not copied."""
        made = HighLevelGraph([], self.mode)
        made.base = self
        for c, x, y in crosses:
            if made.has_cross(c):
                raise ValueError("a temporary cross has the number of another")
            made.places[c] = (x, y)
        for e, a, b, bands in edges:
            if a == b:
                raise ValueError("a temporary edge joins a cross with itself")
            if made.has_edge(e):
                raise ValueError("a temporary edge has the number of another")
            made._add(e, a, b, bands)
        return made

    def find_edge(self, a: int, b: int) -> int:
        return next((e for e, v, _ in self.outgoing(a) if v == b), -1)

    def earliest(self, a: int, t: int, b: int, edges=frozenset(), crosses=frozenset(), latest: int | None = None, ignore=None) -> list[tuple[int, int]]:
        """[(cross, arrival)] from a at t to b, or []; without the deleted edges and crosses, arrivals after
        `latest` and crosses that `ignore` accepts. The start itself is never deleted."""
        best, before, done = {a: t}, {a: None}, set()
        heap = [(t, a)]
        while heap:
            now, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u == b:
                path = [u]
                while before[path[-1]] is not None:
                    path.append(before[path[-1]])
                return [(c, best[c]) for c in reversed(path)]
            for e, v, bands in self.outgoing(u):
                if v in done or v in crosses or e in edges or (ignore and ignore(v)):
                    continue
                then = now + weights.at(bands, now, self.mode) * 1000
                if latest is not None and then > latest:
                    continue
                if v not in best or then < best[v]:
                    best[v], before[v] = then, u
                    heapq.heappush(heap, (then, v))
        return []

    def k_shortest(self, a: int, t: int, b: int, latest: int) -> Iterator[list[tuple[int, int]]]:
        """Loopless paths in order of arrival, each found when it is asked for.

        A path is varied from where it left its parent onwards. There, the next edges of all accepted
        paths with the same beginning are closed; further on, its own next edge too. A variation counts
        only if it arrives later than its parent, so ways that tie with it are not listed.
        """
        first = self.earliest(a, t, b)
        accepted: list[tuple[list, int]] = []
        waiting: list[tuple[int, int, list, int]] = []
        order = 0
        following = (first, 0) if first else None
        while following:
            path, deviation = following
            accepted.append(following)
            yield path
            arrived = path[-1][1]
            closed_edges: set[int] = set()
            closed_crosses = {c for c, _ in path[:deviation]}
            for i in range(deviation, len(path) - 1):
                root, (here, now) = path[: i + 1], path[i]
                if i == deviation:
                    closed_edges |= {self.find_edge(here, p[i + 1][0]) for p, _ in accepted if len(p) > i + 1 and p[: i + 1] == root}
                else:
                    closed_edges.add(self.find_edge(here, path[i + 1][0]))
                if any(e not in closed_edges for e, _, _ in self.outgoing(here)):
                    spur = self.earliest(here, now, b, closed_edges, closed_crosses, latest)
                    if spur and spur[-1][1] > arrived:
                        heapq.heappush(waiting, (spur[-1][1], order, root[:-1] + spur, i))
                        order += 1
                closed_crosses.add(here)
            if waiting:
                _, _, following, deviation = heapq.heappop(waiting)
                following = (following, deviation)
            else:
                following = None


def shared_graph(edges: DataFrame, mode: str = "compat"):
    """A broadcast HighLevelGraph of (edge, src, dst, bands), after a check of its size."""
    rows = edges.select("edge", "src", "dst", "bands").limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"the graph has over {MOST_EDGES} edges")
    return edges.sparkSession.sparkContext.broadcast(HighLevelGraph(rows, mode))


def weigh(edges: DataFrame, t_us: Column, mode: str = "compat") -> DataFrame:
    """edges with cost_ms and arrival_us of a departure."""
    return edges.withColumn("cost_ms", weights.weight_at(F.col("bands"), t_us, mode)).withColumn("arrival_us", weights.arrival(F.col("bands"), t_us, mode))


def earliest_arrival(edges: DataFrame, queries: DataFrame, mode: str = "compat") -> DataFrame:
    """(query_id, src, dst, t0_us, arrival_us, path) of queries (query_id, src, dst, t0_us); null where there is no way."""
    shared = shared_graph(edges, mode)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for q, a, b, t in zip(part.query_id, part.src, part.dst, part.t0_us):
                path = shared.value.earliest(int(a), int(t), int(b))
                rows.append((q, a, b, t, path[-1][1] if path else None, [{"cross_id": c, "tod_us": x} for c, x in path] or None))
            yield pd.DataFrame(rows, columns=["query_id", "src", "dst", "t0_us", "arrival_us", "path"]).astype({"arrival_us": "Int64"})

    return queries.select("query_id", F.col("src").cast("int"), F.col("dst").cast("int"), "t0_us").repartition("query_id").mapInPandas(run, f"query_id long, src int, dst int, t0_us long, arrival_us long, path {PATH}")


PATH = "array<struct<cross_id:int,tod_us:bigint>>"
OVERLAY = "overlay array<struct<edge:int,src:int,dst:int,bands:array<struct<begin_us:bigint,end_us:bigint,cost_ms:bigint>>>>"


def k_shortest_paths(edges: DataFrame, queries: DataFrame, most: int, mode: str = "compat") -> DataFrame:
    """(query_id, k, arrival_us, path) of queries (query_id, src, dst, t0_us, latest_us[, overlay]): up to `most` paths.

    A query without a first path has no rows. An overlay holds the query's temporary edges.
    """
    shared = shared_graph(edges, mode)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                graph = shared.value
                if getattr(r, "overlay", None) is not None and len(r.overlay):
                    graph = graph.with_overlay([(x["edge"], x["src"], x["dst"], [(b["begin_us"], b["end_us"], b["cost_ms"]) for b in x["bands"]]) for x in r.overlay])
                for k, path in enumerate(graph.k_shortest(int(r.src), int(r.t0_us), int(r.dst), int(r.latest_us))):
                    if k >= most:
                        break
                    rows.append((r.query_id, k, path[-1][1], [{"cross_id": c, "tod_us": x} for c, x in path]))
            yield pd.DataFrame(rows, columns=["query_id", "k", "arrival_us", "path"])

    return queries.repartition("query_id").mapInPandas(run, f"query_id long, k int, arrival_us long, path {PATH}")


def attach_endpoints(edges: DataFrame, hot: DataFrame, roads: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, edge, src, dst, bands): temporary edges of ends (id, cross_id, x, y, outgoing) that are not hot.

    An end is joined with the hot crosses around it, at the nominal time of the shortest road path;
    from a start to them, from them to an end. Pairs without a path have no edge. Numbers follow
    those of the lasting edges, separately for every id.
    """
    from pyspark.sql import Window as W

    cold = ends.join(hot.select("cross_id"), "cross_id", "left_anti")
    near = nearby_hot(cold.select("id", "x", "y"), hot).join(cold.select("id", F.col("cross_id").alias("own"), "outgoing"), "id")
    pairs = near.select("id", F.when(F.col("outgoing"), F.col("own")).otherwise(F.col("cross_id")).alias("src"), F.when(F.col("outgoing"), F.col("cross_id")).otherwise(F.col("own")).alias("dst"))
    routed = pairs.join(route_crosses(roads, pairs).where("valid").select("src", "dst", "seconds"), ["src", "dst"])
    most = edges.agg(F.coalesce(F.max("edge"), F.lit(-1)).alias("most"))
    number = F.row_number().over(W.partitionBy("id").orderBy("src", "dst"))
    return routed.join(most, F.lit(True)).select("id", (F.col("most") + number).cast("int").alias("edge"), "src", "dst", weights.constant(F.col("seconds") * 1000).alias("bands"))


def search_box(points: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, box): the envelope of points (by, x, y), grown by its lesser side, cut to a whole number."""
    box = points.groupBy(by).agg(F.struct(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")).alias("box"))
    lesser = F.least(F.col("box.xmax") - F.col("box.xmin"), F.col("box.ymax") - F.col("box.ymin")).cast("long")
    return box.select(by, G.expand("box", lesser).alias("box"))
