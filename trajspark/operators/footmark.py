"""Footmark graphs: which hot crosses the trajectories that support a query pass after one another.

Out: every point on the start cross opens a segment. It goes on while points are not the start, are less
than 1.25 times the query's duration (in whole seconds) away and strictly inside the query's box, hot
or not; its hot points are kept, and it ends with the end cross. In: the mirror image, backward from
the end cross. Each pair of neighbouring kept points counts one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .lineage import cut

DURATION_FACTOR = 1.25
LEAST_COUNT = 44
_BOX = ("xmin", "ymin", "xmax", "ymax")


#: Points that are searched together; whole trajectories.
_BLOCK = 100_000


def _passages(groups: list, cap: int, outward: bool, traj, cross, us, x, y, hot) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, c1, c2, second, n) of neighbouring kept points of whole trajectories, in order of (traj, seq).

    groups: (opens, closes, box). A pair counts for a limit of more whole seconds than `second`: from the opening to its
    farther point, no point is farther in time.
    """
    if not outward:
        traj, cross, us, x, y, hot = (v[::-1] for v in (traj, cross, us, x, y, hot))
    at = np.arange(len(cross))
    begin = np.maximum.accumulate(np.where(np.append(True, traj[1:] != traj[:-1]), at, 0))
    known, number = np.unique(cross, return_inverse=True)
    for g, (opens, closes, box) in enumerate(groups):
        opening = cross == opens
        if not opening.any():
            continue
        start = np.maximum.accumulate(np.where(opening, at, -1))
        seen = np.flatnonzero(start >= begin)  # from the first opening of a trajectory on
        first, own = start[seen], opening[seen]
        with np.errstate(invalid="ignore"):
            away = np.floor(np.abs(us[seen] - us[first]) / 1e6)
            near = (x[seen] > box[0]) & (x[seen] < box[2]) & (y[seen] > box[1]) & (y[seen] < box[3]) & (away < cap)
        second = np.where(own, 0, np.where(near, away, cap)).astype(np.int64)
        segment = np.cumsum(own) * (cap + 1)
        second = np.maximum.accumulate(segment + second) - segment
        closing = (cross[seen] == closes) & ~own
        closed = np.cumsum(closing)
        ended = closed - closing > closed[np.searchsorted(seen, first)]
        kept = np.flatnonzero((second < cap) & ~ended & (own | hot[seen]))
        a, b = kept[:-1], kept[1:]
        same = first[a] == first[b]
        a, b = a[same], b[same]
        near_, far = number[seen[a]], number[seen[b]]
        c1, c2 = (near_, far) if outward else (far, near_)
        keys, n = np.unique((c1 * len(known) + c2) * (cap + 1) + second[b], return_counts=True)
        yield g, known[keys // (cap + 1) // len(known)], known[keys // (cap + 1) % len(known)], keys % (cap + 1), n


def footmarks(located: DataFrame, queries: DataFrame, hot: DataFrame, outward: bool) -> DataFrame:
    """(query_id, c1, c2, n) for queries (query_id, start_cross, end_cross, seconds, box).

    Queries of the same crosses and box differ in their limit only. So trajectories are searched once for each such
    group, and neighbouring points are counted by the least limit that admits them; a query gets the sum up to its own.
    Only points are dealt. The groups are held by each worker.
    """
    opens, closes = ("start_cross", "end_cross") if outward else ("end_cross", "start_cross")
    asked = queries.select("query_id", F.col(opens).alias("o"), F.col(closes).alias("c"), *[F.col(f"box.{k}").alias(k) for k in _BOX], F.floor(F.col("seconds") * DURATION_FACTOR).cast("long").alias("limit"))
    asked = asked.where("limit > 0").dropna()
    group = ["o", "c", *_BOX]
    rows = asked.groupBy(*group).agg(F.max("limit").alias("most")).collect()
    spark = located.sparkSession
    cap = max((r["most"] for r in rows), default=0)
    shared = spark.sparkContext.broadcast([(r["o"], r["c"], [r[k] for k in _BOX]) for r in rows])
    numbered = spark.createDataFrame([(g, *[r[k] for k in group]) for g, r in enumerate(rows)], StructType([StructField("g", IntegerType()), *[asked.schema[k] for k in group]]))
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    marked = located.where("cross_id IS NOT NULL").join(F.broadcast(hot.select("cross_id", F.lit(True).alias("hot")).distinct()), "cross_id", "left")
    points = marked.select("traj_id", "seq", F.col("cross_id").cast("long"), us.alias("us"), F.col("x").cast("double"), F.col("y").cast("double"), F.coalesce("hot", F.lit(False)).alias("hot"))
    columns = ["traj_id", "cross_id", "us", "x", "y", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            values = [rows.column(c).to_numpy() for c in columns]
            if values[0].dtype == object:
                values[0] = np.unique(values[0], return_inverse=True)[1]
            for g, *found in _passages(shared.value, cap, outward, *values):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), g, np.int32)), *[pa.array(v.astype(np.int64)) for v in found]], ["g", "c1", "c2", "second", "n"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= _BLOCK:
                rows = pa.Table.from_batches(waiting)
                last = rows.column("traj_id")[-1]
                whole = pc.index(pc.equal(rows.column("traj_id"), last), True).as_py()
                if whole:
                    yield from counted(rows.slice(0, whole))
                    waiting = rows.slice(whole).to_batches()
        if sum(b.num_rows for b in waiting):
            yield from counted(pa.Table.from_batches(waiting))

    passed = points.repartition("traj_id").sortWithinPartitions("traj_id", "seq").select(*columns).mapInArrow(run, "g int, c1 long, c2 long, second long, n long")
    # Kept, as it is read twice: rows for each group, pair of crosses and second.
    passed = cut(passed.groupBy("g", "c1", "c2", "second").agg(F.sum("n").alias("n")))
    kind = located.schema["cross_id"].dataType
    mine = asked.join(F.broadcast(numbered), group).select("query_id", "g", "limit")
    limits = passed.select("g", "c1", "c2").distinct().join(mine.select("g", "limit").distinct(), "g")
    both = passed.withColumn("limit", F.lit(None).cast("long")).unionByName(limits.select("g", "c1", "c2", (F.col("limit") - 1).alias("second"), F.lit(0).cast("long").alias("n"), "limit"))
    total = F.sum("n").over(W.partitionBy("g", "c1", "c2").orderBy("second").rangeBetween(W.unboundedPreceding, W.currentRow))
    sums = both.withColumn("n", total).where("limit IS NOT NULL AND n > 0")
    return mine.join(sums, ["g", "limit"]).select("query_id", F.col("c1").cast(kind).alias("c1"), F.col("c2").cast(kind).alias("c2"), "n")


def merged(out: DataFrame, in_: DataFrame, more_than: int = LEAST_COUNT) -> DataFrame:
    """Counts of both sides that are over a number each, added up."""
    return out.where(F.col("n") > more_than).unionByName(in_.where(F.col("n") > more_than)).groupBy("query_id", "c1", "c2").agg(F.sum("n").alias("n"))


def on_graph(foot: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, edge, src, dst, n): footmarks that are edges of the high-level graph."""
    return foot.join(edges.select("edge", F.col("src").alias("c1"), F.col("dst").alias("c2")), ["c1", "c2"]).select("query_id", "edge", F.col("c1").alias("src"), F.col("c2").alias("dst"), "n")
