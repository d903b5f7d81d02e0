import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trajspark.operators import footmark


def brute(rows, query, hot, outward):
    """Counts of (c1, c2) by walking every trajectory."""
    _, start, end, seconds, (x0, y0, x1, y1) = query
    opens, closes = (start, end) if outward else (end, start)
    out = {}
    for traj in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == traj), key=lambda r: r[1] if outward else -r[1])
        kept, opened, on = [], None, False
        for _, _, cross, ts, x, y in own:
            if cross == opens:
                kept, opened, on = [cross], ts, True
                continue
            if not on:
                continue
            inside = x is not None and x0 < x < x1 and y0 < y < y1
            if not inside or not abs((ts - opened) / timedelta(seconds=1)) < int(seconds * 1.25 // 1):
                on = False
                continue
            if cross in hot:
                pair = (kept[-1], cross) if outward else (cross, kept[-1])
                out[pair] = out.get(pair, 0) + 1
                kept.append(cross)
            if cross == closes:
                on = False
    return out


@pytest.mark.parametrize("outward", [True, False])
def test_footmarks_of_queries_that_differ_in_time_alone(spark, outward, monkeypatch):
    """Against walks; times that go back, missing places and several blocks included."""
    rng = random.Random(5)
    t0, rows = datetime(2024, 1, 1), []
    for traj in range(12):
        t = t0
        for seq in range(40):
            t += timedelta(milliseconds=rng.choice([500, 1000, 2500, -300]))
            cross = rng.randrange(7)
            rows.append((traj, seq, cross, t, None if rng.random() < 0.02 else float(cross), float(cross % 3)))
    located = spark.createDataFrame(rows, "traj_id long, seq long, cross_id int, ts timestamp, x double, y double").repartition(3)
    hot = [0, 2, 3, 5]
    boxes = [(-1.0, -1.0, 9.0, 9.0), (-1.0, -1.0, 4.5, 9.0)]
    queries = [(i, a, b, s, box) for i, (a, b, s, box) in enumerate((a, b, s, box) for a, b in ((0, 3), (2, 2), (5, 0)) for s in range(0, 30, 2) for box in boxes)]
    asked = spark.createDataFrame(queries, "query_id long, start_cross int, end_cross int, seconds long, box struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    monkeypatch.setattr(footmark, "_BLOCK", 50)
    found = footmark.footmarks(located, asked, spark.createDataFrame([(h,) for h in hot], "cross_id int"), outward)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.c1, r.c2] = r.n
    assert got == {q[0]: w for q in queries if (w := brute(rows, q, hot, outward))}


def test_footmarks_deal_points_once(spark):
    """The points that reach the shuffle are those given, however many queries there are."""
    rows = [(t, s, (t + s) % 4, datetime(2024, 1, 1) + timedelta(seconds=s), 1.0 * ((t + s) % 4), 1.0) for t in range(5) for s in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    located = spark.createDataFrame(rows, "traj_id long, seq long, cross_id int, ts timestamp, x double, y double").mapInArrow(count, "traj_id long, seq long, cross_id int, ts timestamp, x double, y double")
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.lit(0).alias("start_cross"), F.lit(2).alias("end_cross"), (F.col("id") + 1).alias("seconds"), F.struct(*[F.lit(v).alias(k) for k, v in (("xmin", -9.0), ("ymin", -9.0), ("xmax", 9.0), ("ymax", 9.0))]).alias("box"))
    found = footmark.footmarks(located, queries, spark.range(4).select(F.col("id").cast("int").alias("cross_id")), True)
    assert found.select("query_id").distinct().count() > 290
    assert seen.value == 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "traj_id" not in plan
