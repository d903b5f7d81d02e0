import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trajspark import fixtures as fx
from trajspark.operators.matching import DEFAULTS, MatchParameters
from trajspark.sources import sinks, tables, text
from trajspark.sources.shapefile import read_shapefile
from trajspark.streaming import logs


def test_gps_logs(spark, tmp_path):
    folder = tmp_path / "20240101" / "77"
    folder.mkdir(parents=True)
    (folder / "77-3.txt").write_text("a,2024-01-01 08:00:00,b,c,1.5,2.5\na,2024-01-01 08:00:05,b,c,3,4\nbroken\na,2024-01-01 08:00:09,b,c,5,6\n")
    got = text.with_car(text.read_gps(spark, str(folder))).collect()
    assert [(r.seq, r.ts, r.x, r.y) for r in got] == [(0, datetime(2024, 1, 1, 8), 1.5, 2.5), (1, datetime(2024, 1, 1, 8, 0, 5), 3.0, 4.0)]
    assert {(r.date, r.car_id, r.sub_id) for r in got} == {("20240101", "77", "3")}


def test_timed_paths_round_trip(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 8, 0, 0, 123456)
    df = spark.createDataFrame([(1, 0, 0, 5, t0), (1, 0, 1, 6, t0 + timedelta(seconds=2)), (1, 1, 0, 9, t0)], "traj_id long, range_id int, seq long, cross_id int, ts timestamp")
    sinks.write_timed_paths(df, f"{tmp_path}/out")
    back = text.read_timed_path(spark, f"{tmp_path}/out/traj_id=1/range_id=0").orderBy("seq").collect()
    assert [(r.cross_id, r.ts) for r in back] == [(5, t0), (6, t0 + timedelta(seconds=2))]
    assert {(r.range_id, r.suffix) for r in sinks.range_stem(df.select("traj_id", "range_id").distinct()).collect()} == {(0, "-0"), (1, "-1")}
    data = df.select(F.col("traj_id"), "seq", "cross_id", "ts")
    assert [r.cross_id for r in tables.timed_path(data.where("cross_id < 9"), 1).collect()] == [5, 6]


def test_config_and_work_lists():
    assert text.read_config(text.config_text()) == DEFAULTS
    assert text.read_config("[IVMM]\nwindow=7\nbeta=10.5\n") == MatchParameters(window=7, beta=10.5) and text.read_config("") == DEFAULTS
    assert text.work_list(["# c", "in1", "", "  out1 ", "in2", "out2"]) == [("in1", "out1"), ("in2", "out2")]
    assert text.make_work_list(["/a/b/c/d/e.txt"], "out/") == ["/a/b/c/d/e.txt", "out/c/d/e.txt"]


def test_rank_list(spark, tmp_path):
    (tmp_path / "rank.txt").write_text("4,10,0.5\n7,3,1.25\n")
    rank = text.read_rank(spark, f"{tmp_path}/rank.txt")
    assert {tuple(r) for r in rank.collect()} == {(4, 10, 0.5), (7, 3, 1.25)}
    assert sinks.rank_points(rank, fx.cross(spark)).count() == 2


def test_high_level_map(spark, tmp_path):
    crosses = fx.cross(spark)
    edges = spark.createDataFrame([(0, 4, 13, 50), (1, 13, 22, 60)], "id int, start int, end int, count int")
    from trajspark.operators.trajectories import virtual_edge_endpoints

    ends = virtual_edge_endpoints(edges, crosses).join(edges.select("id", "count"), "id")
    assert sinks.write_virtual_edges(ends, f"{tmp_path}/edges") == 2
    meta = spark.createDataFrame([(0, "00:00:00-24:00:00:12.5"), (1, "00:00:00-12:00:00:5\n12:00:00-24:00:00:9")], "id int, pattern string")
    hot, loaded = tables.load_high_level_map(spark, f"{tmp_path}/edges", meta)
    assert {(r.src, r.dst, r["count"], tuple(b.cost_ms for b in r.bands)) for r in loaded.collect()} == {(4, 13, 50, (12500,)), (13, 22, 60, (5000, 9000))}
    assert {(r.cross_id, r.x, r.y) for r in hot.collect()} == {(4, 400.0, 0.0), (13, 300.0, 100.0), (22, 200.0, 200.0)}


def test_tables_and_patterns(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0, datetime(2024, 1, 1), datetime(2024, 1, 1, 1), 3600)], "c1 int, c2 int, id int, enter timestamp, leave timestamp, cost_ms long")
    made = sinks.virtual_edge_tables(rows, 1, "entropy", 6, 20, 0.8)
    sinks.write_tables(made, str(tmp_path))
    meta = tables.read_table(spark, "virtual_edge_metadata", str(tmp_path))
    bands = spark.createDataFrame([(0, [(0, 86_400_000_000, 2500)])], "edge int, bands array<struct<begin_us:bigint,end_us:bigint,cost_ms:bigint>>")
    assert sinks.with_patterns(meta, bands).first().pattern == "00:00:00-24:00:00:2.5"
    assert tables.read_table(spark, "virtual_edge_data", str(tmp_path)).first().cost == 3600


def test_layers(spark, tmp_path):
    crosses = fx.cross(spark)
    data = spark.createDataFrame([(1, i, c, datetime(2024, 1, 1, i)) for i, c in enumerate([0, 1, 11])], "traj_id long, seq long, cross_id int, ts timestamp")
    assert sinks.trajectory_points(data, crosses).count() == 3 and sinks.trajectory_lines(data, crosses).count() == 2
    boxes = spark.createDataFrame([((0.0, 0.0, 2.0, 1.0),)], "box struct<xmin:double,ymin:double,xmax:double,ymax:double>").withColumn("name", F.lit("b"))
    assert sinks.write_boxes(boxes, f"{tmp_path}/box") == 1 and len(read_shapefile(spark, f"{tmp_path}/box").first().geom) == 5
    ranked = spark.createDataFrame([(0, 11, 5, 1.5)], "rank int, cross_id int, total long, entropy double")
    sinks.write_cross_rank(ranked, crosses, f"{tmp_path}/rank")
    r = read_shapefile(spark, f"{tmp_path}/rank").first()
    assert (r.f0, r.f1, r.f2, float(r.f3), r.geom[0].x) == ("0", "11", "5", 1.5, 100.0)
    foot = spark.createDataFrame([(1, 0, 0, 1, 45)], "query_id long, edge int, src int, dst int, n long")
    assert sinks.foot_graph_layer(foot, crosses).columns == ["START", "END", "DBID", "COUNT", "geom"]


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, dx in (("a.txt", 0), ("b.txt", 100)):
        (folder / name).write_text("".join(f"_,2024-01-01 08:00:{10 * i:02d},_,_,{50 + dx + 45 * i},{i % 3}\n" for i in range(6)))
    query = logs.start_matching(logs.log_stream(spark, str(folder)), fx.road(spark), f"{tmp_path}/out", f"{tmp_path}/state", MatchParameters(radius=30.0))
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/timed").select("traj_id").distinct().count() == 2
    assert {r.status for r in spark.read.parquet(f"{tmp_path}/out/status").collect()} == {"finished"}
    assert os.path.isdir(f"{tmp_path}/state")
