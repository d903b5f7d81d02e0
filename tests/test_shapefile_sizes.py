import struct

import pytest
from pyspark.sql import functions as F

from trajspark.sources import shapefile
from trajspark.sources.shapefile import LINE, POINT, read_shapefile, write_shapefile


def layer(spark, n):
    """Records of one to four points, with texts that aren't ASCII, missing values and numbers of several widths."""
    i = F.col("id")
    geom = F.transform(F.sequence(F.lit(0), (i % 4).cast("int") + 1), lambda k: F.struct((i * 1.5 + k).alias("x"), (-i - k * 0.25).alias("y")))
    return spark.range(n, numPartitions=5).orderBy(F.desc("id")).select("id", F.when(i % 3 > 0, F.concat(F.lit("é" * 8), i.cast("string"))).alias("name"), (i / 7).alias("share"), geom.alias("geom"))


def test_a_layer_is_written_piece_by_piece(spark, tmp_path, monkeypatch):
    """No row reaches the driver, in order and whole, with more records than a reader's chunk."""
    frame, collect = type(spark.range(0)), type(spark.range(0)).collect
    monkeypatch.setattr(frame, "collect", lambda self: got if len(got := collect(self)) < 2 else pytest.fail("rows were gathered on the driver"))
    monkeypatch.setattr(shapefile, "CHUNK", 300)
    rows = layer(spark, 1000)
    assert write_shapefile(rows, f"{tmp_path}/lines", kind=LINE) == 1000
    monkeypatch.undo()
    got = sorted(read_shapefile(spark, f"{tmp_path}/lines").collect(), key=lambda r: r.record)
    for r, want in zip(got, rows.collect(), strict=True):
        assert r.geom == want.geom
        assert (int(r.f0), r.f1, r.f2) == (want.id, want.name or "", f"{want.share:.9f}")
    for end in (".shp", ".shx"):
        raw = (tmp_path / f"lines{end}").read_bytes()
        assert struct.unpack(">I", raw[24:28])[0] * 2 == len(raw)
        assert struct.unpack("<4d", raw[36:68]) == (0.0, -999.0 - 4 * 0.25, 999 * 1.5 + 4, 0.0)


def test_points_and_empty_layers(spark, tmp_path):
    rows = layer(spark, 20)
    assert write_shapefile(rows, f"{tmp_path}/points.shp", kind=POINT) == 20
    got = sorted(read_shapefile(spark, f"{tmp_path}/points").collect(), key=lambda r: r.record)
    assert [[(p.x, p.y) for p in r.geom] for r in got] == [[(r.geom[0].x, r.geom[0].y)] for r in rows.collect()]
    assert write_shapefile(rows.where("id < 0"), f"{tmp_path}/none") == 0
    assert read_shapefile(spark, f"{tmp_path}/none").count() == 0


def test_long_texts_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="over 254 bytes"):
        write_shapefile(layer(spark, 3).withColumn("name", F.lit("a" * 255)), f"{tmp_path}/long")
