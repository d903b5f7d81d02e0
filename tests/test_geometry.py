import math

import pytest
from pyspark.sql import functions as F

from trajspark.functions import geometry as G


def line(*points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def value(spark, column):
    # Not a query of constants alone, which the optimizer would evaluate over and over.
    return spark.createDataFrame([(0,)], "z int").select(column.alias("v")).first().v


def pt(x, y):
    return G.point(F.lit(float(x)), F.lit(float(y)))


#: Point, line, its projection and distance.
PROJECTIONS = [
    ((1, 2), [(0, 0), (2, 0)], (1, 0), 2.0),
    ((0, 2), [(0, 0), (1, 0), (1, 1), (2, 1)], (1, 1), math.sqrt(2)),
    ((0, -2), [(0, 0), (1, 1), (2, 1), (2, 2), (2, 3), (-2, 3), (-2, 1), (-1, 1), (0, 0)], (0, 0), 2.0),
]


@pytest.mark.parametrize("p,points,q,d", PROJECTIONS)
def test_projection(spark, p, points, q, d):
    got = value(spark, G.nearest(pt(*p), line(*points)))
    assert (got.q.x, got.q.y) == q and math.sqrt(got.d2) == pytest.approx(d)
    assert value(spark, G.point_line_distance(pt(*p), line(*points))) == pytest.approx(d)


def test_project_point_types(spark):
    road = line((0, 0), (1, 0), (1, 1), (2, 1))
    at = lambda p: value(spark, G.make_project_point(pt(*p), road, F.lit(7), F.lit(3), F.lit(4)))
    assert tuple(at((-1, -1)))[:3] == ("cross", 3, 0.0)
    assert tuple(at((3, 1)))[:3] == ("cross", 4, 3.0)
    assert tuple(at((1.2, 0.3))) == ("road", 7, pytest.approx(1.3), 1.0, pytest.approx(0.3))
    assert at((0.25, -1)).param == pytest.approx(0.25)


def test_part_of_road(spark):
    road = line((0, 0), (1, 0), (1, 1), (2, 1))
    part = G.make_part_of_road(pt(0.5, -1), pt(1.5, 2), road, F.lit(7), F.lit(3), F.lit(4))
    got = value(spark, part)
    assert got.length == pytest.approx(2.0)
    geom = [(p.x, p.y) for p in value(spark, G.part_geometry(part["start"], part["end"], road))]
    assert geom == [(0.5, 0.0), (1.0, 0.0), (1.0, 1.0), (1.5, 1.0)]
    assert [(p.x, p.y) for p in value(spark, G.part_geometry(part["end"], part["start"], road))] == geom[::-1]


def test_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("xmin", "ymin", "xmax", "ymax"))])
    meets = lambda a, b: value(spark, G.boxes_meet(box(*a), box(*b)))
    assert meets((0, 0, 2, 2), (1, 1, 3, 3)) and meets((0, 0, 4, 4), (0, 1, 2, 2)) and not meets((0, 0, 1, 1), (1, 0, 2, 1))
    assert value(spark, G.within(pt(1, 1), box(0, 0, 2, 2))) and not value(spark, G.within(pt(0, 1), box(0, 0, 2, 2))) and value(spark, G.covered_by(pt(0, 1), box(0, 0, 2, 2)))
    assert tuple(value(spark, G.correct(box(3, 5, 1, 2)))) == (1.0, 2.0, 3.0, 5.0)
    assert tuple(value(spark, G.expand(G.range_box(pt(1, 1), 2), 1))) == (-2.0, -2.0, 4.0, 4.0)


@pytest.mark.parametrize("a,b,turn", [((1, 0), (1, 0.1), 0), ((1, 0), (0, 1), -1), ((1, 0), (0, -1), 1), ((1, 0), (-1, 0), -1), ((0, 0), (1, 0), -1), ((1, 0), (0, 0), -1)])
def test_direction(spark, a, b, turn):
    assert value(spark, G.direction(*[F.lit(float(x)) for x in (*a, *b)])) == turn


def test_wkt(spark):
    assert [(p.x, p.y) for p in value(spark, G.from_wkt(F.lit("LINESTRING(0 1,2.5 -3)")))] == [(0.0, 1.0), (2.5, -3.0)]
    assert value(spark, G.to_wkt(G.from_wkt(F.lit("POINT (1 2)")))) == "POINT(1.0 2.0)"
    assert value(spark, G.from_wkt(F.lit("nonsense"))) is None
    assert len(value(spark, G.from_wkt(F.lit("POLYGON((0 0,1 0,1 1,0 0))")))) == 4


def test_joined_lines(spark):
    lines = F.array(line((0, 0), (1, 0)), line((1, 0), (1, 1)))
    assert [(p.x, p.y) for p in value(spark, G.joined_lines(lines))] == [(0, 0), (1, 0), (1, 1)]
    assert value(spark, G.length(line((0, 0), (3, 4), (3, 5)))) == pytest.approx(6.0)
