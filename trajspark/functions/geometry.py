"""Planar geometry as column expressions. A point is struct<x,y>, a line array<struct<x,y>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How near a projected point must be to a segment to lie on it.
ON_SEGMENT = 1e-6
STRAIGHT_DEGREES = 30.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression that is repeated in another grows with every level."""
    return F.element_at(F.transform(F.array(value), use), 1)


def point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def same_point(p, q) -> Column:
    """Equal within rounding."""
    p, q = _col(p), _col(q)
    near = lambda a, b: F.abs(a - b) <= 1e-12 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return near(p["x"], q["x"]) & near(p["y"], q["y"])


def squared_distance(p, q) -> Column:
    p, q = _col(p), _col(q)
    return (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])


def distance(p, q) -> Column:
    return F.sqrt(squared_distance(p, q))


def segments(line) -> Column:
    """array<struct<i,a,b>>: the line's segments, numbered from 1."""
    line = _col(line)
    i = F.sequence(F.lit(1), F.size(line) - 1)
    return F.when(F.size(line) > 1, F.transform(i, lambda n: F.struct(n.alias("i"), F.element_at(line, n).alias("a"), F.element_at(line, n + 1).alias("b"))))


def length(line) -> Column:
    return F.aggregate(F.coalesce(segments(line), F.array().cast("array<struct<i:int,a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def _on_segment(p: Column, s: Column) -> Column:
    """The segment's point that is nearest to p."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy, n))))
    return F.struct((s["a"]["x"] + t * dx).alias("x"), (s["a"]["y"] + t * dy).alias("y"))


def nearest(p, line) -> Column:
    """struct<d2,i,q>: squared distance, segment and point of the line nearest to p; the first on ties."""
    p = _col(p)

    def one(s: Column) -> Column:
        return _let(_on_segment(p, s), lambda q: F.struct(squared_distance(p, q).alias("d2"), s["i"].alias("i"), q.alias("q")))

    return F.array_min(F.transform(segments(line), one))


def project_point(p, line) -> Column:
    return nearest(p, line)["q"]


def point_line_distance(p, line) -> Column:
    return F.sqrt(nearest(p, line)["d2"])


def envelope(line) -> Column:
    """struct<xmin,ymin,xmax,ymax>"""
    line = _col(line)
    xs, ys = F.transform(line, lambda q: q["x"]), F.transform(line, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def range_box(p, r) -> Column:
    """The square around p of half side r."""
    p, r = _col(p), r if isinstance(r, Column) else F.lit(float(r))
    return F.struct((p["x"] - r).alias("xmin"), (p["y"] - r).alias("ymin"), (p["x"] + r).alias("xmax"), (p["y"] + r).alias("ymax"))


def expand(box, by) -> Column:
    """A box grown by an amount on all sides."""
    box = _col(box)
    return F.struct((box["xmin"] - by).alias("xmin"), (box["ymin"] - by).alias("ymin"), (box["xmax"] + by).alias("xmax"), (box["ymax"] + by).alias("ymax"))


def correct(box) -> Column:
    """A box with its corners in order."""
    box = _col(box)
    lo, hi = lambda a: F.least(box[f"{a}min"], box[f"{a}max"]), lambda a: F.greatest(box[f"{a}min"], box[f"{a}max"])
    return F.struct(lo("x").alias("xmin"), lo("y").alias("ymin"), hi("x").alias("xmax"), hi("y").alias("ymax"))


def within(p, box) -> Column:
    """Strictly inside."""
    p, box = _col(p), _col(box)
    return (p["x"] > box["xmin"]) & (p["x"] < box["xmax"]) & (p["y"] > box["ymin"]) & (p["y"] < box["ymax"])


def covered_by(p, box) -> Column:
    """Inside or on the edge."""
    p, box = _col(p), _col(box)
    return (p["x"] >= box["xmin"]) & (p["x"] <= box["xmax"]) & (p["y"] >= box["ymin"]) & (p["y"] <= box["ymax"])


def boxes_meet(a, b) -> Column:
    """One covers the other, or their interiors meet: boxes that only touch don't count."""
    a, b = _col(a), _col(b)

    def covers(p, q):
        return (p["xmin"] <= q["xmin"]) & (p["ymin"] <= q["ymin"]) & (p["xmax"] >= q["xmax"]) & (p["ymax"] >= q["ymax"])

    return covers(a, b) | covers(b, a) | ((a["xmin"] < b["xmax"]) & (a["xmax"] > b["xmin"]) & (a["ymin"] < b["ymax"]) & (a["ymax"] > b["ymin"]))


def make_project_point(p, line, road_id, start_cross, end_cross, near: Column | None = None) -> Column:
    """struct<type,index,param,x,y>: where p projects on a road, as a cross of it or a place along it.

    near is nearest(p, line) where a column has it already: it is used several times.
    """
    line = _col(line)

    def told(n: Column) -> Column:
        q = n["q"]
        start, end = same_point(q, F.element_at(line, 1)), same_point(q, F.element_at(line, -1))
        before = F.aggregate(F.filter(segments(line), lambda s: s["i"] < n["i"]), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))
        along = before + distance(F.element_at(line, n["i"]), q)
        return F.struct(
            F.when(start | end, "cross").otherwise("road").alias("type"),
            F.when(start, _col(start_cross)).when(end, _col(end_cross)).otherwise(_col(road_id)).cast("int").alias("index"),
            F.when(start, 0.0).when(end, length(line)).otherwise(along).alias("param"),
            q["x"].alias("x"),
            q["y"].alias("y"),
        )

    return _let(nearest(p, line) if near is None else near, told)


def cross_project_point(cross_id, x, y) -> Column:
    return F.struct(F.lit("cross").alias("type"), _col(cross_id).cast("int").alias("index"), F.lit(0.0).alias("param"), _col(x).alias("x"), _col(y).alias("y"))


def make_part_of_road(start, end, line, road_id, start_cross, end_cross) -> Column:
    """struct<road_id,start,end,length>: the part of a road between the projections of two points."""
    ends = F.struct(make_project_point(start, line, road_id, start_cross, end_cross).alias("a"), make_project_point(end, line, road_id, start_cross, end_cross).alias("b"))
    return _let(ends, lambda e: F.struct(_col(road_id).alias("road_id"), e["a"].alias("start"), e["b"].alias("end"), F.abs(e["a"]["param"] - e["b"]["param"]).alias("length")))


def part_geometry(start, end, line) -> Column:
    """The sub-line between two places of a road, reversed if the end comes first."""
    line = _col(line)

    def cut(e: Column) -> Column:
        onward = e["a"]["param"] <= e["b"]["param"]
        lo, hi = F.when(onward, e["a"]).otherwise(e["b"]), F.when(onward, e["b"]).otherwise(e["a"])
        at = F.transform(F.sequence(F.lit(1), F.size(line)), lambda i: F.struct(F.element_at(line, i).alias("p"), length(F.slice(line, 1, i)).alias("m")))
        inner = F.transform(F.filter(at, lambda v: (v["m"] > lo["param"] + ON_SEGMENT) & (v["m"] < hi["param"] - ON_SEGMENT)), lambda v: v["p"])
        points = F.concat(F.array(point(lo["x"], lo["y"])), inner, F.array(point(hi["x"], hi["y"])))
        return F.when(onward, points).otherwise(F.reverse(points))

    return _let(F.struct(_col(start).alias("a"), _col(end).alias("b")), cut)


def road_geometry(line, start_cross, from_cross) -> Column:
    """A road's line in the direction of travel."""
    return F.when(_col(start_cross) == _col(from_cross), _col(line)).otherwise(F.reverse(_col(line)))


def joined_lines(lines) -> Column:
    """One line of an array of lines in order, without points that repeat at their ends."""
    flat = F.flatten(_col(lines))
    i = F.sequence(F.lit(1), F.size(flat))
    kept = F.filter(i, lambda n: (n == 1) | ~same_point(F.element_at(flat, n), F.element_at(flat, F.greatest(n - 1, F.lit(1)))))
    return F.transform(kept, lambda n: F.element_at(flat, n))


def direction(ax, ay, bx, by) -> Column:
    """0 straight (under 30 degrees), 1 right, -1 left, of vector b after vector a.

    Where the cosine is undefined (a zero vector) or just above 1, the angle is not a number and
    the turn is decided by the cross product, so it is a left one unless that is negative.
    """
    ax, ay, bx, by = map(_col, (ax, ay, bx, by))
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.try_divide(ax * bx + ay * by, norm)
    small = cosine.isNotNull() & (cosine <= 1.0) & (F.acos(F.least(cosine, F.lit(1.0))) < F.radians(F.lit(STRAIGHT_DEGREES)))
    return F.when(small, 0).when(ax * by - ay * bx < 0, 1).otherwise(-1)


def from_wkt(text) -> Column:
    """The points of a POINT, LINESTRING or single-ring POLYGON in well-known text."""
    body = F.regexp_extract(_col(text), r"^\s*[A-Za-z]+\s*\(+([^()]*)\)+\s*$", 1)
    parts = F.split(F.trim(body), r"\s*,\s*")
    pairs = F.transform(parts, lambda s: F.split(F.trim(s), r"\s+"))
    return F.when(body != "", F.transform(pairs, lambda v: F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y"))))


def to_wkt(line) -> Column:
    line = _col(line)
    body = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    return F.when(F.size(line) == 1, F.concat(F.lit("POINT("), body, F.lit(")"))).otherwise(F.concat(F.lit("LINESTRING("), body, F.lit(")")))
