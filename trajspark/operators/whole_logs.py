"""Candidates and interactive voting by kernels that hold the map, for many logs.

The same results as the joins of `matching`, without a row for each pair of candidates: candidates are
found point by point, and a partition of whole logs is measured and voted on in groups. Only points
are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from .routing import ENTITY, MOST_ROADS, shared_network
from .spatial import WIDER

GROWTH = 1.1
#: Points whose roads are looked up together; far ones, which reach more roads.
_SLICE, _FAR_SLICE = 1000, 50
#: Points of the logs that are voted on together, and bytes of their back pointers.
_GROUP, _POINTERS = 3000, 8_000_000


class Lines:
    """Roads (road_id, start_cross, end_cross, geom) in one process, in grids of square cells made when they are asked for."""

    def __init__(self, roads):
        roads = [r for r in roads if r.geom is not None and len(r.geom) > 1]
        column = lambda name: np.array([getattr(r, name) for r in roads], np.int64)
        self.ids, self.start, self.end = column("road_id"), column("start_cross"), column("end_cross")
        sizes = np.array([len(r.geom) - 1 for r in roads], np.int64)
        x, y = (np.array([p[c] for r in roads for p in r.geom], float) for c in "xy")
        first_point = np.cumsum(sizes + 1) - (sizes + 1)
        self.size, self.first = sizes, np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(roads)), sizes)
        self.ax, self.ay, self.bx, self.by = x[at], y[at], x[at + 1], y[at + 1]
        step = np.sqrt((self.ax - self.bx) * (self.ax - self.bx) + (self.ay - self.by) * (self.ay - self.by))
        self.before, self.length = np.zeros(len(step)), np.zeros(len(roads))
        for i, (f, n) in enumerate(zip(self.first.tolist(), sizes.tolist())):  # each from zero: sums in the order of the line
            sums = np.cumsum(step[f : f + n])
            self.before[f + 1 : f + n], self.length[i] = sums[:-1], sums[-1]
        self.head, self.tail = (x[first_point], y[first_point]), (x[first_point + sizes], y[first_point + sizes])
        self.box = [f.reduceat(v, first_point) if len(roads) else np.zeros(0) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
        self._grids: dict[float, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "_grids": {}}

    def _grid(self, cell: float) -> tuple:
        """(least and most cell, numbers of cells that hold roads, first road of each, roads)"""
        if cell not in self._grids:
            x0, y0, x1, y1 = (np.floor(v / cell).astype(np.int64) for v in self.box)
            wide, high = x1 - x0 + 1, y1 - y0 + 1
            road = np.repeat(np.arange(len(self.ids)), wide * high)
            nth = np.arange(len(road)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
            span = int(y1.max() - y0.min() + 1)
            key = (x0[road] + nth // high[road] - x0.min()) * span + (y0[road] + nth % high[road] - y0.min())
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self._grids[cell] = (int(x0.min()), int(y0.min()), int(x1.max()), int(y1.max())), span, keys, np.append(first, len(road)), road[order]
        return self._grids[cell]

    def near(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, cell: float) -> dict[str, np.ndarray]:
        """The roads at most r from points: point, road (position), d, segment, qx, qy, in order of (point, d, road_id)."""
        (left, low, right, top), span, keys, first, roads = self._grid(cell)
        square = x - r, y - r, x + r, y + r
        cells = [np.clip(np.floor(v / cell), a, b).astype(np.int64) for v, a, b in zip(square, (left, low, left, low), (right, top, right, top))]
        meets = (np.floor(square[0] / cell) <= right) & (np.floor(square[2] / cell) >= left) & (np.floor(square[1] / cell) <= top) & (np.floor(square[3] / cell) >= low)
        found = []
        for i in range(int((cells[2] - cells[0]).max(initial=-1)) + 1):
            for j in range(int((cells[3] - cells[1]).max(initial=-1)) + 1):
                cx, cy = cells[0] + i, cells[1] + j
                at = np.flatnonzero(meets & (cx <= cells[2]) & (cy <= cells[3]))
                key = (cx[at] - left) * span + (cy[at] - low)
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                at, k = at[keys[k] == key], k[keys[k] == key]
                n = first[k + 1] - first[k]
                point = np.repeat(at, n)
                road = roads[np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(len(point))]
                once = (np.floor(np.maximum(square[0][point], self.box[0][road]) / cell) == cx[point]) & (np.floor(np.maximum(square[1][point], self.box[1][road]) / cell) == cy[point])
                found.append((point[once], road[once]))
        point, road = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        a, b = [v[point] for v in square], [v[road] for v in self.box]
        covers = lambda p, q: (p[0] <= q[0]) & (p[1] <= q[1]) & (p[2] >= q[2]) & (p[3] >= q[3])
        meet = covers(a, b) | covers(b, a) | ((a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1]))
        point, road = point[meet], road[meet]
        n = self.size[road]
        start = np.cumsum(n) - n
        pair = np.repeat(np.arange(len(road)), n)
        s = np.repeat(self.first[road] - start, n) + np.arange(len(pair))
        px, py, ax, ay = x[point][pair], y[point][pair], self.ax[s], self.ay[s]
        dx, dy = self.bx[s] - ax, self.by[s] - ay
        norm = dx * dx + dy * dy
        t = np.divide((px - ax) * dx + (py - ay) * dy, norm, out=np.zeros(len(s)), where=norm != 0)
        t = np.minimum(1.0, np.maximum(0.0, t))
        qx, qy = ax + t * dx, ay + t * dy
        d2 = (px - qx) * (px - qx) + (py - qy) * (py - qy)
        least = np.flatnonzero(d2 == np.repeat(np.minimum.reduceat(d2, start), n)) if len(pair) else np.zeros(0, np.int64)
        least = least[np.diff(pair[least], prepend=-1) != 0]
        d = np.sqrt(d2[least])
        kept = np.flatnonzero(d <= r[point])
        kept = kept[np.lexsort((self.ids[road[kept]], d[kept], point[kept]))]
        at = least[kept]
        return {"point": point[kept], "road": road[kept], "d": d[kept], "segment": s[at], "qx": qx[at], "qy": qy[at]}

    def growing(self, x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[dict[str, np.ndarray]]:
        """near() of finite points, in a radius that grows by tenths where no road is in it."""
        for i in range(0, len(x) if len(self.ids) else 0, _SLICE):
            a, b = x[i : i + _SLICE], y[i : i + _SLICE]
            found = [self.near(a, b, np.full(len(a), radius), radius)]
            far = np.setdiff1d(np.arange(len(a)), found[0]["point"])
            for j in range(0, len(far), _FAR_SLICE):
                reach, rest = radius, far[j : j + _FAR_SLICE]
                while len(rest):
                    reach *= WIDER
                    one = self.near(a[rest], b[rest], np.full(len(rest), reach), reach)
                    which, nth = np.unique(one["point"], return_index=True)
                    times = np.maximum(np.ceil(np.log(one["d"][nth] / radius) / math.log(GROWTH) - 1e-9), 0)
                    grown = self.near(a[rest[which]], b[rest[which]], radius * GROWTH**times, reach)
                    found.append({**grown, "point": rest[which][grown["point"]]})
                    rest = np.delete(rest, which)
            whole = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            order = np.argsort(whole["point"], kind="stable")
            yield {k: v[order] + (i if k == "point" else 0) for k, v in whole.items()}


def _same(ax, ay, bx, by) -> np.ndarray:
    near = lambda a, b: np.abs(a - b) <= 1e-12 * np.maximum(1.0, np.maximum(np.abs(a), np.abs(b)))
    return near(ax, bx) & near(ay, by)


def _rank(point: np.ndarray) -> np.ndarray:
    """Position of each row among those of its point, which are neighbours."""
    new = np.flatnonzero(np.diff(point, prepend=-1))
    return np.arange(len(point)) - np.repeat(new, np.diff(np.append(new, len(point))))


def fits(roads: DataFrame) -> bool:
    return len(roads.select("road_id").limit(MOST_ROADS + 1).take(MOST_ROADS + 1)) <= MOST_ROADS


def candidates(points: DataFrame, roads: DataFrame, parameters, least_emission: float) -> DataFrame:
    """matching.match_candidates by lookups in a map that each worker holds; rows stay in the order of the points."""
    lines = Lines(roads.select("road_id", "start_cross", "end_cross", "geom").collect())
    shared = roads.sparkSession.sparkContext.broadcast(lines)
    others = [c for c in points.columns if c not in ("traj_id", "seq", "ts", "x", "y")]
    given = points.withColumns({c: F.col(c).cast("double") for c in "xy"}).select("traj_id", "seq", "ts", "x", "y", *others)
    kind = roads.select("road_id").schema[0].dataType.simpleString()
    made = StructType.fromDDL(f"cand int, road_id {kind}, dist double, pp struct<type:string,index:int,param:double,x:double,y:double>, emission double")
    schema = StructType([*given.schema.fields[:5], *made.fields, *given.schema.fields[5:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = shared.value
        types = to_arrow_schema(made)
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
            placed = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
            for f in lines.growing(x[placed], y[placed], parameters.radius):
                fresh = ~((np.diff(f["point"], prepend=-1) == 0) & _same(f["qx"], f["qy"], np.roll(f["qx"], 1), np.roll(f["qy"], 1)))
                f = {k: v[fresh] for k, v in f.items()}
                rank = _rank(f["point"])
                f, rank = {k: v[rank < parameters.limit] for k, v in f.items()}, rank[rank < parameters.limit]
                road, s, qx, qy = f["road"], f["segment"], f["qx"], f["qy"]
                start = _same(qx, qy, lines.head[0][road], lines.head[1][road])
                end = _same(qx, qy, lines.tail[0][road], lines.tail[1][road])
                along = lines.before[s] + np.sqrt((lines.ax[s] - qx) * (lines.ax[s] - qx) + (lines.ay[s] - qy) * (lines.ay[s] - qy))
                pp = pa.StructArray.from_arrays([
                    pa.array(np.where(start | end, "cross", "road")), pa.array(np.where(start, lines.start[road], np.where(end, lines.end[road], lines.ids[road])).astype(np.int32)),
                    pa.array(np.where(start, 0.0, np.where(end, lines.length[road], along))), pa.array(qx), pa.array(qy),
                ], ["type", "index", "param", "x", "y"])
                off = f["d"] - parameters.mean
                normal = np.exp(-off * off / (2 * parameters.deviation**2)) / (math.sqrt(2 * math.pi) * parameters.deviation)
                own = [pa.array(rank.astype(np.int32)), pa.array(lines.ids[road]), pa.array(f["d"]), pp, pa.array(np.maximum(normal, least_emission))]
                taken = batch.take(pa.array(placed[f["point"]])).columns
                own = [c if c.type == t.type else c.cast(t.type) for c, t in zip(own, types)]
                yield pa.RecordBatch.from_arrays([*taken[:5], *own, *taken[5:]], schema.names)

    return given.mapInArrow(run, schema)


def vote_together(emission: np.ndarray, scores: np.ndarray, xy: np.ndarray, counts: np.ndarray, window: int, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """matching.vote for logs padded to one size, longest first: (votes, values) of every candidate.

    emission (log, point, candidate) and scores (log, step, from, to) have minus infinity where there is no
    candidate; counts are points a log. Values are -1 where no sequence passes. Focuses go a block at a
    time. Up to its focus a recursion is the same for all forced candidates.
    """
    logs, n, c = emission.shape
    votes, values = np.zeros((logs, n, c), np.int64), np.full((logs, n, c), -1.0)
    width = n if window <= 0 else window
    longer = [int((counts > at).sum()) for at in range(n + 1)]  # logs that have a point
    block = max(1, min(n, _POINTERS // (logs * c * c * min(n, 2 * width + 64))))

    def weight(k: int, lo: int, hi: int, m: int) -> np.ndarray:
        """Of the step m -> m + 1 for focuses [lo, hi) of the first k logs."""
        i = np.arange(lo, hi)
        far = xy[:k, np.where(i <= m, m + 1, m)] - xy[:k, lo:hi]
        return np.exp(-(far**2).sum(axis=2) / beta**2)

    def relaxed(state: np.ndarray, gains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        best, which = state[..., 0, None] + gains[0], np.zeros(state.shape, np.int8)
        for k in range(1, c):
            total = state[..., k, None] + gains[k]
            more = total > best
            np.copyto(best, total, where=more)
            np.copyto(which, np.int8(k), where=more)
        return best, which

    for lo in range(0, n, block):
        hi = min(lo + block, n)
        k0 = longer[lo]
        pre, post = np.full((k0, hi - lo, c), -np.inf), np.full((k0, hi - lo, c, c), -np.inf)
        begins = np.maximum(0, np.arange(lo, hi) - width)
        back: dict[int, tuple] = {}
        for at in range(int(begins[0]), min(hi - 1 + width, n)):
            k = min(k0, longer[at])
            if not k:
                break
            pre_lo, pre_hi = max(lo, at), hi if at == 0 else max(max(lo, at), min(hi, at + width))  # focuses i >= at that began before
            post_lo, post_hi = max(lo, at - width + 1), min(hi, at)
            pre_which = post_which = None
            if at > 0:
                step = scores[:k, at - 1]

                def gains(a: int, b: int) -> list[np.ndarray]:
                    paid = weight(k, a, b, at - 1)[:, :, None] * np.where(np.isneginf(emission[:k, None, at]), 1.0, emission[:k, None, at])  # noqa: B023
                    with np.errstate(invalid="ignore"):
                        return [np.where(np.isneginf(step[:, None, f]), -np.inf, paid * step[:, None, f]) for f in range(c)]  # noqa: B023

                if pre_lo < pre_hi:
                    pre[:k, pre_lo - lo : pre_hi - lo], pre_which = relaxed(pre[:k, pre_lo - lo : pre_hi - lo], gains(pre_lo, pre_hi))
                if post_lo < post_hi:
                    post[:k, post_lo - lo : post_hi - lo], post_which = relaxed(post[:k, post_lo - lo : post_hi - lo], [g[:, :, None] for g in gains(post_lo, post_hi)])
            starts = np.flatnonzero(begins == at)
            if len(starts):
                a, b = lo + int(starts[0]), lo + int(starts[-1]) + 1
                first = np.ones((k, b - a))
                more = longer[at + 1] if at + 1 < n else 0  # windows of one point weigh one
                if more and width > 1:
                    first[: min(k, more)] = weight(min(k, more), a, b, at)
                elif more:
                    first[: min(k, more), np.arange(a, b) + width > at + 1] = weight(min(k, more), a, b, at)[:, np.arange(a, b) + width > at + 1]
                with np.errstate(invalid="ignore"):
                    pre[:k, a - lo : b - lo] = np.where(np.isneginf(emission[:k, None, at]), -np.inf, first[:, :, None] * emission[:k, None, at])
            if lo <= at < hi:
                forced = pre[:k, at - lo]
                post[:k, at - lo] = np.where(np.eye(c, dtype=bool), forced[:, None, :], -np.inf)
            back[at] = k, pre_lo, pre_hi, pre_which, post_lo, post_hi, post_which
        last = post.argmax(axis=3)
        value = np.take_along_axis(post, last[..., None], axis=3)[..., 0]
        value = np.where(np.isneginf(value), -1.0, value)
        own = np.arange(lo, hi)[None, :] < counts[:k0, None]
        values[:k0, lo:hi] = np.where(own[..., None], value, -1.0)
        with np.errstate(invalid="ignore"):
            feasible = (value >= 0) & own[..., None]
        here = last
        for at in sorted(back, reverse=True):
            k, pre_lo, pre_hi, pre_which, post_lo, post_hi, post_which = back[at]
            a, b = max(lo, at - width + 1), min(hi, at + width + 1)  # focuses whose window has the point
            now, ok = here[:k, a - lo : b - lo], feasible[:k, a - lo : b - lo]
            for f in range(c):
                votes[:k, at, f] += ((now == f) & ok).sum(axis=(1, 2))
            if pre_which is not None:
                part = here[:k, pre_lo - lo : pre_hi - lo]
                here[:k, pre_lo - lo : pre_hi - lo] = np.take_along_axis(pre_which, part, axis=2)
            if post_which is not None:
                part = here[:k, post_lo - lo : post_hi - lo]
                here[:k, post_lo - lo : post_hi - lo] = np.take_along_axis(post_which, part[..., None], axis=3)[..., 0]
    return votes, values


#: What a candidate's row says of the step from its point to the next, where it won.
STEP = "seq2 long, c1 int, c2 int, v double, ft double, gps_distance double, seconds_between long, length double, speed double, mean_speed double, valid boolean, t1 long, t2 long"
STEP_COLUMNS = [f.split()[0] for f in STEP.split(", ")]
MATCHED = f"traj_id long, seq long, cand int, vote long, fvalue double, chosen boolean, {STEP}, entities array<{ENTITY}>"
#: Columns of a place, as routing names them.
_PLACE = {"type": "type", "index": "index", "param": "param", "x": "px", "y": "py"}


class Log:
    """Candidates of one log: arrays by candidate, and the first of each point."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.rows = rows
        self.first = np.flatnonzero(np.append(True, rows["seq"][1:] != rows["seq"][:-1]))
        self.n = len(self.first)


def _together(network, logs: list[Log], window: int, beta: float, spelled: bool) -> dict[str, np.ndarray]:
    """Rows (MATCHED) of logs, those left out that can't be matched."""
    logs = sorted(logs, key=lambda g: -g.n)
    rows = {k: np.concatenate([g.rows[k] for g in logs]) for k in logs[0].rows}
    counts = np.array([g.n for g in logs])
    n, log = int(counts[0]), np.repeat(np.arange(len(logs)), [len(g.rows["seq"]) for g in logs])
    at = np.concatenate([np.cumsum(np.append(0, np.diff(g.rows["seq"]) != 0)) for g in logs])
    c = int(rows["cand"].max()) + 1
    row = np.full((len(logs), n, c), -1)
    row[log, at, rows["cand"]] = np.arange(len(log))
    emission = np.where(row >= 0, rows["emission"][row], -np.inf)
    xy = np.zeros((len(logs), n, 2))
    xy[log, at] = np.column_stack([rows["x"], rows["y"]])
    # A step leads to the next point of the log, if that has candidates.
    goes = (row[:, 1:, 0] >= 0) & (rows["seq2"][row[:, :-1, 0]] == rows["seq"][row[:, 1:, 0]]) & rows["has2"][row[:, :-1, 0]]
    pairs = np.nonzero((row[:, :-1, :, None] >= 0) & (row[:, 1:, None, :] >= 0) & goes[:, :, None, None])
    p, q = row[pairs[0], pairs[1], pairs[2]], row[pairs[0], pairs[1] + 1, pairs[3]]
    length, speed, _, valid = network.measured({k: rows[c_][p] for k, c_ in _PLACE.items()}, {k: rows[c_][q] for k, c_ in _PLACE.items()})
    d, l = rows["gps_distance"][p] + 1, length + 1
    with np.errstate(all="ignore"):
        v = np.where(valid, np.minimum((d / l) ** 2.0, np.sqrt(l / d)), -np.inf)
        seconds = rows["seconds"][p]
        mean = np.where((seconds != 0) & ~np.isnan(seconds), length / seconds, np.inf)
        ft = np.where(speed == 0, 1.0, speed / (np.abs(mean - speed) + speed))
        scores = np.full((len(logs), max(n - 1, 0), c, c), -np.inf)
        scores[pairs] = v * ft
    votes, values = vote_together(emission, scores, xy, counts, window, beta)
    own = row >= 0
    with np.errstate(invalid="ignore"):
        passed = ((values >= 0) & own).any(axis=2) | (np.arange(n)[None, :] >= counts[:, None])
    most = np.where(own, votes, -1)
    best = np.where(most == most.max(axis=2, keepdims=True), values, -np.inf)
    winner = np.where(np.isnan(best), np.inf, best).argmax(axis=2)
    kept = np.flatnonzero(passed.all(axis=1)[log])
    cand = rows["cand"]
    out = {"traj_id": rows["traj_id"], "seq": rows["seq"], "cand": cand, "vote": votes[log, at, cand], "fvalue": values[log, at, cand], "chosen": winner[log, at] == cand}
    number = np.full(row.shape[:1] + (max(n - 1, 0), c, c), -1)
    number[pairs] = np.arange(len(p))
    step = np.full(len(log), -1)
    inner = np.flatnonzero((at < n - 1) & out["chosen"])
    step[inner] = number[log[inner], at[inner], cand[inner], winner[log[inner], at[inner] + 1]]
    s = np.maximum(step, 0)
    told = lambda values: values[s] if len(p) else np.zeros(len(log), values.dtype)
    gap = told(seconds)
    out |= {"seq2": told(rows["seq"][q]), "c1": told(cand[p]), "c2": told(cand[q]), "v": told(v), "ft": told(ft), "gps_distance": told(rows["gps_distance"][p]), "seconds_between": gap, "length": told(length), "speed": told(speed), "mean_speed": told(mean), "valid": told(valid), "t1": told(rows["us"][p]), "t2": told(rows["us"][q]), "has_t1": told(rows["has_us"][p]), "has_t2": told(rows["has_us"][q])}
    out = {k: v[kept] for k, v in out.items()} | {"step": step[kept] >= 0}
    out["entities"] = None
    if spelled:
        place = lambda i: {k: rows[c_][i].item() if k != "type" else rows[c_][i] for k, c_ in _PLACE.items()}
        out["entities"] = [network.points(place(p[i]), place(q[i])) if i >= 0 else None for i in step[kept].tolist()]
    return out


def _entities(paths: list[list[tuple] | None], kind: pa.DataType) -> pa.Array:
    flat = [e for path in paths if path is not None for e in path]
    struct = kind.value_type
    parts = list(zip(*flat)) if flat else [[]] * struct.num_fields
    fields = [pa.array(parts[i], struct.field(i).type) for i in range(struct.num_fields)]
    sizes = np.array([0 if path is None else len(path) for path in paths], np.int32)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    missing = np.append(np.array([path is None for path in paths], bool), False)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=missing), pa.StructArray.from_arrays(fields, [struct.field(i).name for i in range(struct.num_fields)]), type=kind)


def with_steps(points: DataFrame, order) -> DataFrame:
    """points with seq2, gps_distance, seconds and us: the next point of the log, the way there in a straight line and in whole seconds, and the own time."""
    nxt = lambda c: F.lead(c).over(order)
    told = points.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return told.withColumns({"seq2": nxt("seq"), "gps_distance": F.hypot(nxt("x") - F.col("x"), nxt("y") - F.col("y")), "seconds": F.expr("(lead(us) OVER (PARTITION BY traj_id ORDER BY seq) - us) div 1000000")})


def matched(found: DataFrame, roads: DataFrame, parameters, spelled: bool) -> DataFrame:
    """(MATCHED) of candidates with the columns of with_steps, whose partitions hold whole logs in order of (traj_id, seq, cand).

    Entities are spelled out where they are asked for. A log that can't be matched has no rows.
    """
    shared = shared_network(roads)
    own = found.select("traj_id", "seq", "cand", "emission", "x", "y", "seq2", "gps_distance", "seconds", "us", *[F.col(f"pp.{k}").alias(f"p_{k}") for k in _PLACE])
    schema = StructType.fromDDL(MATCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, types = shared.value, to_arrow_schema(schema)

        def rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            whole = lambda k: batch.column(k).to_numpy(zero_copy_only=False) if not batch.column(k).null_count else batch.column(k).fill_null(0).to_numpy(zero_copy_only=False)
            real = lambda k: batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out = {k: whole(k).astype(np.int64) for k in ("traj_id", "seq", "cand", "seq2", "us")} | {k: real(k) for k in ("emission", "gps_distance", "seconds")}
            out |= {"has2": batch.column("seq2").is_valid().to_numpy(zero_copy_only=False), "has_us": batch.column("us").is_valid().to_numpy(zero_copy_only=False)}
            out |= {"type": batch.column("p_type").to_numpy(zero_copy_only=False), "index": whole("p_index").astype(np.int64), "param": real("p_param"), "x": real("x"), "y": real("y"), "px": real("p_x"), "py": real("p_y")}
            return out

        def told(out: dict[str, np.ndarray]) -> pa.RecordBatch:
            none = ~out["step"]
            columns = []
            for f in types:
                if f.name == "entities":
                    columns.append(pa.nulls(len(none), f.type) if out["entities"] is None else _entities(out["entities"], f.type))
                elif f.name == "seconds_between":
                    lost = none | np.isnan(out[f.name])
                    columns.append(pa.array(np.where(lost, 0, out[f.name]).astype(np.int64), mask=lost))
                else:
                    columns.append(pa.array(out[f.name], mask=none | ~out.get(f"has_{f.name}", ~none) if f.name in STEP_COLUMNS else None).cast(f.type))
            return pa.RecordBatch.from_arrays(columns, schema=types)

        def emit(logs: list[Log]) -> Iterator[pa.RecordBatch]:
            if logs:
                yield told(_together(network, logs, parameters.window, parameters.beta, spelled))

        waiting: list[Log] = []
        open_: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = rows(batch)
            cuts = np.flatnonzero(new["traj_id"][1:] != new["traj_id"][:-1]) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                part = {k: v[a:b] for k, v in new.items()}
                if open_ and open_[0]["traj_id"][0] != part["traj_id"][0]:
                    waiting.append(Log({k: np.concatenate([o[k] for o in open_]) for k in part}))
                    open_ = []
                    if sum(g.n for g in waiting) >= _GROUP:
                        yield from emit(waiting)
                        waiting = []
                open_.append(part)
        if open_:
            waiting.append(Log({k: np.concatenate([o[k] for o in open_]) for k in open_[0]}))
        yield from emit(waiting)

    return own.mapInArrow(run, schema)


RANGES = "traj_id long, range_id long, first_seq long, last_seq long"


def ranges(paths: DataFrame) -> DataFrame:
    """matching.valid_ranges of paths (traj_id, seq, seq2, valid) whose partitions hold whole logs, each in order of seq: nothing is dealt again."""
    schema = StructType.fromDDL(RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        before: tuple | None = None  # log, seq2 and valid of the last path
        open_, made = np.zeros((4, 0), np.int64), 0  # the last range, which may go on; how many its log has so far

        def told(columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=types)

        for batch in batches:
            if not batch.num_rows:
                continue
            log, seq, seq2, valid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("traj_id", "seq", "seq2", "valid"))
            last = before or (log[0], seq[0], False)
            shifted = lambda column, first: np.append(first, column[:-1])
            other = log != shifted(log, last[0])
            fresh = valid & (other | ~shifted(valid, last[2]).astype(bool) | (shifted(seq2, last[1]) != seq))
            count = np.cumsum(fresh)
            first = np.flatnonzero(np.append(True, other[1:]))  # the first path of each log here
            ahead = (count - fresh)[first]
            ahead[0] -= 0 if other[0] else made  # the log goes on
            number = count - 1 - np.repeat(ahead, np.diff(np.append(first, len(log))))
            made = int(number[-1]) + 1
            at = np.flatnonzero(valid)
            begin = np.flatnonzero(fresh[at])
            if open_.shape[1] and (begin[0] if len(begin) else len(at)):
                open_[3] = seq2[at[(begin[0] if len(begin) else len(at)) - 1]]
            if len(begin):
                own = at[begin]
                end = at[np.append(begin[1:], len(at)) - 1]
                found = np.column_stack([open_, np.stack([log[own], number[own], seq[own], seq2[end]])])
                open_ = found[:, -1:].copy()
                yield told(found[:, :-1])
            before = log[-1], seq2[-1], valid[-1]
        yield told(open_)

    return paths.select("traj_id", "seq", "seq2", "valid").mapInArrow(run, schema)
