"""Travel times by time of day: arrays of bands struct<begin_us,end_us,cost_ms>.

Times of day are micros since midnight and may pass 24 hours when sums do; a lookup there is an
error, not a wrap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 24 * 3600 * 1_000_000
BANDS = "array<struct<begin_us:bigint,end_us:bigint,cost_ms:bigint>>"


def clock_us(text: Column) -> Column:
    """Micros of HH:MM:SS, with or without a fraction; 24:00:00 is a whole day."""
    parts = F.split(F.trim(text), ":")
    seconds = parts[2].cast("double")
    return ((parts[0].cast("long") * 60 + parts[1].cast("long")) * 60_000_000 + F.round(seconds * 1_000_000).cast("long")).cast("long")


def clock_text(us: Column) -> Column:
    s = F.floor(us / 1_000_000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), (F.floor(s / 60) % 60).cast("long"), (s % 60).cast("long"))


def parse_pattern(text: Column) -> Column:
    """Bands of lines "begin-end:seconds". The first begins at 0, the last ends at 24 hours; costs are whole ms."""
    lines = F.filter(F.split(text, r"\s*\n\s*|\s+"), lambda s: s != "")
    rows = F.transform(lines, lambda s: F.struct(clock_us(F.regexp_extract(s, r"^([^-]+)-", 1)).alias("begin_us"), clock_us(F.regexp_extract(s, r"-(\d+:\d+:[\d.]+):", 1)).alias("end_us"), F.floor(F.regexp_extract(s, r":([\d.eE+-]+)$", 1).cast("double") * 1000).cast("long").alias("cost_ms")))
    n = F.size(rows)
    return F.transform(rows, lambda b, i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(b["begin_us"]).alias("begin_us"), F.when(i == n - 1, F.lit(DAY_US).cast("long")).otherwise(b["end_us"]).alias("end_us"), b["cost_ms"].alias("cost_ms"))).cast(BANDS)


def constant(ms: Column) -> Column:
    """One band for the whole day."""
    return F.array(F.struct(F.lit(0).cast("long").alias("begin_us"), F.lit(DAY_US).cast("long").alias("end_us"), ms.cast("long").alias("cost_ms")))


def pattern_text(bands: Column) -> Column:
    """Lines "begin-end:seconds"."""
    return F.array_join(F.transform(bands, lambda b: F.concat(clock_text(b["begin_us"]), F.lit("-"), clock_text(b["end_us"]), F.lit(":"), (b["cost_ms"] / 1000.0).cast("string"))), "\n")


def weight_at(bands: Column, t_us: Column, mode: str = "compat") -> Column:
    """Cost in ms at a time of day; an error past 24 hours.

    "compat" takes the first band that begins at or after the time, else the last: the band after the
    one that holds the time. "containing" takes the band that holds it.
    """
    if mode == "compat":
        found = F.coalesce(F.try_element_at(F.filter(bands, lambda b: b["begin_us"] >= t_us), F.lit(1)), F.element_at(bands, -1))
    elif mode == "containing":
        found = F.coalesce(F.try_element_at(F.filter(bands, lambda b: (b["begin_us"] <= t_us) & (t_us < b["end_us"])), F.lit(1)), F.element_at(bands, -1))
    else:
        raise ValueError(mode)
    return F.when(t_us > DAY_US, F.raise_error(F.lit("a time of day is past 24 hours")).cast("long")).otherwise(found["cost_ms"])


def arrival(bands: Column, t_us: Column, mode: str = "compat") -> Column:
    """Departure plus the cost at departure."""
    return t_us + weight_at(bands, t_us, mode) * 1000


def at(bands: list[tuple[int, int, int]], t_us: int, mode: str = "compat") -> int:
    """weight_at for kernels: bands are (begin_us, end_us, cost_ms) in order."""
    if t_us > DAY_US:
        raise ValueError("a time of day is past 24 hours")
    if mode == "compat":
        return next((c for b, _, c in bands if b >= t_us), bands[-1][2])
    return next((c for b, e, c in bands if b <= t_us < e), bands[-1][2])
