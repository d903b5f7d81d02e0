"""Travel-cost classes of virtual edges: by variance, then by time of day, and patterns from them.

A split scan uses prefix sums, so a level costs time in proportion to its records. Sorts have the
record id as a tie-break. An edge's records are one group; its size is bounded by the trimming.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.weights import BANDS, DAY_US


def _variances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variance times size of x[:i] and of x[i:], for i from 1 to len - 1."""
    x = x - x.mean()  # prefix sums of squares lose fewer digits
    n = np.arange(1, len(x))
    s, q = np.cumsum(x)[:-1], np.cumsum(x * x)[:-1]
    left = q - s * s / n
    right = (q_all := (x * x).sum()) - q - (x.sum() - s) ** 2 / (len(x) - n)
    return np.maximum(left, 0) if q_all else np.zeros(len(n)), np.maximum(right, 0) if q_all else np.zeros(len(n))


def variance_classes(seconds: np.ndarray) -> np.ndarray:
    """Class of each of the sorted costs.

    A range is split at the first least weighted variance, if that is under its variance by more than
    the standard deviation of all; classes are numbered from left to right.
    """
    out = np.zeros(len(seconds), np.int64)
    threshold = float(np.sqrt(seconds.var())) if len(seconds) else 0.0
    stack, number = [(0, len(seconds))], 0
    while stack:
        a, b = stack.pop()
        part = seconds[a:b]
        if b - a >= 2:
            left, right = _variances(part)
            weighted = (left + right) / (b - a)
            at = int(np.argmin(np.round(weighted, 9)))
            if part.var() - weighted[at] > threshold:
                stack += [(a + at + 1, b), (a, a + at + 1)]
                continue
        out[a:b] = number
        number += 1
    return out


def _entropies(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy in bits and number of classes of each row of counts."""
    n = counts.sum(axis=1, keepdims=True)
    p = counts / n
    with np.errstate(divide="ignore", invalid="ignore"):
        e = -np.where(counts > 0, p * np.log2(p), 0.0).sum(axis=1)
    return e, (counts > 0).sum(axis=1)


def entropy_classes(classes: np.ndarray) -> np.ndarray:
    """Class of each record, by minimum description length splits of the class sequence in order of time."""
    out = np.zeros(len(classes), np.int64)
    if not len(classes):
        return out
    one_hot = np.eye(int(classes.max()) + 1)[classes]
    stack, number = [(0, len(classes))], 0
    while stack:
        a, b = stack.pop()
        n = b - a
        if n >= 2:
            before = np.cumsum(one_hot[a:b], axis=0)
            left, right = before[:-1], before[-1] - before[:-1]
            (e,), (k,) = _entropies(before[-1:])
            e1, k1 = _entropies(left)
            e2, k2 = _entropies(right)
            size = np.arange(1, n)
            weighted = (e1 * size + e2 * (n - size)) / n
            at = int(np.argmin(np.round(weighted, 12)))
            least = (np.log2(n - 1.0) + np.log2(3.0**k - 2) - (k * e - k1[at] * e1[at] - k2[at] * e2[at])) / n
            if not e - weighted[at] < least:
                stack += [(a + at + 1, b), (a, a + at + 1)]
                continue
        out[a:b] = number
        number += 1
    return out


def cost_classes(records: DataFrame) -> DataFrame:
    """records (edge, id, enter, cost_ms, ..) with vclass and eclass.

    Costs are compared in seconds. For the second pass records are in order of the hour of day
    of `enter`, in whole seconds.
    """
    kept = records.schema
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept)}, vclass int, eclass int"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["cost_ms", "id"]).reset_index(drop=True)
        part["vclass"] = variance_classes(part.cost_ms.to_numpy() / 1000.0).astype(np.int32)
        t = part.enter.dt
        part["_tod"] = t.hour * 3600 + t.minute * 60 + t.second
        part = part.sort_values(["_tod", "id"]).reset_index(drop=True)
        part["eclass"] = entropy_classes(part.vclass.to_numpy()).astype(np.int32)
        return part.drop(columns="_tod")

    return records.groupBy("edge").applyInPandas(one, schema)


def cost_patterns(classed: DataFrame) -> DataFrame:
    """(edge, begin_us, end_us, seconds): a band for each run of one eclass in order of time of day.

    A band begins at its first record's time of day and ends where the next begins, the last at 24
    hours; its seconds are the mean cost. A record's place is (whole second of day, id).
    """
    us = F.pmod(F.unix_micros(F.col("enter").cast("timestamp")), F.lit(DAY_US))
    order = W.partitionBy("edge").orderBy("_s", "id")
    rows = classed.withColumn("_us", us).withColumn("_s", F.floor(F.col("_us") / 1_000_000))
    new = F.when(F.lag("eclass").over(order) == F.col("eclass"), 0).otherwise(1)
    run = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    bands = run.groupBy("edge", "_run").agg(F.min_by("_us", F.struct("_s", "id")).alias("begin_us"), (F.avg("cost_ms") / 1000.0).alias("seconds"))
    end = F.coalesce(F.lead("begin_us").over(W.partitionBy("edge").orderBy("_run")), F.lit(DAY_US))
    return bands.select("edge", "begin_us", end.alias("end_us"), "seconds")


def pattern_bands(patterns: DataFrame) -> DataFrame:
    """(edge, bands): patterns as arrays for lookups; costs in whole ms, the day covered from end to end."""
    ordered = F.sort_array(F.collect_list(F.struct("begin_us", "end_us", F.floor(F.col("seconds") * 1000).cast("long").alias("cost_ms"))))
    grouped = patterns.groupBy("edge").agg(ordered.alias("bands"))
    n = F.size("bands")
    whole = F.transform("bands", lambda b, i: F.struct(F.when(i == 0, F.lit(0).cast("long")).otherwise(b["begin_us"]).alias("begin_us"), F.when(i == n - 1, F.lit(DAY_US).cast("long")).otherwise(b["end_us"]).alias("end_us"), b["cost_ms"].alias("cost_ms")))
    return grouped.select("edge", whole.cast(BANDS).alias("bands"))


def updated(records: DataFrame, classed: DataFrame) -> DataFrame:
    """records with classes written back by id; rows that were not classed keep theirs."""
    new = classed.select("id", F.col("vclass").alias("_v"), F.col("eclass").alias("_e"))
    joined = records.join(new, "id", "left")
    old = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("int")
    return joined.withColumn("vclass", F.coalesce("_v", old("vclass"))).withColumn("eclass", F.coalesce("_e", old("eclass"))).drop("_v", "_e")
