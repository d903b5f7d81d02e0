"""Scores of restored trajectories against the truth."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates that are scored, by hot turn score; candidates that are made at all.
TOP = 10
MOST_CANDIDATES = 10_001


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: matches in order, then a longest increasing run of them."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tails: list[int] = []  # the least b-index that ends a run of each length
    last: list[int] = []  # and the match that has it
    matches: list[tuple[int, int, int]] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            matches.append((i, j, last[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                last.append(len(matches) - 1)
            else:
                tails[k], last[k] = j, len(matches) - 1
    out, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = matches[at]
        out.append((i, j))
    return out[::-1]


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two array columns."""

    @F.pandas_udf("int")
    def measure(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(lcs_pairs(list(p), list(q))) if p is not None and q is not None else 0 for p, q in zip(x, y)])

    return measure(a, b)


def lcs_rate(a: Column, b: Column) -> Column:
    """Twice the length over the sum of sizes; not a number where both are empty."""
    n = F.coalesce(F.size(a), F.lit(0)) + F.coalesce(F.size(b), F.lit(0))
    return F.when(n <= 0, F.lit(float("nan"))).otherwise(F.try_divide(2.0 * lcs_length(a, b), n))


METRICS = ["n_candidate", "lcs_rate", "lcs_rate_hot", "best_lcs_rate", "best_lcs_rate_hot", "mean_lcs_rate", "mean_lcs_rate_hot", "better_share", "better_share_hot", "not_bad_share", "not_bad_share_hot", "better_mean", "better_mean_hot", "not_bad_mean", "not_bad_mean_hot", "contains_shortest", "cover", "cover_hot"]


def restore_metrics(candidates: DataFrame, truth: DataFrame, weights: DataFrame) -> DataFrame:
    """18 metrics for each query and turn weighting, over the ten candidates of least hot turn score.

    candidates: (query_id, k, lcs_rate, lcs_rate_hot, lefts_hot, rights_hot, straights_hot, crosses, crosses_hot);
    truth: (query_id, base_rate, base_rate_hot, crosses, crosses_hot); weights: (straight, left, right), a
    parameter grid. Ties in turn score go to the earlier k. Means over nothing are not a number.
    """
    t = truth.select("query_id", "base_rate", "base_rate_hot", F.array_distinct("crosses").alias("_t"), F.array_distinct("crosses_hot").alias("_th"))
    scored = candidates.where(F.col("k") < MOST_CANDIDATES).withColumn("_w", F.explode(F.array(*[F.struct(*[F.lit(int(r[c])).alias(c) for c in ("straight", "left", "right")]) for r in weights.collect()])))
    turn = F.col("lefts_hot") * F.col("_w.left") + F.col("rights_hot") * F.col("_w.right") + F.col("straights_hot") * F.col("_w.straight")
    keys = ["query_id", "straight", "left", "right"]
    scored = scored.select("*", "_w.straight", "_w.left", "_w.right").withColumn("_turn", turn)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_turn", "k"))
    top = scored.withColumn("_r", rank).where(F.col("_r") <= TOP).join(t, "query_id")
    n = F.count("*")
    r, rh, b, bh = (F.col(c) for c in ("lcs_rate", "lcs_rate_hot", "base_rate", "base_rate_hot"))
    ones = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    mean = lambda cond, v: F.coalesce(F.avg(F.when(cond, v)), F.lit(float("nan")))
    covered = lambda found, true: F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_distinct(F.flatten(F.collect_list(found))), F.first(true))).cast("double"), F.first(F.size(true))), F.lit(float("nan")))
    return top.groupBy(*keys).agg(
        n.alias("n_candidate"), F.first(b).alias("lcs_rate"), F.first(bh).alias("lcs_rate_hot"), F.max(r).alias("best_lcs_rate"), F.max(rh).alias("best_lcs_rate_hot"),
        (F.sum(r) / n).alias("mean_lcs_rate"), (F.sum(rh) / n).alias("mean_lcs_rate_hot"), (ones(r > b) / n).alias("better_share"), (ones(rh > bh) / n).alias("better_share_hot"),
        (ones(r >= b) / n).alias("not_bad_share"), (ones(rh >= bh) / n).alias("not_bad_share_hot"), mean(r > b, r).alias("better_mean"), mean(rh > bh, rh).alias("better_mean_hot"),
        mean(r >= b, r).alias("not_bad_mean"), mean(rh >= bh, rh).alias("not_bad_mean_hot"), F.max(F.when((r == b) & (rh == bh), 1).otherwise(0)).alias("contains_shortest"),
        covered("crosses", F.col("_t")).alias("cover"), covered("crosses_hot", F.col("_th")).alias("cover_hot"),
    )


def window_study(paths: DataFrame) -> DataFrame:
    """(window, avg_rate) of paths (traj_id, window, crosses) against the unbounded window, -1; undefined rates don't count."""
    whole = paths.where("window = -1").select("traj_id", F.col("crosses").alias("_whole"))
    rated = paths.where("window <> -1").join(whole, "traj_id").withColumn("_rate", lcs_rate(F.col("_whole"), F.col("crosses")))
    return rated.where(~F.isnan("_rate")).groupBy("window").agg(F.avg("_rate").alias("avg_rate"))
