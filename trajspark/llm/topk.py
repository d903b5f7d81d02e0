"""Exact top-k by inner product, pruned with segment statistics from coarse to fine.

A vector is cut into s segments of m components. With a segment's mean u and deviation d, the
inner product of two vectors is at most the sum over segments of m * (u1 * u2 + d1 * d2): the
same statistics that bound a distance from below (squared distance = |q|^2 + |x|^2 - 2 q.x).
A block of candidates is bounded with few segments, the survivors with more, and only what is
left is multiplied out, in exact integers. A candidate is dropped only if its bound, with a
margin for rounding, is under the k-th best score that the query already has in the block.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows
without an id. A query meets only vectors of its own length and no row of its own id; repeated
rows count each. Integers are floor(256 * x); scores beyond 64 bits are clamped to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import columns_of, record, shuffle_partitions, sliced, table

SCALE = 256.0
LEVELS = (1, 4, 16)
BLOCK = 2048
_LONG = (-(2**63), 2**63 - 1)
PACKED = "dim int, ids binary, cells binary"


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles floor(256 x)) of the vectors that take part."""
    x = F.col(f"`{embedding}`")
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    scaled = F.transform(x, lambda v: v.cast("double") * SCALE)
    return vectors.where(F.col(f"`{vec_id}`").isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(f"`{vec_id}`").alias("vec_id"), scaled.alias("cells"))


def packed(vectors: DataFrame, rows: int = BLOCK) -> DataFrame:
    """Blocks of at most `rows` vectors of one length, as two binaries each."""
    schema = to_arrow_schema(StructType.fromDDL(PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, rows_: list) -> pa.RecordBatch:
            ids = np.array([i for i, _ in rows_], np.int64)
            return record(schema, [[dim], [ids.tobytes()], [np.floor(np.concatenate([c for _, c in rows_])).tobytes()]])

        for batch in batches:
            cells = batch.column("cells")
            flat, at = cells.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))])
            for r, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                part = flat[at[r] : at[r + 1]]
                held.setdefault(len(part), []).append((vec_id, part))
                if len(held[len(part)]) >= rows:
                    yield out(len(part), held.pop(len(part)))
        for dim, part in held.items():
            yield out(dim, part)

    return vectors.mapInArrow(run, PACKED)


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(m) times mean and deviation of each segment: their products add up to the bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    cols = []
    for p in parts:
        part = x[:, p]
        cols += [part.mean(axis=1) * np.sqrt(len(p)), part.std(axis=1) * np.sqrt(len(p))]
    return np.column_stack(cols)


def best(queries: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int):
    """For each query, (score, id) of its k best in the block; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    cells, ids = cells[order], ids[order]
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(cells).max(initial=0)) * queries.shape[1]
    exact = most < 2**53  # sums of doubles that are whole stay exact
    whole_ = (lambda a: a) if exact else (lambda a: np.array([[int(v) for v in row] for row in a], object).reshape(a.shape))
    q_exact = whole_(queries)
    levels = [(s, _statistics(queries, s), _statistics(cells, s)) for s in LEVELS if s <= queries.shape[1]] if exact else []
    lengths = np.argsort(-np.einsum("ij,ij->i", cells, cells), kind="stable")[: 4 * k + 1] if exact else np.arange(len(ids))
    out = []
    first = queries @ cells[lengths].T if exact else None
    for i in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[i])
        if exact and len(alive) > 4 * k:
            seen = first[i][ids[lengths] != query_ids[i]]
            floor = np.partition(seen, len(seen) - k)[-k] if len(seen) >= k else -np.inf
            for _, of_query, of_cells in levels:
                bound = of_cells[alive] @ of_query[i]
                alive = alive[bound + 1e-6 * (1 + np.abs(bound)) >= floor]
        scores = cells[alive] @ queries[i] if exact else np.array([sum(a * b for a, b in zip(q_exact[i], [int(v) for v in cells[j]])) for j in alive], object)
        if not exact:
            scores = np.array([min(max(s, _LONG[0]), _LONG[1]) for s in scores], np.int64)
        if len(scores) > 4 * k:
            kth = np.partition(scores, len(scores) - k)[-k]
            near = np.flatnonzero(scores >= kth)
            alive, scores = alive[near], scores[near]
        top = np.lexsort((ids[alive], -scores))[:k]
        out.append((scores[top].astype(np.int64), ids[alive[top]]))
    return out


RESULT = "query_id long, query_row long, vec_id long, score long"


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates.

    Queries and candidates meet as blocks; a pair of blocks gives at most k rows a query, so
    no pair of rows is ever made. Blocks of candidates are dealt over all tasks and every task
    gets the blocks of queries. Repeated query rows give repeated results.
    """
    schema = to_arrow_schema(StructType.fromDDL(RESULT))
    q = packed(whole(queries), BLOCK // 2).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.monotonically_increasing_id().alias("q_block"))
    tasks = shuffle_partitions(queries.sparkSession)
    q = q.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    x = packed(whole(candidates)).withColumn("task", F.pmod(F.xxhash64("ids"), F.lit(tasks)).cast("int"))
    pairs = x.join(q, (x.task == q.task) & (F.col("dim") == F.col("q_dim"))).drop("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in batch.to_pylist():
                a = lambda name, kind: np.frombuffer(row[name], kind)
                q_ids, ids = a("q_ids", np.int64), a("ids", np.int64)
                found = best(a("q_cells", np.float64).reshape(len(q_ids), -1), q_ids, a("cells", np.float64).reshape(len(ids), -1), ids, k)
                sizes = [len(s) for s, _ in found]
                if sum(sizes):
                    at = (row["q_block"] << 12) + np.arange(len(q_ids))
                    yield record(schema, [np.repeat(q_ids, sizes), np.repeat(at, sizes), np.concatenate([i for _, i in found]), np.concatenate([s for s, _ in found])])

    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return pairs.mapInArrow(run, RESULT).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = columns_of(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"])
    return top_k(vectors.where("vec_id % 50 = 0"), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.c, x.c)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.c) = len(x.c)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
