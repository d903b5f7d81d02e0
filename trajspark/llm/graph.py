"""Connected components and joins that survive one key with a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import chunked, record, written

#: A key with more than this share of the rows is hot, so at most its inverse of them exist.
HOT_SHARE = 0.001


#: Edges that one task contracts at a time.
TASK_EDGES = 250_000


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) to each node's smallest reachable id within its part: a forest of stars for every part."""
    schema = to_arrow_schema(StructType.fromDDL("u long, v long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
        stars = [(x, find(x)) for x in list(root)]
        for part in chunked(((x, r) for x, r in stars if x != r), 50_000):
            yield record(schema, list(zip(*part)))

    dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts, "v")
    return dealt.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b): the smallest id reachable.

    Tasks of at most about TASK_EDGES edges contract what they hold to stars; if one task holds all, that is
    the answer. Else the large-star and small-star steps join the stars of different tasks, each a
    minimum per node and a join back, until no edge's end is another's start. Rounds are written to
    shared storage.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    parts = -(-edges.count() // TASK_EDGES)
    edges = written(_contracted(edges, max(1, parts)), "edges")
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        if edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            break
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return written(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "labels")


def join_hot(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """left join of right (one row per key), with hot keys apart.

    Keys of more than HOT_SHARE of the rows are at most 1 / HOT_SHARE, so their rows of `right` can be
    broadcast; all others are joined by a shuffle in which no key is hot.
    """
    total = left.count()
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(1, total * HOT_SHARE)).select(key).limit(int(1 / HOT_SHARE) + 1)
    hot = written(right.join(F.broadcast(hot), key, "left_semi"), "hot")
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    done = marked.where("_hot").select(*left.columns, *values)
    rest = marked.where("_hot is null").select(*left.columns).join(right, key, "left").select(*left.columns, *values)
    return done.unionByName(rest)
