"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes gives two values, its minimum and its maximum, so a
signature needs half the hash evaluations. A band is made of whole permutations. Sets that
share a band are candidates; a link is confirmed on the full sets. Equal sets are one class and
are compared once. Words are runs of bytes other than white space, ASCII letters lower-cased; a
set holds the hashes of all runs of k words, or of the whole sequence if it has fewer. A text
without words, or null, has an empty set and no links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import columns_of, kept, map_arrow, mix64, record, shuffle_partitions, sliced, table, tidy, written
from .graph import components, join_hot

#: Percent of the union that two sets must share.
PERCENT = 80
_SEEDS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()
kept("minhash", _hashes.clear)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_hashes.__getitem__, words)), np.uint64)
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def shingle_sets(batch: list[str | None], k: int) -> list[np.ndarray]:
    """shingles() of each text, all at once."""
    words = [(t or "").encode().lower().split() for t in batch]
    counts = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(_hashes.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(counts.sum()))
    long = counts >= k
    runs = np.where(long, counts - k + 1, 0)
    owner = np.repeat(np.arange(len(batch)), runs)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(counts) - counts - np.cumsum(runs) + runs, runs)
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[at + i])
    order = np.lexsort((out, owner))
    out = out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    cuts = np.cumsum(np.bincount(owner[new], minlength=len(batch)))
    sets = np.split(out[new], cuts[:-1]) if len(batch) else []
    return [s if own else shingles(t, k) for s, own, t in zip(sets, long, batch)]


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """(sets, permutations, 2): minimum and maximum of each permutation; all sets non-empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), permutations, 2), np.uint64)
    for p in range(permutations):
        x = (flat ^ _SEEDS[-1 - p]) * _SEEDS[p]
        out[:, p, 0] = np.minimum.reduceat(x, starts)
        out[:, p, 1] = np.maximum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, per_band: int) -> np.ndarray:
    """A key for each band of `per_band` permutations, different between bands."""
    n, permutations, _ = signature.shape
    rows = signature.reshape(n, permutations // per_band, 2 * per_band)
    key = np.broadcast_to(mix64(np.arange(rows.shape[1], dtype=np.uint64)), rows.shape[:2])
    for i in range(rows.shape[2]):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, i])
    return key


SIGNED = "id {}, n long, digest string, bands array<long>"


def signed(items: DataFrame, k: int, permutations: int, per_band: int) -> DataFrame:
    """(id, set size, digest of the set, band keys) of items (id, text), ids of any type; empty sets have no digest."""

    def per_batch(batch):
        sets = shingle_sets(batch.column("text").to_pylist(), k)
        some = [s for s in sets if len(s)]
        keys = iter(band_keys(signatures(some, permutations), per_band).view(np.int64)) if some else iter(())
        return [batch.column("id"), [len(s) for s in sets], [xxhash.xxh128_hexdigest(s.tobytes()) if len(s) else None for s in sets], [next(keys) if len(s) else None for s in sets]]

    return map_arrow(items, per_batch, SIGNED.format(items.schema["id"].dataType.simpleString()))


def linked(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> np.ndarray:
    """Which sets of x share PERCENT or more of their union with which of y (or x), exactly.

    Shingles that only one of the sets has add nothing to an intersection; the others' incidence
    is multiplied in blocks of columns, so all pairs cost matrix products.
    """
    both = x if y is None else x + y
    flat, sizes = np.concatenate(both), np.array([len(s) for s in both])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    shared = count[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = len(x)
    common = np.zeros((n, n if y is None else len(y)), np.float32)
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (at, at + width))
        cells = np.zeros((len(both), width), np.float32)
        cells[owner[i:j], column[i:j] - at] = 1
        common += cells[:n] @ (cells if y is None else cells[n:]).T
    union = sizes[:n, None] + (sizes if y is None else sizes[n:])[None, :] - common
    return 100 * common.astype(np.float64) >= PERCENT * union.astype(np.float64)


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join two components: at most n - 1."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for a, b in pairs.tolist():
        i, j = find(a), find(b)
        if i != j:
            root[j] = i
            kept.append((a, b))
    return kept


def links_in(groups: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is connected in each group of rows (g, side, node, cells).

    Rows of side 0 meet one another; rows of side 1, if any, meet those of side 0 only. Groups are
    bounded: at most GROUP_NODES sets and about GROUP_CELLS shingles a side.
    """
    schema = to_arrow_schema(StructType.fromDDL("a long, b long"))
    dealt = groups.repartition(shuffle_partitions(groups.sparkSession), "g").sortWithinPartitions("g", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def out():
            (ids, x), (others, y) = (tuple(zip(*s)) or ((), ()) for s in sides)
            if len(ids) + len(others) < 2 or not ids:
                return None
            found = np.argwhere(linked(list(x), list(y) if others else None))
            if others:
                found = found + np.array([0, len(ids)])
            every = ids + others
            kept = forest(len(every), found)
            return record(schema, [[every[a] for a, _ in kept], [every[b] for _, b in kept]]) if kept else None

        for batch in sliced(batches):
            for g, side, node, cells in zip(*(batch.column(c).to_pylist() for c in ("g", "side", "node", "cells"))):
                if g != now:
                    if got := out():
                        yield got
                    now, sides = g, ([], [])
                sides[side].append((node, np.frombuffer(cells, np.uint64)))
        if got := out():
            yield got

    return dealt.select("g", "side", "node", "cells").mapInArrow(tidy(run, "minhash"), "a long, b long")


#: What is compared in one task at once, a side.
GROUP_NODES = 1500
GROUP_CELLS = 1_500_000
_NEAR_SIZE = f"100 * least(n, n2) >= {PERCENT} * greatest(n, n2)"


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, cells) share PERCENT or more of their union."""

    def per_batch(batch):
        keep_a, keep_b = [], []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = np.intersect1d(x, y, assume_unique=True).size
            if 100 * common >= PERCENT * (len(x) + len(y) - common):
                keep_a.append(a)
                keep_b.append(b)
        return [keep_a, keep_b]

    x = sets.select(F.col("node").alias("a"), F.col("cells").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("cells").alias("y"))
    return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), per_batch, "a long, b long")


def _large_links(members: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the nodes (node) of large clusters, bucket by bucket.

    Every bucket's members are compared with one centre first. Then the members of buckets that
    still hold several components are dealt to bounded blocks in order of component, and every two
    blocks that don't hold one and the same component meet. No pair of components is left out.
    """
    in_bucket = W.partitionBy("key")
    own = written(members.join(large, "node", "left_semi"), "large")
    centre = F.min(F.struct("node", "n")).over(in_bucket)
    starred = own.withColumn("centre", centre).select("node", "n", F.col("centre.node").alias("c"), F.col("centre.n").alias("n2"))
    links = written(confirmed(starred.where("node <> c").where(_NEAR_SIZE).select(F.col("c").alias("a"), F.col("node").alias("b")).distinct(), sets), "links")
    labels = components(links).withColumnRenamed("id", "node")
    now = own.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = now.withColumn("least", F.min("component").over(in_bucket)).withColumn("most", F.max("component").over(in_bucket)).where("least < most")
    ordered = W.partitionBy("key").orderBy("component", "node")
    cells = F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    block = F.floor(F.greatest((F.row_number().over(ordered) - 1) / GROUP_NODES, F.coalesce(cells, F.lit(0)) / GROUP_CELLS)).cast("int")
    blocked = written(mixed.withColumn("block", block).select("key", "node", "block", "component"), "blocked")
    extent = blocked.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    e, f = extent.alias("e"), extent.alias("f")
    meet = e.join(f, (F.col("e.key") == F.col("f.key")) & (F.col("e.block") <= F.col("f.block")) & ~((F.col("e.low") == F.col("f.high")) & (F.col("e.high") == F.col("f.low"))))
    meet = meet.select(F.col("e.key").alias("key"), F.col("e.block").alias("i"), F.col("f.block").alias("j"))
    meet = meet.withColumn("g", F.struct("key", "i", "j"))
    sides = meet.select("key", "g", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("block")), F.struct(F.lit(1).alias("side"), F.col("j").alias("block"))))).alias("s")).select("key", "g", "s.side", "s.block")
    rows = blocked.join(sides, ["key", "block"]).select(F.concat_ws(":", "g.key", "g.i", "g.j").alias("g"), "side", "node").join(sets, "node")
    return links.unionByName(written(links_in(rows), "links"))


def grouped(items: DataFrame, k: int, permutations: int, per_band: int) -> tuple[DataFrame, DataFrame]:
    """(rows of SIGNED, (digest, component) of every set) for items (id, text) with ids that aren't null.

    A component is the smallest id of any set that links reach. Sets that share a band, directly or
    over others, are a cluster. Clusters that fit one task are compared there, all pairs at once;
    larger ones are compared bucket by bucket. Either way only links that connect are kept.
    """
    rows = written(signed(items, k, permutations, per_band), "signed")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    in_bucket = W.partitionBy("key")
    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    members = written(banded.withColumn("least", F.min("node").over(in_bucket)).withColumn("most", F.max("node").over(in_bucket)).where("least < most").drop("most"), "members")
    clusters = components(members.where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()).select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    wanted = written(clusters.join(classes.select("node", "id", "digest", "n"), "node"), "wanted")
    sizes = wanted.groupBy("cluster").agg(F.count("*").alias("nodes"), F.sum("n").alias("cells"))
    large = sizes.where((F.col("nodes") > GROUP_NODES) | (F.col("cells") > GROUP_CELLS)).select("cluster")
    large = written(wanted.join(large, "cluster", "left_semi").select("node"), "large")

    def of_wanted(batch):
        node, cluster, cells = [], [], []
        for held, own, c, digest in zip(shingle_sets(batch.column("text").to_pylist(), k), *(batch.column(x).to_pylist() for x in ("node", "cluster", "digest"))):
            held = held.tobytes()
            if xxhash.xxh128_hexdigest(held) == digest:
                node.append(own)
                cluster.append(c)
                cells.append(held)
        return [node, cluster, cells]

    sets = written(map_arrow(items.join(wanted.hint("merge"), "id"), of_wanted, "node long, cluster long, cells binary").dropDuplicates(["node"]), "sets")
    small = sets if large.isEmpty() else sets.join(large, "node", "left_anti")
    links = written(links_in(small.select(F.col("cluster").cast("string").alias("g"), F.lit(0).alias("side"), "node", "cells")), "links")
    if not large.isEmpty():
        links = links.unionByName(_large_links(members, large, sets.select("node", "cells")))
    labels = components(links)
    owners = classes.select("node", "digest", "id")
    linked_ = labels.select(F.col("id").alias("node"), F.col("component").alias("root")).join(owners, "node")
    least = linked_.groupBy("root").agg(F.min("id").alias("component"))
    linked_ = linked_.join(least, "root").select("digest", "component")
    alone = owners.join(labels.select(F.col("id").alias("node")), "node", "left_anti").select("digest", F.col("id").alias("component"))
    return rows, written(linked_.unionByName(alone), "component")


def near_groups(docs: DataFrame, k: int = 5, permutations: int = 64, per_band: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; a null doc_id is alone and kept.

    64 permutations in 32 bands of two miss a pair of similarity 0.8 about once in 10^7.
    """
    items = columns_of(docs, ["doc_id", "text"]).withColumnRenamed("doc_id", "id")
    known = items.where("id is not null")
    rows, component = grouped(known, k, permutations, per_band)
    joined = join_hot(rows.select("id", "n", "digest"), component, "digest", ["component"])
    out = joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    alone = map_arrow(items.where("id is null"), lambda b: [b.column("id"), [len(shingles(t, k)) for t in b.column("text").to_pylist()]], "doc_id long, n_shingles long").withColumn("component_id", F.lit(None).cast("long"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id; rows are whole."""
    groups = near_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id")).where("kept_id is not null").distinct()
    return docs.join(groups, F.col("doc_id") == F.col("kept_id"), "left_semi").unionByName(docs.where("doc_id is null"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), k=4)
