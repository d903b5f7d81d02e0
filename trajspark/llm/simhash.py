"""Document fingerprints: SimHash with weighted term votes, and permuted block tables for search.

Terms are words (weight FULL), pairs of neighbouring words (twice that) and 4-grams of code points,
whose weight falls from FULL to nothing as a text grows to FULL code points: where words are few,
their letters tell more. Each term's hash votes on every bit; a tied bit takes the bit of the text's
smallest word hash, or 4-gram hash without words. Null text counts as empty and an
empty text has the all-zero fingerprint. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, dealt, kept, mix64, record, shuffle_partitions, sliced, table, texts, written
from .graph import join_hot

BITS = 256
RADIUS = 7
FULL = 256
_WORDS = BITS // 64
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64) for i in range(_WORDS)]
#: For each byte value, eight 8-bit lanes that hold its bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()
_LANE_MOST = 255


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()
kept("simhash", _hashes.clear)


def _votes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text (counts of its consecutive hashes), how many of its hashes set each bit."""
    out = np.zeros((len(counts), BITS), np.int64)
    has = counts > 0
    if not len(hashes):
        return out
    counts = counts[has]
    per = -(-counts // _LANE_MOST)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    starts = (ends - counts)[owner] + nth * _LANE_MOST
    first = np.cumsum(per) - per
    got = np.zeros((len(counts), BITS), np.int64)
    for w, salt in enumerate(_SALTS):
        bytes_ = mix64(hashes ^ salt).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            lanes = np.add.reduceat(_LANES[bytes_[:, b]], starts).view(np.uint8).reshape(-1, 8)
            at = (w * 8 + b) * 8
            got[:, at : at + 8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    out[has] = got
    return out


def fingerprints(batch: list[str]) -> np.ndarray:
    """One row of BITS / 8 bytes for each text."""
    none = np.zeros(0, np.uint64)
    ones, pairs, grams = [], [], []
    for text in batch:
        words = np.array(list(map(_hashes.__getitem__, text.lower().split())), np.uint64)
        ones.append(words)
        pairs.append(mix64(words[:-1] * np.uint64(3) + words[1:]))
        grams.append(np.array([xxhash.xxh64_intdigest(text[i : i + 4], 1) for i in range(len(text) - 3)], np.uint64) if 4 <= len(text) < FULL else none)
    size = lambda parts: np.array([len(p) for p in parts], np.int64)
    n1, n2, n4 = size(ones), size(pairs), size(grams)
    h1, h2, h4 = (np.concatenate(x) if x else none for x in (ones, pairs, grams))
    fading = np.array([max(0, FULL - len(t)) for t in batch], np.int64)
    total = (FULL * (n1 + 2 * n2) + fading * n4)[:, None]
    twice = 2 * (FULL * (_votes(h1, n1) + 2 * _votes(h2, n2)) + fading[:, None] * _votes(h4, n4))
    least = np.zeros(len(batch), np.uint64)
    for h, n in ((h4, n4), (h1, n1)):
        if len(h):
            least[n > 0] = np.minimum.reduceat(h, (np.cumsum(n) - n)[n > 0])
    tie = np.concatenate([np.unpackbits(mix64(least ^ s).view(np.uint8).reshape(-1, 8), axis=1) for s in _SALTS], axis=1).astype(bool)
    bits = (twice > total) | ((twice == total) & tie & (total > 0))
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def simhash(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the hex fingerprint of a text column; other columns are carried along."""
    @F.pandas_udf("string")
    def fingerprint(column: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes().hex() for x in fingerprints([t or "" for t in column])], dtype=object)

    return docs.withColumn(out, fingerprint(F.col(f"`{text}`")))


def block_tables(prints: DataFrame, radius: int = RADIUS, fingerprint: str = "fingerprint") -> DataFrame:
    """The permuted tables: radius + 1 rows per fingerprint, table t keyed by its block t.

    Two fingerprints within the radius differ in at most radius blocks, so they share the key
    of one table at least: the search over all tables is exact.
    """
    blocks = radius + 1
    digits = BITS // 4
    cuts = [(digits * i // blocks, digits * (i + 1) // blocks) for i in range(blocks)]
    keys = F.array(*[F.substring(fingerprint, a + 1, b - a) for a, b in cuts])
    return prints.select("*", F.posexplode(keys).alias("table_no", "block"))


def _distance(a: str, b: str):
    """Hamming distance of two hex columns, in 64-bit words."""
    parts = [F.bit_count(F.conv(F.substring(a, i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, i + 1, 8), 16, 10).cast("long"))) for i in range(0, BITS // 4, 8)]
    return sum(parts[1:], parts[0])


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = RADIUS, fingerprint: str = "fingerprint") -> DataFrame:
    """All pairs (query, match, distance) of distinct fingerprints within the radius.

    Both sides are reduced to distinct fingerprints, so copies are joined once; a caller joins
    them back by fingerprint. Equal fingerprints are a class and give no pair. A pair found in
    several tables is kept only in its first.
    """
    q = block_tables(queries.select(F.col(fingerprint).alias("query")).where("query is not null").distinct(), radius, "query")
    x = block_tables(index.select(F.col(fingerprint).alias("match")).where("match is not null").distinct(), radius, "match")
    blocks = radius + 1
    digits = BITS // 4
    cuts = [(digits * i // blocks, digits * (i + 1) // blocks) for i in range(blocks)]
    first = F.coalesce(*[F.when(F.substring("query", a + 1, b - a) == F.substring("match", a + 1, b - a), F.lit(i)) for i, (a, b) in enumerate(cuts)])
    distance = _distance("query", "match")
    return q.join(x, (q.table_no == x.table_no) & (q.block == x.block) & (F.col("query") != F.col("match")) & (first == q.table_no) & (distance <= radius)).select("query", "match", distance.alias("distance"))


#: Below every real doc_id.
_NO_ID = -(2**63)


def with_neighbour(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, doc_id, text), dealt by ranges of descending doc_id and sorted in each.

    The first row of each range is sent to the range before it too, marked extra, so every
    row meets its successor without a global sort; the first of all also follows the last.
    A null doc_id sorts last; rows of one doc_id sort by text.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    key = F.coalesce("doc_id", F.lit(_NO_ID))
    keys = columns_of(docs, ["doc_id"]).select(key.alias("k"))
    splits = keys.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    splits = sorted(set(splits or []))

    def bucket(k):
        return F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s > k)) if splits else F.lit(0)

    heads = [(r["b"], r["k"]) for r in keys.groupBy(bucket(F.col("k")).alias("b")).agg(F.max("k").alias("k")).orderBy("b").collect()]  # one row a range
    links = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]
    before = spark.createDataFrame(links, "head long, before int")
    rows = columns_of(docs, ["doc_id", "text"]).withColumn("k", key)
    rows = rows.join(F.broadcast(before), F.col("k") == F.col("head"), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(bucket(F.col("k")).alias("bucket"), F.lit(False).alias("extra")))).otherwise(F.array(F.struct(bucket(F.col("k")).alias("bucket"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))))
    placed = rows.select(F.explode(places).alias("at"), "k", "doc_id", "text").select("at.bucket", "at.extra", "k", "doc_id", "text")
    return dealt(placed, n, "bucket").sortWithinPartitions("bucket", "extra", F.desc("k"), "text").drop("k")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_likeness(docs: DataFrame) -> DataFrame:
    """For each document, its fingerprint, that of its edited text, and likenesses.

    The edited text has the last third of the code points replaced by the start of the next
    document in descending doc_id. A single document follows itself. An empty table gives none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(EDITED))

    def out(rows: list) -> pa.RecordBatch:
        """rows: (doc_id, text, its fingerprint, next text, the next's fingerprint)"""
        ids, own, prints, nexts, next_prints = zip(*rows)
        edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(own, nexts)]
        mine, theirs, changed = np.stack(prints), np.stack(next_prints), fingerprints(edited)
        hexes = lambda m: [x.tobytes().hex() for x in m]
        return record(schema, [ids, [len(t) for t in own], [hashlib.sha256(t.encode()).hexdigest() for t in edited], hexes(mine), hexes(changed), likeness(mine, changed), likeness(mine, theirs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, fingerprint) whose successor hasn't come
        for batch in sliced(batches):
            got, body = [], texts(batch.column("text"))
            prints = fingerprints(body)
            for bucket, extra, doc_id, text, mark in zip(batch.column("bucket").to_pylist(), batch.column("extra").to_pylist(), batch.column("doc_id").to_pylist(), body, prints):
                if held and held[0] == bucket:
                    got.append((*held[1:], text, mark))
                held = None if extra else (bucket, doc_id, text, mark)
            if got:
                yield out(got)

    return with_neighbour(docs).mapInArrow(run, EDITED)


#: A search takes as queries the documents whose doc_id this divides.
QUERY_STEP = 100


def with_nearest(rows: DataFrame, radius: int = RADIUS, step: int = QUERY_STEP) -> DataFrame:
    """rows with the search of all fingerprints for those of the rows whose doc_id `step` divides.

    `n_near` is the number of other distinct fingerprints within the radius, and `nearest` the least distance:
    0 for a fingerprint that another row has too, null without any neighbour. Rows that aren't queries have null in both.
    """
    rows = written(rows, "prints")
    asked = F.col("doc_id") % step == 0
    prints = written(rows.groupBy("fingerprint").agg(F.count("*").alias("rows"), F.coalesce(F.max(asked), F.lit(False)).alias("asked")), "distinct")
    queries = prints.where("asked")
    found = near_fingerprints(queries, prints, radius).groupBy(F.col("query").alias("_of")).agg(F.count("*").alias("n_near"), F.min("distance").alias("least"))
    nearest = F.when(F.col("rows") > 1, F.lit(0)).otherwise(F.col("least")).cast("int")
    told = queries.join(found, F.col("fingerprint") == F.col("_of"), "left").select("fingerprint", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), nearest.alias("nearest"))
    others = rows.where(~F.coalesce(asked, F.lit(False))).select("*", F.lit(None).cast("long").alias("n_near"), F.lit(None).cast("int").alias("nearest"))
    return join_hot(rows.where(asked), written(told, "nearest"), "fingerprint", ["n_near", "nearest"]).unionByName(others)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_nearest(edit_likeness(table(spark, sf_dir, "documents")))
