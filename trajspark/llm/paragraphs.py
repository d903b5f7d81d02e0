"""Substring dedup: near-equal paragraphs and repeated passages, removed but for one.

A paragraph is a line of at least LEAST_WORDS words. They are found by MinHash banding: bands of one
permutation each (its minimum and maximum), so a pair of similarity j shares a band with probability
j * j, and bands_for(RECALL) of them find a pair of the least similarity with probability RECALL. Colliding
paragraphs are confirmed by exact Jaccard similarity of 0.8 on runs of five words, and joined into
components. Of each component the paragraph of the smallest (doc_id, place) stays.

Passages take no notice of lines. Anchors are the least of any ANCHOR_WINDOW neighbouring runs of
three words, by hash; a piece reaches from an anchor to the end of the next one's run. Equal passages
have equal anchors but near their ends, so every passage of 50 words that occurs again has two equal
pieces at least in both places. Pieces are compared by 64-bit hashes of their words, ASCII letters
lower-cased. Those that follow one another in a document are a passage if they have PASSAGE_WORDS words
or more; of each piece the one of the smallest (doc_id, place) stays.

Shorter repeats (greetings, licence and contact lines) are left alone: a paragraph of LEAST_WORDS words has
about the 100 bytes of the byte-wise operator. Documents with a null doc_id take no part; a null
text has no paragraphs; rows of one doc_id are judged by their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BASE, INVERSE, columns_of, dealt, map_arrow, mix64, power, record, shuffle_partitions, sliced, table, written
from .graph import join_hot
from .minhash import PERCENT, grouped

WORDS = 5
LEAST_WORDS = 16
PASSAGE_WORDS = 25
RECALL = 0.999
RUN_WORDS, ANCHOR_WINDOW = 3, 16
#: Code points that are cut into pieces at a time; a longer text is a group of its own.
GROUP_CHARS = 1 << 20
#: Pieces whose claims meet in one task.
PIECES_A_TASK = 2_000_000


def bands_for(recall: float, similarity: float = PERCENT / 100) -> int:
    """Bands of one permutation that find a pair of this similarity with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**2))


def cut(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the paragraphs of a text, line breaks left out."""
    out, at = [], 0
    for line in text.split("\n"):
        if len(line.encode().split()) >= LEAST_WORDS:
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def paragraphs(docs: DataFrame) -> DataFrame:
    """(id, text) with id "doc_id:start:end"."""

    def per_batch(batch):
        ids, lines = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for a, b in cut(text or ""):
                ids.append(f"{doc_id}:{a}:{b}")
                lines.append(text[a:b])
        return [ids, lines]

    return map_arrow(columns_of(docs, ["doc_id", "text"]).where("doc_id is not null"), per_batch, "id string, text string")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, cluster_doc_id, cluster_start, removed): every paragraph that has near copies."""
    rows, component = grouped(paragraphs(docs), WORDS, bands_for(RECALL), 1)
    placed = join_hot(rows.where("digest is not null").select("id", "digest"), component, "digest", ["component"])
    parts = F.split("id", ":")
    placed = placed.select("component", *(parts[i].cast("long").alias(c) for i, c in enumerate(("doc_id", "start", "end"))))
    placed = written(placed, "placed")
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "start")).alias("first")).where("size > 1").drop("size")
    found = join_hot(placed, sizes, "component", ["first"]).where("first is not null")
    return found.select("doc_id", "start", "end", F.col("first.doc_id").alias("cluster_doc_id"), F.col("first.start").alias("cluster_start"), ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).alias("removed"))


#: Pieces of a group of texts: the owner's place in the group, start and end in code points, first word and the word after the last.
_PIECE = np.dtype([("owner", "<i4"), ("start", "<i4"), ("end", "<i4"), ("from", "<i4"), ("to", "<i4"), ("hash", "<u8")])


def pieces(batch: list[str]) -> np.ndarray:
    """The pieces of texts, in order of text and place."""
    points = np.frombuffer("\n".join([*batch, ""]).encode("utf-32-le"), np.uint32)
    n = len(points)
    blank = (points == 32) | (points - np.uint32(9) < 5)
    before = np.ones(n, bool)
    before[1:] = blank[:-1]
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    folded = points + np.uint32(32) * (points - np.uint32(65) < 26)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * power(BASE, n), out=sums[1:])
    h = mix64((sums[end] - sums[start]) * power(INVERSE, n + 1)[start] + (end - start).astype(np.uint64))
    first = np.cumsum([0, *(len(t) + 1 for t in batch)])[:-1]
    owner = np.searchsorted(first, start, side="right") - 1
    words, runs = len(h), len(h) - RUN_WORDS + 1
    if runs < ANCHOR_WINDOW:
        return np.zeros(0, _PIECE)
    run = mix64(h[:runs] * np.uint64(9) + h[1 : runs + 1] * np.uint64(3) + h[2:])
    # The least of each window by doubling, its place in the low bits; ties to the left, inside any equal passage alike.
    low = np.uint64((1 << int(words).bit_length()) - 1)
    least = (run & ~low) | np.arange(runs, dtype=np.uint64)
    reach = 1
    while 2 * reach <= ANCHOR_WINDOW:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if ANCHOR_WINDOW > reach:
        least = np.minimum(least[: reach - ANCHOR_WINDOW], least[ANCHOR_WINDOW - reach :])
    inside = owner[: len(least)] == owner[ANCHOR_WINDOW + RUN_WORDS - 2 :]
    anchor = (least[inside] & low).astype(np.int64)
    anchor = anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])] if len(anchor) else anchor
    a, b = anchor[:-1], anchor[1:]
    same = owner[a] == owner[b]
    a, b = a[same], b[same] + RUN_WORDS
    of_word = np.zeros(words + 1, np.uint64)
    np.cumsum(h * power(BASE, words), out=of_word[1:])
    out = np.zeros(len(a), _PIECE)
    out["hash"] = mix64((of_word[b] - of_word[a]) * power(INVERSE, words + 1)[a] + (b - a).astype(np.uint64))
    out["owner"], out["start"], out["end"] = owner[a], start[a] - first[owner[a]], end[b - 1] - first[owner[a]]
    nth = np.searchsorted(owner, np.arange(len(batch)))  # the first word of each text
    out["from"], out["to"] = a - nth[owner[a]], b - nth[owner[a]]
    return out


PLACED = "ids binary, pieces binary, n long"
_CLAIM = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("times", "<i4")])


def _held(raw: bytes, kind: np.dtype) -> np.ndarray:
    """The rows of a compressed column-wise table of differences."""
    raw = zstandard.decompress(raw)
    out = np.zeros(len(raw) // kind.itemsize, kind)
    at = 0
    for c in kind.names:
        n = len(out) * kind[c].itemsize
        x = np.frombuffer(raw[at : at + n], kind[c])
        out[c] = x if c in ("hash", "doc") else np.cumsum(x, dtype=kind[c])
        at += n
    return out


def _pressed(rows: np.ndarray) -> bytes:
    return zstandard.compress(b"".join((rows[c] if c in ("hash", "doc") else np.diff(rows[c], prepend=rows[c].dtype.type(0))).tobytes() for c in rows.dtype.names), 1)


def _claims(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each distinct hash of a group its first place and how often it is there, in order of hash."""
    doc = ids[rows["owner"]]
    order = np.lexsort((rows["start"], doc, rows["hash"]))
    h = rows["hash"][order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    out = np.zeros(len(at), _CLAIM)
    out["hash"], out["doc"], out["start"], out["times"] = h[at], doc[order[at]], rows["start"][order[at]], np.diff(np.append(at, len(h)))
    return out


def _ruled(held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Of claims by group, those of hashes with two places or more, with the first place of all."""
    claim = np.concatenate([c for _, c in held])
    owner = np.repeat(np.arange(len(held)), [len(c) for _, c in held])
    order = np.lexsort((claim["start"], claim["doc"], claim["hash"]))
    claim, owner = claim[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], claim["hash"][1:] != claim["hash"][:-1]]))
    sizes = np.diff(np.append(at, len(claim)))
    again = np.repeat(np.add.reduceat(claim["times"], at) > 1, sizes)
    for c in ("doc", "start"):
        claim[c] = np.repeat(claim[c][at], sizes)
    claim, owner = claim[again], owner[again]
    order = np.argsort(owner, kind="stable")  # still in order of hash within a group
    claim, owner = claim[order], owner[order]
    for part in np.split(np.arange(len(claim)), np.flatnonzero(np.diff(owner)) + 1):
        if len(part):
            yield held[owner[part[0]]][0], claim[part]


def _passages(ids: np.ndarray, rows: np.ndarray, ruled: np.ndarray) -> list[np.ndarray]:
    """Columns (doc_id, start, end, cluster_doc_id, cluster_start, removed) of a group's passages, given the rulings on its pieces."""
    at = np.minimum(np.searchsorted(ruled["hash"], rows["hash"]), len(ruled) - 1)
    known = ruled["hash"][at] == rows["hash"]
    rows, first = rows[known], ruled[at[known]]
    doc = ids[rows["owner"]]
    # Pieces of one text that touch are a passage; within it, those that repeat one and the same place are one row.
    apart = np.ones(len(rows), bool)
    apart[1:] = (rows["owner"][1:] != rows["owner"][:-1]) | (rows["from"][1:] > rows["to"][:-1])
    begin = np.flatnonzero(apart)
    sizes = np.diff(np.append(begin, len(rows)))
    words = np.maximum.reduceat(rows["to"], begin) - rows["from"][begin] if len(begin) else begin
    keep = np.repeat(words >= PASSAGE_WORDS, sizes)
    rows, first, doc, apart = rows[keep], first[keep], doc[keep], apart[keep]
    shift = first["start"] - rows["start"]
    new = apart.copy()
    new[1:] |= (first["doc"][1:] != first["doc"][:-1]) | (shift[1:] != shift[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
    end = np.maximum.reduceat(rows["end"], begin)
    return [doc[begin], rows["start"][begin], end, first["doc"][begin], first["start"][begin], (doc[begin] != first["doc"][begin]) | (shift[begin] != 0)]


REPEATS = "doc_id long, start long, end long, cluster_doc_id long, cluster_start long, removed boolean"


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, cluster_doc_id, cluster_start, removed): passages that stand elsewhere too, and where first.

    Groups of texts claim their distinct pieces at the tasks that the pieces' hashes lead to, so a piece that
    a large share of all rows has reaches its task once a group; the tasks rule which occur again and
    where first. Claims and rulings travel as packed arrays.
    """
    spark = docs.sparkSession
    placed_schema, claim_schema, out_schema = (to_arrow_schema(StructType.fromDDL(s)) for s in (PLACED, "part int, block long, claims binary", REPEATS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, body, size = [], [], 0

        def out() -> pa.RecordBatch:
            found = pieces(body)
            return record(placed_schema, [[np.array(ids, np.int64).tobytes()], [_pressed(found)], [len(found)]])

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if body and size + len(text) > GROUP_CHARS:
                    yield out()
                    ids, body, size = [], [], 0
                ids.append(doc_id)
                body.append(text)
                size += len(text)
        if body:
            yield out()

    placed = columns_of(docs, ["doc_id", "text"]).where("doc_id is not null and text is not null").mapInArrow(place, PLACED)
    placed = written(placed.where("n > 0").withColumn("block", F.monotonically_increasing_id()), "pieces", "none")
    total = placed.agg(F.sum("n")).first()[0] or 0
    tasks = max(shuffle_partitions(spark), -(-total // PIECES_A_TASK))

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            found = _claims(np.frombuffer(row["ids"], np.int64), _held(row["pieces"], _PIECE))
            part = ((found["hash"] >> np.uint64(32)) % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, part = found[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            yield record(claim_schema, [part[np.concatenate([[0], cuts])], [row["block"]] * (len(cuts) + 1), [x.tobytes() for x in np.split(found, cuts)]])

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(block, np.frombuffer(x, _CLAIM)) for batch in batches for block, x in zip(batch.column("block").to_pylist(), batch.column("claims").to_pylist())]
        for block, ruled in _ruled(held) if held else ():
            yield record(claim_schema, [[0], [block], [ruled.tobytes()]])

    claims = placed.mapInArrow(claim, "part int, block long, claims binary")
    rulings = dealt(claims, tasks, "part").mapInArrow(rule, "part int, block long, claims binary")
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    both = placed.select("block", F.lit(1).alias("kind"), "ids", "pieces", *none("claims")).unionByName(rulings.select("block", F.lit(0).alias("kind"), *none("ids", "pieces"), "claims"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            if row["kind"] == 0:
                held.append(np.frombuffer(row["claims"], _CLAIM))
                continue
            if held:
                ruled = np.concatenate(held)
                ruled = ruled[np.argsort(ruled["hash"])]
                columns = _passages(np.frombuffer(row["ids"], np.int64), _held(row["pieces"], _PIECE), ruled)
                for at in range(0, len(columns[0]), 10_000):
                    yield record(out_schema, [c[at : at + 10_000] for c in columns])
            held = []

    return both.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(tell, REPEATS)


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated paragraphs and, besides, repeated passages."""
    return repeated_paragraphs(docs).unionByName(repeated_passages(docs))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removed paragraphs and passages (and one character after each) cut out of `text`; no row goes."""
    cuts = repeats(docs).where("removed").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.array("start", "end"))).alias("_cuts"))  # at most the lines and pieces of one document

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else _without(t, s) for t, s in zip(text, spans)], dtype=object)

    joined = docs.join(cuts.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left")
    return joined.withColumn("text", kept("text", "_cuts")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _without(text: str, spans) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = max(at, min(b + 1, len(text)))
    return "".join([*out, text[at:]])


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
