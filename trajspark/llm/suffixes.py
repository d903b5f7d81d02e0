"""Suffix-array dedup: bytes that a string of LENGTH bytes from further up covers are removed.

A document's text is its UTF-8 bytes (null: none) and matches never cross documents. A string
counts as repeated if it also starts earlier: in a smaller doc_id, or earlier in the same one. A
null doc_id sorts last; rows of one doc_id sort by the block and place that holds them. All
strings are judged on the input, and overlapping ones are removed together.

Suffixes need sorting only where a repeat is possible. Every string of LENGTH bytes has an
anchor, the GRAM bytes in it with the least hash, which is the same wherever the string is. One
exchange of anchors finds those that occur twice; the second sends each occurrence's context
(the strings with that anchor) to the anchor's task. There equal contexts collapse, and in what
is left the suffixes with one anchor at one distance are merge-sorted: a comparison finds the
common extension by binary search over prefix polynomial hashes. Neighbours that extend over
LENGTH bytes are compared byte by byte, in case of a collision.

Within a block of documents only the first of equal contexts is sent, so a text that is copied
into a large share of all rows reaches a task once per block.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import columns_of, dealt, kept, mix64, record, shuffle_partitions, sliced, table, tidy, written

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 1 << 20
#: Starts that are looked at together, and context bytes that are decided together.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
kept("suffixes", _powers.clear)
_LAST = 2**63 - 1


def _power(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
        if n > 8 * BLOCK_BYTES:
            return _powers.pop(base)[:n]
    return _powers[base][:n]


class Prefixes:
    """Prefix polynomial hashes of a buffer."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=self.sums[1:])
        self.inverse = _power(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [start, end)."""
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[x + n] - self.sums[x]) * self.inverse[x] == (self.sums[y + n] - self.sums[y]) * self.inverse[y]

    def common(self, x: np.ndarray, y: np.ndarray, most: int = LENGTH) -> np.ndarray:
        """Length of the common extension of the suffixes x and y, up to `most`, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
        for _ in range(most.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.same(x, y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix x sorts before y; equal ones give or_equal."""
        n = self.common(x, y)
        whole = n >= LENGTH
        at = np.minimum(n, LENGTH - 1)
        return np.where(whole, or_equal, self.data[x + at] < self.data[y + at])


def suffix_sort(prefixes: Prefixes, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Order of the suffixes by (bucket, first LENGTH bytes), stable: bottom-up mergesort.

    In each round every element finds its rank in the sibling run by binary search, all at once.
    """
    order = np.argsort(bucket, kind="stable")
    sizes = np.unique(bucket, return_counts=True)[1]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    local = np.arange(len(order)) - first
    width = 1
    while len(sizes) and width < sizes.max():
        x = starts[order]
        pair = local // (2 * width) * (2 * width)
        in_left = local - pair < width
        own = local - pair - np.where(in_left, 0, width)
        low = np.where(in_left, np.minimum(pair + width, size), pair)
        begin, end = low, np.where(in_left, np.minimum(pair + 2 * width, size), pair + width)
        low, high = begin.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            # an equal element of the left run goes before those of the right one
            after = prefixes.less(x[first[open_] + middle], x[open_], ~in_left[open_])
            low[open_] = np.where(after, middle + 1, low[open_])
            high[open_] = np.where(after, high[open_], middle)
        place = first + pair + own + (low - begin)
        moved = np.empty_like(order)
        moved[place] = order
        order = moved
        width *= 2
    return order


def equal_classes(prefixes: Prefixes, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A number for each suffix, equal for suffixes of one bucket that share their first LENGTH bytes."""
    order = suffix_sort(prefixes, starts, bucket)
    x, b = starts[order], bucket[order]
    joined = (b[1:] == b[:-1]) & (prefixes.common(x[1:], x[:-1]) >= LENGTH) if len(x) > 1 else np.zeros(0, bool)
    span = np.arange(LENGTH)
    truly = joined.copy()
    for part in np.array_split(np.flatnonzero(joined), max(1, len(x) // 50_000)):
        truly[part] = (prefixes.data[x[part + 1][:, None] + span] == prefixes.data[x[part][:, None] + span]).all(axis=1)
    out = np.empty(len(x), np.int64)
    if (truly != joined).any():  # a collision: fall back to the bytes themselves
        known: dict = {}
        raw = prefixes.data.tobytes()
        out[:] = [known.setdefault((k, raw[s : s + LENGTH]), len(known)) for s, k in zip(starts.tolist(), bucket.tolist())]
    elif len(x):
        out[order] = np.concatenate([[0], np.cumsum(~joined)])
    return out


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place of the anchor, first start, last start, hash of the context) of each run of strings with one anchor.

    Works through CHUNK starts at a time, so a very long text needs no more memory; a run that a
    chunk cuts is two runs, which changes no string.
    """
    ends = np.cumsum(sizes)
    long = sizes >= LENGTH
    begin, stop = (ends - sizes)[long], (ends - LENGTH + 1)[long]
    found = [tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64))]
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        edge = np.zeros(CHUNK + 1, np.int32)
        here = (stop > at) & (begin < at + CHUNK)
        np.add.at(edge, np.maximum(begin[here] - at, 0), 1)
        np.add.at(edge, np.minimum(stop[here] - at, CHUNK), -1)
        starts = np.flatnonzero(np.cumsum(edge[:CHUNK]) > 0)
        if len(starts):
            hashes, place, first, last, look = _anchors(data[at : at + CHUNK + LENGTH - 1], starts)
            found.append((hashes, place + at, first + at, last + at, look))
    return tuple(map(np.concatenate, zip(*found)))


def _anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    n, width = len(data), LENGTH - GRAM + 1
    prefixes = Prefixes(data)
    hashes = mix64((prefixes.sums[GRAM:] - prefixes.sums[:-GRAM]) * prefixes.inverse[: n - GRAM + 1])
    low = np.uint64((1 << int(n).bit_length()) - 1)
    least = (hashes & ~low) | np.arange(n - GRAM + 1, dtype=np.uint64)  # ties to the leftmost: decided inside the string
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least[starts] & low).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = starts[np.concatenate([first[1:] - 1, [len(starts) - 1]])]
    place, first = place[first], starts[first]
    return hashes[place], place, first, last, prefixes.of(first, last + LENGTH)


BLOCKS = "rest binary, sizes binary, data binary"


def blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) as blocks of about BLOCK_BYTES: (block, rest, sizes, data), written."""
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        body: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rest[0].schema) as stream:
                for x in rest:
                    stream.write_batch(x)
            return record(schema, [[zstandard.compress(sink.getvalue(), 3)], [np.array([len(b) for b in body], np.int64).tobytes()], [zstandard.compress(b"".join(body), 3)]])

        for batch in sliced(batches, 64):
            others = batch.select([c for c in batch.schema.names if c != "text"])
            text = [(t or "").encode() for t in batch.column("text").to_pylist()]
            at = 0
            for i, t in enumerate(text):
                body.append(t)
                size += len(t)
                if size >= BLOCK_BYTES or i == len(text) - 1:
                    rest.append(others.slice(at, i + 1 - at))
                    at = i + 1
                if size >= BLOCK_BYTES:
                    yield out()
                    rest, body, size = [], [], 0
        if body:
            yield out()

    packed = docs.mapInArrow(tidy(run, "suffixes"), BLOCKS)
    return written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks", "none")


def _opened(row: dict) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    rest = pa.ipc.open_stream(zstandard.decompress(row["rest"])).read_all()
    return rest, np.frombuffer(row["sizes"], np.int64), np.frombuffer(zstandard.decompress(row["data"]) if row["data"] else b"", np.uint8)


def _order(rest: pa.Table) -> np.ndarray:
    return np.array([_LAST if i is None else i for i in rest.column("doc_id").to_pylist()], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _with_notes(packed: DataFrame, notes: DataFrame, per_block: Callable, schema: str) -> DataFrame:
    """Each block (a dict) with the binaries of its notes (block, note), given to per_block."""
    empty = [F.lit(None).cast("binary").alias(c) for c in ("rest", "sizes", "data")]
    both = packed.select("block", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("note"), "rest", "sizes", "data").unionByName(notes.select("block", F.lit(0).alias("kind"), "note", *empty))
    dealt = both.repartition(shuffle_partitions(packed.sparkSession), "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for row in _rows(batches):
            if row["kind"] == 0:
                held.append(row["note"])
            else:
                yield from per_block(row, held)
                held = []

    return dealt.mapInArrow(tidy(run, "suffixes"), schema)


NOTE = "block long, note binary"
SENT = "part int, block long, head binary, body binary"
_HEAD = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("anchor", "<i4"), ("size", "<i4")])
#: Parts below this hold what a block decides alone: part LOCAL - p goes through task p unchanged.
LOCAL = -1


def _squeezed(head: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(head[c].tobytes() for c in _HEAD.names), 3)


def _restored(held: bytes) -> np.ndarray:
    raw = zstandard.decompress(held)
    out = np.zeros(len(raw) // _HEAD.itemsize, _HEAD)
    at = 0
    for c in _HEAD.names:
        n = len(out) * _HEAD[c].itemsize
        out[c] = np.frombuffer(raw[at : at + n], _HEAD[c])
        at += n
    return out


def _twice(packed: DataFrame, parts: int) -> DataFrame:
    """(block, hashes of its anchors that another block has too)."""
    out_schema, note_schema = (to_arrow_schema(StructType.fromDDL(s)) for s in ("part int, block long, note binary", NOTE))

    def send(batches):
        for row in _rows(batches):
            _, sizes, data = _opened(row)
            hashes = np.unique(anchors(data, sizes)[0])
            part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            hashes, part = hashes[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            some = [x for x in np.split(hashes, cuts) if len(x)]
            if some:
                yield record(out_schema, [part[np.concatenate([[0], cuts])], [row["block"]] * len(some), [x.tobytes() for x in some]])

    def match(batches):
        block, note = [], []
        for batch in batches:
            block += batch.column("block").to_pylist()
            note += [np.frombuffer(x, np.uint64) for x in batch.column("note").to_pylist()]
        if not note:
            return
        flat = np.concatenate(note)
        owner = np.repeat(np.arange(len(note)), [len(x) for x in note])
        order = np.argsort(flat, kind="stable")
        x = flat[order]
        same = x[1:] == x[:-1]
        twice = np.zeros(len(x), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = np.sort(order[twice])
        cuts = np.flatnonzero(np.diff(owner[found])) + 1
        for part in np.split(found, cuts):
            if len(part):
                yield record(note_schema, [[block[owner[part[0]]]], [flat[part].tobytes()]])

    sent = packed.mapInArrow(tidy(send, "suffixes"), "part int, block long, note binary")
    return dealt(sent, parts, "part").mapInArrow(tidy(match, "suffixes"), NOTE)


def _intervals(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return np.column_stack([starts, ends]).astype(np.int64).tobytes()


def _contexts(packed: DataFrame, notes: DataFrame, parts: int) -> DataFrame:
    """Contexts of anchors that occur twice, for their part; a negative part holds intervals that the block alone decides."""
    schema = to_arrow_schema(StructType.fromDDL(SENT))

    def per_block(row: dict, held: list[bytes]):
        rest, sizes, data = _opened(row)
        hashes, place, first, last, look = anchors(data, sizes)
        if not len(hashes):
            return
        _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
        known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in held])) if held else np.zeros(0, np.uint64)
        at = np.searchsorted(known, hashes)
        twice = (count[inverse] > 1) | ((at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == hashes) if len(known) else False)
        use = np.flatnonzero(twice)
        if not len(use):
            return
        hashes, place, first, end, look = hashes[use], place[use], first[use], last[use] + LENGTH, look[use]
        ids = _order(rest)[np.searchsorted(np.cumsum(sizes), first, side="right")]
        order = np.lexsort((first, ids, place - first, end - first, look, hashes))
        h, k, a, n = hashes[order], look[order], (place - first)[order], (end - first)[order]
        same = np.zeros(len(order), bool)
        same[1:] = (h[1:] == h[:-1]) & (k[1:] == k[:-1]) & (a[1:] == a[:-1]) & (n[1:] == n[:-1])
        raw = data.tobytes()
        for i in np.flatnonzero(same):  # equal hashes, so compare the bytes
            a, b = order[i - 1], order[i]
            same[i] = raw[first[a] : end[a]] == raw[first[b] : end[b]]
        gone = order[same]
        if len(gone):
            yield record(schema, [[LOCAL - row["block"] % parts], [row["block"]], [b""], [_intervals(first[gone], end[gone])]])
        keep = order[~same]
        head = np.zeros(len(keep), _HEAD)
        head["hash"], head["doc"], head["start"], head["anchor"], head["size"] = hashes[keep], ids[keep], first[keep], (place - first)[keep], (end - first)[keep]
        part = ((head["hash"] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
            own = keep[group]
            body = b"".join([raw[a:b] for a, b in zip(first[own].tolist(), end[own].tolist())])
            yield record(schema, [[part[group[0]]], [row["block"]], [_squeezed(head[group])], [zstandard.compress(body, 3)]])

    return _with_notes(packed, notes, per_block, SENT)


def decided(head: np.ndarray, block: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first byte, end) of the parts of the contexts that a string from further up covers."""
    offset = np.cumsum(head["size"]) - head["size"]
    prefixes = Prefixes(data)
    look = prefixes.of(offset, offset + head["size"])
    order = np.lexsort((head["start"], block, head["doc"], head["anchor"], head["size"], look, head["hash"]))
    h, o = head[order], offset[order]
    same = np.zeros(len(order), bool)
    same[1:] = (h["hash"][1:] == h["hash"][:-1]) & (look[order][1:] == look[order][:-1]) & (h["anchor"][1:] == h["anchor"][:-1]) & (h["size"][1:] == h["size"][:-1])
    raw = data.tobytes()
    for i in np.flatnonzero(same):
        n = h["size"][i]
        same[i] = raw[o[i - 1] : o[i - 1] + n] == raw[o[i] : o[i] + n]
    gone, kept = order[same], order[~same]
    out = [(gone, np.zeros(len(gone), np.int64), head["size"][gone].astype(np.int64))]
    # Of equal contexts the first stands for all; anchors left with one context have no repeat.
    hashes = head["hash"][kept]
    _, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    kept = kept[count[inverse] > 1]
    if len(kept):
        runs = head["size"][kept] - LENGTH + 1
        owner = np.repeat(kept, runs)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        distance = head["anchor"][owner] - shift
        bucket = mix64(head["hash"][owner] ^ mix64(distance.astype(np.uint64) + np.uint64(1)))
        _, inverse, count = np.unique(bucket, return_inverse=True, return_counts=True)
        several = count[inverse] > 1
        owner, shift, bucket = owner[several], shift[several], inverse[several].astype(np.int64)
        if len(owner):
            number = equal_classes(prefixes, offset[owner] + shift, bucket)
            by = np.lexsort((head["start"][owner] + shift, block[owner], head["doc"][owner], number))
            again = by[1:][number[by][1:] == number[by][:-1]]
            out.append((owner[again], shift[again], shift[again] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out))


def _repeats(contexts: DataFrame, parts: int) -> DataFrame:
    """(block, intervals) from the contexts of each part, about CHUNK bytes of them at a time, cut between anchors."""
    schema = to_arrow_schema(StructType.fromDDL(NOTE))

    def told(own: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((a, own))
        for group in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(group):
                x, y = a[group], np.maximum.accumulate(b[group])
                new = np.concatenate([[True], x[1:] > y[:-1]])
                yield record(schema, [[own[group[0]]], [_intervals(x[new], y[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(x) - 1]])])]])

    def run(batches):
        heads, owners, bodies = [], [], []
        for row in _rows(batches):
            if row["part"] < 0:
                yield record(schema, [[row["block"]], [row["body"]]])
                continue
            heads.append(_restored(row["head"]))
            owners.append(np.full(len(heads[-1]), row["block"], np.int64))
            bodies.append(zstandard.decompress(row["body"]))
        if not heads:
            return
        head, block, data = np.concatenate(heads), np.concatenate(owners), np.frombuffer(b"".join(bodies), np.uint8)
        del heads, owners, bodies
        offset = np.cumsum(head["size"]) - head["size"]
        order = np.argsort(head["hash"], kind="stable")
        hashes = head["hash"][order]
        filled = np.cumsum(head["size"][order]) // CHUNK
        cut = np.flatnonzero((filled[1:] != filled[:-1]))
        cut = np.unique(np.searchsorted(hashes, hashes[cut], side="right")) if len(cut) else cut
        for part in np.split(order, cut):
            if len(part):
                runs = head["size"][part]
                at = np.repeat(offset[part] - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
                which, a, b = decided(head[part], block[part], data[at])
                yield from told(block[part][which], head["start"][part][which] + a, head["start"][part][which] + b)

    return dealt(contexts.withColumn("to", F.when(F.col("part") < 0, LOCAL - F.col("part")).otherwise(F.col("part"))), parts, "to").drop("to").mapInArrow(tidy(run, "suffixes"), NOTE)


def repeated(docs: DataFrame, rendered: Callable, schema: str) -> DataFrame:
    """For each block of docs, the rows that `rendered` makes of (its other columns, [(bytes, removed mask)])."""
    parts = shuffle_partitions(docs.sparkSession)
    packed = blocks(docs)
    notes = _repeats(_contexts(packed, _twice(packed, parts), parts), parts)

    def per_block(row: dict, held: list[bytes]):
        rest, sizes, data = _opened(row)
        edge = np.zeros(len(data) + 1, np.int32)
        for note in held:
            pairs = np.frombuffer(note, np.int64).reshape(-1, 2)
            np.add.at(edge, pairs[:, 0], 1)
            np.add.at(edge, pairs[:, 1], -1)
        removed = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(sizes)
        for at in range(0, len(sizes), 1000):  # rows of a batch
            yield rendered(rest.slice(at, 1000), [(data[e - n : e], removed[e - n : e]) for e, n in zip(ends[at : at + 1000], sizes[at : at + 1000])])

    return _with_notes(packed, notes, per_block, schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_digest(docs: DataFrame) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(DIGEST))

    def rendered(rest: pa.Table, rows: list) -> pa.RecordBatch:
        spans = [int(np.count_nonzero(m[1:] & ~m[:-1])) + bool(len(m) and m[0]) for _, m in rows]
        return record(schema, [rest.column("doc_id").to_pylist(), [len(d) for d, _ in rows], [int(m.sum()) for _, m in rows], spans, [hashlib.sha256(d[~m].tobytes()).hexdigest() for d, m in rows]])

    return repeated(columns_of(docs, ["doc_id", "text"]), rendered, DIGEST)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of `text` and `n_chars` recounted; no row goes.

    A code point that a cut splits is dropped. A null text stays null.
    """
    rows = docs.withColumn("_null", F.col("text").isNull())
    names = [c for c in rows.columns if c != "text"]
    schema = StructType([*(rows.schema[c] for c in names), rows.schema["text"]])
    arrow = to_arrow_schema(schema)

    def rendered(rest: pa.Table, cut: list) -> pa.RecordBatch:
        text = [None if null else d[~m].tobytes().decode("utf-8", "ignore") for null, (d, m) in zip(rest.column("_null").to_pylist(), cut)]
        return pa.RecordBatch.from_arrays([*(rest.column(c).combine_chunks().cast(arrow.field(c).type) for c in names), pa.array(text, arrow.field("text").type)], schema=arrow)

    out = repeated(rows, rendered, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))
