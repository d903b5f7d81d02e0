"""Lexical retrieval packing: windows filled with the nearest unused neighbours of a seed document.

Document frequencies and the mean length are those of all documents. Documents are put in order of
their content: by the informative term that is least in a random order weighted by idf, then by
those of two more such orders, so that copies stand together and texts that share many terms often
do; what shares all keys is in order of a hash of the document. Tasks get ranges of that order with
equal numbers of ids, and cut shards of SHARD_DOCS documents, or SHARD_IDS ids, from theirs. Each shard has a BM25 inverted index of its token ids; a
window starts with a seed (an unused document, or the one that the last window cut), asks the index
for the seed's unused neighbours and takes them, best first, until it is full. Documents without a
common informative term follow in order of doc_id. What is left at a shard's end is cut into
sequences whose lengths are powers of two, which need no padding.

A document is its token ids and then END; a null text is empty. Rows of one doc_id are documents
of their own. Windows are WINDOW ids long.
"""

from __future__ import annotations

import math
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BASE, INVERSE, columns_of, dealt, kept, map_arrow, mix64, power, record, shuffle_partitions, sliced, table, texts, tidy, written

WINDOW = 4096
END = 2
SHARD_DOCS = 1200
#: Ids that a shard holds at most, but for one document that has more.
SHARD_IDS = 2_000_000
#: A sequence_id is the task's range, the shard in it and the sequence in that.
SHARD_BITS, SEQUENCE_BITS = 19, 24
K1, B = 1.2, 0.75
#: A worker remembers half as many parts as its table has slots, about 80 MB in all.
_SLOTS = 22
_MARKS = string.punctuation
#: Runs of marks that a worker remembers.
_TAILS = 10_000
_BATCH_CHARS = 500_000
_BLANK = np.zeros(256, bool)
_BLANK[list(b"\t\n\x0b\x0c\r ")] = True


class Ids:
    """Token ids, as bytes of unsigned 16-bit numbers, of texts.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its
    parts between ASCII white space, in a row. Parts are remembered in a table over their hashes,
    looked up for a whole batch at once. The tokenizer lower-cases, and keeps letters apart from
    marks after them: new parts are reduced to their lower-case letters, and these are encoded together
    in one text, which is cut after each token that ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.tails: dict[str, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << _SLOTS, np.uint64)  # 0 is an empty slot
        self.at, self.size = np.zeros(1 << _SLOTS, np.uint32), np.zeros(1 << _SLOTS, np.uint32)
        self.pool, self.used, self.held = np.zeros(1 << 20, np.uint16), 0, 0

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """For each key its slot, or the empty slot where it would go."""
        slot = (keys >> np.uint64(64 - _SLOTS)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOTS) - 1)
        return slot

    def _insert(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds distinct new keys with their ids, in a row."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint16)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self._point(keys, at, sizes)

    def _point(self, keys: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        """Adds distinct new keys whose ids are in the pool."""
        left = np.arange(len(keys))
        while len(left):  # keys that want one slot take turns
            slot = self._slots(keys[left])
            _, first = np.unique(slot, return_index=True)
            won = left[first]
            self.keys[slot[first]], self.at[slot[first]], self.size[slot[first]] = keys[won], at[won], sizes[won]
            left = np.delete(left, first)
        self.held += len(keys)

    def _pooled(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Runs of the pool, in a row."""
        after = np.cumsum(size)
        return self.pool[np.repeat(at - after + size, size) + np.arange(int(after[-1]) if len(after) else 0)]

    def _parts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key) of the parts of bytes that end with white space."""
        blank = _BLANK[data]
        before = np.concatenate([[True], blank[:-1]])
        start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power(BASE, len(data)), out=sums[1:])
        keys = mix64((sums[end] - sums[start]) * power(INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))
        return start, end, np.maximum(keys, np.uint64(1))

    def of(self, batch: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for group in grouped_by_size(batch, _BATCH_CHARS):
            out += self._of(group)
        return out

    def _of(self, batch: list[str]) -> list[bytes]:
        raw = [t.encode() for t in batch]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        start, end, keys = self._parts(data)
        slot = self._slots(keys)
        new = self.keys[slot] == 0
        if new.any():
            _, first = np.unique(keys[new], return_index=True)
            first = np.flatnonzero(new)[first]
            if self.held + 2 * len(first) > 1 << (_SLOTS - 1):
                self.clear()
                _, first = np.unique(keys, return_index=True)
            size = end[first] - start[first] + 1  # with the white space after it
            after = np.cumsum(size)
            text = data[np.repeat(start[first] - after + size, size) + np.arange(int(after[-1]))]
            text[after - 1] = 10
            self._learn(text[:-1].tobytes().decode(), keys[first])
            slot = self._slots(keys)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        after = np.cumsum(size)
        ids = self._pooled(at, size)
        ends = np.cumsum([len(r) + 1 for r in raw])
        cuts = np.concatenate([[0], after])[np.searchsorted(end, ends, side="left")]
        flat = ids.tobytes()
        return [flat[2 * a : 2 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def _learn(self, text: str, keys: np.ndarray) -> None:
        """Remembers new parts, given in lines."""
        parts, lows = text.split("\n"), text.lower().split("\n")
        words, plain, marked, tails, odd = [], [], [], [], []
        sigma = "\u03a3" in text  # lower-cased by its place in a word here, but not by the tokenizer
        for i, low in enumerate(lows):
            if sigma and "\u03a3" in parts[i]:
                odd.append(i)
            elif low.isalpha():
                words.append(low)
                plain.append(i)
            elif (word := low.rstrip(_MARKS)).isalpha():
                marked.append(i)
                tails.append(low[len(word) :])
            else:
                odd.append(i)
        words += [lows[i][: -len(tail)] for i, tail in zip(marked, tails)]
        at, size = self._words(words)
        n, known = len(plain), self.keys[self._slots(keys)] != 0
        fresh = np.flatnonzero(~known[plain])
        self._point(keys[np.array(plain, np.int64)[fresh]], at[fresh], size[fresh])
        ends = [self._tail(t) for t in tails]
        ids = [x for a, k, end in zip(at[n:].tolist(), size[n:].tolist(), ends) for x in (self.pool[a : a + k], end)]
        others = [self.encoded(parts[i]) for i in odd]
        rows = np.array(marked + odd, np.int64)
        if len(rows):
            sizes = np.concatenate([size[n:] + np.array([len(e) for e in ends], np.int64), np.array([len(o) for o in others], np.int64)])
            self._insert(keys[rows], np.concatenate(ids + others), sizes)

    def _tail(self, marks: str) -> np.ndarray:
        if marks not in self.tails:
            if len(self.tails) == _TAILS:
                self.tails.clear()
            self.tails[marks] = self.encoded(marks)
        return self.tails[marks]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of words of lower-case letters in the pool; words that are new are remembered."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, _, keys = self._parts(np.frombuffer("\n".join(words).encode() + b"\n", np.uint8))
        slot = self._slots(keys)
        new = np.flatnonzero(self.keys[slot] == 0)
        if len(new):
            new = new[np.unique(keys[new], return_index=True)[1]]
            fresh = [words[i] for i in new]
            ids = self.encoded(" ".join(fresh))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(fresh):
                each = [self.encoded(w) for w in fresh]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            self._insert(keys[new], ids, np.diff(cuts, prepend=0))
            slot = self._slots(keys)
        return self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)


def grouped_by_size(batch: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about `most` code points each, a longer text alone."""
    group: list[str] = []
    size = 0
    for t in batch:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


_known: dict[str, Ids] = {}
kept("packing", _known.clear)


def ids_of(path: str) -> Ids:
    if path not in _known:
        _known[path] = Ids(path)
    return _known[path]


_TERMS = 1 << 16


def idf_of(n: int, df: np.ndarray) -> np.ndarray:
    """Weights of terms; those of half of the documents or more weigh nothing."""
    return np.log(np.maximum((n - df + 0.5) / (df + 0.5), 1.0))


class Index:
    """BM25 over the documents of one shard, under the idf and mean length of all shards (by default, its own)."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64) | (np.repeat(np.arange(n, dtype=np.int64), sizes) << 16)
        pairs, times = np.unique(flat, return_counts=True)
        term, doc = pairs & 0xFFFF, pairs >> 16
        if idf is None:
            idf = idf_of(n, np.bincount(term, minlength=_TERMS))
        informative = idf[term] > 0  # others weigh nothing
        term, doc, times = term[informative], doc[informative], times[informative].astype(float)
        length = sizes / max(sizes.mean() if mean is None else mean, 1.0)
        weight = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[doc]))
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        self.terms = term
        by = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by], weight[by]
        self.of_term = np.searchsorted(term[by], np.arange(_TERMS + 1))
        self.n = n

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents, best score for the seed's terms first; ties in order."""
        terms = self.terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        starts, sizes = self.of_term[terms], self.of_term[terms + 1] - self.of_term[terms]
        total = int(sizes.sum())
        at = np.arange(total) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        scores = np.bincount(self.doc[at], self.weight[at], self.n)
        return np.argsort(-scores, kind="stable")


def arranged(docs: list[np.ndarray], window: int = WINDOW, idf: np.ndarray | None = None, mean: float | None = None) -> list[int]:
    """The order in which a shard's documents follow one another."""
    index = Index(docs, idf, mean)
    used = np.zeros(len(docs), bool)
    order: list[int] = []
    place, next_, seed = 0, 0, None
    while len(order) < len(docs):
        if seed is None:
            while used[next_]:
                next_ += 1
            seed = next_
            used[seed] = True
            order.append(seed)
            place += len(docs[seed])
        room = -place % window
        if room:
            near = index.neighbours(seed)
            for j in near[~used[near]].tolist():
                used[j] = True
                order.append(j)
                place += len(docs[j])
                room -= len(docs[j])
                if room <= 0:
                    seed = j if room else None
                    break
        else:
            seed = None
    return order


def sequences(total: int, window: int = WINDOW) -> list[int]:
    """Lengths of the sequences of a shard: whole windows, then powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(shard: int, doc_ids: list, docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None) -> list[tuple]:
    lengths = sequences(sum(map(len, docs)))
    out, sequence, offset = [], 0, 0
    for i in arranged(docs, WINDOW, idf, mean):
        ids, start = docs[i].astype("<u4"), 0
        while start < len(ids):
            n = min(len(ids) - start, lengths[sequence] - offset)
            out.append((doc_ids[i], start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), (shard << SEQUENCE_BITS) + sequence, offset))
            start += n
            offset += n
            if offset == lengths[sequence]:
                sequence, offset = sequence + 1, 0
    return out


def statistics(coded: DataFrame) -> tuple[int, float, np.ndarray]:
    """Number and mean length of all documents, and of how many each term is part."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df, last = 0, 0, np.zeros(_TERMS, np.int64), np.full(_TERMS, -1)
        for batch in sliced(batches):
            for cell in batch.column("ids").to_pylist():
                ids = np.frombuffer(cell, np.uint16)
                new = ids[last[ids] != n]
                last[new] = n
                df[new] += 1  # once a term, however often it is there
                n, total = n + 1, total + len(ids)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *terms.tolist()], pa.int32()), pa.array([n, total, *df[terms].tolist()], pa.int64())], ["term", "n"])

    found = coded.select("ids").mapInArrow(tidy(count, "packing"), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    df = np.zeros(_TERMS, np.int64)
    n = total = 0
    for r in found:
        if r.term == -2:
            n = r.n
        elif r.term == -1:
            total = r.n
        else:
            df[r.term] = r.n
    return n, total / max(n, 1), df


#: Bits of a term in a key of three terms, and of the hash that splits what shares all three.
_KEY_BITS, _TIE_BITS = 16, 15


def orders(idf: np.ndarray) -> list[np.ndarray]:
    """Places of the terms in three random orders in which a term is first with a chance like its idf."""
    out = []
    for salt in range(3):
        u = ((mix64(np.arange(_TERMS, dtype=np.uint64) * np.uint64(3) + np.uint64(salt + 1)) >> np.uint64(11)).astype(float) + 0.5) / 2**53
        wait = np.full(_TERMS, np.inf)
        np.divide(-np.log(u), idf, out=wait, where=idf > 0)
        place = np.empty(_TERMS, np.int64)
        place[np.argsort(wait, kind="stable")] = np.arange(_TERMS)
        place[idf <= 0] = _TERMS - 1
        out.append(place)
    return out


def content_keys(docs: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """63-bit keys: each document's least place in every order, above _TIE_BITS bits of zero."""
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    flat = np.concatenate(docs)
    key = np.zeros(len(docs), np.int64)
    for place in places:
        key = (key << _KEY_BITS) | np.minimum.reduceat(place[flat], starts)
    return key << _TIE_BITS


def bounds(keys: DataFrame, total: int, parts: int) -> np.ndarray:
    """The keys at which `parts` ranges of rows (key, size) of `total` size begin but for the first; equal keys stay in one range."""
    spark = keys.sparkSession
    if parts <= 1:
        return np.zeros(0, np.int64)
    ranked = written(keys.repartitionByRange(parts, "key").select("key", "size", F.spark_partition_id().alias("part")), "ranks")
    before, sum_ = [], 0
    for r in sorted(ranked.groupBy("part").agg(F.sum("size").alias("size")).collect()):  # a row a partition
        before.append((r["part"], sum_))
        sum_ += r["size"]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    upto = F.col("before") + F.sum("size").over(W.partitionBy("part").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0))
    target = math.ceil(total / parts)
    marked = ranked.join(offsets, "part").select("key", F.floor(upto / target).alias("new"), F.floor((upto - F.col("size")) / target).alias("old"))
    return np.unique(np.array([r.key for r in marked.where("new > old").select("key").collect()], np.int64))  # a row a range


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of all documents; an empty table gives none."""
    spark = docs.sparkSession
    schema = to_arrow_schema(StructType.fromDDL(PIECES))

    def encode(batch):
        known = ids_of(tokenizer)
        end = np.array([END], np.uint16).tobytes()
        return [batch.column("doc_id"), [x + end for x in known.of(texts(batch.column("text")))]]

    coded = map_arrow(columns_of(docs, ["doc_id", "text"]), encode, "doc_id long, ids binary")
    coded = written(coded.withColumn("tie", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << _TIE_BITS))), "ids", "snappy")
    n, mean, df = statistics(coded)
    idf = idf_of(n, df)
    places = orders(idf)

    def keys_of(batch) -> np.ndarray:
        docs_ = [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]
        return content_keys(docs_, places) + batch.column("tie").to_numpy()

    cuts = bounds(map_arrow(coded.select("ids", "tie"), lambda b: [keys_of(b), [len(x) // 2 for x in b.column("ids").to_pylist()]], "key long, size long"), round(n * mean), min(math.ceil(n * mean / SHARD_IDS), shuffle_partitions(spark)))

    def place(batch):
        key = keys_of(batch)
        return [np.searchsorted(cuts, key, side="right"), key, batch.column("doc_id"), batch.column("ids")]

    placed = dealt(map_arrow(coded, place, "part int, key long, doc_id long, ids binary"), len(cuts) + 1, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, ids, held, size = None, 0, [], [], 0

        def out():
            made = pieces((part << SHARD_BITS) + shard, ids, held, idf, mean)
            for at in range(0, len(made), 10_000):
                yield record(schema, list(zip(*made[at : at + 10_000])))

        for batch in sliced(batches):
            for own, doc_id, cells in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if held and (own != part or len(held) == SHARD_DOCS or size + len(cells) // 2 > SHARD_IDS):
                    yield from out()
                    shard, ids, held, size = shard + 1, [], [], 0
                if own != part:
                    part, shard = own, 0
                ids.append(doc_id)
                held.append(np.frombuffer(cells, np.uint16))
                size += len(held[-1])
        if held:
            yield from out()

    return placed.sortWithinPartitions("part", "key", "doc_id", "ids").select("part", "doc_id", "ids").mapInArrow(tidy(run, "packing"), PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
