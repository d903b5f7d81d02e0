"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

The lattice of a text holds every way to cut its normalised form (a leading mark, blanks as marks) into
pieces of a BPE model. Such a model has ranks, not probabilities: a piece weighs 1 / (1 + rank), a
character without a piece its UTF-8 bytes at the weight of the last piece each. The lattice is a
product over units (marks and what follows, up to the next mark or line break), which no piece
crosses; each unit's backward sums give the probability of a piece at each place.

Perturbed A-star search: the whole lattice has a Gumbel value, the maximum over its segmentations.
The best subset is opened along its maximum, one piece after another; at each place the pieces not
taken form a subset of their own, with a Gumbel value truncated at their parent's. Subsets wait in
order of value, so the k best come out exactly, distinct, in order, and only k paths are walked. The
inclusion score of a sample is log(1 - exp(-exp(log p - t))), t being the value of the next.

Random numbers come from a hash of the row key and the place, so a row has the same samples wherever
it runs. Samples decode to the text they are of, but that a mark in the text comes back as a blank. Null text counts as empty; an empty text has one segmentation, the empty one. A text with
fewer than k segmentations gives them all. Rows of one key and text give equal samples.
"""

from __future__ import annotations

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import columns_of, map_arrow, mix64, table, texts

SAMPLES = 2
_UNIT = re.compile("▁+[^▁\n]*|\n|[^▁\n]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MOST_EDGES = 3_000_000
_GUIDE = 8
_SEEN = 18
_MET = 22
#: Places looked at first; the most that a Gumbel value of a 53-bit number can be.
_FIRST = 64
_MOST_GUMBEL = 37.5


class _Spelt(dict):
    """The byte pieces of characters, by -1 - code point."""

    def __init__(self, of: dict[int, int]):
        self.of = of

    def __missing__(self, number: int) -> list[int]:
        ids = self[number] = [self.of[b] for b in chr(-number - 1).encode()]
        return ids


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        normal = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        pieces = [self.model.id_to_piece(i) for i in normal]
        if any(re.search("[^▁]▁|.\n|\n.", p) for p in pieces):
            raise ValueError("a piece crosses the bounds of units")
        self.bytes = {int(self.model.id_to_piece(i)[3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.by_bytes = _Spelt(self.bytes)
        spelling = [b"" if self.model.is_control(i) or self.model.is_unused(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            spelling[i] = bytes([b])
        self.spelling = np.array(spelling, object)
        rank = np.argsort(np.argsort([-self.model.get_score(i) for i in normal], kind="stable"))
        self.byte_weight = -math.log(1.0 + len(normal))
        # By size, what is known of a hash's first bits (1: a piece may have them, 2: the beginning of a longer one
        # may), and the hashes, ids and weights of the pieces.
        self.of_size = []
        weights = -np.log1p(rank.astype(float))
        sizes = np.array([len(p) for p in pieces])
        points, begin = _points("".join(pieces)), np.cumsum(sizes) - sizes
        at, rolled = np.arange(len(pieces)), np.zeros(len(pieces), np.uint64)
        for size in range(1, int(sizes.max()) + 1):
            rolled = _longer(rolled, points[begin[at] + size - 1])
            ends = sizes[at] == size
            known = np.zeros(1 << _SEEN, np.uint8)
            known[_first_bits(rolled[ends])] |= 1
            known[_first_bits(rolled[~ends])] |= 2
            order = np.argsort(rolled[ends])
            own = at[ends][order]
            self.of_size.append((known, rolled[ends][order], np.array(normal)[own], weights[own]))
            at, rolled = at[~ends], rolled[~ends]

    def decoded(self, ids: np.ndarray) -> bytes:
        """What ids spell, in UTF-8, without the leading mark."""
        return b"".join(self.spelling[ids].tolist()).removeprefix(b" ")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _longer(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings, each with one more character."""
    return hashes * _BASE + points + np.uint64(1)


def _first_bits(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) >> np.uint64(64 - _SEEN)).astype(np.int64)


def units_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """How many units each text has, their numbers among the distinct ones, and those; blanks are marks."""
    if any("\0" in t for t in batch):
        parts = pa.array([_UNIT.findall("▁" + t.replace(" ", "▁")) if t else [] for t in batch], pa.list_(pa.string()))
    else:
        marked = pa.array(["▁" + t if t else "" for t in batch], pa.string())
        # A cut before every run of marks and on both sides of a line break.
        for old, new in (" ", "▁"), ("▁", "\0▁"), ("▁\0", "▁"), ("\n", "\0\n\0"):
            marked = pc.replace_substring(marked, old, new)
        parts = pc.split_pattern(marked, "\0")
    flat = parts.flatten()
    some = pc.not_equal(flat, "")
    counts = np.bincount(pc.list_parent_indices(parts).filter(some).to_numpy(), minlength=len(batch))
    found = flat.filter(some).dictionary_encode()
    return counts, found.indices.to_numpy(), found.dictionary.to_pylist()


class Lattices:
    """Backward sums and piece probabilities of units, met so far, as one graph of numbered nodes."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.unit = collections.defaultdict()  # numbers in order of first sight
        self.met = np.zeros(1 << _MET, bool)
        self.start = np.zeros(0, np.int64)  # the first node of each unit
        self.nodes = self.edges = self.guides = 0
        self.passing: list[str] = []
        # Arrays with room to grow. Edges of node i: first[i] to first[i + 1]. rank numbers the nodes that have edges;
        # guide says where to look first for a number in each of _GUIDE parts of (0, 1).
        self.first, self.rank = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.target, self.source, self.piece = (np.zeros(0, np.int32) for _ in range(3))
        self.log_p, self.upto, self.guide = np.zeros(0), np.zeros(0), np.zeros(0, np.int32)

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        if used + len(values) > len(array):
            array = np.concatenate([array, np.zeros(max(len(values), len(array)), array.dtype)])
            setattr(self, name, array)
        array[used : used + len(values)] = values

    def starts(self, units: list[str]) -> np.ndarray:
        """The first node of each of the distinct units."""
        if self.passing:  # units of the last call that there was no lasting room for
            for u in self.passing:
                del self.unit[u]
            self.nodes, self.edges, self.guides = self.lasting
            self.passing = []
        known = len(self.unit)
        self.unit.default_factory = itertools.count(known).__next__
        numbers = np.fromiter(map(self.unit.__getitem__, units), np.int64, len(units))
        if len(self.unit) > known:
            new = list(itertools.islice(self.unit, known, None))
            if self.edges > _MOST_EDGES // 2:
                # Most units are met once: the second half of the room is for those met before.
                marks = np.fromiter(map(hash, new), np.int64, len(new)) & ((1 << _MET) - 1)
                lasts = self.met[marks] & (self.edges <= _MOST_EDGES)
                self.met[marks] = True
                order = np.argsort(~lasts, kind="stable")
                place = np.empty(len(new), np.int64)
                place[order] = np.arange(known, known + len(new))
                late = np.flatnonzero(numbers >= known)
                numbers[late] = place[numbers[late] - known]
                new = [new[i] for i in order.tolist()]
                stay = int(lasts.sum())
                self.unit.update(zip(new[:stay], range(known, known + stay)))
                new, self.passing = new[:stay], new[stay:]
            if new:
                self._append("start", known, self._add(new))
            self.lasting = self.nodes, self.edges, self.guides
            if self.passing:
                self._append("start", known + len(new), self._add(self.passing))
        return self.start[numbers]

    def _add(self, units: list[str]) -> np.ndarray:
        """The first nodes of new units."""
        v = self.vocabulary
        sizes = np.array([len(u) for u in units])
        points = _points("".join(units))
        n = len(points)
        to_end = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # characters to the unit's end
        node = np.arange(n) + np.repeat(np.arange(len(units)), sizes)  # a unit of m characters has m + 1 nodes
        source, target, piece, weight = [], [], [], []
        has_one = np.zeros(n, bool)
        at, rolled = np.arange(n), np.zeros(n, np.uint64)
        for size, (known, hashes, ids, weights) in enumerate(v.of_size, 1):
            rolled = _longer(rolled, points[at + (size - 1)])
            what = known[_first_bits(rolled)]
            maybe = np.flatnonzero(what & 1)
            if len(maybe):
                place = np.minimum(np.searchsorted(hashes, rolled[maybe]), len(hashes) - 1)
                hit = hashes[place] == rolled[maybe]
                own, place = at[maybe[hit]], place[hit]
                if size == 1:
                    has_one[own] = True
                source.append(own)
                target.append(node[own] + size)
                piece.append(ids[place])
                weight.append(weights[place])
            on = np.flatnonzero((what > 1) & (to_end[at] > size))
            if not len(on):
                break
            at, rolled = at[on], rolled[on]
        rest = np.flatnonzero(~has_one)
        source.append(rest)
        target.append(node[rest] + 1)
        piece.append(-points[rest].astype(np.int64) - 1)  # a character by its bytes
        weight.append(v.byte_weight * np.select([points[rest] < 0x80, points[rest] < 0x800, points[rest] < 0x10000], [1, 2, 3], 4))
        source, target, piece, weight = map(np.concatenate, (source, target, piece, weight))
        order = np.argsort(source, kind="stable")
        distance = to_end[source[order]]
        order = order[np.argsort(distance.astype(np.uint16) if distance.max() < 1 << 16 else distance, kind="stable")]
        source, target, piece, weight = source[order], target[order], piece[order], weight[order]
        beta = np.zeros(n + len(units))
        distance = to_end[source]
        cuts = np.searchsorted(distance, np.arange(1, int(sizes.max()) + 2))
        log_p = np.empty(len(source))
        for a, b in zip(cuts[:-1], cuts[1:]):  # from the units' ends backward
            value = weight[a:b] + beta[target[a:b]]
            new = np.concatenate([[True], source[a + 1 : b] != source[a : b - 1]]) if b > a else np.zeros(0, bool)
            at = np.flatnonzero(new)
            if not len(at):
                continue
            most = np.maximum.reduceat(value, at)
            group = np.cumsum(new) - 1
            total = most + np.log(np.add.reduceat(np.exp(value - most[group]), at))
            beta[node[source[a:b][at]]] = total
            log_p[a:b] = value - total[group]
        by_node = np.argsort(node[source], kind="stable")
        source, target, piece, log_p = node[source[by_node]], target[by_node], piece[by_node], log_p[by_node]
        count = np.bincount(source, minlength=n + len(units))
        base, edges = self.nodes, self.edges
        own = np.exp(log_p)
        begin = np.cumsum(count) - count
        running = np.cumsum(own)
        inside = np.minimum(running - np.repeat((running - own)[np.minimum(begin, max(len(own) - 1, 0))], count), 1.0)
        some = count > 0
        inside[begin[some] + count[some] - 1] = 1.0
        reached = np.ceil(inside * _GUIDE).astype(np.int64)
        before = np.concatenate([[0], reached[:-1]])
        before[begin[some]] = 0
        guide = np.repeat(np.arange(edges, edges + len(own), dtype=np.int32), np.maximum(reached - before, 0))
        self._append("rank", base, np.where(some, self.guides // _GUIDE + np.cumsum(some) - 1, -1))
        self._append("guide", self.guides, guide)
        self._append("first", base + 1, edges + np.cumsum(count))
        for name, values in (("target", target + base), ("source", source + base), ("piece", piece), ("log_p", log_p), ("upto", inside)):
            self._append(name, edges, values)
        self.nodes, self.edges, self.guides = base + len(count), edges + len(own), self.guides + len(guide)
        return base + np.cumsum(sizes + 1) - (sizes + 1)

    def walk(self, node: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
        """The edges of walks from the nodes to the ends of their units, one walk after another, and where each walk ends among them."""
        steps, out = np.zeros(len(node), np.int64), []
        part = self.rank[node]
        alive = np.flatnonzero(part >= 0)
        part = part[alive]
        while len(alive):
            u = draw(alive, len(out))
            edge = self.guide[part * _GUIDE + (u * _GUIDE).astype(np.int64)].astype(np.int64)
            late = np.flatnonzero(self.upto[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[self.upto[edge[late]] <= u[late]]
            out.append((alive, edge))
            part = self.rank[self.target[edge]]
            on = part >= 0
            steps[alive[~on]] = len(out)
            alive, part = alive[on], part[on]
        ends = np.cumsum(steps)
        edges = np.empty(int(steps.sum()), np.int64)
        begin = ends - steps
        for step, (walker, edge) in enumerate(out):
            edges[begin[walker] + step] = edge
        return edges, ends


def chained(*parts, h=np.uint64(0x243F6A8885A308D3)) -> np.ndarray:
    """Hashes of integers, one part after another; h: those of parts before."""
    for p in parts:
        h = mix64(np.asarray(h ^ (np.asarray(p).astype(np.uint64) * _BASE)).reshape(-1))
    return h


def uniforms(*parts, **before) -> np.ndarray:
    """Numbers in (0, 1) from a hash of integers."""
    return ((chained(*parts, **before) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def truncated(location: np.ndarray, u: np.ndarray, most: float) -> np.ndarray:
    """Gumbel values at locations, given that they are at most `most`."""
    return -np.logaddexp(-most, np.log(-np.log(u)) - location)


class _Subset:
    """Segmentations that begin with the edges `prefix` (log probability `before`) and then take none of `closed`."""

    def __init__(self, value: float, prefix: np.ndarray, before: float, unit: int, node: int, closed: frozenset):
        self.value, self.prefix, self.before, self.unit, self.node, self.closed = value, prefix, before, unit, node, closed


def samples(lattices: Lattices, batch: list[str], keys: list[int], k: int) -> list[list[tuple]]:
    """For each text, up to k tuples (edges, log probability, Gumbel value, log inclusion)."""
    counts, numbers, units = units_of(batch)
    starts = np.split(lattices.starts(units)[numbers], np.cumsum(counts)[:-1]) if len(batch) else []
    seeds = np.array(keys, np.uint64)
    first_value = -np.log(-np.log(uniforms(seeds, 1))) if len(seeds) else []
    queues = [[_Subset(float(g), np.zeros(0, np.int64), 0.0, 0, int(s[0]), frozenset())] if len(s) else [] for g, s in zip(first_value, starts)]
    results: list[list[tuple]] = [[] for _ in batch]
    for rank in range(k):
        walking, closing = chained(seeds, 3 + rank), chained(seeds, 1000 + rank)
        opened = []
        for d, queue in enumerate(queues):
            if queue:
                queue.sort(key=lambda s: s.value)
                opened.append((d, queue.pop()))
        if not opened:
            break
        # All walks of the round at once: the rest of the opened unit, and every unit after it.
        nodes, owners, entries = [], [], []
        for d, subset in opened:
            entry = subset.node
            if subset.closed:
                choice = [e for e in range(int(lattices.first[subset.node]), int(lattices.first[subset.node + 1])) if e not in subset.closed]
                p = np.exp(lattices.log_p[choice])
                u = float(uniforms(seeds[d], 2, rank)[0])
                taken = choice[min(int(np.searchsorted(np.cumsum(p), u * p.sum(), side="right")), len(choice) - 1)]
                entry = int(lattices.target[taken])
                entries.append(taken)
            else:
                entries.append(-1)
            own = np.concatenate([[entry], starts[d][subset.unit + 1 :]])
            nodes.append(own)
            owners.append(np.full(len(own), d))
        number = np.concatenate([np.arange(len(x)) for x in nodes])  # units from the opened one on
        flat, owner = np.concatenate(nodes), np.concatenate(owners)
        walks = chained(number, h=walking[owner])
        edge, ends = lattices.walk(flat, lambda w, step: uniforms(step, h=walks[w]))
        edge_p = lattices.log_p[edge]
        last_walk, edges_before = -1, 0
        for (d, subset), taken, own in zip(opened, entries, nodes):
            last_walk += len(own)
            part = slice(edges_before, int(ends[last_walk]))
            own_ends = ends[last_walk + 1 - len(own) : last_walk + 1] - edges_before  # by walk, one for each unit
            edges_before = part.stop
            tail, log_p = edge[part], edge_p[part]
            if taken >= 0:
                tail, log_p = np.concatenate([[taken], tail]), np.concatenate([[lattices.log_p[taken]], log_p])
                own_ends = own_ends + 1
            before = subset.before + np.cumsum(log_p) - log_p
            results[d].append((np.concatenate([subset.prefix, tail]), subset.before + float(log_p.sum()), subset.value))
            if not len(tail):
                continue
            gone = subset.closed | {int(tail[0])} if subset.closed else frozenset()
            open_ = [e for e in range(int(lattices.first[subset.node]), int(lattices.first[subset.node + 1])) if e not in gone] if gone else []
            places, values = np.zeros(0, np.int64), np.zeros(0)
            at, end = 0, min(len(tail), _FIRST)
            while at < end:
                part = np.arange(at, end)
                left = -np.expm1(log_p[part])
                if at == 0 and gone:
                    left[0] = np.exp(lattices.log_p[open_]).sum() if open_ else 0.0
                node = lattices.source[tail[part]]
                left[lattices.first[node + 1] - lattices.first[node] == 1] = 0.0
                part, left = part[left > 1e-15], left[left > 1e-15]
                places = np.concatenate([places, part])
                values = np.concatenate([values, truncated(before[part] + np.log(left), uniforms(part, h=closing[d]), subset.value)])
                # A value is at most its location + _MOST_GUMBEL and locations fall along the path, so places
                # further on than this can't be among the k + 1 best.
                bound = np.partition(values, len(values) - k - 1)[-k - 1] - _MOST_GUMBEL if len(values) > k else -np.inf
                at, end = end, int(np.searchsorted(-before, -bound, side="right"))
            keep = np.argpartition(-values, k)[: k + 1] if len(values) > k + 1 else range(len(values))
            for j in keep:
                i = int(places[j])
                closed = (subset.closed if i == 0 else frozenset()) | {int(tail[i])}
                queues[d].append(_Subset(float(values[j]), np.concatenate([subset.prefix, tail[:i]]), float(before[i]), subset.unit + int(np.searchsorted(own_ends, i, side="right")), int(lattices.source[tail[i]]), closed))
    out = []
    for t, found, queue in zip(batch, results, queues):
        if not t:
            out.append([(np.zeros(0, np.int64), 0.0, 0.0, 0.0)])
            continue
        after = max((s.value for s in queue), default=-math.inf)
        out.append([(e, p, g, _log_inclusion(p - after)) for e, p, g in found])
    return out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    if x > 30:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def ids_of(lattices: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids of a path, characters without a piece as their bytes."""
    piece = lattices.piece[edges]
    rest = np.flatnonzero(piece < 0)
    if not len(rest):
        return piece
    spelt = [lattices.vocabulary.by_bytes[p] for p in piece[rest].tolist()]
    sizes = np.ones(len(piece), np.int64)
    sizes[rest] = [len(x) for x in spelt]
    out = np.repeat(piece, sizes)
    at = (np.cumsum(sizes) - sizes)[rest]
    out[np.repeat(at - np.cumsum(sizes[rest]) + sizes[rest], sizes[rest]) + np.arange(int(sizes[rest].sum()))] = list(itertools.chain.from_iterable(spelt))
    return out


_known: dict[str, Lattices] = {}


def lattices_of(path: str) -> Lattices:
    if path not in _known:
        _known[path] = Lattices(path)
    return _known[path]


def row_key(doc_id, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id), seed)


def _sampled(docs: DataFrame, model: str, k: int, seed: int, rendered, schema: str) -> DataFrame:
    def per_batch(batch):
        lattices = lattices_of(model)
        doc_ids = batch.column("doc_id").to_pylist()
        rows = []
        body = texts(batch.column("text"))
        for doc_id, text, found in zip(doc_ids, body, samples(lattices, body, [row_key(i, seed) for i in doc_ids], k)):
            rows += [(doc_id, r + 1, *rendered(ids_of(lattices, e), text), p, g, x) for r, (e, p, g, x) in enumerate(found)]
        return list(zip(*rows)) if rows else [[] for _ in schema.split(",")]

    return map_arrow(columns_of(docs, ["doc_id", "text"]), per_batch, schema)


def encode_samples(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = 0) -> DataFrame:
    """(doc_id, sample, ids, log_p, value, log_inclusion) of each document's k sampled segmentations."""
    return _sampled(docs, model, k, seed, lambda ids, text: (ids.tolist(),), "doc_id long, sample int, ids array<int>, log_p double, value double, log_inclusion double")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, sample, ids) with the text of the ids."""

    def per_batch(batch):
        vocabulary = lattices_of(model).vocabulary
        return [batch.column("doc_id"), batch.column("sample"), [vocabulary.decoded(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]]

    return map_arrow(columns_of(encoded, ["doc_id", "sample", "ids"]), per_batch, "doc_id long, sample int, text string")


def op4_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's samples: their ids as a count and a CRC-32 of little-endian 32-bit numbers, and whether they decode to its text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")

    def digest(ids: np.ndarray, text: str) -> tuple:
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), lattices_of(model).vocabulary.decoded(ids) == text.replace("▁", " ").encode()

    return _sampled(table(spark, sf_dir, "documents"), model, SAMPLES, 0, digest, "doc_id long, sample int, n_pieces long, ids_crc32 long, round_trip boolean, log_p double, value double, log_inclusion double")
