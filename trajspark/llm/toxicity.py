"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to plain letters and drops
zero-width characters. The lexicon holds words and word beginnings, weighted by their log odds
between toxic and other labelled documents; a phrase of two words with a lexicon word in it,
seen mostly in clean documents, is an exception that takes the word's weight back. A score is
the logistic of the matched weight, raw and normalised by length.

Labels are learnt only from rows with crc32(doc_id) mod 4 other than 2 and at most SAMPLE of
them, taken in hash order of doc_id. Without two classes there the score is the base rate (0
without labels). Null text counts as empty; an empty text has the score of no match.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, map_arrow, sliced, table, texts, tidy

#: Bound on the labelled rows that are learnt from, and so on the lexicon.
SAMPLE = 20_000
THRESHOLD = 0.3
HELD_OUT = 2
_BEGINNINGS = (3, 4, 5, 6, 7, 8)

# Characters that look like a Latin letter, and the letter.
_ALIKE = dict(zip("асеорхуіѕјкмтвнԁɡοαεικνρτυχ", "aceopxyisjkmtbhdgoaeikvptux"))
_ALIKE |= {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
_DIGITS = dict(zip("013457@$!|", "oieastasil"))
_DROPPED = "​‌‍⁠﻿­"
_SIGNS = "@$!|"
#: A sign stands for a letter only before a word character: "!" may just end a sentence.
_FOLDED = re.compile("[" + "".join(_ALIKE) + "013457" + _DROPPED + "]|[" + re.escape(_SIGNS) + r"](?=\w)")
_MAP = {**_ALIKE, **_DIGITS, **dict.fromkeys(_DROPPED, "")}
_WORD = re.compile(r"\w+")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    return _WORD.findall(_FOLDED.sub(lambda m: _MAP[m[0]], text.lower()))


def crc(doc_id):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


class Lexicon:
    """Weights of words, beginnings and exception phrases, and the logistic's coefficients."""

    def __init__(self, words: dict, beginnings: dict, exceptions: dict, coefficients: list[float]):
        self.words, self.beginnings, self.exceptions, self.coefficients = words, beginnings, exceptions, coefficients
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for w, x in self.beginnings.items():
                found.add_word(f" {w}", ("b", w, x))
            for w, x in self.words.items():
                found.add_word(f" {w} ", ("w", w, x))
            for w, x in self.exceptions.items():
                found.add_word(f" {w} ", ("x", w, x))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def features(self, text: str) -> tuple[float, float]:
        """Matched weight on a log scale, raw and per 100 words."""
        words = fold(text)
        found = self.automaton()
        if not len(found) or not words:
            return 0.0, 0.0
        # One weight for each matched word: the heaviest of its matches; an exception phrase takes it back.
        weights: dict[int, float] = {}
        back: list[tuple[int, int]] = []
        line = f" {' '.join(words)} "
        for end, (kind, w, x) in found.iter(line):
            if kind == "x":
                back.append((end - len(w) - 1, end))
            else:
                start = end - len(w) + (kind == "b") - 1
                weights[start] = max(weights.get(start, 0.0), x)
        for a, b in back:
            weights = {s: x for s, x in weights.items() if not a <= s < b}
        total = sum(weights.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / (len(words) + 20)))

    def scores(self, batch: list[str]) -> np.ndarray:
        a, b, c = self.coefficients
        x = np.array([self.features(t) for t in batch]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -30, 30)))


def _counted(rows: DataFrame) -> DataFrame:
    """(feature, toxic documents, other documents) of labelled rows."""

    def per_batch(batch):
        counts = Counter(), Counter()  # of other and of toxic documents
        for text, label in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
            words = fold(text)
            own = {f"w{w}" for w in words}
            own |= {f"b{w[:k]}" for w in set(words) for k in _BEGINNINGS if len(w) > k}
            own |= {f"x{a} {b}" for a, b in zip(words, words[1:])}
            counts[label].update(own)
        found = list(counts[0].keys() | counts[1].keys())
        return [found, [counts[1][x] for x in found], [counts[0][x] for x in found]]

    return map_arrow(rows, per_batch, "feature string, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> list[float]:
    """Newton's method on three coefficients."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from two thirds of the sampled rows, calibrated on the rest; collects only bounded rows."""
    spark = docs.sparkSession
    small_lex = lambda base: Lexicon({}, {}, {}, [float(np.log(base / (1 - base))) if 0 < base < 1 else (30.0 if base else -30.0), 0.0, 0.0])
    known = columns_of(labels, ["doc_id", "toxic"]).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(crc("doc_id") != HELD_OUT)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # at most `sample` rows
    if not chosen:
        return small_lex(0.0)
    base = sum(r.toxic for r in chosen) / len(chosen)
    if base in (0.0, 1.0):
        return small_lex(base)
    ids = spark.createDataFrame(chosen, "doc_id long, toxic int")
    rows = columns_of(docs, ["doc_id", "text"]).join(F.broadcast(ids), "doc_id")
    taught = rows.where(crc("doc_id") != 3)
    seen = {r.toxic: r["count"] for r in taught.select("toxic").groupBy("toxic").count().collect()}  # two rows; labels without a document don't count
    toxic, other = seen.get(1, 0), seen.get(0, 0)
    if not toxic or not other:
        return small_lex(base)
    t, n = F.col("t"), F.col("n")
    odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((n + 0.5) / (other - n + 0.5))
    expected = (t + n) * (toxic / (toxic + other))
    counts = _counted(taught).cache()
    least = max(2, min(5, toxic // 20))
    mine = counts.where((t >= least) & (t <= toxic) & (n <= other)).select("feature", odds.alias("weight"), "t", ((t - expected) / F.sqrt(expected + 1)).alias("z")).where("weight > 2 and z > 4")
    terms = mine.where("substr(feature, 1, 1) <> 'x'").collect()  # terms of at most `sample` rows
    words = {r.feature[1:]: r.weight for r in terms if r.feature[0] == "w"}
    # A beginning is kept only if it is in clearly more toxic documents than any one word that starts with it.
    most: Counter = Counter()
    for r in terms:
        if r.feature[0] == "w":
            for k in _BEGINNINGS:
                most[r.feature[1 : k + 1]] = max(most[r.feature[1 : k + 1]], r.t)
    begun = {r.feature[1:]: r for r in terms if r.feature[0] == "b" and r.t > 1.2 * most[r.feature[1:]]}
    # Nor if a longer one and that word are in nearly as many of them, and the longer one tells much more.
    vague = {x[:k] for x, r in begun.items() for k in range(min(_BEGINNINGS), len(x)) if x[:k] in begun and r.t + most[x[:k]] >= 0.8 * begun[x[:k]].t and r.weight > begun[x[:k]].weight + 1}
    starts = {x: r.weight for x, r in begun.items() if x not in vague}
    phrase = F.split(F.substring("feature", 2, 1_000_000), " ")
    lexical = spark.createDataFrame([(w,) for w in words], "word string")
    phrases = counts.where("substr(feature, 1, 1) = 'x'").where((n >= 3) & (n * toxic >= 3 * t * other)).select("feature", F.explode(phrase).alias("word"))
    clean = phrases.join(F.broadcast(lexical), "word", "left_semi").select("feature").distinct().collect()  # phrases of at most `sample` rows
    counts.unpersist()
    made = Lexicon(words, starts, {r.feature[1:]: 0.0 for r in clean}, [0.0, 0.0, 0.0])

    def per_batch(batch):
        x = [made.features(v) for v in texts(batch.column("text"))]
        return [[a for a, _ in x], [b for _, b in x], batch.column("toxic")]

    got = map_arrow(rows.where(crc("doc_id") == 3), per_batch, "a double, b double, y int").collect()  # at most `sample` rows
    if got and 0 < sum(r.y for r in got) < len(got):
        made.coefficients = _logistic(np.array([[r.a, r.b] for r in got]), np.array([r.y for r in got], float))
    else:
        made.coefficients = [float(np.log(base / (1 - base))) - 1.0, 1.0, 0.0]
    return made


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    def per_batch(batch):
        return [batch.column("doc_id"), lexicon.scores(texts(batch.column("text")))]

    scored = map_arrow(columns_of(docs, ["doc_id", "text"]), per_batch, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents whose score is under the threshold, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(lexicon.scores(texts(batch.column("text"))) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(tidy(run, "toxicity"), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
