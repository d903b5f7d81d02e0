"""Secret scans: base patterns, and values in a credential context that would cost many guesses.

Base kinds are `assign`, `access` and `hex`: leftmost non-overlapping matches, those too short
dropped after matching. The kind `guess` is the value of a wider credential context that no base
span covers and whose cheapest segmentation into dictionary words, dates, repeats, keyboard walks
and brute-force characters costs GUESS_BITS or more. A brute-force character costs its alphabet: the
character classes (lower, upper, digits, marks) that the value uses. The dictionary is a short list of
words people choose and, after them, the letter pieces of a public tokenizer's vocabulary by rank. Spans are in code points, end exclusive.
Null text counts as empty and has no spans; rows are scored one by one, so repeats change nothing.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import columns_of, kept, map_arrow, table, texts

KINDS = ("assign", "access", "hex", "guess")
GUESS_BITS = 36.0
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of hex digits of 16 or more is the same as a run of any length kept if 16 or longer.
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|(?:api|access|private)_?key|credentials?|auth)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
#: One of these is in any text where _CONTEXT or _ASSIGN matches.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

# Words people choose, most common first.
_COMMON = "password admin welcome letmein monkey dragon master login hello secret love sun summer winter spring autumn princess shadow qwerty football baseball soccer hunter batman superman killer pepper ginger cookie cheese coffee orange banana purple yellow silver golden diamond flower tiger lion eagle wolf horse summer london paris berlin madrid america freedom liberty family mother father sister brother john david michael daniel robert thomas maria anna test user guest root server change default temp pass word key token home house computer internet office company money lucky magic star moon light night day monday friday sunday january march april may june july august october november december".split()
_RANK = {w: i + 1 for i, w in reversed(list(enumerate(_COMMON)))}
_LEET = str.maketrans("013457@$!", "oleastasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


def _adjacent() -> dict[str, set[str]]:
    """Neighbours on a slanted keyboard, plus alphabetical and numerical successors."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for c, key in enumerate(row):
            for other, at in ((r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c)):
                if 0 <= other < len(_ROWS) and 0 <= at < len(_ROWS[other]):
                    near.setdefault(key, set()).add(_ROWS[other][at])
    for a, b in zip("abcdefghijklmnopqrstuvwxy", "bcdefghijklmnopqrstuvwxyz"):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


_NEAR = _adjacent()
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d|(?:19|20)\d\d)")
_DATE_LONGEST = 10


@lru_cache(1)
def _pieces() -> dict[str, int]:
    """Ranks of lower-case pieces of three letters or more, after the words of _RANK."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = dict(_RANK)
    for piece, i in sorted(vocabulary.items(), key=lambda x: x[1]):
        word = re.sub("^(?:##|\u0120|\u2581)|</w>$", "", piece).lower()
        if len(word) >= 3 and word.isalpha():
            ranks.setdefault(word, len(_RANK) + 1 + i)
    return ranks


_PIECE_LONGEST = 20


def _classes(value: str) -> int:
    """Size of the alphabet of the character classes that a value uses."""
    plain = [c for c in value if c.isascii()]
    return 26 * any(c.islower() for c in plain) + 26 * any(c.isupper() for c in plain) + 10 * any(c.isdigit() for c in plain) + 33 * any(not c.isalnum() for c in plain)


def _brute(ch: str, alphabet: int = 95) -> float:
    return math.log2(alphabet if ch.isascii() else alphabet + 100)


def _case_bits(raw: str) -> float:
    """Bits of which letters of a word are capitals: none for lower case, one for a capital first or all."""
    return 0.0 if raw == raw.lower() else 1.0 if raw in (raw.upper(), raw.capitalize()) else float(len(raw))


#: A run (keyboard walk, repeated character or unit) that is longer is a segment only as a whole.
_RUN_LONGEST = 64
_UNIT_LONGEST = 16


@lru_cache(20_000)
def guess_bits(value: str, enough: float = math.inf) -> float:
    """log2 of the guesses of the cheapest segmentation, by dynamic programming over end positions.

    A segment is a character by brute force, a dictionary word, a date, or a run: a keyboard walk of three or
    more, a character two or more times, a unit of up to _UNIT_LONGEST characters back to back. Runs up to
    _RUN_LONGEST may begin anywhere, longer ones where they do. Time is linear in the value's length. The result
    is exact below `enough`; where no cheaper way is left, the search stops and gives `enough`.
    """
    alphabet, ranks = _classes(value), _pieces()
    shortest = 3 if value.isalpha() else 4  # three letters of a random value are a piece too often
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    brute = [_brute(c, alphabet) for c in value]
    upto = [0.0]
    for b in brute:
        upto.append(upto[-1] + b)
    best = [0.0] + [math.inf] * n
    walk = same = 1
    alike = [0] * (_UNIT_LONGEST + 1)  # how many characters up to here equal those a unit before
    last_open = 0  # the last place that costs less than enough
    for end in range(1, n + 1):
        i = end - 1
        walk = walk + 1 if i and low[i] in _NEAR.get(low[i - 1], ()) else 1
        same = same + 1 if i and value[i] == value[i - 1] else 1
        cost = best[i] + brute[i]
        for start in range(max(0, end - _PIECE_LONGEST), end - 2):
            if best[start] < cost:
                rank = _RANK.get(plain[start:end]) or (ranks.get(plain[start:end]) if end - start >= shortest else None)
                if rank:
                    cost = min(cost, best[start] + math.log2(rank + 1) + 1 + _case_bits(value[start:end]) + (low[start:end] != plain[start:end]) * 2)
        if value[i].isdigit():
            for start in range(max(0, end - _DATE_LONGEST), end - 3):
                if best[start] < cost and _DATE.fullmatch(value, start, end):
                    cost = min(cost, best[start] + math.log2(366 * (1 if end - start == 4 else 120)))
        longest = 0
        if walk >= 3:
            longest = walk
            for length in range(3, walk + 1) if walk <= _RUN_LONGEST else (walk,):
                cost = min(cost, best[end - length] + math.log2(47 * length) + 0.5 * (length - 1))
        if same >= 2:
            longest = max(longest, same)
            for length in range(2, same + 1) if same <= _RUN_LONGEST else (same,):
                cost = min(cost, best[end - length] + brute[i] + math.log2(length))
        for unit in range(2, min(end - 1, _UNIT_LONGEST) + 1):
            alike[unit] = alike[unit] + 1 if value[i] == value[i - unit] else 0
            most = alike[unit] // unit + 1
            if most > 1:
                longest = max(longest, alike[unit] + unit)
                block = upto[end] - upto[end - unit]
                for times in range(2, most + 1) if most * unit <= _RUN_LONGEST else (most,):
                    cost = min(cost, best[end - unit * times] + block + math.log2(times + 1))
        best[end] = cost
        if cost < enough:
            last_open = end
        elif end - last_open > _RUN_LONGEST and end - longest > last_open:  # no segment to come begins where it is cheap
            return enough
    return min(best[n], enough)


kept("secrets", lambda: (_pieces.cache_clear(), guess_bits.cache_clear()))


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added), each a list of (start, kind, end) in order."""
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if hinted else []
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    added = []
    for m in _CONTEXT.finditer(text) if hinted else ():
        start, end = m.span(1)
        if not any(a < end and start < b for a, _, b in base) and guess_bits(m[1], GUESS_BITS) >= GUESS_BITS:
            added.append((start, 3, end))
    return base, added


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, and all spans."""
    def per_batch(batch):
        rows = [spans(t) for t in texts(batch.column("text"))]
        count = lambda k: [sum(x[1] == k for x in base) for base, _ in rows]
        return [batch.column("doc_id"), count(0), count(1), count(2), [hashlib.sha256(told(b).encode()).hexdigest() for b, _ in rows], [told(b + a) for b, a in rows]]

    return map_arrow(columns_of(docs, ["doc_id", "text"]), per_batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with each secret (of an assignment, its value alone) replaced by its kind in angle brackets."""
    base, added = spans(text)
    out, at = [], 0
    for start, kind, end in sorted(base + added):
        if kind == 0:
            start = _ASSIGN.match(text, start).start(2)
        if end <= at:
            continue
        start = max(start, at)
        out += [text[at:start], f"<{KINDS[kind]}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in `text` replaced and `n_chars` recounted; no row goes."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda t: t if t is None else redacted(t))

    return docs.withColumn("text", clean("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
