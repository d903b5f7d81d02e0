import hashlib
import random

import numpy as np
import pytest

from trajspark.llm import suffixes

from .util import ODD, documents


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for i, t in order:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - suffixes.LENGTH + 1):
            w = data[s : s + suffixes.LENGTH]
            if w in seen:
                gone[s : s + suffixes.LENGTH] = b"\1" * suffixes.LENGTH
            seen.add(w)
        spans = len([p for p in bytes(gone).split(b"\0") if p])
        out.append((str(i), len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out)


def check(spark, rows):
    got = suffixes.removal_digest(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def corpus(seed):
    random.seed(seed)
    make = lambda n: "".join(random.choices("abcdé \n", k=n))
    shared = [make(n) for n in (90, 99, 100, 101, 150, 400, 3000)]
    rows = []
    for i in range(80):
        parts = [make(random.randint(0, 300)) for _ in range(3)] + random.choices(shared, k=random.randint(0, 3))
        random.shuffle(parts)
        rows.append((i * 5 + 2, "".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 80, 9)] + [(2000, "ab" * 400), (2001, "z" * 1000), (2002, "z" * 99)]
    random.shuffle(rows)
    return rows


def test_odd_rows(spark):
    check(spark, [r for r in ODD if r[0] != 7])  # rows of one id have no order of their own


def test_empty(spark):
    check(spark, [])


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_very_long_text(spark):
    random.seed(9)
    text = "".join(random.choices("abcdefghijklmnopqrstuvwxyz ", k=2_500_000))
    check(spark, [(1, text), (2, text[1_000_000:1_000_400]), (3, text[-250:] + text[:120])])


@pytest.mark.parametrize("chunk", [1 << 20, 777])
def test_anchors_cover_every_string_once(monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    random.seed(2)
    docs = [bytes(random.choices(b"abc", k=n)) for n in (5000, 99, 100, 0, 101, 1500)]
    sizes = np.array([len(d) for d in docs], np.int64)
    data = np.frombuffer(b"".join(docs), np.uint8)
    hashes, place, first, last, look = suffixes.anchors(data, sizes)
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    ends = np.cumsum(sizes)
    assert starts == [s for e, n in zip(ends, sizes) for s in range(e - n, e - suffixes.LENGTH + 1)]
    by_string = {}
    raw = data.tobytes()
    for h, p, a, b in zip(hashes, place, first, last):
        for s in range(a, b + 1):
            assert by_string.setdefault(raw[s : s + suffixes.LENGTH], (h, p - s)) == (h, p - s)


def test_suffix_sort_orders_like_bytes():
    random.seed(3)
    data = np.frombuffer(bytes(random.choices(b"ab", k=3000)) + b"a" * 400, np.uint8)
    starts = np.array(random.sample(range(len(data) - suffixes.LENGTH), 900))
    bucket = np.array([random.randrange(7) for _ in starts])
    order = suffixes.suffix_sort(suffixes.Prefixes(data), starts, bucket)
    raw = data.tobytes()
    key = lambda i: (bucket[i], raw[starts[i] : starts[i] + suffixes.LENGTH])
    assert [key(i) for i in order] == sorted(key(i) for i in range(len(starts)))


def test_collision_is_verified(monkeypatch):
    """With hashes that all collide, classes still come from the bytes."""
    data = np.frombuffer(b"a" * 300 + b"b" * 300, np.uint8)
    prefixes = suffixes.Prefixes(data)
    monkeypatch.setattr(prefixes, "same", lambda x, y, n: np.ones(len(x), bool))
    got = suffixes.equal_classes(prefixes, np.array([0, 10, 300, 320]), np.zeros(4, np.int64))
    assert got[0] == got[1] != got[2] == got[3]


def test_without_repeats(spark):
    shared = "".join(f"é{i}" for i in range(40)) + "passage that is repeated word for word in two documents, one after the other here"
    docs = documents(spark, [(1, shared + " one"), (2, "two " + shared), (3, None), (4, "")])
    got = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert suffixes.without_repeats(docs).columns == docs.columns
    assert got[1].text == shared + " one" and got[2].text == "two " and got[3].text is None and got[4].text == ""
    assert got[2].n_chars == 4 and got[2].lang == "en"
