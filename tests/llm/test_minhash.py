import random
import re

import numpy as np
import pytest

from trajspark.llm import graph, minhash

from .util import ODD, documents

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, k):
    sets = []
    for _, t in rows:
        w = _WORD.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if d is not None else None)) for i, (d, _) in enumerate(rows))


def corpus(n, seed):
    random.seed(seed)
    words = ["".join(random.choices("abcdefghij", k=4)) for _ in range(2000)]
    rows = []
    for g in range(n):
        base = random.choices(words, k=random.randint(1, 120))
        for _ in range(random.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(copy) // 25))):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    random.shuffle(rows)
    return rows


def check(spark, rows, k=4):
    got = minhash.near_groups(documents(spark, rows), k=k).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    check(spark, ODD)


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize("nodes,cells,edges", [(1500, 1_500_000, 250_000), (5, 400, 10)])
def test_against_brute_force(spark, monkeypatch, nodes, cells, edges):
    """With the production bounds, and with bounds so small that large clusters and many parts occur."""
    monkeypatch.setattr(minhash, "GROUP_NODES", nodes)
    monkeypatch.setattr(minhash, "GROUP_CELLS", cells)
    monkeypatch.setattr(graph, "TASK_EDGES", edges)
    check(spark, corpus(60, 3))


def test_case_and_white_space(spark):
    check(spark, [(1, "A b\x0bC D e"), (2, "a B c\x0cd\re"), (3, "É x y z w"), (4, "é x y z w"), (5, "a\xa0b c d e")])


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = minhash.mix64(np.arange(1000, dtype=np.uint64))
    a, b = np.sort(pool[:800]), np.sort(pool[200:])
    s = minhash.signatures([a, b], 128)
    estimate = (s[0] == s[1]).mean()
    assert abs(estimate - 0.6) < 0.08
    del rng


def test_linked_is_exact():
    random.seed(4)
    sets = [np.unique(np.array(random.sample(range(60), random.randint(1, 50)), np.uint64)) for _ in range(40)]
    got = minhash.linked(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (100 * len(x & y) >= 80 * len(x | y))
    assert (minhash.linked(sets[:15], sets[15:]) == got[:15, 15:]).all()


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 30)
    random.seed(5)
    edges = [(i, i + 1) for i in range(100, 180)] + [(random.randrange(80), random.randrange(80)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_without_near_copies(spark):
    docs = documents(spark, ODD)
    got = minhash.without_near_copies(docs)
    assert got.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in got.select("doc_id").collect())
    assert ids == sorted(str(i) for i, _ in ODD if i != 2)
