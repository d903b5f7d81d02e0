import random
import re

from trajspark.llm import paragraphs

from .util import ODD, documents


def make(n, seed):
    random.seed(seed)
    return [f"w{random.randrange(10**6)}" for _ in range(n)]


def rows():
    passage = make(60, 1)
    near = list(passage)
    near[30] = "changed"
    far = passage[:30] + make(30, 2)
    line = lambda w: " ".join(w)
    return [(1, f"intro\n{line(passage)}\nend"), (2, f"{line(make(40, 3))}\n{line(near)}"), (3, line(far)), (4, f"{line(passage)}\n{line(passage)}"), (5, line(make(80, 4))), (6, "short line here\nshort line here"), (None, line(passage)), (7, None), (8, "")]


def brute(rows_):
    items = []
    for d, t in rows_:
        if d is not None and t:
            for a, b in paragraphs.cut(t):
                w = t[a:b].lower().split()
                items.append((d, a, b, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    items.sort(key=lambda x: x[:2])
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(items):
        for j, y in enumerate(items[:i]):
            if 100 * len(x[3] & y[3]) >= 80 * len(x[3] | y[3]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    sizes = [find(i) for i in range(len(items))]
    return sorted((*x[:3], *items[find(i)][:2], find(i) != i) for i, x in enumerate(items) if sizes.count(find(i)) > 1)


def check(spark, rows_):
    got = paragraphs.repeated_paragraphs(documents(spark, rows_)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows_)


def test_against_brute_force(spark):
    check(spark, rows())


def test_odd_rows_and_empty(spark):
    check(spark, ODD)
    check(spark, [])


def test_text_without_repeats(spark):
    docs = documents(spark, rows())
    got = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect()}
    texts = dict(rows())
    assert got[1] == texts[1] and got[5] == texts[5] and got[7] is None
    assert got[4] == "" and got[2].count("\n") == 1 and "changed" not in got[2]


def test_every_repeated_passage_meets_a_row(spark):
    """Lines, passages across lines of other lengths and inside longer lines; the brute force knows neither lines nor pieces."""
    shared = make(60, 11)
    licence, greeting = " ".join(make(16, 12)), " ".join(make(15, 18))
    inside = " ".join(make(50, 13) + shared + make(50, 14))
    broken = "\n".join(" ".join(shared[i : i + 4]) for i in range(0, 60, 4))
    given = [(1, f"{greeting}\n{inside}"), (2, broken), (3, f"{' '.join(make(9, 15))}\n{licence}"), (4, f"{licence}\n{' '.join(make(30, 16))}"), (5, f"{greeting}\n{' '.join(make(300, 17))}")]
    found = paragraphs.repeats(documents(spark, given)).collect()
    windows = {}
    for d, t in given:
        words = [(m.group().lower(), *m.span()) for m in re.finditer(r"\S+", t)]
        for n in (16, 50):
            for i in range(len(words) - n + 1):
                windows.setdefault(tuple(w for w, _, _ in words[i : i + n]), []).append((d, words[i][1], words[i + n - 1][2]))
    again = [(len(k), p) for k, v in windows.items() if len({d for d, _, _ in v}) > 1 for p in v if len(k) == 50 or p[0] in (3, 4)]
    assert {p[0] for _, p in again} == {1, 2, 3, 4}
    for _, (d, a, b) in again:
        assert any(r.doc_id == d and r.start < b and a < r.end for r in found)
    assert all(r.doc_id != 5 for r in found)
    kept = {r.doc_id: r.text for r in paragraphs.without_repeats(documents(spark, given)).collect()}
    assert kept[1] == given[0][1] and len(kept[2].split()) < 30 and licence in kept[3] and licence not in kept[4]


def test_bands_reach_the_recall():
    n = paragraphs.bands_for(paragraphs.RECALL)
    assert 1 - (1 - 0.64) ** n >= paragraphs.RECALL > 1 - (1 - 0.64) ** (n - 1)


def test_pieces_by_place_and_group():
    """Equal passages have equal pieces wherever they stand, in texts that are cut together or alone."""
    shared = make(50, 31)
    texts = [" ".join(make(20, 32) + shared + make(30, 33)), "", "é " * 5, "\n".join(make(3, 34) + shared), " ".join(shared).upper()]
    together = paragraphs.pieces(texts)
    for i, t in enumerate(texts):
        alone, own = paragraphs.pieces([t]), together[together["owner"] == i]
        assert (alone["hash"] == own["hash"]).all() and (alone["start"] == own["start"]).all() and (alone["to"] == own["to"]).all()
        for p in alone:
            assert t[p["start"] : p["end"]].split() == t.split()[p["from"] : p["to"]]
    common = [set(together["hash"][together["owner"] == i].tolist()) for i in (0, 3, 4)]
    assert len(common[0] & common[1] & common[2]) >= 2


def test_passage_of_a_hot_group(spark):
    """One passage in most documents, between different neighbours: every one is told, but the first is kept."""
    shared = make(60, 41)
    given = [(i, " ".join(make(30, 100 + i) + shared + make(30, 900 + i))) for i in range(120)]
    got = paragraphs.repeated_passages(documents(spark, given).repartition(7)).collect()
    assert {r.doc_id for r in got} == set(range(120)) and {r.doc_id for r in got if r.removed} == set(range(1, 120))
    for r in got:  # near its ends a piece may depend on the neighbours, and then be first elsewhere
        assert given[r.doc_id][1][r.start : r.end] == given[r.cluster_doc_id][1][r.cluster_start :][: r.end - r.start]
    assert all(sum(len(given[i][1][r.start : r.end].split()) for r in got if r.doc_id == i and r.removed) >= 25 for i in range(1, 120))
