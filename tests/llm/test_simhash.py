import hashlib
import random

import numpy as np

from trajspark.llm import simhash

from .util import ODD, documents


def edited(rows):
    """Brute force: rows in descending (id, none last), ties by text, each with the next one's start."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in order]
    return [(i, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + texts[(n + 1) % len(texts)][: len(t) // 3]).encode()).hexdigest(), texts[(n + 1) % len(texts)]) for n, (i, t) in enumerate(zip([i for i, _ in order], texts))]


def check(spark, rows):
    got = simhash.edit_likeness(documents(spark, rows)).collect()
    want = edited(rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(i), n, h) for i, n, h, _ in want)
    return got


def test_odd_rows(spark):
    got = check(spark, ODD)
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_one_and_none(spark):
    assert check(spark, [(1, "only one")])[0].near_next == 1.0
    assert check(spark, []) == []


def test_many_ranges(spark):
    random.seed(1)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = [(i * 7 % 1001, " ".join(random.choices(words, k=random.randint(1, 200)))) for i in range(500)]
    got = check(spark, rows)
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.15


def test_fingerprint_is_the_vote():
    """Against a plain count over terms."""
    text = "The quick brown fox, the lazy dog " * 3
    words = text.lower().split()
    h = [simhash._hashes[w] for w in words]
    terms = [(x, 256) for x in h] + [(int(simhash.mix64(np.array([a], np.uint64) * np.uint64(3) + np.uint64(b))[0]), 512) for a, b in zip(h, h[1:])]
    terms += [(simhash.xxhash.xxh64_intdigest(text[i : i + 4], 1), 256 - len(text)) for i in range(len(text) - 3)]
    votes = np.zeros(simhash.BITS)
    for x, w in terms:
        bits = np.concatenate([np.unpackbits(simhash.mix64(np.array([np.uint64(x) ^ s], np.uint64)).view(np.uint8)) for s in simhash._SALTS])
        votes += w * (2.0 * bits - 1)
    got = np.unpackbits(simhash.fingerprints([text])[0])
    assert ((votes > 0) == got)[votes != 0].all()


def test_block_tables_find_all(spark):
    random.seed(2)
    base = [random.getrandbits(simhash.BITS) for _ in range(40)]
    prints = set()
    for b in base:
        prints.add(b)
        for r in (1, 3, 7, 8, 12):
            x = b
            for bit in random.sample(range(simhash.BITS), r):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    hexes = [f"{p:0{simhash.BITS // 4}x}" for p in prints]
    df = spark.createDataFrame([(h,) for h in hexes] + [(None,), (hexes[0],)], "fingerprint string")
    got = {(r["query"], r["match"]): r["distance"] for r in simhash.near_fingerprints(df, df).collect()}
    want = {(hexes[i], hexes[j]): (a ^ b).bit_count() for i, a in enumerate(prints) for j, b in enumerate(prints) if i != j and (a ^ b).bit_count() <= simhash.RADIUS}
    assert got == want and want


def test_simhash_column(spark):
    got = simhash.simhash(documents(spark, ODD), out="f2").collect()
    assert len(got) == len(ODD) and {r.f2 for r in got if not r.text} == {"0" * (simhash.BITS // 4)}


def test_op1_searches_all_documents(spark, tmp_path):
    words = [f"word{i}" for i in range(3000)]
    near = list(words)
    near[1500] = "changed"
    rows = [(100, " ".join(words)), (2, " ".join(near)), (300, "something else altogether"), (400, "copied text"), (5, "copied text"), (600, None), (None, "no id")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in simhash.op1_simhash(spark, str(tmp_path)).collect()}
    marks = {i: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8) for i, r in got.items()}
    assert all(got[i].n_near is None and got[i].nearest is None for i in (2, 5, None))
    for i, r in ((i, r) for i, r in got.items() if i in (100, 300, 400, 600)):
        others = {o.fingerprint: int(np.bitwise_count(marks[i] ^ marks[j]).sum()) for j, o in got.items() if j != i}
        within = {p: d for p, d in others.items() if d <= simhash.RADIUS}
        assert r.n_near == len([p for p in within if p != r.fingerprint]) and r.nearest == min(within.values(), default=None)
    assert got[100].n_near == 1 and got[400].nearest == 0 and got[300].nearest is None


def test_likeness_is_steady_as_a_text_grows():
    """4-grams fade out: a few more characters change no more at one length than at another."""
    random.seed(5)
    text = " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(60))
    near = [float(simhash.likeness(*(simhash.fingerprints([text[:n]]) for n in (n, n + 4)))[0]) for n in range(200, 300, 4)]
    assert min(near) > 0.85


def test_near_edited_and_near_next_by_brute_force(spark):
    rows = [(i, f"{w} " * 40) for i, w in enumerate(("alpha beta", "gamma delta", "alpha beta", "eps zeta eta"))]
    got = {r.doc_id: r for r in simhash.edit_likeness(documents(spark, rows)).collect()}
    texts = dict(rows)
    bits = lambda t: np.unpackbits(simhash.fingerprints([t])[0])
    for i, t in rows:
        after = texts[(i - 1) % 4]
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i].near_edited == (bits(t) == bits(changed)).mean() and got[i].near_next == (bits(t) == bits(after)).mean()
