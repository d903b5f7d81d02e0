import random
import string
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trajspark.llm import packing

from .util import ODD, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(spark, rows):
    got = packing.pack(documents(spark, rows), PATH).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted((str(i), np.array(plain.encode(t or "", add_special_tokens=False).ids + [packing.END], "<u4").tobytes()) for i, t in rows)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW and (at == packing.WINDOW or at & (at - 1) == 0)
    # Every document's pieces tile one of the documents of its id.
    left = list(want)
    tiles = {}
    for r in got:
        tiles.setdefault(str(r.doc_id), []).append(r)
    for i, pieces in tiles.items():
        own = [w for w in left if w[0] == i]
        assert sum(r.length for r in pieces) == sum(len(w[1]) // 4 for w in own)
        for r in pieces:
            assert any(r.doc_tokens == len(w[1]) // 4 and zlib.crc32(w[1][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for w in own)
    assert set(tiles) == {i for i, _ in want}


def test_odd_rows(spark):
    check(spark, ODD)


def test_empty(spark):
    check(spark, [])


def test_long_documents(spark):
    check(spark, [(i, f"word{i} and more words about topic {i % 5} " * (10 + 137 * i)) for i in range(12)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("abAB12 .,'!\n\t\x1c\x85\xa0éÉΣσςİß²½中<|>") + ["<|endoftext|>", "don't", "I'LL", "́", "Å", "ﬁ"]), max_size=30).map("".join), max_size=6))
def test_ids_equal_the_tokenizers(batch):
    known = packing.ids_of(PATH)
    assert [np.frombuffer(x, np.uint16).tolist() for x in known.of(batch)] == [known.tokenizer.encode(t, add_special_tokens=False).ids for t in batch]


def test_bm25_ranks_like_a_plain_sum():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, rng.integers(1, 80)).astype(np.uint16) for _ in range(30)]
    index = packing.Index(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in set(d.tolist()) for d in docs) for t in range(60)}
    for seed in (0, 7):
        scores = []
        for d in docs:
            x = d.tolist()
            s = 0.0
            for t in set(docs[seed].tolist()):
                idf = max(0.0, np.log((n - df[t] + 0.5) / (df[t] + 0.5)))
                tf = x.count(t)
                s += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
            scores.append(s)
        assert np.allclose(np.array(scores)[index.neighbours(seed)], np.sort(scores)[::-1])


def test_neighbours_share_a_window():
    rng = np.random.default_rng(2)
    topics = [np.concatenate([rng.integers(100 * t, 100 * t + 30, 900)]).astype(np.uint16) for t in [0, 1, 2, 3] * 4]
    order = packing.arranged(topics)
    assert sorted(order) == list(range(16))
    assert len({i % 4 for i in order[:4]}) == 1


def test_shards_are_cut_by_content_under_the_statistics_of_all(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 25)
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(4000)]
    originals = [" ".join(rng.choice(vocabulary, 120)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(originals)] + [(1000 + i, t + " tail") for i, t in enumerate(originals)]
    got = packing.pack(documents(spark, rows), PATH).collect()
    shard = {r.doc_id: r.sequence_id >> packing.SEQUENCE_BITS for r in got}
    assert set(shard) == {i for i, _ in rows} and len(set(shard.values())) > 6
    assert sum(shard[i] == shard[1000 + i] for i in range(150)) > 130  # 12 by chance
    coded = spark.createDataFrame([(bytes(np.array(d, np.uint16)),) for d in ([1, 1, 2], [2, 3], [2])], "ids binary").repartition(3)
    n, mean, df = packing.statistics(coded)
    assert (n, mean) == (3, 2.0) and df[:5].tolist() == [0, 1, 3, 1, 0]


def test_marks_after_a_word_cost_no_call():
    """Words with runs of marks after them are encoded with the others; what is no word with marks goes alone."""
    ids, plain = packing.Ids(PATH), Tokenizer.from_file(PATH)
    calls, encoded = [], ids.encoded
    ids.encoded = lambda text: calls.append(text) or encoded(text)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgHIJßéжλ") for _ in range(rng.randint(1, 9)))
    batch = [" ".join(word() + rng.choice(["", "!!", "%%%", "...", "'", "\"'"]) for _ in range(200)) for _ in range(10)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in batch]
    assert [np.frombuffer(x, np.uint16).tolist() for x in ids.of(batch)] == want
    assert len(calls) < 10
    odd = ["ΟΔΟΣ ΟΔΟΣ. Σ", "it's i'll' l'll x's's", "a1!! 12.5% é! é", "İ İ! ı", "<|endoftext|> a<|endoftext|>! <|endoftext|", "a b! a b\x85c \x1c\x1d!", "ﬁ! ǅ? 가! 가!", "≠ a≠", "", "\n \t", *(f"Ab{m} {m} {m}{m}Ab{m}b{m}" for m in string.punctuation)]
    assert [np.frombuffer(x, np.uint16).tolist() for x in ids.of(odd)] == [plain.encode(t, add_special_tokens=False).ids for t in odd]
