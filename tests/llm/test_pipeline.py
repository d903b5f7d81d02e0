import random

import public_tokenizers

import corpus_pipeline
from trajspark.llm import common, packing, secrets, suffixes, toxicity

from .test_others import labelled
from .util import documents


def corpus(spark, folder):
    """Labelled documents with near copies, a passage that repeats and secrets, as a folder of tables."""
    rows, labels = labelled(spark, seed=3, n=160)
    random.seed(4)
    passage = " ".join(f"p{random.randrange(10**6)}" for _ in range(60))
    rows = [(i, t + f" unique{i} " + " ".join(f"u{i}x{j}" for j in range(40))) for i, t in rows]
    rows += [(1000 + i, rows[i][1].replace("word1", "wordone", 1)) for i in range(1, 40, 5)]
    rows += [(2000 + i, f"start{i} {passage} end{i} password=b7db7aa4a5fcc78305{i}") for i in range(5)] + [(3000, ""), (3001, None)]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return dict(rows)


def test_stages_take_effect(spark, tmp_path):
    rows = corpus(spark, f"{tmp_path}")
    docs, kept = common.table(spark, str(tmp_path), "documents"), dict(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            lexicon = toxicity.learn(common.table(spark, str(tmp_path), "documents"), common.table(spark, str(tmp_path), "labels"))
            kept = {i: t for i, t in kept.items() if lexicon.scores([t or ""])[0] < toxicity.THRESHOLD}
        elif name == "minhash":
            from .test_minhash import brute

            kept = {int(i): kept[int(i)] for i, _, c in brute(list(kept.items()), 5) if i == c}
        elif name == "suffix_array":
            seen, cut = set(), {}
            for i in sorted(kept):
                data = (kept[i] or "").encode()
                gone = bytearray(len(data))
                for s in range(len(data) - suffixes.LENGTH + 1):
                    w = data[s : s + suffixes.LENGTH]
                    if w in seen:
                        gone[s : s + suffixes.LENGTH] = b"\1" * suffixes.LENGTH
                    seen.add(w)
                cut[i] = None if kept[i] is None else bytes(c for c, g in zip(data, gone) if not g).decode("utf-8", "ignore")
            kept = cut
        else:
            kept = {i: None if t is None else secrets.redacted(t) for i, t in kept.items()}
        assert got == kept, name
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = packing.ids_of(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in pieces) == sum(len(x) // 2 + 1 for x in ids.of([t or "" for t in kept.values()]))
    assert {r.doc_id for r in pieces} == set(kept)
