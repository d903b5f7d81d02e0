import pyarrow as pa

from trajspark.llm import common, minhash, packing, secrets, simhash, suffixes  # noqa: F401
from trajspark.llm.common import map_arrow


def test_a_worker_lets_go_of_what_other_operators_kept(spark):
    """Within one worker: hashes of words are there for the next task of minhash, and gone after one of another operator."""

    def fill(batch):
        minhash._hashes["word"] = 1
        return [pa.array([len(minhash._hashes)] * batch.num_rows)]

    def look(batch):
        return [pa.array([len(minhash._hashes)] * batch.num_rows)]

    seen = []
    one = spark.range(1, numPartitions=1)
    for module, kernel in (("minhash", fill), ("minhash", look), ("toxicity", look)):
        kernel.__module__ = f"trajspark.llm.{module}"
        run = common.tidy(lambda batches, kernel=kernel: (pa.RecordBatch.from_arrays(kernel(b), ["n"]) for b in batches), module)
        seen += [c for b in run(iter([pa.RecordBatch.from_pydict({"id": [0]})])) for c in b.column("n").to_pylist()]
    assert seen[0] == seen[1] > 0 and seen[2] == 0
    assert map_arrow(one, look, "n long").count() == 1


def test_all_that_is_kept_is_named():
    assert {"minhash", "simhash", "suffixes", "packing", "secrets"} <= set(common._kept)
    secrets.guess_bits("hunter2hunter2")
    common.let_go("minhash")
    assert not packing._known and not secrets.guess_bits.cache_info().currsize
