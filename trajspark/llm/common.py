"""What the operators of this subpackage share: tables, shared storage and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a kernel works on at a time; texts reach 100 KB, so few rows bound memory, whatever the session's Arrow batches are.
BATCH_ROWS = 256


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of its own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context_dir.isDefined():
            found = context_dir.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='trajspark-')}"
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_dir(spark)}/trajspark-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """df with the rows of part p of `column` (0 to n - 1) in a partition of their own.

    Hashing p itself would put several parts in one partition and none in others, so p is replaced by a
    number whose hash leads to partition p; there are n of them.
    """
    spark = df.sparkSession
    found = spark.range(40 * n + 40).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    keys = {r.p: r.id for r in found}
    array = F.array(*[F.lit(keys.get(p, p)).cast("long") for p in range(n)])
    return df.withColumn("_to", F.element_at(array, (F.col(column) + 1).cast("int"))).repartition(n, "_to").drop("_to")


def texts(column: pa.Array) -> list[str]:
    """Values as str, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


#: How to let go of what operators keep in a worker from task to task.
_kept: dict[str, Callable[[], object]] = {}


def kept(operator: str, clear: Callable[[], object]) -> None:
    _kept[operator] = clear


def let_go(operator: str) -> None:
    """Lets go of what other operators than this one keep in this worker."""
    for name, clear in _kept.items():
        if name != operator:
            clear()


def give_back() -> None:
    """Free memory of this worker, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run, operator: str):
    """A kernel that begins without what other operators kept, and gives back free memory when it ends.

    Workers are used again from stage to stage, and while they wait they count against their executor's memory.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def map_arrow(df: DataFrame, per_batch, schema: str) -> DataFrame:
    """mapInArrow of a function of one batch that returns columns in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield record(out, per_batch(batch))

    return df.mapInArrow(tidy(run, per_batch.__module__.rpartition(".")[2]), schema)


def chunked(items: Iterable, n: int) -> Iterator[list]:
    part: list = []
    for x in items:
        part.append(x)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Base of prefix polynomial hashes mod 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n; the first 2 ** 21 are kept."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        x = np.multiply.accumulate(x)
        if n > 1 << 21:
            return x
        _powers[base] = x
    return _powers[base][:n]


def columns_of(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, can't clash later."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
