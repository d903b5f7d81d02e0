"""Matching logs as their files arrive: a file stream with one batch plan for each trigger."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import DEFAULTS, MatchParameters
from ..plans.pipelines import match_logs
from ..sources.sinks import status
from ..sources.text import TIME


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(traj_id, seq, ts, x, y): a file is a complete log, so there is no event time to wait for.

    A log ends at its first row that doesn't parse, as in a batch.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)

    def parsed(line: Column, seq: Column) -> Column:
        p = F.split(line, ",")
        field = lambda i: F.trim(F.get(p, F.lit(i)))
        whole = F.size(p) == 6
        return F.struct(seq.cast("long").alias("seq"), F.when(whole, F.try_to_timestamp(field(1), F.lit(TIME))).alias("ts"), field(4).try_cast("double").alias("x"), field(5).try_cast("double").alias("y"), (F.trim(line) == "").alias("blank"))

    rows = files.select(F.xxhash64(F.input_file_name()).alias("traj_id"), F.filter(F.transform(F.split("value", r"\r?\n"), parsed), lambda r: ~r["blank"]).alias("rows"))
    bad = F.array_position(F.transform("rows", lambda r: r["ts"].isNull() | r["x"].isNull() | r["y"].isNull()), True)
    good = F.when(bad > 0, F.slice("rows", F.lit(1), (bad - 1).cast("int"))).otherwise(F.col("rows"))
    return rows.select("traj_id", F.explode(good).alias("r")).select("traj_id", "r.seq", "r.ts", "r.x", "r.y")


def start_matching(stream: DataFrame, roads: DataFrame, out: str, checkpoint: str, parameters: MatchParameters = DEFAULTS):
    """Writes timed paths and status of each batch under out/batch=N; a repeated batch overwrites itself."""

    def match(batch: DataFrame, number: int) -> None:
        began = time.time()
        batch = batch.persist()
        found = match_logs(batch, roads, parameters, keep=True)
        found.timed.write.mode("overwrite").parquet(f"{out}/timed/batch={number}")
        status(batch, found.votes, seconds=round(time.time() - began, 3)).write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        found.release()
        batch.unpersist()

    return stream.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
