"""Text sources: GPS logs, timed paths, rank lists, work lists, and their configuration."""

from __future__ import annotations

import configparser
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.matching import DEFAULTS, MatchParameters

TIME = "yyyy-MM-dd HH:mm:ss"
_NAMES = {"mean": "projectDistMean", "deviation": "projectDistStddev", "radius": "candidateQueryRadious", "limit": "candidateLimit", "beta": "beta", "window": "window"}


def _numbered_lines(spark: SparkSession, path, wholetext: bool = True) -> DataFrame:
    """(file, line, value): a log file is one row of text, so its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where("trim(value) <> ''")


def read_gps(spark: SparkSession, path) -> DataFrame:
    """(file, seq, ts, x, y) of logs with the columns _, time, _, _, x, y.

    y has to be the last column. A log ends at its first row that doesn't parse.
    """
    rows = _numbered_lines(spark, path)
    p = F.split("value", ",")
    field = lambda i: F.trim(F.get(p, F.lit(i)))
    parsed = rows.select("file", F.col("line").cast("long").alias("seq"), F.try_to_timestamp(field(1), F.lit(TIME)).alias("ts"), field(4).try_cast("double").alias("x"), field(5).try_cast("double").alias("y"), F.size(p).alias("n"))
    bad = F.sum(F.when(F.col("ts").isNull() | F.col("x").isNull() | F.col("y").isNull() | (F.col("n") != 6), 1).otherwise(0)).over(W.partitionBy("file").orderBy("seq"))
    return parsed.withColumn("_bad", bad).where("_bad = 0").select("file", "seq", "ts", "x", "y")


def with_car(logs: DataFrame) -> DataFrame:
    """Adds date, car_id and sub_id from a path .../date/car/car-sub.txt."""
    part = lambda i: F.regexp_extract("file", r"([^/]+)/([^/]+)/[^/]*?-?([^/\-.]+)\.[^/.]+$", i)
    return logs.select("*", part(1).alias("date"), part(2).alias("car_id"), part(3).alias("sub_id"))


def read_timed_path(spark: SparkSession, path) -> DataFrame:
    """(file, seq, cross_id, ts) of lines cross,time with fractions of a second."""
    p = F.split("value", ",")
    return _numbered_lines(spark, path).select("file", F.col("line").cast("long").alias("seq"), F.trim(p[0]).cast("int").alias("cross_id"), F.to_timestamp(F.trim(p[1])).alias("ts"))


def read_rank(spark: SparkSession, path) -> DataFrame:
    """(cross_id, count, entropy) of a rank list."""
    return spark.read.csv(path, schema="cross_id int, count long, entropy double")


def work_list(lines: list[str]) -> list[tuple[str, str]]:
    """(input, output) of lines that hold the two in turn; blank ones and those after a # are skipped."""
    kept = [s for s in (line.strip() for line in lines) if s and not s.startswith("#")]
    return list(zip(kept[::2], kept[1::2]))


def make_work_list(paths: list[str], prefix: str) -> list[str]:
    """Every path, followed by the prefix and its parts 3 to 5."""
    out = []
    for path in (p.strip() for p in paths):
        out += [path, prefix + "/".join(path.split("/")[3:6])]
    return out


def read_config(text: str) -> MatchParameters:
    """Parameters of section IVMM of an INI text; what is missing has its default."""
    parser = configparser.ConfigParser()
    parser.optionxform = str
    parser.read_string(text)
    section = parser["IVMM"] if parser.has_section("IVMM") else {}
    kinds = {f.name: type(getattr(DEFAULTS, f.name)) for f in fields(MatchParameters)}
    return MatchParameters(**{k: kinds[k](float(section[v])) for k, v in _NAMES.items() if v in section})


def config_text(parameters: MatchParameters = DEFAULTS) -> str:
    return "[IVMM]\n" + "".join(f"{v}={getattr(parameters, k):g}\n" for k, v in _NAMES.items())
