"""Road attributes and cross identities read from attribute tables, by position of the field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORWARD, BACKWARD, BOTH = 1, 2, 3
#: km/h by path class.
CLASS_KMH = {4: 70.0, 3: 50.0, 2: 40.0}
OTHER_KMH = 30.0


def class_speed(column: str) -> Column:
    """Metres per second of a path class."""
    out = F.lit(OTHER_KMH)
    for k, v in CLASS_KMH.items():
        out = F.when(F.col(column).cast("int") == k, v).otherwise(out)
    return out / 3.6


def road_direction(column: str) -> Column:
    """Direction bits of a direction code: 2 forward, 3 backward, any other both."""
    code = F.col(column).cast("string").try_cast("int")
    return F.when(code == 2, FORWARD).when(code == 3, BACKWARD).otherwise(BOTH)


def plain(records: DataFrame) -> DataFrame:
    """No attributes, two-way."""
    return records.withColumn("direction", F.lit(BOTH))


def road_attributes(records: DataFrame) -> DataFrame:
    """sid, direction and speed of a road layer (fields f2, f6, f20)."""
    return records.withColumn("sid", F.col("f2")).withColumn("direction", road_direction("f6")).withColumn("speed", class_speed("f20"))


def virtual_edge_attributes(records: DataFrame) -> DataFrame:
    """metadata_id and count of a virtual-edge layer (fields f2, f3), one-way."""
    return records.withColumn("metadata_id", F.col("f2").cast("int")).withColumn("count", F.col("f3").cast("int")).withColumn("direction", F.lit(FORWARD))


def _end(point: str) -> Column:
    """The key of a record's end by exact coordinates."""
    return F.struct(F.col(f"{point}.x").alias("x"), F.col(f"{point}.y").alias("y"))


def by_geometry(records: DataFrame) -> DataFrame:
    """Ends are one cross if their coordinates are equal."""
    return records.withColumn("front", F.element_at("geom", 1)).withColumn("back", F.element_at("geom", -1)).withColumn("front_key", _end("front")).withColumn("back_key", _end("back"))


def by_sid(records: DataFrame) -> DataFrame:
    """Ends are one cross if the text fields f18 and f19 say so."""
    return by_geometry(records).withColumn("front_key", F.col("f18").cast("string")).withColumn("back_key", F.col("f19").cast("string"))


def by_cross_id(records: DataFrame) -> DataFrame:
    """Ends are one cross if the integer fields f0 and f1 say so."""
    return by_geometry(records).withColumn("front_key", F.col("f0").cast("int")).withColumn("back_key", F.col("f1").cast("int"))
