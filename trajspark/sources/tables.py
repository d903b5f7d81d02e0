"""Tables of a trajectory database, in any format or over JDBC; and the high-level map they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import parse_pattern
from ..operators.network import load_network
from .pickers import by_cross_id, virtual_edge_attributes
from .shapefile import read_shapefile

TABLES = ("traj_metadata", "traj_data", "virtual_edge_type", "virtual_edge_metadata", "virtual_edge_data", "cross")


def read_table(spark: SparkSession, name: str, base: str | None = None, fmt: str = "parquet", **jdbc: str) -> DataFrame:
    """A table from a folder, or from a database where url, user and password are given."""
    if name not in TABLES:
        raise ValueError(name)
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.format(fmt).load(f"{base}/{name}.{fmt}")


def edges_of_type(metadata: DataFrame, type_id: int) -> DataFrame:
    """(id, start, end, pattern) of the virtual edges of a type."""
    return metadata.where(F.col("type") == type_id).select("id", "start", "end", "pattern")


def timed_path(data: DataFrame, metadata_id: int) -> DataFrame:
    """(seq, cross_id, ts) of a trajectory, in the order of seq."""
    return data.where(F.col("traj_id") == metadata_id).select("seq", "cross_id", "ts").orderBy("seq")


def load_high_level_map(spark: SparkSession, layer: str, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hot crosses, edges (edge, src, dst, count, bands)) of a virtual-edge layer and its patterns."""
    crosses, roads = load_network(read_shapefile(spark, layer), by_cross_id, virtual_edge_attributes)
    pattern = metadata.select(F.col("id").alias("metadata_id"), "pattern")
    names = crosses.select("cross_id", F.col("key").alias("original"), "x", "y")
    a, b = names.select(F.col("cross_id").alias("start_cross"), F.col("original").alias("src")), names.select(F.col("cross_id").alias("end_cross"), F.col("original").alias("dst"))
    edges = roads.join(pattern, "metadata_id").join(a, "start_cross").join(b, "end_cross")
    hot = names.select(F.col("original").alias("cross_id"), "x", "y")
    return hot, edges.select(F.col("road_id").alias("edge"), "src", "dst", "count", parse_pattern(F.col("pattern")).alias("bands"))
