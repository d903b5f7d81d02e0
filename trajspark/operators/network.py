"""Road networks: crosses and roads from records, directed edges, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import length


def crosses_of(records: DataFrame) -> DataFrame:
    """(cross_id, key, x, y) of the ends of records (record, front_key, back_key, front, back).

    Ids count from 0 in order of first sight, the front of a record before its back. A map's crosses
    are numbered together; a map is a static table, far smaller than what is matched on it.
    """
    front = records.select((2 * F.col("record")).alias("seen"), F.col("front_key").alias("key"), F.col("front").alias("p"))
    back = records.select((2 * F.col("record") + 1).alias("seen"), F.col("back_key").alias("key"), F.col("back").alias("p"))
    first = front.unionByName(back).groupBy("key").agg(F.min(F.struct("seen", "p")).alias("first"))
    return first.select((F.row_number().over(W.orderBy("first.seen")) - 1).alias("cross_id"), "key", F.col("first.p.x").alias("x"), F.col("first.p.y").alias("y"))


def load_network(records: DataFrame, identity, attributes) -> tuple[DataFrame, DataFrame]:
    """(crosses, roads) of line records (record, geom, f0, f1, ...) under a cross identity and attributes."""
    keyed = attributes(identity(records))
    crosses = crosses_of(keyed)
    a = crosses.select(F.col("key").alias("front_key"), F.col("cross_id").alias("start_cross"))
    b = crosses.select(F.col("key").alias("back_key"), F.col("cross_id").alias("end_cross"))
    roads = keyed.join(a, "front_key").join(b, "back_key").withColumn("road_id", F.col("record").cast("int")).withColumn("geo_length", length("geom"))
    return crosses, roads.drop("front_key", "back_key", "front", "back", "record")


def directed_edges(roads: DataFrame) -> DataFrame:
    """(src, dst, road_id, weight): an edge for each direction that a road allows."""
    forward = roads.where(F.col("direction").bitwiseAND(1) != 0).select(F.col("start_cross").alias("src"), F.col("end_cross").alias("dst"), "road_id", F.col("geo_length").alias("weight"))
    backward = roads.where(F.col("direction").bitwiseAND(2) != 0).select(F.col("end_cross").alias("src"), F.col("start_cross").alias("dst"), "road_id", F.col("geo_length").alias("weight"))
    return forward.unionByName(backward)


def successors(edges: DataFrame, crosses: DataFrame) -> DataFrame:
    """(cross_id, road_id, next_cross) of the given crosses."""
    return edges.join(crosses.select(F.col("cross_id").alias("src")), "src").select(F.col("src").alias("cross_id"), "road_id", F.col("dst").alias("next_cross"))


def predecessors(edges: DataFrame, crosses: DataFrame) -> DataFrame:
    """(cross_id, road_id, previous_cross) of the given crosses."""
    return edges.join(crosses.select(F.col("cross_id").alias("dst")), "dst").select(F.col("dst").alias("cross_id"), "road_id", F.col("src").alias("previous_cross"))


def find_road_oneway(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, road_id) of pairs (src, dst): the first road, in load order, from one to the other; -1 if none."""
    roads = edges.groupBy("src", "dst").agg(F.min("road_id").alias("road_id"))
    return pairs.join(roads, ["src", "dst"], "left").select("src", "dst", F.coalesce("road_id", F.lit(-1)).alias("road_id"))


def find_road_any(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Like find_road_oneway, else the road back."""
    roads = edges.groupBy("src", "dst").agg(F.min("road_id").alias("road_id"))
    back = roads.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("road_id").alias("road_back"))
    return pairs.join(roads, ["src", "dst"], "left").join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce("road_id", "road_back", F.lit(-1)).alias("road_id"))


def contained(items: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Those of ids that items hold under the key; ids without a match go."""
    return ids.join(items.select(key).distinct(), key, "left_semi")


def property_index(items: DataFrame, prop: str, ident: str) -> DataFrame:
    """(prop, ident): the last item in load order that has each value."""
    return items.where(F.col(prop).isNotNull()).groupBy(prop).agg(F.max(ident).alias(ident))


def lookup(items: DataFrame, prop: str, ident: str, values: DataFrame) -> DataFrame:
    """Items by a property's value; a value that none has is an error where the result is made."""
    found = values.join(property_index(items, prop, ident), prop, "left")
    known = found.withColumn(ident, F.when(F.col(ident).isNull(), F.raise_error(F.concat(F.lit(f"no {prop} "), F.col(prop).cast("string")))).otherwise(F.col(ident)))
    return known.join(items.drop(prop), ident)


def road_of_edges(edges: DataFrame, roads: DataFrame) -> DataFrame:
    return edges.join(roads, "road_id")


def sizes(crosses: DataFrame, roads: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (cross_size, road_size, edge_size)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(crosses, "cross_size").join(count(roads, "road_size"), F.lit(True)).join(count(edges, "edge_size"), F.lit(True))


def with_edge_property(edges: DataFrame, roads: DataFrame, name: str, value=None) -> DataFrame:
    """Edges with a road's property under its name, or a computed one from an expression over both."""
    joined = edges.join(roads.drop("direction"), "road_id")
    return joined.select(*edges.columns, (F.expr(value) if value else F.col(name)).alias(name))
