"""Groups from edges, and their members in order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.components import connected_components, cut


def members(items: DataFrame, edges: DataFrame, key="id", order=None) -> DataFrame:
    """Rows key, group_id, member_idx of groups of two or more.

    A component's first member in `order` (default: the key) names it; groups are numbered
    from 0 in the order of their first members.
    """
    order = order if order is not None else F.col(key)
    comps = connected_components(edges)
    rows = items.join(comps, items[key] == comps["node"]).select(items["*"], "component").withColumn("_order", order)
    firsts = rows.groupBy("component").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    numbered = number(firsts.select("component", "_first"), "_first", "group_id")
    rows = rows.join(numbered.select("component", "group_id"), "component").withColumn("_within", F.struct("_order", key))
    return ranked(rows, "component", "_within", "member_idx").drop("component", "_order", "_within")


def number(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 (long) by a unique `order` column, without one task for all
    rows.

    Rows are range-partitioned, sorted and settled with their place in their partition; the
    partitions' sizes (one number each) become the offsets.
    """
    spark = df.sparkSession
    # partition number above bit 33, place below
    parts = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).cast("int")
    sizes, offset, rows = sorted((r["_p"], r["count"]) for r in parts.groupBy(part.alias("_p")).count().collect()), 0, []
    for p, n in sizes:
        rows.append((p, offset))
        offset += n
    offsets = spark.createDataFrame(rows, "_p int, _offset long")
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_offset")
    return parts.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, place).drop("_p", "_offset", "_m")


def ranked(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 inside each group by an `order` that is unique there; a group
    that holds much of the input is spread over tasks like the rest."""
    all_ = number(df.withColumn("_k", F.struct(group, order)), "_k", "_at").drop("_k")
    first = all_.groupBy(F.col(group).alias("_g")).agg(F.min("_at").alias("_first"))
    return all_.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_g", "_first")


def surviving(member_rows: DataFrame, analysed: DataFrame, key="id", group="group_id") -> DataFrame:
    """Members that have an analysis, in groups that keep two or more."""
    kept = member_rows.join(analysed, key)
    large = kept.groupBy(group).agg(F.count("*").alias("_n")).filter("_n >= 2").select(group)
    return kept.join(large, group, "left_semi")


def renumbered(member_rows: DataFrame, group="group_id", member="member_idx") -> DataFrame:
    """Groups and members numbered without gaps, in the order they have."""
    dense = number(member_rows.select(group).distinct(), group, "_g")
    rows = member_rows.join(dense, group).withColumn(group, F.col("_g")).drop("_g").withColumnRenamed(member, "_old")
    return ranked(rows, group, "_old", member).drop("_old")
