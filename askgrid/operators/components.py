"""Connected components by alternating star contraction.

Each round keeps, for every node, only links to the least label seen so far
(the large-star / small-star scheme of Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014). Minima are combined before the shuffle and a
hub with very many links is split when its minimum is attached. Every round
is cut by a table in the checkpoint folder, which takes one job where a
checkpoint takes two and is read in fewer tasks; the number of rounds grows with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators.bounded import materialise
from askgrid.operators.skew import attach_by_key


def _with_minimum(links: DataFrame) -> DataFrame:
    """links (u, v) with the least neighbour of u."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return attach_by_key(links, least, ["u"], "n").drop("n")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_minimum(both).where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    downward = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_minimum(downward)
    return (starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(starred.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def _is_settled(links: DataFrame) -> bool:
    """Whether every u has one v that is no u itself; as v < u, it is then the least of its component."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("child")),
                                          F.struct(F.col("v").alias("id"), F.lit(0).alias("child")))).alias("end"))
    return (ends.groupBy("end.id").agg(F.sum("end.child").alias("parents"), F.min("end.child").alias("least"))
            .where((F.col("parents") > 1) | ((F.col("parents") > 0) & (F.col("least") == 0))).isEmpty())


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) where root is the least id of the component.

    ``nodes``: (id). ``edges``: (left, right), undirected, between nodes.
    """
    current = materialise(edges.select(F.greatest("left", "right").alias("u"),
                                       F.least("left", "right").alias("v")).where("u <> v").distinct(), "links")
    while not _is_settled(current):
        current = materialise(_small_star(materialise(_large_star(current), "links")), "links")
    roots = current.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.select("id").join(roots, "id", "left").withColumn(
        "root", F.coalesce("root", "id"))


MAX_CLUSTER_MEMBERS = 50_000_000


def cluster_ids(members: DataFrame, part_size: int = 100_000,
                max_members: int = MAX_CLUSTER_MEMBERS) -> DataFrame:
    """(root, cluster_id, member_count) from (id, root).

    The id is the first 16 hex digits of the SHA-256 of the sorted member ids
    joined by commas, for a cluster of any size. Ids are joined by ranges of
    ``part_size`` first, so only the text of the ids meets in one row. A
    cluster of more than ``max_members``, whose text would outgrow a row, is an
    error.
    """
    parts = (members.groupBy("root", F.floor(F.col("id") / part_size).alias("part"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")),
                                           lambda value: value.cast("string")), ",").alias("ids"),
                  F.count(F.lit(1)).alias("n")))
    by_root = parts.groupBy("root").agg(
        F.sum("n").alias("member_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))),
                                 lambda item: item["ids"]), ",").alias("all"))
    key = F.when(F.col("member_count") > max_members, F.raise_error(F.lit("A cluster has too many members"))) \
        .otherwise(F.sha2("all", 256))
    return by_root.select("root", F.concat(F.lit("rc-"), F.substring(key, 1, 16)).alias("cluster_id"),
                          "member_count")
