"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (id, component): the smallest id that is reachable, for every id in a link but those smallest ones.

    Each round hooks every id to its smallest neighbour, follows these parents to their roots by pointer jumping, and
    goes on with the links between different roots. All tables are written, so joins read both sides from scans and
    Spark can split a root that many ids point to. Null ids and links of an id with itself link nothing."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    links = stage(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        parents = stage(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent")), "parents")
        while True:
            up = parents.select(F.col("id").alias("up_id"), F.col("parent").alias("up"))
            jumped = parents.join(up, F.col("parent") == F.col("up_id"), "left").select("id", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved"))
            jumped = stage(jumped, "parents")
            parents = jumped.select("id", "parent")
            if jumped.where("moved").isEmpty():
                break
        at = parents.select(F.col("id").alias("at"), F.col("parent").alias("root"))
        if labels is None:
            labels = parents.withColumnRenamed("parent", "component")
        else:
            moved = labels.join(at, F.col("component") == F.col("at"), "left").select("id", F.coalesce("root", "component").alias("component"))
            labels = stage(moved.unionByName(parents.withColumnRenamed("parent", "component")), "labels")
        half = stage(links.join(at, F.col("a") == F.col("at"), "left").select(F.coalesce("root", "a").alias("a"), "b"), "links")
        both = half.join(at, F.col("b") == F.col("at"), "left").select("a", F.coalesce("root", "b").alias("b")).where("a <> b")
        links = stage(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component"))
