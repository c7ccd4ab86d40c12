"""Connected components of an edge table by repeated contraction onto the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component: the smallest node reachable. See components_at."""
    return components_at(edges, a, b)[0]


def components_at(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, list[str]]:
    """((node, component) of every node of an edge, paths that it reads); component: the smallest node reachable.

    In each round every node takes the smallest of itself and its neighbours as its parent (aggregated before the
    shuffle, so a node with very many edges is no task of its own), and edges are replaced by those between parents.
    A round at least halves the nodes that still have edges, so there are few. Only counts reach the driver.
    """
    spark = edges.sparkSession
    now, at = common.write_table(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    parents, paths = [], [at]
    while not now.isEmpty():
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent, at = common.write_table(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("parent")), "parents")
        parents.append(parent)
        paths.append(at)
        ends = lambda c, n: parent.select(F.col("node").alias(c), F.col("parent").alias(n))  # noqa: E731, B023
        up = now.join(ends("a", "pa"), "a").join(ends("b", "pb"), "b").where("pa != pb")
        chain = parent.where("node != parent").join(parent.select(F.col("node").alias("parent"), F.col("parent").alias("top")), "parent").where("parent != top").select(F.col("parent").alias("pa"), F.col("top").alias("pb"))
        now, at = common.write_table(up.select("pa", "pb").union(chain).select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        paths.append(at)
    if not parents:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component")), paths
    out = parents[0].select("node", F.col("parent").alias("component"))
    for p in parents[1:]:
        step = p.select(F.col("node").alias("component"), F.col("parent").alias("next"))
        out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    out, out_at = common.write_table(out, "components")
    common.delete(spark, *paths)
    return out, [out_at]
