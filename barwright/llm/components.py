"""Connected components of a table of links, by hooking and pointer jumping.

Each node takes its lowest neighbour as parent, if that is lower than itself.
Parents of parents are followed until every node points to the root of its
tree; then the links are taken between roots, and what is left of them goes
through the same again.  At least half of the linked nodes lose their place
as a root each time, so some log(n) rounds do.  No table is collected: rounds
are written to the shared folder, and only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _roots(parents: DataFrame, max_rounds: int = 60) -> DataFrame:
    """parents: node, component (lower than node).  Follows them to their roots."""
    for _ in range(max_rounds):
        up = parents.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        after = parents.join(up, "component", "left").select("node", F.coalesce("_next", "component").alias("component"), F.col("_next").isNotNull().alias("_moved"))
        after = cut(after, "parents")
        parents = after.select("node", "component")
        if after.where("_moved").isEmpty():
            return parents
    raise RuntimeError("roots did not settle")


def _relabel(links: DataFrame, labels: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    for end in ends:
        to = labels.select(F.col("node").alias(end), F.col("component").alias("_to"))
        links = links.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return links


def _lower_first(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: long columns u, v.  Returns node, component (lowest node reachable) for all linked nodes; roots included."""
    edges = cut(_lower_first(links.where("u IS NOT NULL AND v IS NOT NULL")), "links")
    labels = None
    for _ in range(max_rounds):
        found = _roots(edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"))
        if labels is None:
            labels = found
        else:
            # Roots of the rounds before now belong to lower ones.
            moved = _relabel(labels, found, ("component",))
            labels = cut(moved.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")
        edges = cut(_lower_first(_relabel(edges, found, ("u", "v"))), "links")
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots)


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels with further links between the nodes; only pairs of different components go through the rounds."""
    between = components(_lower_first(_relabel(links, labels, ("u", "v"))))
    merged = _relabel(labels, between, ("component",))
    return cut(merged.unionByName(between.join(labels.select("node"), "node", "left_anti")), "labels")
