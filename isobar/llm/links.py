"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import written


def distinct_links(a, b, links: DataFrame) -> DataFrame:
    return written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct())


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of nodes (id): the smallest id reachable over links (a, b).

    Each round every node hooks on to its smallest neighbour, chains of hooks are shortened by doubling to their ends, and links
    are drawn anew between the ends. Links inside a group vanish that way, and every end but the smallest of a neighbourhood
    loses its place, so links and nodes shrink round by round. Nodes of many links are pre-aggregated in the tasks.
    """
    edges = distinct_links(F.col("a"), F.col("b"), links)
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("up")))
        while True:
            above = hooks.select(F.col("id").alias("up"), F.col("up").alias("up2"))
            hooks = written(hooks.join(above, "up").select("id", F.col("up2").alias("up"), (F.col("up") != F.col("up2")).alias("moved")))
            if hooks.filter("moved").isEmpty():
                break
        ends = hooks.select("id", "up")
        later = ends.select(F.col("id").alias("component"), F.col("up").alias("further"))
        labels = ends.withColumnRenamed("up", "component") if labels is None else written(
            labels.join(later, "component", "left").select("id", F.coalesce("further", "component").alias("component")))
        a, b = (ends.select(F.col("id").alias(c), F.col("up").alias(f"end_{c}")) for c in "ab")
        edges = distinct_links(F.col("end_a"), F.col("end_b"), edges.join(a, "a").join(b, "b"))
    if labels is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
