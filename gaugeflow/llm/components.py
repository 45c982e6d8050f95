"""Connected components of a link table: forests inside tasks, alternating stars between them.

A task replaces its links by a spanning forest in which every node points at the smallest one
of its tree, which leaves fewer links than nodes.  If more than one task is needed, rounds
of large and small stars follow until every node points at the smallest one it can reach;
their number grows with the logarithm of the longest path.  Steps between tasks are grouped
minima and equi-joins, each round is checkpointed, and the driver learns only how many links
there are and whether another round is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import Columns, batchwise, compacted, materialized

# Links that a task puts into one forest.
FOREST_LINKS = 250_000


def _grown(batches: Iterator[Columns]) -> Iterator[Columns]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    for start in range(0, len(nodes), 1 << 16):
        part = nodes[start : start + (1 << 16)]
        yield {"a": part, "b": [root(x) for x in part]}


def _forests(edges: DataFrame, tasks: int) -> DataFrame:
    """Every node of a task's links with the smallest it reaches by them."""
    return edges.coalesce(tasks).transform(batchwise(_grown, "a long, b long"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point at its smallest neighbour (or itself)."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point at the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node."""
    edges = materialized(edges.where("a != b").select("a", "b"))
    while True:
        tasks = edges.count() // FOREST_LINKS + 1
        forest = _forests(edges, tasks)
        if tasks == 1:
            edges = compacted(forest)
            break
        edges = materialized(_small_star(_large_star(forest)).where("a != b").distinct())
        if _are_stars(edges):
            break
    return (
        edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(edges.select("b", "b").distinct())
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger node has one link, to a node that has none to a smaller one."""
    twice = edges.groupBy("a").count().where("count > 1").select("a")
    inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
    return twice.union(inner).isEmpty()


def joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b), which are first put between components."""
    part = {x: named.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}")) for x in "ab"}
    between = (
        links.join(part["a"], "a", "left")
        .join(part["b"], "b", "left")
        .select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b"))
    )
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = named.join(merged, "component", "left").select(
        "node", F.coalesce("least", "component").alias("component")
    )
    fresh = merged.toDF("node", "component").join(named.select("node"), "node", "left_anti")
    return compacted(moved.union(fresh))
