"""Connected components of a link table that is larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import dropped, written


def connected_components(links: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """``(node, component)`` for every linked node; the component is its smallest node.

    Rounds of large and small stars: every node links its larger neighbours, then itself and its
    smaller ones, to the smallest node it knows. When nothing changes, each node is linked to its
    component and to nothing else. Goes on until then, for about log(nodes) rounds, none with more
    links than at the start. A round reads and writes tables in the shared folder, so that no lineage grows, keeps
    the newest only, and nothing but a count and a checksum comes to the driver. The smallest neighbour is
    aggregated before the shuffle, and joined between two plain tables, which Spark splits
    where a node has very many links. Links with NULL and of a node to itself do nothing.
    """
    pairs = links.select(F.col(source).alias("u"), F.col(target).alias("v"))
    ordered = pairs.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = written(ordered.distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u"))
        small = _star(large, F.lit(True))
        after = _state(small)
        dropped(edges, large)
        edges = small
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _star(edges: DataFrame, moved: F.Column) -> DataFrame:
    """Link the moved neighbours of every node, or the node and all of them, to the smallest."""
    smallest = written(
        edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-smallest"
    )
    joined = edges.where(moved).join(smallest, "u")
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    stars = written(
        linked.unionByName(own).where(F.col("u") != F.col("v")).distinct(), "links"
    )
    dropped(smallest)
    return stars


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
