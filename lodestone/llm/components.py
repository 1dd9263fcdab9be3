"""Connected components of a table of links, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(links: DataFrame, downwards: bool) -> DataFrame:
    """Links each node's neighbours to the least of them (and itself): the larger neighbours, or the smaller ones and the node.

    The least is pre-aggregated, stored and joined back, so that the join can split
    the links of a node that has very many.
    """
    if not downwards:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least")
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    least = staged(links.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    moved = links.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def component_labels(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): for every node with a link (columns u, v) the least node of its component.

    Large-star and small-star steps in turn; each round is written to the shared
    folder, and the number of rounds grows with the logarithm of a component's
    diameter. Self links and repeated links change nothing.
    """
    links = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), name)
    while not _is_forest_of_stars(links):
        links = staged(_stars(staged(_stars(links, False), name), True), name)
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label")))


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether each node has one link downwards at most, and what it links to has none."""
    several = links.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
    chained = links.select(F.col("v").alias("u")).distinct().join(links, "u", "left_semi")
    return not several.select("u").union(chained).limit(1).count()
