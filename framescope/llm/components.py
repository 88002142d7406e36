"""Connected groups of links, by joins and partial aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import stored_for_now


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node of the links; a component is named by its least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) turn the links into
    stars in a logarithmic number of rounds. The least neighbour of a node is found by a partial
    aggregation and joined back, so the neighbours of a hub are never in one task together.
    Every round is a table in the shared folder, and that of the round before is deleted. Links with a NULL end are none.
    """
    a, b = links[left], links[right]
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = edges.where(a.isNotNull() & b.isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges, path = stored_for_now(edges, "links")
    state = fingerprint(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hang(both, F.col("v") > F.col("u"))
        small = hang(large, F.lit(True))
        edges, path = stored_for_now(small.distinct(), "links", path)
        now = fingerprint(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def hang(edges: DataFrame, chosen) -> DataFrame:
    """Links from each chosen neighbour of a node, and the node, to its least neighbour."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = edges.join(least, "u").where(chosen).select(F.col("v").alias("x"), "m")
    moved = moved.unionAll(least.select(F.col("u").alias("x"), "m")).where("x != m").distinct()
    return moved.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v"))


def fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
