"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import is_empty, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of the component) for every node that has an edge.

    ``edges`` has two long columns, nodes; direction, loops and repeats do not matter, an edge
    with a null end is no edge.  Each round moves neighbours to the smallest node seen; the
    table stops changing when every node points at its root.  A node with very many edges is
    only ever a join key whose partner has one row, so adaptive execution can split it.  Each
    round is written to the shared folder; only a count and checksums come to the driver.
    """
    a, b = edges.columns
    edges = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges = stored(edges, "edges")
    if not is_empty(edges):
        mark = _mark(edges)
        while True:
            edges = stored(_small(_large(edges)).distinct(), "stars")
            mark, before = _mark(edges), mark
            if mark == before:
                break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select("v", "v").distinct())
