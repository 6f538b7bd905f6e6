"""Near-duplicate vectors: random hyperplanes in several tables, exact cosine, components.

Equal vectors are one node with a count.  In each table a node's bucket is its label and the
signs of its products with a few random hyperplanes; inside a bucket cosines are taken in
double precision.  A pair that meets in several tables counts in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import by_key, mixed, signed, sorted_groups, spanning, stored, table
from claimcheck.llm.components import components

COSINE = 0.93
#: Hyperplanes of a table and number of tables.  Two vectors at the threshold (21.6 degrees)
#: agree on a plane with probability 0.88, so they share a bucket of some table with 0.99.
PLANES, TABLES = 12, 20
#: Nodes of a bucket that one task compares with each other; a larger bucket is cut into
#: chunks, and each pair of chunks is a task.
CHUNK = 1024
SEED = 20240229


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _signs(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For each row and table, the signs as a number."""
    side = (unit @ planes(unit.shape[1], bits, tables) > 0).reshape(len(unit), tables, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of each length of vector in the batch."""
    column = batch.column(vector)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield own, _unit(_matrix(column.take(pa.array(own)), int(dim)))


_DEALT = "key long, bucket int, label long, node long, n long, embedding array<double>"


def _dealt(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Every node in its bucket of every table: ``key`` hashes label, length, table and signs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy().astype(np.int64).view(np.uint64)
            for own, unit in _by_dim(batch, "embedding"):
                signs = _signs(unit, bits, tables)
                for t in range(tables):
                    key = mixed(label[own], unit.shape[1], t, signs[:, t].astype(np.uint64))
                    rest = ["label", "node", "n", "embedding"]
                    columns = [batch.column(c).take(pa.array(own)) for c in rest]
                    table_no = pa.array(np.full(len(own), t, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(key)), table_no, *columns], ["key", "bucket", *rest]
                    )

    return nodes.mapInArrow(deal, _DEALT)


def _comparer(cosine: float, bits: int, tables: int):
    """For tasks of two chunks: how many rows each node links, and links that span the groups."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, begins in sorted_groups(batches, "task"):
            node, n, side, t, label = (group.column(c).to_numpy() for c in ("node", "n", "side", "bucket", "label"))
            embedding = group.column("embedding").combine_chunks()
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                if b - a < 2:
                    continue
                rows = embedding.slice(a, b - a)
                sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
                if sizes.min() != sizes.max():  # two buckets of one hash: their lengths differ
                    continue
                unit = _unit(_matrix(rows, int(sizes[0])))
                close = unit @ unit.T >= cosine
                signs = _signs(unit, bits, tables)
                for before in range(int(t[a])):
                    close &= signs[:, None, before] != signs[None, :, before]
                close &= signs[:, None, t[a]] == signs[None, :, t[a]]
                close &= label[a:b, None] == label[None, a:b]
                np.fill_diagonal(close, False)
                own = side[a:b]
                if own.any():  # two chunks: what lies inside one of them is another task's
                    close &= own[:, None] != own[None, :]
                linked = close @ n[a:b]
                some = np.flatnonzero(linked)
                if len(some):
                    pairs = np.array(spanning(close))
                    out[0] += [node[a:b][some], node[a:b][pairs[:, 0]]]
                    out[1] += [linked[some], np.zeros(len(pairs), dtype=np.int64)]
                    out[2] += [node[a:b][some], node[a:b][pairs[:, 1]]]
            if out[0]:
                columns = [pa.array(np.concatenate(c)) for c in out]
                yield pa.RecordBatch.from_arrays(columns, ["node", "linked", "other"])

    return compare


def links(
    nodes: DataFrame, cosine: float = COSINE, bits: int = PLANES, tables: int = TABLES, chunk: int = CHUNK
) -> DataFrame:
    """``node, linked, other``: parts of each node's number of links, and links that span its group.

    ``nodes`` has ``node`` (a long), ``label`` (a long), ``n`` (rows it stands for) and
    ``embedding`` (doubles, not null, finite, not zero).  No pair is written out but the
    spanning ones: a bucket gives at most two rows for each member of each task.
    """
    dealt = _dealt(nodes, bits, tables)
    sizes = dealt.groupBy("key").count().where("count > 1")
    sizes = sizes.select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    dealt = dealt.join(sizes, "key")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # A node meets all chunks: as the first side of later ones, as the second of earlier ones.
    dealt = dealt.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    task = F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with"))
    dealt = dealt.select(
        task.alias("task"), "bucket", "label", "node", "n", (F.col("own") > F.col("with")).alias("side"), "embedding"
    )
    return by_key(dealt, "task", _comparer(cosine, bits, tables), "node long, linked long, other long")


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, bits: int = PLANES, tables: int = TABLES, chunk: int = CHUNK
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors are compared only where labels are equal and not null.  A vector that is null,
    empty, zero or holds a null or non-finite component, or whose label or id is null, links
    with nothing.  Vectors of different lengths do not link.  Equal vectors of one label link
    always.  ``component_id``: the smallest vec_id reachable by links, itself included (null
    for a null id).  Rows that repeat a vec_id count each as a vector and share a component.
    Other columns are not read; an empty table gives an empty one.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & finite
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable").drop("usable")
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    nodes = stored(nodes, "vectors")
    found = stored(links(nodes, cosine, bits, tables, chunk), "links")
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    # Nodes of one vec_id (repeated with other vectors) have one number and one component.
    copies = good.join(nodes, ["label", "embedding"]).select("vec_id", "node", "n")
    edges = found.where("node != other").select("node", "other")
    edges = edges.union(copies.where("vec_id != node").select("vec_id", "node"))
    roots = components(edges)
    named = copies.join(linked, "node", "left")
    named = named.select("vec_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    lone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = named.union(lone).join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    root = F.coalesce("root", "vec_id")
    kept = F.coalesce(F.col("vec_id") == root, F.lit(False))
    return out.select("vec_id", "n_links", root.alias("component_id"), kept.alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
