"""Approximate top-k by signed hyperplanes, with the recall it is asked for.

Each table deals vectors into buckets by the signs of their products with a few random planes.
The number of planes follows the size of a source, so that buckets hold a bounded mean however
large the index grows; the number of tables follows from the planes, so that a hit of
similarity ``similar`` shares a bucket of some table with probability ``recall``.  Whatever
meets in a bucket is compared exactly: a hit's score is the same as in the exact join, only
hits can be missing.

A vector travels once for each table.  The tables are gone through a few at a time, so what is on
disk at once is a few copies of the vectors, however many tables there are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck.operators.retrieval import HIT_COLUMNS, SCORE_DIGITS, block_topk
from claimcheck.session import materialize

SEED = 20240517


@dataclass(frozen=True)
class LshLimits:
    """What recall to reach and how much a task may hold."""

    recall: float = 0.95
    #: Mean rows of a bucket, and rows of each side that a task compares at once.
    bucket_rows: int = 64
    block_rows: int = 4096
    #: Planes at most; beyond them buckets grow, and are cut into blocks, instead of being lost.
    max_bits: int = 24
    #: Tables whose copies of the vectors are on disk at once.
    copies: int = 8


def bits_for(rows: int, limits: LshLimits = LshLimits()) -> int:
    """Planes of a table: buckets of a source of so many rows hold ``bucket_rows`` on average."""
    return max(1, min(limits.max_bits, math.ceil(math.log2(max(rows, 1) / limits.bucket_rows)) if rows > limits.bucket_rows else 1))


def tables_for(bits: int, similar: float, limits: LshLimits = LshLimits()) -> int:
    """Tables so that a pair of that cosine meets in one of them with the wanted probability."""
    agree = (1 - math.acos(max(-1.0, min(1.0, similar))) / math.pi) ** bits
    if agree >= 1:
        return 1
    return max(1, math.ceil(math.log(1 - limits.recall) / math.log1p(-agree)))


@functools.lru_cache(maxsize=64)
def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Planes of a vector length: the same numbers on every worker, whatever it did before."""
    return np.random.default_rng([SEED, dim]).standard_normal((tables, bits, dim)).reshape(tables * bits, dim)


def bucket_keys(vectors: np.ndarray, bits: int, tables: int, some: range | None = None) -> np.ndarray:
    """A row for each vector and a column for each table, or for some of them: the signs as one number."""
    some = range(tables) if some is None else some
    planes = _planes(vectors.shape[1], bits, tables)[some.start * bits : some.stop * bits]
    side = vectors @ planes.T > 0
    return side.reshape(len(vectors), len(some), bits) @ (1 << np.arange(bits, dtype=np.int64))


def _dealt(rows: DataFrame, plan: dict[str, tuple[int, int]], first: int, last: int, only: bool = False) -> DataFrame:
    """Each row once for every table from ``first`` up to ``last``: ``table`` and ``bucket``.

    ``plan``: planes and tables by source.  ``only`` gives the names of the buckets without the rows.
    """
    kept = ["source", "dim"] if only else rows.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("source").to_numpy(zero_copy_only=False)
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for name, (bits, tables) in plan.items():
                some = range(first, min(last, tables))
                for dim in np.unique(sizes[source == name]) if some else ():
                    own = np.flatnonzero((source == name) & (sizes == dim))
                    part = batch.take(pa.array(own))
                    flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    keys = bucket_keys(flat.reshape(len(own), int(dim)), bits, tables, some)
                    columns = [part.column(x) for x in kept]
                    for i, t in enumerate(some):
                        extra = [pa.array(np.full(len(own), t, np.int32)), pa.array(keys[:, i])]
                        yield pa.RecordBatch.from_arrays([*columns, *extra], [*kept, "table", "bucket"])

    extra = [T.StructField("table", T.IntegerType()), T.StructField("bucket", T.LongType())]
    return rows.mapInArrow(deal, T.StructType([*(rows.schema[x] for x in kept), *extra]))


_CELL = ["source", "dim", "table", "bucket"]


def _cells(q: DataFrame, p: DataFrame) -> DataFrame:
    """Buckets with how many queries and passages they hold."""
    one = q.groupBy(*_CELL).agg(F.count("*").alias("n_query"))
    both = one.join(p.groupBy(*_CELL).agg(F.count("*").alias("n_index")), _CELL, "full")
    return both.na.fill(0, ["n_query", "n_index"])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of one value of ``key`` each, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _compared(rows: DataFrame, k: int, threshold: float | None, n_keys: int, schema: T.StructType) -> DataFrame:
    def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        vectors = table.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        keys = [np.stack([table.column(f"_k{i}_{x}").to_numpy() for x in "ab"], axis=1) for i in range(n_keys)]
        return flat, table.column("id").to_numpy(), keys

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs((b for b in batches if b.num_rows), "task"):
            asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            q, q_ids, q_keys = parts(group.filter(pa.array(asks)))
            p, p_ids, p_keys = parts(group.filter(pa.array(~asks)))
            rows, ids, scores, rank = block_topk(q, p, p_ids, k, threshold, q_keys, p_keys)
            columns = [q_ids[rows], np.full(len(rows), group.column("source")[0].as_py(), dtype=object), ids, scores]
            arrays = [pa.array(columns[0]), pa.array(columns[1], pa.string()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rank.astype(np.int32))], list(HIT_COLUMNS))

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(compare, schema)


class LshJoin:
    """A top-k search prepared for one index size: its plan, its work and its hits.

    ``queries`` has ``qid, source, qvec`` (long ids), ``index`` has ``source, passage_id,
    embedding``; ``exclude`` names (query column, index column) pairs that must differ in every
    hit.  A vector that is null, empty or holds a null has no bucket and no hit; vectors of
    different lengths are never compared.  Zero vectors share a bucket and score 0.
    Only the number of passages of each source comes to the driver; ``sources`` bounds it.
    """

    def __init__(
        self,
        queries: DataFrame,
        index: DataFrame,
        *,
        sources: Sequence[str],
        k: int = 5,
        threshold: float | None = 0.55,
        similar: float | None = None,
        exclude: Sequence[tuple[str, str]] = (),
        limits: LshLimits = LshLimits(),
    ):
        self.k, self.threshold, self.n_keys, self.limits = k, threshold, len(exclude), limits
        similar = (0.55 if threshold is None else threshold) if similar is None else similar
        names = list(dict.fromkeys(sources))
        whole = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) & F.forall(c, lambda x: x.isNotNull())
        queries = queries.where(F.col("source").isin(names) & whole("qvec"))
        index = index.where(F.col("source").isin(names) & whole("embedding"))
        sizes = {r["source"]: r["count"] for r in index.groupBy("source").count().collect()}
        self.plan = {s: (b := bits_for(n, limits), tables_for(b, similar, limits)) for s, n in sizes.items()}

        def side(rows: DataFrame, ident: str, vector: str, keys: list[str], asks: bool) -> DataFrame:
            hashed = [
                F.xxhash64(*lead, F.col(c)).alias(f"_k{i}_{x}")
                for i, c in enumerate(keys)
                for x, lead in (("a", []), ("b", [F.lit("second")]))
            ]
            rows = rows.select(
                F.col(ident).cast("long").alias("id"), "source", F.col(vector).cast("array<double>").alias("vector"),
                F.size(vector).alias("dim"), F.lit(asks).alias("asks"), *hashed,
            )
            return rows

        self.q = side(queries, "qid", "qvec", [a for a, _ in exclude], True)
        self.p = side(index, "passage_id", "embedding", [b for _, b in exclude], False)

    def _cells(self) -> DataFrame:
        return _cells(*(_dealt(rows, self.plan, 0, self._tables(), only=True) for rows in (self.q, self.p)))

    def _tables(self) -> int:
        return max((tables for _, tables in self.plan.values()), default=0)

    def work(self) -> DataFrame:
        """``source, pairs``: how many pairs the tables bring together, a pair once for each table."""
        met = self._cells().where("n_query > 0 AND n_index > 0")
        return met.groupBy("source").agg(F.sum(F.col("n_query") * F.col("n_index")).alias("pairs"))

    def hits(self) -> DataFrame:
        """``qid, source, passage_id, score, rank`` as the exact join gives them, some may be missing.

        A bucket is cut into blocks of bounded size on both sides, and every pair of blocks is
        one task, so equal or very similar vectors that fill a bucket are no task of their own.
        """
        limit = self.limits.block_rows
        # A cell that is cut holds more than a block, so there are few of them; the others need no look.
        cut = self._cells().where((F.col("n_query") > limit) | (F.col("n_index") > limit))
        blocks = lambda n: F.ceil(F.col(n) / limit).cast("int").alias(n)
        cut = materialize(cut.select(*_CELL, blocks("n_query"), blocks("n_index")), "cut-cells")
        step, tables = self.limits.copies, self._tables()
        found = [self._found(cut, first, first + step) for first in range(0, max(tables, 1), step)]
        if len(found) > 1:
            found = [materialize(self._best(x), "lsh-hits") for x in found]
        return self._best(functools.reduce(DataFrame.union, found))

    def _found(self, cut: DataFrame, first: int, last: int) -> DataFrame:
        """Hits of the tables from ``first`` up to ``last``, the best of each task."""
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        def placed(rows: DataFrame) -> DataFrame:
            rows = _dealt(rows, self.plan, first, last).join(F.broadcast(cut), _CELL, "left")
            return rows.na.fill(1, ["n_query", "n_index"]).where("n_query > 0 AND n_index > 0")

        q = placed(self.q).withColumn("chunk", own("n_query")).withColumn("sub", all_("n_index"))
        p = placed(self.p).withColumn("sub", own("n_index")).withColumn("chunk", all_("n_query"))
        task: Column = F.xxhash64(*_CELL, "sub", "chunk").alias("task")
        keys = [f"_k{i}_{x}" for i in range(self.n_keys) for x in "ab"]
        columns = [task, "source", "asks", "id", "vector", *keys]
        schema = T.StructType(
            [
                T.StructField("qid", T.LongType()),
                T.StructField("source", T.StringType()),
                T.StructField("passage_id", T.LongType()),
                T.StructField("score", T.DoubleType()),
                T.StructField("rank", T.IntegerType()),
            ]
        )
        return _compared(q.select(*columns).union(p.select(*columns)), self.k, self.threshold, self.n_keys, schema)

    def _best(self, found: DataFrame) -> DataFrame:
        found = found.select(*HIT_COLUMNS[:-1]).distinct()
        order = Window.partitionBy("qid", "source").orderBy(F.desc("score"), F.asc("passage_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select(*HIT_COLUMNS)


def recall_report(exact: DataFrame, found: DataFrame, work: DataFrame, pairs: DataFrame) -> DataFrame:
    """``source, n_exact, n_found, recall, pairs, all_pairs``: what an approximate search kept.

    ``exact`` and ``found`` are hits, ``work`` the pairs that were compared, ``pairs``
    (``source, all_pairs``) those that an exact search compares.  Wrong hits would show as a
    recall above one; scores are verified, so there are none.
    """
    key = ["qid", "source", "passage_id"]
    counts = exact.groupBy("source").agg(F.count("*").alias("n_exact"))
    kept = exact.select(*key).join(found.select(*key), key, "left_semi").groupBy("source").agg(F.count("*").alias("n_found"))
    out = counts.join(kept, "source", "left").join(work, "source", "left").join(pairs, "source", "left")
    n_found = F.coalesce("n_found", F.lit(0))
    return out.select(
        "source", "n_exact", n_found.alias("n_found"), F.round(n_found / F.col("n_exact"), SCORE_DIGITS).alias("recall"),
        F.coalesce("pairs", F.lit(0)).alias("pairs"), "all_pairs",
    )
