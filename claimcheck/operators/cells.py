"""A vector index kept in cells: appended to, and searched by reading only the cells in reach.

``pivots`` holds a sample of each source's first vectors, ``rows`` the passages by source and
the cell of their nearest pivot, and ``ranges`` how many passages each cell of a batch holds
and between which angles to the pivot.  A batch counts once its ranges are written.  A search
reads the cells of its queries' own pivots, and with the scores found there those that the
triangle inequality on angles cannot rule out; other cells are pruned before the scan.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck.operators import retrieval
from claimcheck.operators.retrieval import BlockLimits
from claimcheck.session import exists, materialize

#: Passages of a cell on average, and pivots of a source at most; they are held by every task.
CELL_ROWS, MAX_PIVOTS = 65_536, 4096
_CELL = ["source", "cell"]


class CellIndex:
    """The index under ``root``.  ``rows`` given to it have ``source, passage_id, embedding`` and others.

    Rows without a source, an id or a vector are left out; a zero vector has no direction and
    counts as at right angles to all.  All vectors of a source have one length.
    """

    def __init__(self, spark: SparkSession, root: str, cell_rows: int = CELL_ROWS, limits: BlockLimits = BlockLimits()):
        self.spark, self.root, self.cell_rows, self.limits = spark, root, cell_rows, limits
        #: Of the last search: cells that were read, of those there are.
        self.read, self.there = 0, 0

    def _path(self, kind: str, batch: str = "") -> str:
        return os.path.join(self.root, kind, f"batch={batch}" if batch else "")

    def _batches(self) -> list[str]:
        """Names of the batches whose ranges are written."""
        if not exists(self.spark, self._path("ranges")):
            return []
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self._path("ranges"))
        names = [x.getPath().getName() for x in path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)]
        names = [x.removeprefix("batch=") for x in names if x.startswith("batch=")]
        return sorted(x for x in names if exists(self.spark, os.path.join(self._path("ranges", x), "_SUCCESS")))

    def _table(self, kind: str, batches: Sequence[str]) -> DataFrame:
        read = self.spark.read.option("basePath", self._path(kind))
        if kind == "rows":
            told = self.spark.read.text(self._path("schema", batches[0])).first()["value"]
            read = read.schema(T.StructType.fromJson(json.loads(told)))
        return read.parquet(*[self._path(kind, x) for x in batches]).drop("batch")

    def _pivots(self, batches: Sequence[str]) -> dict[str, np.ndarray]:
        """The pivots of each source, in order: at most ``MAX_PIVOTS`` vectors of each."""
        if not batches:
            return {}
        rows = self._table("pivots", batches).orderBy("source", "cell").collect()
        sources = dict.fromkeys(r["source"] for r in rows)
        return {s: np.array([r["pivot"] for r in rows if r["source"] == s], dtype=np.float64) for s in sources}

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add passages as ``batch``, in place of an unfinished or earlier batch of that name.

        Sources that are new get pivots from this batch: the passages with the least hashes of
        their ids.  Those of known sources go to the cells that there are.  All batches have the
        same columns.
        """
        rows = rows.where("source IS NOT NULL AND passage_id IS NOT NULL AND embedding IS NOT NULL")
        known = self._pivots([x for x in self._batches() if x != batch])
        sizes = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
        fresh = {s: max(1, min(MAX_PIVOTS, -(-n // self.cell_rows))) for s, n in sizes.items() if s not in known}
        order = Window.partitionBy("source").orderBy(F.xxhash64("passage_id"), "passage_id")
        picked = rows.where(F.col("source").isin(list(fresh))).withColumn("cell", F.row_number().over(order) - 1)
        picked = picked.where(F.col("cell") < MAX_PIVOTS).select("source", "cell", F.col("embedding").alias("pivot"))
        if fresh:
            wanted = self.spark.createDataFrame(list(fresh.items()), "source string, n int")
            picked = picked.join(wanted, "source").where("cell < n").drop("n")
        picked.write.mode("overwrite").parquet(self._path("pivots", batch))
        pivots = known | self._pivots([batch])
        assigned = retrieval.assigned(rows, "embedding", pivots)
        # Few files for each cell; a cell that very many vectors fall in is split, not one task's.
        spread = assigned.hint("rebalance", *[F.col(c) for c in _CELL])
        spread.write.mode("overwrite").partitionBy(*_CELL).parquet(self._path("rows", batch))
        told = self.spark.createDataFrame([(assigned.schema.json(),)], "value string").coalesce(1)
        told.write.mode("overwrite").text(self._path("schema", batch))
        written = self.spark.read.schema(assigned.schema).parquet(self._path("rows", batch))
        facts = written.groupBy(*_CELL).agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        facts.coalesce(1).write.mode("overwrite").parquet(self._path("ranges", batch))

    def rows(self, cells: Sequence[tuple[str, int]] | None = None) -> DataFrame:
        """The passages, or those of some cells: a partition filter, so no other file is opened."""
        found = self._table("rows", self._batches())
        if cells is None:
            return found
        by_source: dict[str, list[int]] = {}
        for source, cell in cells:
            by_source.setdefault(source, []).append(cell)
        wanted = F.lit(False)
        for source, some in by_source.items():
            wanted = wanted | ((F.col("source") == source) & F.col("cell").isin(sorted(some)))
        return found.where(wanted)

    def search(
        self,
        queries: DataFrame,
        k: int = 5,
        threshold: float | None = 0.55,
        exclude: Sequence[tuple[str, str]] = (),
    ) -> DataFrame:
        """``qid, source, passage_id, score, rank`` as the exact join over all passages gives them.

        ``queries`` has ``qid, source, qvec``.  What comes to the driver is bounded by the pivots.
        """
        q = queries.select("qid", "source", "qvec", *retrieval._key_columns("_qk", [F.col(a) for a, _ in exclude]))
        batches = self._batches()
        pivots = self._pivots(batches)
        q = q.where(F.col("source").isin(list(pivots)) & F.col("qvec").isNotNull())
        if not pivots:
            return retrieval._no_hits(q)
        facts = self._table("ranges", batches).groupBy(*_CELL)
        facts = facts.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
        cells = {(r["source"], r["cell"]): (r["n"], r["low"], r["high"]) for r in facts}
        self.there, seen = len(cells), set()
        q = materialize(retrieval.assigned(q, "qvec", pivots).drop("angle"), "own-cells")
        most = self.limits.task_rows(next(iter(pivots.values())).shape[1])
        cores = self.spark.sparkContext.defaultParallelism
        keys = retrieval._key_columns("_pk", [F.col(b) for _, b in exclude])

        def passages(asked: dict[tuple[str, int], int]) -> DataFrame:
            seen.update(asked)
            return self.rows(list(asked)).select(*_CELL, "passage_id", "embedding", *keys)

        asked = {(r["source"], r["cell"]): r["count"] for r in q.groupBy(*_CELL).count().collect()}
        sizes = {x: (cells[x][0], n) for x, n in asked.items() if x in cells}
        near = retrieval._no_hits(q)
        if sizes:
            plan = retrieval._splits(sizes, most, self.limits.least_rows, cores)
            found = retrieval.search_own(q, passages(sizes), plan, k, threshold, len(exclude))
            near = materialize(retrieval._best(found, k), "near-hits")
        bounded = materialize(retrieval.bounds(q, near, k, threshold), "bounded")
        asked = retrieval.needed_cells(bounded, pivots, cells)
        p = passages(asked) if asked else None
        self.read = len(seen)
        if p is None:
            return near
        more = retrieval.search_needed(
            bounded, p, pivots, cells, asked, k, threshold, len(exclude), most, self.limits.least_rows, cores
        )
        return retrieval._best(near.unionByName(more), k)
