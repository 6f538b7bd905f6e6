"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

A search asks for each anchor's best rows inside windows of scores.  Rows are dealt out in
blocks and anchors in chunks, both by hash, and a task holds one block and one chunk.  In a
task dimensions are taken in order of energy.  For a threshold t a row's entries are indexed
only up to the dimension from which on the norm of the rest times the anchors' largest norm
is below t: the rest alone cannot reach t.  Partial scores add up over the index; a pair goes
as soon as its partial score and the product of both remaining norms stay below t; what is
left gets its omitted dimensions.  An anchor whose windows hold too few rows of the block is
searched again with a lower threshold, the last of which no wanted row is below.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimcheck.llm.common import stored, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Numbers that a block holds, rows times dimensions (``FEW`` at least), and anchors of a chunk.
BLOCK_VALUES, FEW, CHUNK = 1 << 19, 64, 256
#: Where thresholds lie between the highest score that is wanted and the lowest.
LEVELS = (0.35, 0.6, 0.8, 1.0)
#: Dimensions that are added up between two prunings.
SLAB = 8
#: Below this product of norms, sums of whole numbers are exact in doubles.
_EXACT = 2.0**52
_LONG = 2**63 - 1


def _product(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of whole numbers of any size, cut to a long."""
    return max(-_LONG, min(_LONG, sum(int(x) * int(y) for x, y in zip(a, b, strict=True))))


def _suffix_norms(m: np.ndarray) -> np.ndarray:
    """Column j: the norm of each row's entries from j on; one column more, of zeros."""
    out = np.zeros((len(m), m.shape[1] + 1))
    with np.errstate(over="ignore"):
        out[:, :-1] = np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])
    return out


class Block:
    """Rows of one task, dimensions by descending energy, with the norms of their suffixes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.order = np.argsort(-np.abs(vectors).max(axis=0, initial=0), kind="stable")
        self.ids, self.labels, self.vectors = ids, labels, np.ascontiguousarray(vectors[:, self.order])
        self.rest = _suffix_norms(self.vectors)
        self.norm = float(self.rest[:, 0].max(initial=0))
        self.verified = 0  # pairs that no bound ruled out

    def above(
        self, q: np.ndarray, rest: np.ndarray, least: np.ndarray, allowed: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All allowed pairs (anchor, row, score) whose score is ``least[anchor]`` or more."""
        dim, most = self.vectors.shape[1], rest[:, 0].max(initial=0)
        if not most * self.norm < _EXACT:
            anchor, row = np.nonzero(allowed)
            scores = np.array([_product(q[a], self.vectors[b]) for a, b in zip(anchor, row, strict=True)], dtype=object)
            good = (scores >= least[anchor]).astype(bool)
            return anchor[good], row[good], scores[good]
        # Norms are rounded, so bounds get a little room.
        least = least - 1e-9 * (1 + most * self.norm)
        lowest = least.min(initial=np.inf)
        depth = np.minimum((self.rest * most >= lowest).sum(axis=1), dim)
        depth = np.minimum(-(-depth // SLAB) * SLAB, dim)  # entries that are indexed
        rows = np.argsort(-depth, kind="stable")  # postings of a dimension are then a run
        rows = rows[(depth[rows] > 0) | (lowest <= 0)]
        depth, sums = depth[rows], np.zeros((len(q), len(rows)))
        alive = allowed[:, rows]
        for at in range(0, dim, SLAB):
            n = int(np.searchsorted(-depth, -at, side="left"))  # rows indexed beyond ``at``
            if not n:
                break
            to = min(at + SLAB, dim)
            sums[:, :n] += q[:, at:to] @ self.vectors[rows[:n], at:to].T
            end = np.minimum(depth[:n], to)
            alive[:, :n] &= sums[:, :n] + rest[:, to, None] * self.rest[rows[:n], end][None, :] >= least[:, None]
            keep = alive.any(axis=0)
            if keep.sum() < 0.8 * len(rows):
                rows, depth, sums, alive = rows[keep], depth[keep], sums[:, keep], alive[:, keep]
        anchor, row = np.nonzero(alive)
        self.verified += len(anchor)
        scores = sums[anchor, row]
        for omitted in np.unique(depth[row]):
            if omitted < dim:
                own = depth[row] == omitted
                a, b = anchor[own], rows[row[own]]
                scores[own] += np.einsum("ij,ij->i", q[a][:, omitted:], self.vectors[b][:, omitted:])
        scores = scores.astype(np.int64)
        good = scores >= least[anchor]
        return anchor[good], rows[row[good]], scores[good]


def search(
    block: Block, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: list[list[tuple]], same: bool, want: int
) -> list[tuple]:
    """``(anchor, window, row, score)``: the first ``want`` rows of the block in each window.

    ``windows[i]`` lists anchor i's windows ``(lowest, highest)``, both ends wanted; rows have
    its label if ``same``, another if not, and never its id.
    """
    vectors = vectors[:, block.order]
    rest = _suffix_norms(vectors)
    with np.errstate(invalid="ignore", over="ignore"):
        limit = rest[:, 0] * block.norm + 1
    limit = np.where(limit < 2.0**64, limit, 2.0**64)
    top = np.array([min(limit[i], max((hi for lo, hi in w if lo <= hi), default=-math.inf)) for i, w in enumerate(windows)])
    bottom = np.array([max(-limit[i], min((lo for lo, hi in w if lo <= hi), default=math.inf)) for i, w in enumerate(windows)])
    allowed = (labels[:, None] == block.labels[None, :]) == same
    allowed &= ids[:, None] != block.ids[None, :]
    out: list[tuple] = []
    todo = np.flatnonzero(top >= bottom)
    for level in LEVELS:
        if not len(todo):
            break
        least = bottom[todo] if level == 1.0 else top[todo] - level * (top[todo] - bottom[todo])
        anchor, row, score = block.above(vectors[todo], rest[todo], least, allowed[todo])
        order = np.lexsort((block.ids[row], -score, anchor))
        anchor, row, score = anchor[order], row[order], score[order]
        ends = np.searchsorted(anchor, np.arange(len(todo) + 1))
        open_ = []
        for k, i in enumerate(todo):
            own = slice(ends[k], ends[k + 1])
            found, filled = [], True
            for w, (lo, hi) in enumerate(windows[i]):
                if lo > hi:
                    continue
                inside = np.flatnonzero((score[own] >= lo) & (score[own] <= hi))[:want]
                filled &= len(inside) == want or least[k] <= max(lo, -limit[i])
                found += [(i, w, row[own][x], score[own][x]) for x in inside]
            if filled:
                out += found
            else:
                open_.append(i)
        todo = np.array(open_, dtype=np.int64)
    return out


_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dim)


def _searcher(same: bool, want: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _FOUND.split(", ")]
        found: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            ids, labels = (left.column(c).to_numpy() for c in ("vec_id", "label"))
            asked: list[list] = left.column("positives").to_pylist()
            windows = [
                [(-math.inf, math.inf)] if same else [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in own]
                for own in asked
            ]
            block = Block(*(right.column(c).to_numpy() for c in ("vec_id", "label")), _matrix(right.column("vector"), dim))
            for i, w, row, score in search(block, ids, labels, _matrix(left.column("vector"), dim), windows, same, want):
                positive = {"vec_id": None, "score": None} if same else asked[i][w]
                line = (int(ids[i]), positive["vec_id"], positive["score"], int(block.ids[row]), int(score))
                for column, value in zip(found, line, strict=True):
                    column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=names)

    return run


def _searched(rows: DataFrame, anchors: DataFrame, same: bool, want: int, low: int, high: int) -> DataFrame:
    """Every chunk of anchors against every block of rows of its length; a block's first rows each."""
    chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    several = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.withColumn("chunk", chunk).withColumn("block", several("blocks"))
    right = rows.withColumn("block", block).withColumn("chunk", several("chunks"))
    key = ["dim", "block", "chunk"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searcher(same, want, low, high), _FOUND)


def _first(found: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block_values: int = BLOCK_VALUES,
    chunk: int = CHUNK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``, whose components are whole numbers;
    a score is an inner product, higher ones first, ties by smaller vec_id.  ``is_anchor`` is a
    condition on these columns.  An anchor's positives are its first ``positives`` other rows of
    its label; each of them gets the first ``negatives`` rows of other labels whose score is
    ``low`` to ``high`` hundredths of its own.  A positive of negative score has none, one of
    score 0 those of score 0.

    Rows with a null id or label, or a vector that is null or holds a null or non-finite
    component, take no part.  Vectors are compared with those of their length; empty ones
    score 0.  Rows that repeat all three columns are one row; rows that repeat an id count
    each, but never meet their own id.  A score beyond a long is cut to its ends.  Other
    columns are not read; an empty table gives an empty one.

    Blocks and chunks are bounded by ``block_values`` and ``chunk`` whatever the labels are, so
    a label that holds most rows is no group of its own; all rows are compared as the anchors
    are a stated part of the table.  Only the rows and anchors of each length are counted on
    the driver.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(finite).withColumnRenamed("embedding", "vector").withColumn("dim", F.size("vector"))
    rows = stored(rows.distinct(), "negatives-rows")
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count("*") * F.greatest("dim", F.lit(FEW)) / block_values).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.count_if("asks") / chunk), F.lit(1)).cast("int").alias("chunks"),
    )
    rows = rows.join(sizes, "dim")
    nothing = F.array().cast("array<struct<vec_id:long,score:long>>").alias("positives")
    asked = stored(rows.where("asks").drop("asks").select("*", nothing), "negatives-anchors")
    rows = rows.drop("asks")
    found = _searched(rows, asked, True, positives, low, high)
    found = _first(found, ["anchor_id"], positives)
    best = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))
    # Rows that repeat an anchor's id with another label or vector share its lists.
    best = best.withColumnRenamed("anchor_id", "vec_id")
    asked = stored(asked.drop("positives").join(best, "vec_id"), "negatives-positives")
    found = _searched(rows, asked, False, negatives, low, high).distinct()
    found = _first(found, ["anchor_id", "positive_id"], negatives)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 100 ask; those divisible by 7 have another label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    wrong = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    # floor() gives longs, which hold no large double; rint() does, so it is put right after.
    down = lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0)
    whole = F.transform("embedding", lambda x: down(x.cast("double") * 256))
    rows = rows.select("vec_id", wrong.alias("label"), whole.alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
