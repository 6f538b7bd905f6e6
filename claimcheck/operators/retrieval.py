"""Exact top-k similarity joins, index tables and evidence assembly.

A search compares every query with every passage of its source, so the work is split
into blocks that fit one task: passages into ``sub`` blocks, queries into ``chunk``s, both
by hash.  No source, however large, ends up in one group.  A task holds the passages of its
block, lets the queries pass by in slices and emits at most k rows per query; a window merges
the blocks.

Sources of more than one block are cut by pivots first.  A passage belongs to the cell of its
nearest pivot, and a query is compared with its own cell.  By the triangle inequality on angles
it then needs only cells whose angle range comes within acos(t) of its own angle to the pivot,
where t is its k-th score so far, or the threshold.  That prunes whole cells and loses no hit.
Neighbouring numbers of cells share a bin, a task's worth of them: a query goes once to each bin,
with a bit for every cell of it that it needs, however many cells there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck.functions import text as tx
from claimcheck.functions import vectors
from claimcheck.functions.vectors import Encoder
from claimcheck.session import materialize

SCORE_DIGITS = 6
HIT_COLUMNS = ("qid", "source", "passage_id", "score", "rank")
#: Scores or angles that a task computes at once, and queries that it looks at or sends at once.
SLAB, SLICE = 1 << 20, 2048
#: Passages of a task that are in double precision at once; those it holds keep the type they came in.
TILE = 4096


@dataclass(frozen=True)
class BlockLimits:
    """How finely a search is cut, and how much one of its tasks may hold."""

    #: A source of more passages than this is cut by pivots, about one for so many.
    block_bytes: int = 64 << 20
    least_rows: int = 1024
    max_pivots: int = 256
    pivot_from_blocks: int = 2
    #: Passages that a task holds; each further block of a source costs a copy of its queries.
    task_bytes: int = 64 << 20

    def rows(self, dim: int) -> int:
        return max(64, self.block_bytes // (8 * max(dim, 1)))

    def task_rows(self, dim: int) -> int:
        return max(64, self.task_bytes // (8 * max(dim, 1)))


# --- kernel -----------------------------------------------------------------------------


def as_given(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in their own type; a null component is NaN."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or (sizes != sizes[0]).any():
        raise ValueError("vectors of a source must be there and have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]))


def matrix(column: pa.Array) -> np.ndarray:
    """The same in double precision."""
    return as_given(column).astype(np.float64)


def _norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of the rows, a slice of them at a time: squares need as much room as the rows."""
    parts = [rows[at : at + SLICE].astype(np.float64, copy=False) for at in range(0, len(rows), SLICE)]
    return np.concatenate([np.zeros(0), *(np.sqrt((x * x).sum(axis=1)) for x in parts)])


def _fit(norms: np.ndarray) -> np.ndarray:
    """Whether vectors of these lengths, or their unit vectors, can be held in single precision."""
    return (norms == 0) | ((norms > 1e-30) & (norms < 1e30))


def _units(rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision; zero vectors, and those that do not fit, are zero."""
    inverse = np.divide(1.0, norms, out=np.zeros(len(rows)), where=_fit(norms) & (norms != 0))
    units = (rows * inverse.astype(rows.dtype)[:, None]).astype(np.float32, copy=False)
    units[~_fit(norms)] = 0
    return units


def _counts_only(rows: np.ndarray) -> bool:
    return rows.size > 0 and bool(rows.min() >= 0) and bool((np.rint(rows) == rows).all())


#: Two products of counts below this fit the 24 bits of a single-precision number, and stay exact in it.
PACKED = 4096.0


class _Coarse:
    """Products of query rows and a tile of passages in single precision.

    Rows are unit vectors, or counts: those of two passages then make one number, so that one
    multiplication serves both.  ``scale`` is what the cosines of a row come multiplied by.
    """

    def __init__(self, q: np.ndarray, q_norms: np.ndarray, p: np.ndarray, p_norms: np.ndarray):
        self.n, self.half = len(p), -(-len(p) // 2)
        packed = np.zeros(len(q), dtype=bool)
        if len(q) and _counts_only(p) and _counts_only(q):
            packed = np.maximum(q_norms, 1) * p_norms.max() < PACKED - 1  # no product is larger
        self.packed, self.scale = packed, np.where(packed, q_norms, 1.0)
        self.rows = q.astype(np.float32)
        if not packed.all():
            self.rows[~packed] = _units(q[~packed], q_norms[~packed])
            self.units = _units(p, p_norms)
        self.q_odd, self.p_odd = np.flatnonzero(~packed & ~_fit(q_norms)), np.flatnonzero(~_fit(p_norms))
        if packed.any():
            self.two = p[: self.half].astype(np.float32)
            self.two[: self.n - self.half] += np.float32(PACKED) * p[self.half :].astype(np.float32)
            self.inverse = np.divide(1.0, p_norms, out=np.zeros(len(p)), where=p_norms > 0).astype(np.float32)

    def __call__(self, start: int, stop: int) -> np.ndarray:
        packed = self.packed[start:stop]
        out = np.empty((len(packed), self.n), np.float32)
        for which, product in ((packed, self._unpacked), (~packed, lambda rows: rows @ self.units.T)):
            if which.all():
                return product(self.rows[start:stop])
            if which.any():
                out[which] = product(self.rows[start:stop][which])
        return out

    def _unpacked(self, rows: np.ndarray) -> np.ndarray:
        both, out = rows @ self.two.T, np.empty((len(rows), self.n), np.float32)
        for at in range(0, len(rows), 32):  # so few that they stay near the core
            low, part = both[at : at + 32], out[at : at + 32]
            high = low * np.float32(1 / PACKED)
            np.floor(high, out=high)
            low -= np.float32(PACKED) * high
            np.multiply(low, self.inverse[: self.half], out=part[:, : self.half])
            np.multiply(high[:, : self.n - self.half], self.inverse[self.half :], out=part[:, self.half :])
        return out


def _cosine(q: np.ndarray, p: np.ndarray, norms: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cosines of some pairs in double precision; zero vectors score 0.  ``norms``: the products of their lengths."""
    out, step = np.zeros(len(rows)), max(1, SLAB // max(q.shape[1], 1))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        raw = np.einsum("ij,ij->i", q[rows[part]], p[cols[part]].astype(np.float64, copy=False))
        np.divide(raw, norms[part], out=out[part], where=norms[part] > 0)
    return out


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Rounded half up."""
    unit = 10.0**SCORE_DIGITS
    return np.sign(scores) * np.floor(np.abs(scores) * unit + 0.5) / unit


def _blank_equal_keys(scores: np.ndarray, q_keys: np.ndarray, p_keys: np.ndarray) -> None:
    """Rule out pairs with equal keys; only keys present on both sides cost anything."""
    both = np.concatenate([q_keys, p_keys])
    _, ids = np.unique(both, axis=0, return_inverse=True)
    ids = ids.reshape(-1)
    q_ids, p_ids = ids[: len(q_keys)], ids[len(q_keys) :]
    for row in np.flatnonzero(np.isin(q_ids, p_ids)):
        scores[row, p_ids == q_ids[row]] = -np.inf


def block_topk(
    q: np.ndarray,
    p: np.ndarray,
    p_ids: np.ndarray,
    k: int,
    threshold: float | None,
    q_keys: Sequence[np.ndarray] = (),
    p_keys: Sequence[np.ndarray] = (),
    floor: np.ndarray | None = None,
    p_norms: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best k passages per query row: (query row, passage id, score, rank).

    Order is score descending, then passage id ascending; ties at the k-th score are all
    looked at before cutting.  Scores below a row's ``floor`` are left out.

    Products in single precision, which are off by ``off`` at most whatever the order of their
    sums, rule pairs out; the others are scored in double precision.
    """
    least_of = np.full(len(q), -2.0 if threshold is None else threshold)
    least_of = least_of if floor is None else np.maximum(least_of, floor)
    margin = 10.0**-SCORE_DIGITS  # rounding moves a score by less
    slab = max(1, SLAB // max(len(p), 1))
    p_norms = _norms(p) if p_norms is None else p_norms
    if len(p) > TILE:
        tiles = [slice(at, at + TILE) for at in range(0, len(p), TILE)]
        found = [
            block_topk(q, p[x], p_ids[x], k, threshold, q_keys, [y[x] for y in p_keys], floor, p_norms[x]) for x in tiles
        ]
        return _first(found, k)[0]
    q_norms = _norms(q)
    off = (q.shape[1] + 8) * 2.0**-23 + margin
    products = _Coarse(q, q_norms, p, p_norms) if len(p) else None
    parts: list[tuple[np.ndarray, ...]] = []
    for start in range(0, len(q) if len(p) else 0, slab):
        least, scale = least_of[start : start + slab], products.scale[start : start + slab]
        coarse = products(start, start + slab)
        odd = products.q_odd[(products.q_odd >= start) & (products.q_odd < start + slab)] - start
        bound = ((least - off) * scale).astype(np.float32)
        some = coarse.max(axis=1) >= bound
        some[odd] = True
        some = np.arange(len(coarse)) if len(products.p_odd) else np.flatnonzero(some)
        if not len(some):
            continue
        coarse = coarse if len(some) == len(coarse) else coarse[some]
        near = coarse >= bound[some][:, None]
        near[:, products.p_odd] = True
        near[np.isin(some, odd)] = True
        flat = np.flatnonzero(near)
        many = np.flatnonzero(np.bincount(flat // len(p), minlength=len(some)) > 4 * k) if len(p) > k else []
        if len(many):
            best = np.where(near[many], coarse[many], -np.inf)
            best[:, products.p_odd] = -np.inf
            best[np.isin(some[many], odd)] = -np.inf
            for qk, pk in zip(q_keys, p_keys, strict=True):
                _blank_equal_keys(best, qk[start + some[many]], pk)
            kth = np.partition(best, len(p) - k, axis=1)[:, len(p) - k]
            reach = (kth - 2 * off * scale[some[many]]).astype(np.float32)
            near[many] &= (coarse[many] >= reach[:, None]) | (kth == -np.inf)[:, None]
            near[np.ix_(many, products.p_odd)] = True
            flat = np.flatnonzero(near)
        rows, cols = some[flat // len(p)], flat % len(p)
        for qk, pk in zip(q_keys, p_keys, strict=True):
            differs = (qk[rows + start] != pk[cols]).any(axis=1)
            rows, cols = rows[differs], cols[differs]
        product = q_norms[rows + start] * p_norms[cols]
        found = _rounded(_cosine(q, p, product, rows + start, cols))
        keep = found >= least_of[rows + start]
        rows, cols, found = rows[keep], cols[keep], found[keep]
        order = np.lexsort((p_ids[cols], -found, rows))
        rows, cols, found = rows[order], cols[order], found[order]
        first = np.searchsorted(rows, rows, side="left")
        rank = np.arange(len(rows)) - first + 1
        keep = rank <= k
        parts.append((rows[keep] + start, p_ids[cols[keep]], found[keep], rank[keep]))
    if not parts:
        empty = np.empty(0)
        return empty.astype(int), empty.astype(np.int64), empty, empty.astype(int)
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))  # type: ignore


# --- the join ------------------------------------------------------------------------------


def _key_columns(prefix: str, keys: Sequence[Column]) -> list[Column]:
    """128 bits per exclusion key, as two longs."""
    out: list[Column] = []
    for i, key in enumerate(keys):
        out.append(F.xxhash64(key).alias(f"{prefix}{i}_a"))
        out.append(F.xxhash64(F.lit("second"), key).alias(f"{prefix}{i}_b"))
    return out


def _per_source(values: dict[str, int]) -> Column:
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), F.col("source"))


def _blocks(rows: int, limit: int) -> int:
    return max(1, math.ceil(rows / limit))


def _split(n_index: int, n_query: int, limit: int, least: int, tasks: float) -> tuple[int, int]:
    """(passage blocks, query chunks) of a source: within the limit, and enough for ``tasks``.

    Further splits cut the longer side, because each copies the other one once more.
    """
    sub, chunk = _blocks(n_index, limit), _blocks(n_query, limit)
    more = math.ceil(tasks / (sub * chunk))
    if more > 1 and n_index >= n_query:
        sub *= max(1, min(more, n_index // (sub * least)))
    elif more > 1:
        chunk *= max(1, min(more, n_query // (chunk * least)))
    return sub, chunk


def _splits(
    sizes: dict[tuple[str, int], tuple[int, int]], limit: int, least: int, cores: int
) -> dict[tuple[str, int], tuple[int, int]]:
    """``_split`` of each cell, which gets tasks by its share of all comparisons."""
    work = {key: n * m for key, (n, m) in sizes.items()}
    total = sum(work.values())
    return {
        key: _split(n, m, limit, least, cores * work[key] / total)
        for key, (n, m) in sizes.items()
    }


def _counts(df: DataFrame, side: str) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))


def topk_join(
    queries: DataFrame,
    index: DataFrame,
    *,
    sources: Sequence[str],
    k: int = 5,
    threshold: float | None = 0.55,
    dim: int | None = None,
    exclude: Sequence[tuple[str, str]] = (),
    limits: BlockLimits = BlockLimits(),
) -> DataFrame:
    """Exact cosine top-k of each query among the passages of its source.

    ``queries`` has ``qid, source, qvec``, ``index`` has ``source, passage_id, embedding``;
    ``exclude`` names (query column, index column) pairs that must differ in every hit.
    Returns ``qid, source, passage_id, score, rank``.  Only per-source counts (and pivots,
    for large sources) come to the driver, and ``sources`` bounds how many there are.
    """
    sources = list(dict.fromkeys(sources))
    queries = queries.where(F.col("source").isin(sources))
    index = index.where(F.col("source").isin(sources))
    if dim is None:
        row = index.select(F.size("embedding").alias("d")).first()
        dim = row["d"] if row else 1
    counted = _counts(index, "index").unionByName(_counts(queries, "query")).collect()
    n_index = {r["source"]: r["n"] for r in counted if r["side"] == "index"}
    n_query = {r["source"]: r["n"] for r in counted if r["side"] == "query"}
    both = [s for s in sources if s in n_index and s in n_query]
    limit, most = limits.rows(dim), limits.task_rows(dim)

    q = queries.select(
        "qid", "source", "qvec", *_key_columns("_qk", [F.col(a) for a, _ in exclude])
    )
    p = index.select(
        "source", "passage_id", "embedding", *_key_columns("_pk", [F.col(b) for _, b in exclude])
    )
    if not both:
        return _no_hits(q)
    q, p = q.where(F.col("source").isin(both)), p.where(F.col("source").isin(both))
    subs = {s: _blocks(n_index[s], limit) for s in both}
    cores = q.sparkSession.sparkContext.defaultParallelism
    if max(subs.values()) < limits.pivot_from_blocks:
        # One cell for each source, so every query is in the cell it needs.
        q, p = q.withColumn("cell", F.lit(0)), p.withColumn("cell", F.lit(0))
        sizes = {s: (n_index[s], n_query[s]) for s in both}
        plan = _splits({(s, 0): n for s, n in sizes.items()}, most, limits.least_rows, cores)
        hits = search_own(q, p, plan, k, threshold, len(exclude))
        if max(sub for sub, _ in plan.values()) == 1:
            return hits
    else:
        hits = _cell_search(q, p, subs, k, threshold, len(exclude), most, limits, cores)
    return _best(hits, k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The first k of the hits that several blocks found."""
    order = Window.partitionBy("qid", "source").orderBy(F.desc("score"), F.asc("passage_id"))
    return (
        hits.drop("rank")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(*HIT_COLUMNS)
    )


def _hit_schema(q: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", q.schema["qid"].dataType),
            T.StructField("source", T.StringType()),
            T.StructField("passage_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )


def _no_hits(q: DataFrame) -> DataFrame:
    return q.sparkSession.createDataFrame([], _hit_schema(q))


# --- one task -----------------------------------------------------------------------------------

_CELL = ["source", "cell"]
_TASK = ["source", "cell", "sub", "chunk"]


def _spread(rows: DataFrame, own: str, ident: str, every: str) -> DataFrame:
    """Each row to the block that the hash of its id names, and to all blocks of the other side."""
    n_own, n_every = F.col(f"n_{own}"), F.col(f"n_{every}")
    rows = rows.withColumn(own, F.pmod(F.xxhash64(ident), n_own).cast("int"))
    return rows.withColumn(every, F.explode(F.sequence(F.lit(0), n_every - 1))).drop("n_sub", "n_chunk")


def _plan_table(spark: SparkSession, plan: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """A row for each cell or bin: there are no more of them than pivots, or blocks of passages."""
    rows = [(*cell, *n) for cell, n in plan.items()]
    return F.broadcast(spark.createDataFrame(rows, "source string, cell int, n_sub int, n_chunk int"))


def _sized(rows: DataFrame, plan: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """Rows of the cells in ``plan``, with ``n_sub`` and ``n_chunk``.

    One cell for each source is looked up in a map: where rows name one source, a join would have no key left.
    """
    if any(cell for _, cell in plan):
        return rows.join(_plan_table(rows.sparkSession, plan), _CELL)
    sizes = [(F.lit(s), F.struct(F.lit(a).alias("n_sub"), F.lit(b).alias("n_chunk"))) for (s, _), (a, b) in plan.items()]
    found = F.try_element_at(F.create_map(*[x for pair in sizes for x in pair]), F.col("source"))
    rows = rows.withColumn("_n", found).where("_n IS NOT NULL AND cell = 0")
    return rows.select("*", "_n.n_sub", "_n.n_chunk").drop("_n")


def search_own(
    q: DataFrame, p: DataFrame, plan: dict[tuple[str, int], tuple[int, int]], k: int, threshold: float | None, n_keys: int
) -> DataFrame:
    """Every query against the passages of its ``source`` and ``cell``; other cells are not sent."""
    q = _sized(q, plan).withColumns({"wanted": F.lit(None).cast("binary"), "kth": F.lit(None).cast("double")})
    q = _spread(q, "chunk", "qid", "sub")
    p = _spread(_sized(p, plan).withColumn("part", F.lit(0)), "sub", "passage_id", "chunk")
    return _search(q, p, k, threshold, n_keys)


def _held(rows: pa.RecordBatch, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    ids = rows.column("passage_id").fill_null(np.iinfo(np.int64).min).to_numpy()
    return as_given(rows.column("vector")), ids, rows.column("part").to_numpy(), _keys_of(rows, n_keys)


def _keys_of(rows: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [np.stack([rows.column(f"_k{i}_{x}").to_numpy() for x in "ab"], axis=1) for i in range(n)]


def _first(found: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """The best k of each query row, in order, of hits that several parts gave."""
    rows, ids, scores, _ = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
    keep = rank <= k
    return [(rows[keep], ids[keep], scores[keep], rank[keep])]


def _answers(rows: pa.RecordBatch, block: tuple, k: int, threshold: float | None, n_keys: int) -> tuple[np.ndarray, ...]:
    """Hits of a slice of queries in the passages that a task holds, part by part as each wants."""
    p, ids, part, p_keys, norms = block
    q, q_keys = matrix(rows.column("vector")), _keys_of(rows, n_keys)
    wanted, want, floor = rows.column("wanted"), None, None
    if not wanted.null_count:
        bits = np.frombuffer(b"".join(wanted.to_pylist()), dtype=np.uint8).reshape(len(q), -1)
        want = np.unpackbits(bits, axis=1).astype(bool)
        floor = rows.column("kth").to_numpy()
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    found, held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))], 0
    for a, end in zip(begins, [*begins[1:], len(part)], strict=True):
        asks = np.arange(len(q)) if want is None else np.flatnonzero(want[:, part[a]])
        if not len(asks):
            continue
        asked, keys, least = q[asks], [x[asks] for x in q_keys], None if floor is None else floor[asks]
        for at in range(a, end, TILE):
            to = min(at + TILE, end)
            tile = p[at:to].astype(np.float64, copy=False)
            row, hit, score, rank = block_topk(
                asked, tile, ids[at:to], k, threshold, keys, [x[at:to] for x in p_keys], least, norms[at:to]
            )
            found.append((asks[row], hit, score, rank))
            held += len(row)
            if held > SLAB // 4:
                found, held = _first(found, k), 0
    return _first(found, k)[0]


def _search(q: DataFrame, p: DataFrame, k: int, threshold: float | None, n_keys: int) -> DataFrame:
    """Hits of each task, a group of ``source, cell, sub, chunk``.

    Its passages come first and are held, its queries pass by in slices: what a task holds does
    not grow with the number of queries.
    """
    schema, names = _hit_schema(q), [f"_k{i}_{x}" for i in range(n_keys) for x in "ab"]
    kinds = {q.schema["qvec"].dataType, p.schema["embedding"].dataType}
    kind = "array<float>" if kinds == {T.ArrayType(T.FloatType())} else "array<double>"
    none = lambda t: F.lit(None).cast(t)
    passages = p.select(
        *_TASK, F.lit(False).alias("asks"), F.col("part").cast("int").alias("part"), none("binary").alias("wanted"), none("double").alias("kth"),
        none(schema["qid"].dataType).alias("qid"), F.col("passage_id").cast("long").alias("passage_id"),
        F.col("embedding").cast(kind).alias("vector"), *[F.col(x.replace("_k", "_pk")).alias(x) for x in names],
    )
    queries = q.select(
        *_TASK, F.lit(True).alias("asks"), none("int").alias("part"), "wanted", "kth", "qid", none("long").alias("passage_id"),
        F.col("qvec").cast(kind).alias("vector"), *[F.col(x.replace("_k", "_qk")).alias(x) for x in names],
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, pieces, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            source = batch.column("source").dictionary_encode()
            marks = [source.indices, *(batch.column(x) for x in (*_TASK[1:], "asks"))]
            marks = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in marks])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                name = source[int(a)].as_py()
                now = (name, *marks[1:4, a])
                if now != task:
                    task, pieces, block = now, [], None
                if not marks[4, a]:
                    pieces.append(_held(batch.slice(a, b - a), n_keys))
                    continue
                if block is None:
                    if not pieces:
                        continue
                    p, ids, part, keys = zip(*pieces, strict=True)
                    keys = [np.concatenate(x) for x in zip(*keys, strict=True)]
                    p, pieces = np.concatenate(p), []
                    block = (p, np.concatenate(ids), np.concatenate(part), keys, _norms(p))
                for at in range(a, b, SLICE):
                    part = batch.slice(at, min(SLICE, b - at))
                    rows, ids, scores, rank = _answers(part, block, k, threshold, n_keys)
                    if not len(rows):
                        continue
                    columns = [part.column("qid").take(pa.array(rows)), pa.array([name] * len(rows), pa.string())]
                    columns += [pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(rank.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, list(HIT_COLUMNS))

    dealt = passages.union(queries).repartition(*_TASK).sortWithinPartitions(*_TASK, "asks", "part")
    return dealt.mapInArrow(search, schema)


# --- pivots -----------------------------------------------------------------------------------


def _angles(vectors_: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors_ * vectors_).sum(axis=1))[:, None]
    norms = norms * np.sqrt((pivots * pivots).sum(axis=1))[None, :]
    raw = vectors_ @ pivots.T
    return np.arccos(np.clip(np.divide(raw, norms, out=np.zeros_like(raw), where=norms > 0), -1, 1))


def _with_angles(
    batches: Iterator[pa.RecordBatch], vector: str, pivots: dict[str, np.ndarray]
) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
    """Rows of one source in slices, and their angles to its pivots: at most ``SLAB`` at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sources = batch.column("source").dictionary_encode()
        codes = sources.indices.to_numpy()
        for code, source in enumerate(sources.dictionary.to_pylist()):
            own = np.flatnonzero(codes == code)
            step = max(1, min(SLICE, SLAB // len(pivots[source])))
            for at in range(0, len(own), step):
                part = batch.take(pa.array(own[at : at + step]))
                yield source, part, _angles(matrix(part.column(vector)), pivots[source])


def assigned(rows: DataFrame, vector: str, pivots: dict[str, np.ndarray]) -> DataFrame:
    """``cell`` of the nearest pivot and the ``angle`` to it, for rows of sources that have pivots."""
    names = [*rows.columns, "cell", "angle"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, angles in _with_angles(batches, vector, pivots):
            cell = angles.argmin(axis=1)
            extra = [pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names)

    extra = [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, *extra]))


def _needs(
    pivots: dict[str, np.ndarray], cells: dict[tuple[str, int], tuple]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, pa.RecordBatch, np.ndarray]]]:
    """Queries in slices, with a mark for every other cell that may hold a passage as good as ``kth``."""
    ranges = {s: (np.full(len(x), np.inf), np.full(len(x), -np.inf)) for s, x in pivots.items()}
    for (source, cell), (_, low, high) in cells.items():
        ranges[source][0][cell], ranges[source][1][cell] = low, high

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
        for source, part, angles in _with_angles(batches, "qvec", pivots):
            low, high = ranges[source]
            least = part.column("kth").to_numpy(zero_copy_only=False) - 10.0**-SCORE_DIGITS
            reach = np.arccos(np.clip(least, -1.0, 1.0))[:, None] + 1e-9
            within = (angles - reach <= high) & (angles + reach >= low)
            within[np.arange(len(within)), part.column("cell").to_numpy()] = False
            yield source, part, within

    return need


def needed_cells(
    bounded: DataFrame, pivots: dict[str, np.ndarray], cells: dict[tuple[str, int], tuple]
) -> dict[tuple[str, int], int]:
    """How many queries need each cell besides their own."""
    need = _needs(pivots, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for source, _, within in need(batches):
            total[source] = total.get(source, 0) + within.sum(axis=0)
        for source, n in total.items():
            cell = np.flatnonzero(n)
            columns = [pa.array([source] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(n[cell])]
            yield pa.RecordBatch.from_arrays(columns, [*_CELL, "n"])

    counted = bounded.select("source", "qvec", "cell", "kth").mapInArrow(count, "source string, cell int, n long")
    return {(r["source"], r["cell"]): r["n"] for r in counted.groupBy(*_CELL).agg(F.sum("n").alias("n")).collect()}


def search_needed(
    bounded: DataFrame,
    p: DataFrame,
    pivots: dict[str, np.ndarray],
    cells: dict[tuple[str, int], tuple],
    asked: dict[tuple[str, int], int],
    k: int,
    threshold: float | None,
    n_keys: int,
    most: int,
    least: int,
    cores: int,
) -> DataFrame:
    """Hits of the queries in the ``asked`` cells that they need besides their own.

    Cells are put into bins of at most ``most`` passages (a larger cell is a bin of its own, and
    is cut by hash), and into as many as there are cores where ``least`` passages fall in each.
    """
    bins: dict[tuple[str, int], list[int]] = {}
    rows_in = {s: sum(cells[x][0] for x in asked if x[0] == s) for s in pivots}
    work = sum(rows_in.values())
    for source, n in rows_in.items():
        wide = min(most, max(least, math.ceil(work / cores)))
        number, filled = -1, wide
        for _, cell in sorted(x for x in asked if x[0] == source):
            size = cells[source, cell][0]
            if filled + size > wide:
                number, filled = number + 1, 0
            bins.setdefault((source, number), []).append(cell)
            filled += size
    sizes = {
        (s, b): (sum(cells[s, c][0] for c in own), max(asked[s, c] for c in own)) for (s, b), own in bins.items()
    }
    plan = _splits(sizes, most, least, cores)
    spark = p.sparkSession
    places = [(s, c, b, i) for (s, b), own in bins.items() for i, c in enumerate(own)]
    places = spark.createDataFrame(places, "source string, cell int, bin int, part int")
    p = p.join(F.broadcast(places), _CELL).drop("cell").withColumnRenamed("bin", "cell")
    need = _needs(pivots, cells)
    by_source: dict[str, list[tuple[int, list[int]]]] = {}
    for (source, number), own in bins.items():
        by_source.setdefault(source, []).append((number, own))
    names = [*bounded.drop("cell").columns, "cell", "wanted"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, part, within in need(batches):
            for number, own in by_source.get(source, ()):
                want = within[:, own]
                rows = np.flatnonzero(want.any(axis=1))
                if len(rows):
                    bits = [x.tobytes() for x in np.packbits(want[rows], axis=1)]
                    sent = part.take(pa.array(rows))
                    columns = [sent.column(x) for x in names[:-2]]
                    columns += [pa.array(np.full(len(rows), number, np.int32)), pa.array(bits, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    kept = [f for f in bounded.schema.fields if f.name in names[:-2]]
    extra = [T.StructField("cell", T.IntegerType()), T.StructField("wanted", T.BinaryType())]
    sent = bounded.mapInArrow(send, T.StructType([*kept, *extra]))
    table = _plan_table(spark, plan)
    q = _spread(sent.join(table, _CELL), "chunk", "qid", "sub")
    return _search(q, _spread(p.join(table, _CELL), "sub", "passage_id", "chunk"), k, threshold, n_keys)


def bounds(q: DataFrame, near: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """Queries with ``kth``, what another cell must offer: the k-th score so far, or the threshold."""
    scores = near.groupBy("qid", "source").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    floor = F.greatest(F.lit(-1.0 if threshold is None else float(threshold)), "kth")
    return q.join(scores, ["qid", "source"], "left").withColumn("kth", floor)


def _cell_search(
    q: DataFrame,
    p: DataFrame,
    subs: dict[str, int],
    k: int,
    threshold: float | None,
    n_keys: int,
    most: int,
    limits: BlockLimits,
    cores: int,
) -> DataFrame:
    """Hits by cells of the nearest pivot: a query's own cell first, then those within reach.

    The k-th score in its own cell, or the threshold if that is higher, bounds what another
    cell must offer a query.  Together the two searches hold the best k.
    """
    wanted = {s: min(limits.max_pivots, n) for s, n in subs.items()}
    sample = Window.partitionBy("source").orderBy(F.xxhash64("passage_id"), "passage_id")
    rows = (
        p.select("source", "passage_id", "embedding")
        .withColumn("pick", F.row_number().over(sample))
        .where(F.col("pick") <= limits.max_pivots)
        .where(F.col("pick") <= _per_source(wanted))
        .collect()
    )
    pivots = {
        s: np.array([r["embedding"] for r in rows if r["source"] == s], dtype=np.float64)
        for s in wanted
    }
    # Stored, since each is read by the counts and by both searches.
    p = materialize(assigned(p, "embedding", pivots), "cells")
    q = materialize(assigned(q, "qvec", pivots).drop("angle"), "own-cells")
    # A zero vector has no direction and scores 0 everywhere, so its angle of 90 degrees is
    # as good as any: a bound above 0 rules it out and one up to 0 reaches 90 degrees.
    cells = {
        (r["source"], r["cell"]): (r["n"], r["low"], r["high"])
        for r in p.groupBy("source", "cell")
        .agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        .collect()
    }
    p = p.drop("angle")
    asked = {(r["source"], r["cell"]): r["count"] for r in q.groupBy(*_CELL).count().collect()}
    sizes = {key: (cells[key][0], n) for key, n in asked.items() if key in cells}
    near = _no_hits(q)
    if sizes:
        plan = _splits(sizes, most, limits.least_rows, cores)
        near = materialize(_best(search_own(q, p, plan, k, threshold, n_keys), k), "near-hits")
    bounded = materialize(bounds(q, near, k, threshold), "bounded")
    asked = needed_cells(bounded, pivots, cells)
    if not asked:
        return near
    found = search_needed(bounded, p, pivots, cells, asked, k, threshold, n_keys, most, limits.least_rows, cores)
    return near.unionByName(found)


# --- single query, index tables, evidence ---------------------------------------------------


def retrieve(
    index: DataFrame, vector: Sequence[float], k: int = 5, threshold: float = 0.55
) -> DataFrame:
    """Hits of one query vector: ``passage_id, text, score`` in rank order."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    norms = vectors.l2_norm(F.col("embedding")) * vectors.l2_norm(query)
    score = F.coalesce(F.try_divide(vectors.dot(F.col("embedding"), query), norms), F.lit(0.0))
    # The limit comes first: a filter on the score would evaluate the product twice.
    best = (
        index.select("passage_id", "text", F.round(score, SCORE_DIGITS).alias("score"))
        .orderBy(F.desc("score"), F.asc("passage_id"))
        .limit(k)
    )
    return best.where(F.col("score") >= threshold)


def passage_hash(source: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", source, text), 256)


def embed_passages(passages: DataFrame, encoder: Encoder) -> DataFrame:
    """``source, passage_id, text`` to index rows."""
    return passages.select(
        "source",
        "passage_id",
        "text",
        passage_hash(F.col("source"), F.col("text")).alias("passage_hash"),
        vectors.encode_text(encoder)(F.col("text")).alias("embedding"),
    )


def missing_from_index(passages: DataFrame, index: DataFrame) -> DataFrame:
    """Passages whose text the index does not hold yet; only these need encoding."""
    hashed = passages.withColumn(
        "passage_hash", passage_hash(F.col("source"), F.col("text"))
    )
    known = index.select("passage_hash").distinct()
    return hashed.join(known, "passage_hash", "left_anti").select(*passages.columns)


def embed_missing(passages: DataFrame, index: DataFrame, encoder: Encoder) -> DataFrame:
    """Index rows to append so that the index covers ``passages``."""
    return embed_passages(missing_from_index(passages, index), encoder)


def index_status(passages: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row per registered source: passages found and whether an index can be built."""
    spark = passages.sparkSession
    known = spark.createDataFrame([(s,) for s in sources], "source string")
    counts = passages.groupBy("source").agg(F.count("*").alias("n_passages"))
    found = F.coalesce(F.col("n_passages"), F.lit(0))
    return known.join(counts, "source", "left").select(
        "source",
        found.alias("n_passages"),
        F.when(found > 0, F.lit("built")).otherwise(F.lit("skipped")).alias("status"),
    )


def hit_texts(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Attach passage texts to hits.

    The distinct hit ids are few, so the passages are cut down to those first and a
    passage that very many queries hit is a single row there.  ``hits`` is read twice:
    pass a materialized frame.
    """
    key = ["source", "passage_id"]
    needed = hits.select(*key).distinct()
    texts = passages.select(*key, "text").join(needed, key, "left_semi")
    return hits.join(texts, key)


def evidence_of_hits(
    hits: DataFrame, by: Sequence[str], max_tokens: int | None = None
) -> DataFrame:
    """Hit texts of a group joined in rank order, with hit statistics.

    ``max_tokens`` cuts the text to so many words, for a scorer that takes no more.

    A group has at most top-k hits, so collecting it is safe.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    joined = F.array_join(F.transform(ranked, lambda r: r["text"]), " ")
    return hits.groupBy(*by).agg(
        tx.truncate_words(joined, max_tokens).alias("evidence"),
        F.count("*").cast("int").alias("n_retrieved"),
        F.max("score").alias("retrieval_sim_max"),
        F.round(F.avg("score"), SCORE_DIGITS).alias("retrieval_sim_mean"),
    )


def exemplar_index(labelled: DataFrame, encoder: Encoder) -> DataFrame:
    """Labelled claims embedded by question and answer together."""
    both = F.concat_ws(" ", F.col("prompt_bn"), F.col("response_bn"))
    return labelled.select(
        F.lit("exemplars").alias("source"),
        F.col("id").alias("passage_id"),
        F.col("context"),
        F.col("prompt_bn"),
        F.col("response_bn"),
        F.col("label").cast("int").alias("label"),
        F.trim("prompt_bn").alias("prompt_key"),
        F.trim("response_bn").alias("response_key"),
        vectors.encode_text(encoder)(both).alias("embedding"),
    )


def exemplar_hits(
    claims: DataFrame, exemplars: DataFrame, encoder: Encoder, k: int = 3, **options: object
) -> DataFrame:
    """Nearest exemplars per claim, never one with the same question or the same answer."""
    both = F.concat_ws(" ", F.col("prompt_bn"), F.col("response_bn"))
    queries = claims.select(
        F.col("id").alias("qid"),
        F.lit("exemplars").alias("source"),
        F.trim("prompt_bn").alias("q_prompt"),
        F.trim("response_bn").alias("q_response"),
        vectors.encode_text(encoder)(both).alias("qvec"),
    )
    return topk_join(
        queries,
        exemplars,
        sources=["exemplars"],
        k=k,
        threshold=None,
        dim=getattr(encoder, "dim", None),
        exclude=[("q_prompt", "prompt_key"), ("q_response", "response_key")],
        **options,
    )


def exemplar_lists(hits: DataFrame, exemplars: DataFrame) -> DataFrame:
    """``id, exemplars``: the chosen exemplars of a claim as a ranked array."""
    fields = ["context", "prompt_bn", "response_bn", "label"]
    shots = exemplars.select("passage_id", *fields)
    needed = hits.select("passage_id").distinct()
    joined = hits.join(shots.join(needed, "passage_id", "left_semi"), "passage_id")
    ranked = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return joined.groupBy(F.col("qid").alias("id")).agg(
        F.transform(
            ranked, lambda r: F.named_struct(*[x for f in fields for x in (F.lit(f), r[f])])
        ).alias("exemplars")
    )
