"""Helpers shared by the operators: stored stages, Arrow batches, words, runs of sorted keys."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.session import materialize

#: Characters of text that one vectorised step works on; a longer text is a step of its own.
STEP_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back, so that no lost executor costs it."""
    return materialize(df, f"llm-{name}")


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def crc_mod(key: str, mod: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of the text column, whole rows each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        slots = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.diff(slots, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def strings(column: pa.Array) -> list[str]:
    """A column of strings as a list, without a Python object of Arrow's for each of them."""
    return column.to_numpy(zero_copy_only=False).tolist()


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a column of texts, the code of each word in order, and row offsets.

    Words are what stands between ASCII white space (0x20, 0x09 to 0x0D); null has none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64), offsets


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of several unsigned 64-bit columns."""
    with np.errstate(over="ignore"):
        out = np.uint64(0x9E3779B97F4A7C15)
        for part in parts:
            out = (out ^ np.asarray(part, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
            out = out * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(32))
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.int64).view(np.uint64)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of equal keys from batches that are sorted by ``key``: a table and where its runs begin.

    A run that goes on in the next batch is held back; a run is as long as its caller has
    bounded it, so little is held.  The begins end with the number of rows.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and keys[0] == keys[-1] == last:
            held.append(batch)
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        ready = [*held, batch.slice(0, cut)]
        held, last = [batch.slice(cut)], keys[-1]
        yield from _runs(ready, key)
    yield from _runs(held, key)


def _runs(parts: list[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    parts = [x for x in parts if x.num_rows]
    if parts:
        whole = pa.Table.from_batches(parts).combine_chunks()
        keys = whole.column(key).to_numpy()
        yield whole, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def by_key(df: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """Deal rows out by ``key``, sort, and hand Arrow batches of whole partitions to ``fn``."""
    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(fn, schema)


def spanning(close: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep a boolean matrix's groups connected: at most one for each row."""
    todo = np.ones(len(close), dtype=bool)
    out: list[tuple[int, int]] = []
    for start in range(len(close)):
        if not todo[start]:
            continue
        todo[start] = False
        front = [start]
        while front:
            node = front.pop()
            new = np.flatnonzero(close[node] & todo)
            todo[new] = False
            out += [(node, int(x)) for x in new]
            front += new.tolist()
    return out


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory.

    A worker waits for further tasks of any stage, and what it keeps counts all the while.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def one_thread() -> None:
    """Tasks are the parallel unit: libraries inside them stay on their core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
