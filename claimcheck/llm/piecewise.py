"""Context-triggered piecewise hashing: chunk signatures at two block sizes, and their likeness.

A rolling hash of the last seven bytes ends a chunk where it takes a certain value modulo the
block size, so an edit changes the chunks that it touches and no others.  A fingerprint is
``block size:signature:signature at twice the block size``, one character for each chunk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimcheck.llm.common import stored, table

WINDOW = 7
LEAST_BLOCK = 3
#: Chunks that a block size is chosen for.
CHUNKS = 64
#: A chunk without a trigger ends after so many block sizes, one with a trigger not before half of one.
LONGEST = 4
#: Different texts must share a run of so many chunks before they count as alike at all.
COMMON = 5
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolling(data: bytes) -> np.ndarray:
    """A hash of the window that ends at each byte (a shorter one at the begin)."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(len(raw), dtype=np.uint32)
    factor = np.uint32(1)
    for back in range(min(WINDOW, len(raw))):
        out[back:] += (raw[: len(raw) - back] + np.uint32(1)) * factor
        factor = np.uint32(int(factor) * 0x01000193 & 0xFFFFFFFF)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def _signature(data: bytes, triggers: list[int], block: int) -> str:
    out, begin, n = [], 0, len(data)
    least, most = max(1, block // 2), block * LONGEST
    view = memoryview(data)

    def close(end: int) -> None:
        nonlocal begin
        out.append(_ALPHABET[zlib.crc32(view[begin:end]) & 63])
        begin = end

    for at in triggers:
        while at - begin > most:
            close(begin + most)
        if at - begin >= least:
            close(at)
    while n - begin > most:
        close(begin + most)
    if begin < n:
        close(n)
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes; equal bytes have equal fingerprints."""
    block = LEAST_BLOCK
    while block * CHUNKS < len(data):
        block *= 2
    rolling = _rolling(data)
    ends = np.flatnonzero(rolling % np.uint32(block) == block - 1)
    rare = ends[rolling[ends] % np.uint32(2 * block) == 2 * block - 1]
    one, two = _signature(data, (ends + 1).tolist(), block), _signature(data, (rare + 1).tolist(), 2 * block)
    return f"{block}:{one}:{two}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and changes from ``a`` to ``b``, a column of the table in one number."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        diagonal = ((same & plus) + plus ^ plus) | same | minus
        rise, fall = minus | ~(diagonal | plus) & full, plus & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = rise << 1 | 1
        plus = (fall << 1 | ~(diagonal | rise)) & full
        minus = rise & diagonal & full
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    shorter = min(len(a), len(b))
    if not shorter:
        return 0.0
    run = min(COMMON, max(1, shorter // 2))
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: edit distance of the signatures at block sizes that both fingerprints have, the best one."""
    if a == b:
        return 1.0
    (m, *x), (n, *y) = a.split(":"), b.split(":")
    one = {int(m) << k: s for k, s in enumerate(x)}
    two = {int(n) << k: s for k, s in enumerate(y)}
    return max((_alike(one[k], two[k]) for k in one.keys() & two.keys()), default=0.0)


_FIELDS = {
    "doc_id": "long",
    "n_chars": "long",
    "edited_sha256": "string",
    "fingerprint": "string",
    "edited_fingerprint": "string",
    "near_edited": "double",
    "near_next": "double",
}
_SCHEMA = ", ".join(f"{n} {k}" for n, k in _FIELDS.items())
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], fields: dict[str, str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(c, _ARROW[k]) for c, k in zip(columns, fields.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(fields))


def compared(doc_id: int | None, text: str, after: str, own: str | None = None, other: str | None = None) -> tuple:
    """A result row: ``text`` against its edited form and against the text after it."""
    own = own or fingerprint(text.encode("utf-8", "surrogatepass"))
    other = other or fingerprint(after.encode("utf-8", "surrogatepass"))
    cut = len(text) // 4
    edited = (text[: len(text) - cut] + after[:cut]).encode("utf-8", "surrogatepass")
    changed = fingerprint(edited)
    digest = hashlib.sha256(edited).hexdigest()
    return doc_id, len(text), digest, own, changed, likeness(own, changed), likeness(own, other)


_ENDS = _FIELDS | {"part": "int", "first_text": "string", "last_text": "string"}


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of a sorted range; its first and its last text come apart, for its neighbours."""
    part = TaskContext.get().partitionId()
    nothing = (None,) * (len(_FIELDS) - 1)
    before: tuple | None = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            own = fingerprint(text.encode("utf-8", "surrogatepass"))
            if before is None:
                rows.append((doc_id, *nothing, part, text, None))
            else:
                row = compared(before[0], before[1], text, before[2], own)
                rows.append((*row, None, None, None))
            before = (doc_id, text, own)
        yield _batch(rows, _ENDS)
    if before is not None:
        yield _batch([(before[0], *nothing, part, None, before[1])], _ENDS)


def piecewise(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    One row for every row of ``docs``, each whole text (null: empty) against its edited form
    and the next document in ascending doc_id (after the last the first; a single document is
    its own next).  Rows without an id come first; rows of equal ids follow each other by
    their texts.  Other columns are not read; an empty table gives an empty one.

    The rows are dealt out in ranges of doc_id and sorted there, which moves each text once.
    What a range cannot know, the text after its last, is looked up afterwards among the first
    texts of all ranges: one row for each partition of the shuffle.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    schema = ", ".join(f"{n} {k}" for n, k in _ENDS.items())
    ranged = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    walked = stored(ranged.mapInArrow(_walk, schema), "piecewise")
    firsts = walked.where("first_text IS NOT NULL").select("part", "first_text")
    lasts = walked.where("last_text IS NOT NULL").select("doc_id", "last_text", "part")
    order = firsts.select("part").withColumn("one", F.lit(0))
    over = Window.partitionBy("one").orderBy("part")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = order.select(
        "part", F.coalesce(F.lead("part").over(over), F.min("part").over(whole)).alias("after")
    )
    after = firsts.select(F.col("part").alias("after"), F.col("first_text").alias("next_text"))
    pairs = lasts.join(order, "part").join(after, "after").select("doc_id", "last_text", "next_text")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            yield _batch([compared(*row) for row in rows], _FIELDS)

    inner = walked.where("fingerprint IS NOT NULL").select(*_FIELDS)
    return inner.union(pairs.mapInArrow(join, _SCHEMA))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise(table(spark, sf_dir, "documents"))
