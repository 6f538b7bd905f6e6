"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, verified distance, components.

Two fingerprints of 64 bits that differ in at most ``max_bits`` places, cut into ``blocks``
blocks, agree on all bits of some ``blocks - max_bits`` of them.  Every fingerprint is dealt
to one bucket for each such choice, and only inside a bucket distances are taken.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import by_key, is_empty, mixed, signed, sorted_groups, stored, table, unsigned
from claimcheck.llm.components import components

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
#: A larger bucket is dealt out again by the bits it has not used yet.  Ten free bits hold no
#: more than this many different fingerprints, so the dealing ends.
BUCKET = 1024
_ROWS = 65536


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text: a bit is set if over half of its shingles' hashes set it.

    A-Z become lower case; words stand between ASCII white space; shingles are ``width``
    words joined by a space, repeats included (fewer words: all of them; none: zero).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    hashed, n = xxhash.xxh64_intdigest, len(starts)
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((hashed(joined[a:b], 42) for a, b in spans), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _ROWS):
        part = hashes[at : at + _ROWS].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.array([simhash(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(bits))], ["doc_id", "bits"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a signed long) for every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_fingerprint, "doc_id long, bits long")


def _choices(free: list[int], blocks: int, max_bits: int) -> list[int]:
    """Masks over the free bit positions: all bits of ``blocks - max_bits`` of the blocks."""
    parts = [sum(1 << int(p) for p in part) for part in np.array_split(free, blocks)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - max_bits)]


def _dealt(rows: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    """``key, used, bits``: every fingerprint in all buckets of the next level."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, used, bits = (unsigned(batch.column(c).to_numpy()) for c in ("key", "used", "bits"))
            for mask in np.unique(used):
                own = np.flatnonzero(used == mask)
                free = [p for p in range(64) if not int(mask) >> p & 1]
                for chosen in _choices(free, blocks, max_bits):
                    key = mixed(keys[own], chosen, bits[own] & np.uint64(chosen))
                    now = np.full(len(own), np.uint64(int(mask) | chosen))
                    columns = [pa.array(signed(x)) for x in (key, now, bits[own])]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "used", "bits"])

    return rows.mapInArrow(deal, "key long, used long, bits long")


def _linker(max_bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, begins in sorted_groups(batches, "key"):
            bits = unsigned(group.column("bits").to_numpy())
            sizes = np.diff(begins)
            first = begins[:-1][sizes == 2]
            near = np.bitwise_count(bits[first] ^ bits[first + 1]) <= max_bits
            a, b = [bits[first[near]]], [bits[first[near] + 1]]
            for k in np.flatnonzero(sizes > 2):
                own = bits[begins[k] : begins[k + 1]]
                todo = np.arange(len(own))
                while len(todo):  # one front after another; links span the group, no more
                    front, todo = [todo[0]], todo[1:]
                    while front and len(todo):
                        node = front.pop()
                        close = np.bitwise_count(own[todo] ^ own[node]) <= max_bits
                        new, todo = todo[close], todo[~close]
                        a.append(np.full(len(new), own[node]))
                        b.append(own[new])
                        front.extend(new)
            columns = [pa.array(signed(np.concatenate(x))) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return link


def links(bits: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that keep every close pair connected.

    ``bits`` has one column of distinct fingerprints.  Inside a bucket the links span the
    groups of close fingerprints, so a bucket gives fewer links than it has members, not all
    pairs.  A bucket above ``bucket`` members is split by its unused bits, again by pigeonhole,
    so no close pair is lost and no task holds a large bucket.
    """
    if not max_bits < blocks <= 10 or bucket < 1024:
        raise ValueError("blocks must lie in max_bits + 1 to 10, bucket at 1024 or above")
    zero = F.lit(0).cast("long")
    rows = bits.select(zero.alias("key"), zero.alias("used"), F.col(bits.columns[0]).alias("bits"))
    found, link = [], _linker(max_bits)
    while True:
        dealt = _dealt(rows, blocks, max_bits)
        large = dealt.groupBy("key").count().where(F.col("count") > bucket).select("key")
        large = stored(large, "buckets")
        if is_empty(large):
            found.append(by_key(dealt, "key", link, "a long, b long"))
            break
        found.append(by_key(dealt.join(large, "key", "left_anti"), "key", link, "a long, b long"))
        rows = stored(dealt.join(large, "key", "left_semi").select("key", "used", "bits"), "refined")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint``: 16 lower-case hex digits.  ``component_id``: the smallest doc_id that
    links of at most ``max_bits`` differing bits reach.  Texts without a word (null, empty,
    blank) have fingerprint zero and are linked like any other.  Rows with equal fingerprints,
    repeated rows among them, are one node of the search.  A row without a doc_id counts as a
    link between others; its component's id is null only if no member has an id.  Other
    columns are not read.  An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs), "simhash")
    nodes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(nodes.select("bits"), max_bits, blocks))
    roots = roots.select(F.col("node").alias("bits"), "root")
    nodes = nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(ids, "root").select("bits", "component_id")
    hexed = F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint")
    return prints.join(named, "bits").select("doc_id", hexed, "component_id")


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """``doc_id, component_id`` of what the links of both searches connect.

    Rows without a doc_id have their say inside each search, they do not carry one into the other.
    """
    both = found.select("doc_id", "component_id").union(more.select("doc_id", "component_id"))
    both = stored(both.where("doc_id IS NOT NULL").distinct(), "classes")
    roots = components(both)
    ids = both.select("doc_id").distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return ids.select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, all columns kept.

    ``more`` has ``doc_id, component_id`` of a further search, whose links count besides those
    of the fingerprints.  Of rows that repeat that doc_id one stays.  Rows without a doc_id
    cannot be named as copies of each other and stay.
    """
    found = near_duplicates(docs)
    found = found if more is None else _joined(found, more)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(docs.columns)
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    if not is_empty(ids.where("count > 1")):
        kept = kept.dropDuplicates(["doc_id"])
    return kept.union(docs.where("doc_id IS NULL"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
