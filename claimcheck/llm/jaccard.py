"""Near-duplicates by Jaccard similarity: MinHash bands find candidates, exact sets decide.

Two texts are near-duplicates if the sets of their shingles of ``WIDTH`` words share at least
``SHARE`` of their union.  A band is ``ROWS`` minima of a text's shingle hashes; texts of
similarity s agree in some band with probability 1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8.

A text is first compared with one other, the least of those it shares a band with, so a family
of copies is linked with one look at each text.  Bands whose texts are all linked by then are
done.  What the other bands connect is dealt out by group, and there all sets that are not
linked yet are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import by_key, is_empty, mixed, signed, sorted_groups, stored
from claimcheck.llm.components import components

WIDTH = 5
#: The least similarity, as a fraction of whole numbers: no pair at the bound is lost to rounding.
SHARE = (4, 5)
ROWS, BANDS = 5, 24
#: Texts and shingles that a task compares at once, two chunks of them; one longer text is a chunk.
CHUNK, CHUNK_SHINGLES = 1024, 1_000_000
_STEP = 1024
_FACTORS = mixed(np.arange(1, ROWS * BANDS + 1), 5) | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """A hash of a text's words in order, and the hashes of its shingles, repeats included.

    A-Z become lower case; words stand between ASCII white space; a text of fewer words than
    ``width`` has one shingle, all of them; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    whole = hashed(joined, 7)
    if len(words) <= width:
        return whole, np.array([hashed(joined, 42)] if words else [], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    return whole, np.fromiter((hashed(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(starts))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of a text with shingles."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP]
        np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(axis=1), out=least)
    return mixed(np.arange(BANDS), *least.reshape(BANDS, ROWS).T)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, keys = [], [], []
        for text in batch.column("text"):
            node, hashes = shingles(text.as_py())
            nodes.append(node)
            sizes.append(len(hashes))
            keys.append(signed(bands(hashes)) if len(hashes) else [])
        columns = [pa.array(signed(np.array(nodes, dtype=np.uint64))), pa.array(sizes, pa.int64())]
        columns.append(pa.array(keys, pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("raw"), *columns], ["doc_id", "raw", "node", "size", "keys"]
        )


def _sliced(members: DataFrame, group: str) -> DataFrame:
    """``slices``: in how many parts the members (``node, size``) of a group are dealt out."""
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES))
    return members.join(members.groupBy(group).agg(parts.cast("int").alias("slices")), group)


def _first_looks(shared: DataFrame, facts: DataFrame) -> DataFrame:
    """``node, task, side, class``: each text beside the least one it shares a band with.

    A text that others are compared with is there on side 0 of each part of its group.
    """
    least = shared.groupBy("key").agg(F.min("node").alias("first"))
    looks = shared.join(least, "key").groupBy("node").agg(F.min("first").alias("head")).where("node != head")
    looks = stored(_sliced(looks.join(facts, "node"), "head"), "looks")
    heads = looks.groupBy("head").agg(F.max("slices").alias("slices")).withColumnRenamed("head", "node")
    part = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    members = looks.select("node", F.xxhash64("head", part).alias("task"), F.lit(1).alias("side"))
    firsts = heads.withColumn("part", every).select("node", F.xxhash64("node", "part").alias("task"), F.lit(0).alias("side"))
    # Members of one side are not compared with each other, so a class does not matter.
    return members.union(firsts).withColumn("class", F.col("node"))


def _second_looks(shared: DataFrame, facts: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, task, side, class``: what bands with texts of several classes connect, in chunk pairs."""
    known = shared.join(classes.select("node", F.col("root").alias("class")), "node", "left")
    known = stored(known.withColumn("class", F.coalesce("class", "node")), "classes")
    mixed = known.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("node").alias("first"))
    open_ = known.join(mixed.where("low != high").select("key", "first"), "key")
    groups = components(open_.where("node != first").select("node", "first"))
    members = open_.select("node", "class").distinct().join(groups, "node").join(facts, "node")
    members = _sliced(stored(members, "members"), "root")
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    pairs = members.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    task = F.xxhash64("root", F.least("own", "with"), F.greatest("own", "with")).alias("task")
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") > F.col("with"), 1).otherwise(0)
    return pairs.select("node", task, side.alias("side"), "class")


def _spanning(sets: list[np.ndarray], side: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect similar sets of different classes, at most one for each set.

    Sets of side 0 and 1 are compared with the other side, those of side 2 with all.  What is
    linked, by class or found here, goes on to be compared with the rest only.
    """
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    whole = [codes[b - n : b] for b, n in zip(ends, sizes, strict=True)]
    marked = np.zeros(int(codes.max()) + 1, dtype=np.uint8)
    todo, out, (share, of) = np.arange(len(sets)), [], SHARE
    flat, held = codes, todo  # the codes of the sets in ``held``, which ``todo`` is a part of
    while len(todo):
        front = [int(todo[0])]
        same = classes[todo] == classes[todo[0]]
        front += todo[same][1:].tolist()
        todo = todo[~same]
        while front and len(todo):
            node = front.pop()
            if 2 * sizes[todo].sum() < len(flat):
                flat, held = np.concatenate([whole[k] for k in todo]), todo
            marked[whole[node]] = 1
            starts = np.cumsum(sizes[held]) - sizes[held]
            both = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            marked[whole[node]] = 0
            near = both * of >= (sizes[held] + sizes[node] - both) * share
            near &= np.isin(held, todo, assume_unique=True) & ((side[held] == 2) | (side[held] != side[node]))
            new = held[near]
            if len(new):
                out += [(node, int(x)) for x in new]
                joined = np.isin(classes[todo], classes[new])
                front += todo[joined].tolist()
                todo = todo[~joined]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group, begins in sorted_groups(batches, "task"):
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            sets: dict[int, tuple] = {}
            columns = (group.column(c).slice(a, b - a) for c in ("node", "text", "side", "class"))
            for node, text, side, own in zip(*columns, strict=True):
                found, hashes = shingles(text.as_py())
                # Rows that repeat an id may have other texts than the one that is meant.
                if found == node.as_py() & 0xFFFFFFFFFFFFFFFF:
                    sets[found] = np.unique(hashes), side.as_py(), own.as_py()
            if len(sets) > 1:
                nodes = signed(np.array(list(sets), dtype=np.uint64))
                hashes, side, own = zip(*sets.values(), strict=True)
                pairs = np.array(_spanning(hashes, np.array(side), np.array(own)), dtype=np.int64).reshape(-1, 2)
                columns = [pa.array(nodes[pairs[:, side]]) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _ident(docs: DataFrame) -> DataFrame:
    """``doc_id, text, raw``; ``raw`` stands in for a missing id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("raw"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``.

    ``component_id``: the smallest doc_id that links of similar texts reach.  Texts of equal
    words, or without a word (null, empty, blank), are one node of the search.  A row without
    a doc_id counts as a link between others; its component's id is null only if no member
    has an id.  Other columns are not read.  An empty table gives an empty one.

    A group that bands connect is compared in pairs of chunks, so no task holds a large group.
    """
    rows = _ident(docs)
    schema = "doc_id long, raw long, node long, size long, keys array<long>"
    sketches = stored(rows.mapInArrow(_sketch, schema), "sketches")
    ident = F.coalesce(F.min("doc_id"), F.min("raw")).alias("ident")
    nodes = sketches.groupBy("node").agg(
        F.min("doc_id").alias("least"), ident, F.first("size").alias("size"), F.first("keys").alias("keys")
    )
    nodes = stored(nodes, "nodes")
    facts = nodes.select("node", "ident", "size")
    shared = nodes.select("node", F.explode("keys").alias("key"))
    shared = shared.join(shared.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
    shared = stored(shared, "shared")

    # Whole texts move once, and only those of nodes that share a band are kept for the looks.
    # A hint, since a broadcast that fits small inputs alone would only hide what large ones cost.
    some = shared.select("node").distinct().join(facts.select("node", "ident"), "node").hint("merge")
    texts = rows.select(F.coalesce("doc_id", "raw").alias("ident"), "text").join(some, "ident").select("node", "text")
    texts = stored(texts, "shared-texts")

    def linked(wanted: DataFrame, name: str) -> DataFrame:
        rows = texts.join(wanted.hint("merge"), "node")
        return stored(by_key(rows, "task", _compare, "a long, b long"), name)

    classes = stored(components(linked(_first_looks(shared, facts), "first-links")), "families")
    more = linked(_second_looks(shared, facts, classes), "second-links")
    roots = classes
    if not is_empty(more):
        roots = components(more.union(classes.select("node", "root")))
    roots = roots.select("node", F.col("root").alias("top"))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("top", "node").alias("top"))
    ids = named.groupBy("top").agg(F.min("least").alias("component_id"))
    return sketches.select("doc_id", "node").join(named.join(ids, "top").select("node", "component_id"), "node").drop("node")
