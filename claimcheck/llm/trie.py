"""Prefix trie of conversations, by collapsing whole sequences.

Equal conversations become one weighted sequence with a list of ends.  Sequences that are a
proper prefix of another are dropped by an anti-join; the others are the leaves.  A node is a
prefix of a sequence, and everything about it is a sum, a minimum or a count over the
sequences that pass through it, weighted: no node is ever carried to all its ancestors, so
the work grows with the number of turns and not with the square of a long conversation.

A prefix is named by its depth and 128 bits: each turn's role, text and place are hashed,
and a prefix has the exclusive or of its turns.  Texts do not leave the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimcheck.llm.common import stored, table

#: Turns that one window holds: a long conversation is several windows.
RUN = 4096
#: Ids that one list of ends holds at most: a longer list is several.
IDS = 65536
#: What names a node.
KEY = ["depth", "key_a", "key_b"]
_NULL_RUN = -(2**63)


def placed(turns: DataFrame, run: int = RUN) -> DataFrame:
    """``conv_id, place, turn_a, turn_b, chars``: the turns of each conversation numbered from 1.

    ``turns`` has ``conv_id, turn, role, text``.  Turns come in order, null first; equal ones by
    role, then by the text's MD5.  Null roles and texts are empty; rows without a conv_id take
    no part; rows that repeat are turns of their own.  Other columns are not read.

    A conversation is cut by ``run`` turn numbers, each part is numbered on its own and moved
    on by the sizes of those before it, so a long one is not one task's.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn").cast("long") / run), F.lit(_NULL_RUN)).alias("run"),
        role.alias("role"),
        F.md5(F.encode(text, "UTF-8")).alias("digest"),
        F.xxhash64(role, text).alias("turn_a"),
        F.xxhash64(F.lit("second"), role, text).alias("turn_b"),
        F.length(text).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv_id", "run").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "run").count()
    sizes = sizes.select("conv_id", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("passed"))
    rows = rows.withColumn("within", F.row_number().over(order)).join(sizes, ["conv_id", "run"])
    return rows.select("conv_id", (F.col("within") + F.col("passed")).alias("place"), "turn_a", "turn_b", "chars")


def _hashed(steps: DataFrame) -> DataFrame:
    place = ["place", "turn_a", "turn_b"]
    return steps.select(
        "conv_id",
        "place",
        F.xxhash64(*place).alias("step_a"),
        F.xxhash64(F.lit("second"), *place).alias("step_b"),
        "chars",
    )


def sequences(steps: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole conversations, and the distinct sequences they collapse into.

    ``steps`` has ``conv_id, place, turn_a, turn_b, chars`` with places from 1 without gaps,
    ``ids`` every ``conv_id`` once, those without a turn too.  The first frame has ``conv_id``
    and the key of its sequence, the end list of a sequence as rows; the second the key,
    ``rep`` (the smallest member), ``weight`` (how many are equal) and ``total`` characters.
    """
    whole = _hashed(steps).groupBy("conv_id").agg(
        F.count("*").alias("depth"), F.bit_xor("step_a").alias("key_a"), F.bit_xor("step_b").alias("key_b"),
        F.sum("chars").alias("total"),
    )
    names = [*KEY, "total"]
    ends = ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    ends = stored(ends, "trie-ends")
    found = ends.groupBy(*KEY).agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.min("total").alias("total")
    )
    return ends, stored(found, "trie-sequences")


def _prefixes(steps: DataFrame, found: DataFrame, run: int) -> DataFrame:
    """``rep``, key, ``inner``, parent's key, ``chars`` and ``passed`` for each prefix of each sequence.

    ``chars``: of the last text; ``passed``: of all texts; ``inner``: whether the sequence goes on.
    """
    ends = found.select(F.col("rep").alias("conv_id"), F.col("depth").alias("length"))
    rows = _hashed(steps).join(ends, "conv_id").withColumn("run", F.floor((F.col("place") - 1) / run))
    upto = Window.partitionBy("conv_id", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"key_a": F.bit_xor("step_a"), "key_b": F.bit_xor("step_b"), "passed": F.sum("chars")}
    runs = rows.groupBy("conv_id", "run").agg(*[x.alias(c) for c, x in sums.items()])
    # The parts before a run: exclusive or of keys, sum of characters.
    earlier = {"key_a": F.bit_xor("key_a"), "key_b": F.bit_xor("key_b"), "passed": F.sum("passed")}
    runs = runs.select(
        "conv_id", "run", *[F.coalesce(x.over(before), F.lit(0)).alias(f"run_{c}") for c, x in earlier.items()]
    )
    rows = rows.select("*", *[x.over(upto).alias(c) for c, x in sums.items()]).join(runs, ["conv_id", "run"])
    key_a, key_b = (F.col(c).bitwiseXOR(F.col(f"run_{c}")) for c in ("key_a", "key_b"))
    rows = rows.select(
        F.col("conv_id").alias("rep"),
        F.col("place").cast("long").alias("depth"),
        key_a.alias("key_a"),
        key_b.alias("key_b"),
        (F.col("place") < F.col("length")).alias("inner"),
        key_a.bitwiseXOR(F.col("step_a")).alias("parent_a"),
        key_b.bitwiseXOR(F.col("step_b")).alias("parent_b"),
        "chars",
        (F.col("passed") + F.col("run_passed")).alias("passed"),
    )
    zero = F.lit(0).cast("long")
    root = found.select(
        "rep", *[zero.alias(c) for c in KEY], (F.col("depth") > 0).alias("inner"),
        *[zero.alias(c) for c in ("parent_a", "parent_b", "chars", "passed")],
    )
    return stored(rows.union(root), "trie-prefixes")


def leaves(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The sequences that are a proper prefix of no other."""
    return found.join(prefixes.where("inner").select(*KEY).distinct(), KEY, "left_anti")


def nodes(steps: DataFrame, found: DataFrame, run: int = RUN) -> DataFrame:
    """Every distinct prefix: key, ``conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens``.

    ``conv_id``: the smallest member of those that begin with the prefix; the root has depth 0
    and no parent.  ``saved_tokens``: over all nodes below and the node itself, its members
    less one times the characters of its last text.

    With T the characters of a sequence and C those before the node's last text, the members'
    part of that sum is weight * (T - C) over the sequences through the node.  The nodes that
    count once each are told apart by their smallest member, who owns them: what one sequence
    owns is the end of its path, so below a node it is all that its sequences own, but for the
    node's own member, who owns a part above it too.
    """
    prefixes = _prefixes(steps, found, run)
    first = prefixes.groupBy(*KEY).agg(F.min("rep").alias("rep"), F.min(F.col("passed") - F.col("chars")).alias("start"))
    owned = first.groupBy("rep").agg(F.min("start").alias("start"))
    leaf = leaves(found, prefixes).select("rep", F.lit(1).cast("long").alias("leaf"))
    facts = found.select("rep", "weight", "total").join(owned, "rep", "left").join(leaf, "rep", "left")
    facts = facts.select(
        "rep", "weight", "total",
        F.coalesce(F.col("total") - F.col("start"), F.lit(0)).alias("owned"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    out = prefixes.join(facts, "rep").groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("total")).alias("all_chars"),
        F.sum("owned").alias("all_owned"),
        F.min_by(F.struct("total", "owned"), "rep").alias("own"),
        F.min(F.col("passed") - F.col("chars")).alias("start"),
        F.min("parent_a").alias("parent_a"),
        F.min("parent_b").alias("parent_b"),
    )
    once = F.col("all_owned") - F.col("own.owned") + F.col("own.total") - F.col("start")
    saved = F.col("all_chars") - F.col("n_convs") * F.col("start") - once
    out = out.select(*KEY, "conv_id", "n_convs", "n_leaves", saved.alias("saved_tokens"), "parent_a", "parent_b")
    out = stored(out, "trie-nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("key_a"), F.col("parent_b").alias("key_b")]
    children = out.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    parents = children.join(out.select(*KEY, F.col("conv_id").alias("parent_conv_id")), KEY)
    named = parents.select(
        (F.col("depth") + 1).alias("depth"), F.col("key_a").alias("parent_a"), F.col("key_b").alias("parent_b"),
        "parent_conv_id",
    )
    out = out.join(named, ["depth", "parent_a", "parent_b"], "left").join(children, KEY, "left")
    return out.select(
        *KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal keys; only the digest so far is held."""
    last, digest, names = None, hashlib.sha256(), [*KEY, "ends_sha256"]

    def told() -> pa.RecordBatch:
        values = [*last, digest.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], names)

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
        done: list[pa.RecordBatch] = []
        for key, ids in zip(keys, batch.column("ids"), strict=True):
            if key != last:
                if last is not None:
                    done.append(told())
                last, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if last is not None:
        yield told()


def end_digests(ends: DataFrame, ids: int = IDS) -> DataFrame:
    """Key and ``ends_sha256``: SHA-256 of a sequence's conv_ids, ascending, joined by commas.

    Ids are joined in parts of at most ``ids`` numbers, spread over tasks; the digest then takes
    one part after another, so no list is held whole however many conversations are equal.
    """
    part = F.floor(F.col("conv_id") / ids).alias("part")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy(*KEY, part).agg(joined.alias("ids"))
    parts = parts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids")
    return parts.mapInArrow(_digests, "depth long, key_a long, key_b long, ends_sha256 string")


def prefix_trie(steps: DataFrame, ids: DataFrame, run: int = RUN) -> DataFrame:
    """All nodes with their facts and ``ends_sha256`` of the members that end there.

    ``steps`` and ``ids`` as for ``sequences``.  Conversations without a turn end at the root.
    Without a conversation there is no node.
    """
    ends, found = sequences(steps, ids)
    nothing = hashlib.sha256(b"").hexdigest()
    out = nodes(steps, found, run).join(end_digests(ends), KEY, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


#: Conversation c begins with up to ``HEADS - 1`` turns of the first one of its hundred.
HEADS, HUNDRED = 6, 100


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps and ids of conversations that share their beginnings: c takes its first
    h = crc32(c) % 6 turns from conversation c - c % 100, all if there are fewer, none if it is
    not there, and goes on with its own turns after its first h."""
    own = stored(placed(turns), "trie-turns")
    ids = own.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    head = F.col("conv_id") - F.col("conv_id") % HUNDRED
    beginnings = own.where((F.col("conv_id") % HUNDRED == 0) & (F.col("place") < HEADS)).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "turn_a", "turn_b", "chars"))).alias("first")
    )
    taken = ids.select("conv_id", h.alias("h"), head.alias("head")).join(
        beginnings.withColumnRenamed("conv_id", "head"), "head", "left"
    )
    nothing = F.array().cast("array<struct<place:long,turn_a:long,turn_b:long,chars:long>>")
    taken = taken.select("conv_id", "h", F.slice(F.coalesce("first", nothing), 1, F.col("h").cast("int")).alias("taken"))
    taken = stored(taken, "trie-heads")
    begun = taken.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.*")
    rest = own.join(taken.select("conv_id", "h", F.size("taken").alias("n")), "conv_id").where("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("place"), "turn_a", "turn_b", "chars")
    return stored(begun.union(rest), "trie-steps"), ids


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that they share beginnings."""
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))
