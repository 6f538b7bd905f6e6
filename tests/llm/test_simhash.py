import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimcheck.llm import simhash
from claimcheck.llm.components import components

from .helpers import ODD, SF2, groups, nothing, odd


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_groups(rows):
    prints = [slow_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = groups(len(rows), pairs)
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, root, strict=True)]


def sortable(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sortable(got) == sortable(slow_groups(rows))


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert sortable(got) == sortable(slow_groups(ODD))
    assert simhash.near_duplicates(nothing(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    kept = simhash.deduplicated(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sortable(r[:1] for r in kept.collect()) == sortable([(1,), (2,), (None,), (6,), (7,)])
    assert simhash.deduplicated(nothing(spark)).collect() == []


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_large_bucket_is_split(spark, blocks):
    """Thousands of close fingerprints around one, so that every bucket is too large at first."""
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 2**63))
    found = {center}
    while len(found) < 2500:
        flips = rng.choice(40, size=rng.integers(1, 5), replace=False) + 20
        found.add(center ^ sum(1 << int(f) for f in flips))
    found |= {int(x) for x in rng.integers(0, 2**63, size=300)}
    found = sorted(found)
    bits = spark.createDataFrame([(x if x < 2**63 else x - 2**64,) for x in found], "bits long")
    got = {r.node: r.root for r in components(simhash.links(bits, blocks=blocks)).collect()}
    array = np.array(found, dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(array)) for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= 4)]
    root = groups(len(found), pairs)
    linked = {i for p in pairs for i in p}
    signed = [x if x < 2**63 else x - 2**64 for x in found]
    want = {}
    for i in linked:
        want.setdefault(root[i], []).append(signed[i])
    assert got == {x: min(members) for members in want.values() for x in members}


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(1)
    path = [(i, i + 1) for i in range(60)]
    star = [(100, int(x)) for x in range(101, 400)]
    loose = [tuple(int(x) for x in rng.integers(1000, 1100, size=2)) for _ in range(60)]
    edges = [*path, *star, *loose, (5, 5), (7, None), (None, None), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    root = groups(1100, real)
    assert got == {x: root[x] for e in real for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_copies_are_one_node(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text in every row of it").alias("text"))
    got = simhash.near_duplicates(docs)
    assert got.select("component_id").distinct().collect()[0][0] == 0 and got.count() == 3000


def test_links_of_both_searches_count(spark):
    """One text's fingerprint is near a second's, another search links the second and a third."""
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:-1]), "something else altogether, of a few words", "one more of its own kind"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.near_duplicates(docs).where("component_id = 0").count() == 2
    more = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 3)], "doc_id long, component_id long")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs, more).collect()) == [0, 3]
