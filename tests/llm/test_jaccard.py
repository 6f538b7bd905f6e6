import random
import re
import time
from collections import Counter

import corpus_pipeline

from claimcheck.llm import jaccard

from .helpers import ODD, SF2, groups, nothing, odd


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def slow_components(rows):
    """Component ids by comparing the shingle sets of all pairs."""
    cut = [words(t) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    pairs = []
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                pairs.append((i, j))
    root = groups(len(rows), pairs)
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((d, least.get(r)) for (d, _), r in zip(rows, root, strict=True)), key=repr)


def found(docs):
    return sorted((tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "component_id").collect()), key=repr)


def test_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == slow_components(rows)


def test_stage_drops_copies_at_the_bound(spark):
    """Copies with words changed until just 0.8 or less of the shingles are shared."""
    rng = random.Random(5)
    rows = []
    for k in range(300):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 400))]
        copy = list(text)
        for _ in range(max(1, round(len(text) * rng.uniform(0.012, 0.032)))):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted({c for _, c in slow_components(rows)})
    assert 320 < len(want) < 580
    kept = corpus_pipeline.near_duplicates(spark, docs, SF2)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_large_group_is_compared_in_chunks(spark, monkeypatch):
    rng = random.Random(6)
    text = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(60):
        copy = list(text)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == slow_components(rows)


def test_families_that_share_bands_but_little_else(spark, monkeypatch):
    """Two bases whose copies are linked at once, and texts between them that link with some copies only."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        copy = list(base)
        for at in range(k % 3 * 6, k % 3 * 6 + 4 + k % 5):
            copy[at * 3] = f"x{rng.randrange(4) if k % 2 else k}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    want = slow_components(rows)
    assert 2 < len({c for _, c in want}) < 80
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_a_large_family_of_unlike_copies_takes_seconds(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(2000):
        copy = list(base)
        for at in rng.sample(range(150), 3):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    begun = time.time()
    parts = Counter(c for _, c in found(spark.createDataFrame(rows, "doc_id long, text string")))
    assert time.time() - begun < 60 and sum(parts.values()) == 2000


def test_odd_rows(spark):
    assert found(odd(spark)) == slow_components(ODD)
    assert jaccard.near_duplicates(nothing(spark)).collect() == []
