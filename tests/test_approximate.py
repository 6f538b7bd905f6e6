import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.operators import approximate, retrieval
from claimcheck.operators.approximate import LshJoin, LshLimits

Q = "qid long, source string, qvec array<double>, mine string, task int, bucket string"
P = "source string, passage_id long, embedding array<double>, yours string, id int, vector string"


def frames(spark, queries, passages):
    q = spark.createDataFrame([(i, s, v, m, 1, "x") for i, s, v, m in queries], Q)
    return q, spark.createDataFrame([(s, i, v, y, 2, "y") for i, s, v, y in passages], P)


def around(rng, base, cosine):
    """A vector at just that cosine to ``base``."""
    other = rng.standard_normal(len(base))
    unit = base / np.linalg.norm(base)
    other -= (other @ unit) * unit
    return cosine * unit + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_bits_follow_the_size_and_tables_the_bits():
    sizes = [1, 64, 65, 1000, 10**6, 10**9, 10**12]
    bits = [approximate.bits_for(n) for n in sizes]
    assert bits == sorted(bits) and bits[0] == bits[1] == 1 and bits[-1] == 24
    for n, b in zip(sizes[2:6], bits[2:6], strict=True):
        assert 32 <= n / 2**b <= 128 or b == 24
    tables = [approximate.tables_for(b, 0.8) for b in range(1, 20)]
    assert tables == sorted(tables)
    for b, t in zip(range(1, 20), tables, strict=True):
        assert 1 - (1 - (1 - np.arccos(0.8) / np.pi) ** b) ** t >= 0.95
    assert approximate.tables_for(5, 1.0) == 1


def test_recall_per_source_and_fewer_pairs(spark):
    rng = np.random.default_rng(4)
    passages = [(k, f"s{k % 2 if k < 3000 else 2}", rng.standard_normal(32), "p") for k in range(3300)]
    queries = [(k, p[1], around(rng, p[2], 0.85).tolist(), "q") for k, p in enumerate(passages) if k % 3 == 0]
    q, p = frames(spark, queries, [(i, s, v.tolist(), y) for i, s, v, y in passages])
    options = {"sources": ["s0", "s1", "s2", "none"], "k": 3, "threshold": 0.8}
    join = LshJoin(q, p, **options)
    exact = retrieval.topk_join(q, p, **options)
    counts = p.groupBy("source").count().join(q.groupBy("source").agg(F.count("*").alias("n")), "source")
    pairs = counts.select("source", (F.col("count") * F.col("n")).alias("all_pairs"))
    report = approximate.recall_report(exact, join.hits(), join.work(), pairs).collect()
    assert sorted(r.source for r in report) == ["s0", "s1", "s2"]
    assert all(0.9 <= r.recall <= 1 and r.pairs < 0.7 * r.all_pairs for r in report)
    # What is found is found with the exact score.
    known = {(r.qid, r.passage_id): r.score for r in exact.collect()}
    assert all(known[r.qid, r.passage_id] == r.score for r in join.hits().collect())


@pytest.mark.parametrize("rows", [7, 4096])
def test_one_full_bucket_is_cut_into_blocks(spark, rows):
    passages = [(k, "s", [1.0, 2.0, 3.0], f"t{k % 5}") for k in range(60)]
    q, p = frames(spark, [(k, "s", [2.0, 4.0, 6.0], f"t{k}") for k in range(20)], passages)
    join = LshJoin(q, p, sources=["s"], k=4, exclude=[("mine", "yours")], limits=LshLimits(block_rows=rows))
    got = {}
    for r in join.hits().orderBy("rank").collect():
        assert r.score == 1.0
        got.setdefault(r.qid, []).append(r.passage_id)
    assert got == {k: [i for i in range(60) if i % 5 != k][:4] for k in range(20)}


def test_odd_vectors_and_no_rows(spark):
    passages = [
        (1, "s", [1.0, 0.0], "p"), (2, "s", [0.0, 0.0], "p"), (3, "s", None, "p"), (4, "s", [], "p"),
        (5, "s", [1.0, None], "p"), (6, "s", [1.0, 0.0, 0.0], "p"), (7, "other", [1.0, 0.0], "p"), (8, None, [1.0, 0.0], "p"),
    ]
    q, p = frames(spark, [(1, "s", [1.0, 0.0], "q"), (2, "s", None, "q"), (3, "s", [0.0, 0.0], "q"), (4, None, [1.0], "q")], passages)
    found = {(r.qid, r.passage_id): r.score for r in LshJoin(q, p, sources=["s"], threshold=None).hits().collect()}
    assert found[1, 1] == 1.0 and found[3, 2] == 0.0
    assert {pid for _, pid in found} <= {1, 2} and {qid for qid, _ in found} <= {1, 3}
    assert LshJoin(q, p.limit(0), sources=["s"]).hits().collect() == []
    assert LshJoin(q.limit(0), p, sources=["s"]).hits().collect() == []


@pytest.mark.parametrize("block_rows", [5, 4096])
def test_a_few_tables_at_a_time_find_the_same(spark, monkeypatch, block_rows):
    rng, dealt, real = np.random.default_rng(9), [], approximate._dealt
    passages = [(k, f"s{k % 2}", rng.standard_normal(8).tolist(), f"t{k % 3}") for k in range(400)]
    passages += [(k, "s0", [0.0] * 8, "t") for k in range(400, 420)]  # a full bucket that no query is in
    queries = [(k, p[1], (np.array(p[2]) + 0.1).tolist(), p[3]) for k, p in enumerate(passages[:200])]
    q, p = frames(spark, queries, passages)

    def watched(rows, plan, first, last, only=False):
        if not only:
            dealt.append(min(last, max(t for _, t in plan.values())) - first)
        return real(rows, plan, first, last, only)

    monkeypatch.setattr(approximate, "_dealt", watched)
    options = {"sources": ["s0", "s1"], "k": 3, "threshold": 0.3, "similar": 0.7, "exclude": [("mine", "yours")]}
    got = {}
    for copies in (2, 1000):
        limits = LshLimits(bucket_rows=16, block_rows=block_rows, copies=copies)
        got[copies] = sorted(map(tuple, LshJoin(q, p, limits=limits, **options).hits().collect()))
        assert max(dealt) <= copies and (copies > 2 or sum(dealt) > 12)
    assert got[2] == got[1000] and len(got[2]) > 300
