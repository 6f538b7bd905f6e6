import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import negatives

from .helpers import SF2

SCHEMA = "vec_id long, label int, embedding array<double>, rank int, score string, block int, dim int"


def slow(rows, every=3, positives=5, count=10):
    """All pairs in whole numbers; ``rows`` are distinct."""
    good = [
        (i, label, [int(x) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, la, va in good:
        if a % every:
            continue
        scored = [
            (-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(va, v, strict=True)))), i, label)
            for i, label, v in good
            if i != a and len(v) == len(va)
        ]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:positives]:
            fits = sorted(x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:count])]
    return sorted(out)


def got(spark, rows, every=3, **options):
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize(("values", "chunk"), [(64 * 40, 7), (1 << 19, 256)])
def test_equals_all_pairs_in_any_blocks(spark, values, chunk):
    rng = np.random.default_rng(1)
    vectors = np.floor(20 * rng.standard_normal((260, 11)) * rng.uniform(0.2, 3, (260, 1)))
    vectors[50:90] = vectors[:40] + np.floor(2 * rng.standard_normal((40, 11)))
    vectors[90:130] = vectors[3]  # ties
    rows = [(k, int(k % 4 if k % 5 else 7), [float(x) for x in v]) for k, v in enumerate(vectors)]
    want = slow(rows)
    assert len(want) > 1000
    assert got(spark, rows, block_values=values, chunk=chunk) == want


def test_one_label_holds_nearly_all(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(k < 4), [float(x) for x in np.floor(9 * rng.standard_normal(6))]) for k in range(150)]
    assert got(spark, rows, block_values=64 * 30, chunk=10) == slow(rows)


def test_odd_rows(spark):
    nan, inf, big = float("nan"), float("inf"), 1e200
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [2.0, 1.0]), (3, None, [1.0, 2.0]), (None, 1, [1.0, 2.0]),
        (4, 1, None), (5, 1, [nan, 1.0]), (6, 1, [inf, 1.0]), (7, 1, [None, 1.0]), (8, 2, [0.0, 0.0]), (9, 1, [0.0, 0.0]),
        (10, 2, [1.0, 0.0]), (11, 2, [1.0]), (12, 2, []), (15, 1, []), (16, 1, []), (18, 3, [-5.0, -5.0]),
        (19, 3, [5.0, 5.0]), (21, 4, [big, big]), (22, 4, [big, 1.0]), (23, 5, [3.0, -1.0]), (24, 6, [2.0**40, 1.0]),
        (25, 6, [2.0**21, 3.0]), (26, 7, [2.0**20, 5.0]),
    ]
    assert got(spark, rows) == slow(rows)
    assert got(spark, [r for r in rows if r[0] is None or r[0] < 20]) == slow([r for r in rows if r[0] is None or r[0] < 20])
    assert got(spark, rows + rows) == slow(rows)
    assert got(spark, []) == []


def test_bounds_rule_pairs_out():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.standard_normal((2000, 64)) / 8)
    ids = np.arange(2000)
    block = negatives.Block(ids, ids % 2, vectors)
    asked = np.arange(0, 2000, 100)
    windows = [[(9000, 27000)]] * len(asked)
    found = negatives.search(block, asked, asked % 2, vectors[asked], windows, False, 10)
    assert block.verified < 0.2 * len(asked) * len(ids)
    scores = vectors[asked] @ vectors.T
    for k, a in enumerate(asked):
        fits = [(-scores[k, i], i) for i in ids if i % 2 != a % 2 and 9000 <= scores[k, i] <= 27000]
        assert [(-int(s), r) for i, _, r, s in found if i == k] == sorted(fits)[:10]


def test_query_floors_and_relabels(spark, tmp_path):
    rows = spark.read.parquet(f"{SF2}/embeddings.parquet").where("vec_id < 200")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    plain = [
        (r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * x) for x in r.embedding])
        for r in rows.collect()
    ]
    found = sorted(tuple(r) for r in negatives.op13_hard_negatives(spark, str(tmp_path)).collect())
    assert found == slow(plain, 100)
