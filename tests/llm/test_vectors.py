import numpy as np
import pytest

from claimcheck.llm import vectors

from .helpers import SF2, groups

SCHEMA = "vec_id long, label int, embedding array<float>, node string, n int, linked string"


def slow(rows, cosine):
    """All pairs in double precision."""
    good = []
    for vec, label, v in rows:
        ok = vec is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, dtype=np.float32).astype(float) if ok else None)
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = good[i], good[j]
            if a is None or b is None or rows[i][1] != rows[j][1] or len(a) != len(b):
                continue
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                pairs.append((i, j))
    ids = {}
    same = [(i, ids.setdefault(r[0], i)) for i, r in enumerate(rows) if r[0] is not None and good[i] is not None]
    root = groups(len(rows), pairs + [(i, j) for i, j in same if i != j])
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    n = [0] * len(rows)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    return sorted(((r[0], n[i], least.get(root[i])) for i, r in enumerate(rows)), key=repr)


def got(frame):
    rows = frame.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in rows)
    return sorted((tuple(r[:3]) for r in rows), key=repr)


def test_recall_and_precision_on_the_table(spark):
    frame = spark.read.parquet(f"{SF2}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in frame.collect()]
    want = {r[0]: r[1] for r in slow(rows, 0.93)}
    have = {r[0]: r[1] for r in got(vectors.near_vectors(frame))}
    assert all(have[k] <= want[k] for k in want)
    assert sum(have.values()) >= 0.99 * sum(want.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 2.0, 3.0]), (2, 0, [1.0, 2.0, 3.0]), (3, 1, [1.0, 2.0, 3.0]), (4, None, [1.0, 2.0, 3.0]),
        (5, 0, None), (6, 0, []), (7, 0, [0.0, 0.0, 0.0]), (8, 0, [nan, 1.0, 1.0]), (9, 0, [inf, 1.0, 1.0]),
        (10, 0, [1.0, None, 3.0]), (None, 0, [1.0, 2.0, 3.0]), (11, 0, [1.0, 2.0]), (12, 0, [10.0, 20.0, 30.0]),
        (13, 0, [3e38, 3e38, 0.0]), (14, 0, [1e-38, 1e-38, 0.0]), (15, 1, [1.0, 2.0, 3.0]), (15, 0, [0.0, 0.0, -1.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert got(vectors.near_vectors(frame)) == slow(rows, 0.93)
    assert vectors.near_vectors(frame.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [16, 1024])
def test_one_large_group_in_chunks(spark, chunk):
    rng = np.random.default_rng(0)
    center = rng.standard_normal(16)
    near = center + 0.25 * rng.standard_normal((150, 16))
    far = rng.standard_normal((80, 16))
    rows = [(k, k % 2 if k >= 150 else 0, [float(np.float32(x)) for x in v]) for k, v in enumerate([*near, *far])]
    rows += [(500 + k, 0, rows[0][2]) for k in range(40)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert got(vectors.near_vectors(frame, bits=3, tables=30, chunk=chunk)) == slow(rows, 0.93)
