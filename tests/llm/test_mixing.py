import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import mixing
from claimcheck.session import plan_text

from .helpers import SF2, nothing, odd


def slow_fit(tokens, p, targets, rounds=mixing.ROUNDS, tolerance=mixing.TOLERANCE):
    goal, total = np.array(targets) / sum(targets), tokens.sum()
    rates, last = np.ones(len(p)), None
    for _ in range(rounds):
        expected = (rates * tokens) @ p / total
        if np.abs(expected - goal).max() < tolerance:
            break
        if last is not None and np.abs(expected - last).max() < tolerance / 10:
            break
        metric = (p * (tokens * (rates > 0))[:, None]).T @ p / total + 1e-9 * np.eye(len(goal))
        rates = np.maximum(0, rates - p @ np.linalg.solve(metric, expected - goal))
        last = expected
    return rates


def test_steps_against_numpy(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4, 0.3, 0.2], size=400)
    tokens = rng.integers(0, 500, size=400).astype(float)
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    for targets in ([0.5, 0.3, 0.2], [0.9, 0.08, 0.02], [0.05, 0.05, 0.9]):
        steps = mixing.fit(rows, targets)
        got = rows.select("tokens", "p", mixing.rate(F.col("p"), steps).alias("r")).collect()
        want = slow_fit(np.array([r.tokens for r in got], float), np.array([r.p for r in got]), targets)
        assert np.allclose([r.r for r in got], want, atol=1e-6) and min(r.r for r in got) >= 0
        share = sum(np.array(r.p) * r.tokens * r.r for r in got) / tokens.sum()
        assert np.abs(share - np.array(targets)).max() < 1e-4


def slow_bins(text, lexicon):
    words = (text or "").strip(" \t\n\x0b\f\r").split()
    n, chars = len(words), len(text or "")
    signs = sum(not (c.isalnum() or c.isspace() or c in ".,") for c in text or "")
    raw = {
        "signs": signs / max(1, chars), "distinct": len(set(words) or {""}) / max(1, n), "length": chars / max(1, n),
        "words": n, "marked": len(set(words) & set(lexicon)),
    }
    return n, {k: sum(raw[k] > e for e in ends) for k, ends in mixing.BINS.items()}


def test_whole_run_against_python(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    domains = mixing.QUALITY_AND_TOXIC
    names = list(domains.targets)
    out, own = mixing.mixed(docs, labels, domains, keep=["doc_id"])
    got = {r.doc_id: r[own] for r in out.collect()}
    marked = {r.doc_id: "toxic" if r.toxic > 0 else "low" if r.quality == 0 else "clean" for r in labels.collect()}
    lexicon = mixing.telling_words(docs, mixing._labelled(labels, domains), "clean")
    rows = {r.doc_id: slow_bins(r.text, lexicon) for r in docs.collect()}
    size = {d: sum(marked.get(k) == d for k in rows) for d in names}
    probabilities = {}
    for doc, (_, bins) in rows.items():
        logs = []
        for d in names:
            total = math.log((size[d] + 1) / (sum(size.values()) + len(names)))
            for part, ends in mixing.BINS.items():
                same = sum(marked.get(k) == d and rows[k][1][part] == bins[part] for k in marked if k in rows)
                total += math.log((same + 1) / (size[d] + len(ends) + 1))
            logs.append(total)
        e = np.exp(np.array(logs) - max(logs))
        probabilities[doc] = e / e.sum()
    assert {k: v.tokens for k, v in got.items()} == {k: v[0] for k, v in rows.items()}
    assert all(np.allclose(got[k].p, probabilities[k]) for k in rows)
    order = sorted(rows)
    want = slow_fit(np.array([rows[k][0] for k in order], float), np.array([probabilities[k] for k in order]), list(domains.targets.values()))
    assert np.allclose([got[k].rate for k in order], want, atol=1e-4)
    assert all(got[k].copies in (math.floor(got[k].rate), math.floor(got[k].rate) + 1) for k in rows)
    assert sum(v.copies for v in got.values()) == pytest.approx(sum(v.rate for v in got.values()), rel=0.06)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        out, own = mixing.mixed(odd(spark), some)
        assert own == "mix_" and out.count() == 9 and out.columns == [*odd(spark).columns, own]
        rows = {r.doc_id: r for r in out.collect()}
        assert rows[2][own].tokens == rows[3][own].tokens == rows[4][own].tokens == 0 and rows[6][own].tokens == 60_000
        assert all(sum(r[own].p) == pytest.approx(1) and r[own].rate >= 0 for r in rows.values())
    assert mixing.mixed(nothing(spark), labels)[0].collect() == []
    again = mixing.resampled(odd(spark), labels)
    assert again.columns == odd(spark).columns
    assert mixing.resampled(nothing(spark), labels).collect() == []


def test_no_python_in_the_plan(spark):
    plan = plan_text(mixing.op2_mixing(spark, SF2))
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
