import inspect
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimcheck.functions import vectors
from claimcheck.functions.vectors import HashingEncoder
from claimcheck.operators import retrieval
from claimcheck.operators.retrieval import BlockLimits, block_topk, topk_join
from claimcheck.session import plan_text


def brute_force(q, p, k, threshold, same=None):
    """(query, rank) -> (passage, score) by sorting everything."""
    out = set()
    for qi, (qs, qv) in q.items():
        scored = []
        qv = qv.astype(np.float64)
        for pi, (ps, pv) in p.items():
            if ps != qs or (same and same(qi, pi)):
                continue
            pv = pv.astype(np.float64)
            norm = np.linalg.norm(qv) * np.linalg.norm(pv)
            cos = qv @ pv / norm if norm else 0.0
            score = float(np.sign(cos) * np.floor(abs(cos) * 1e6 + 0.5) / 1e6)
            if threshold is None or score >= threshold:
                scored.append((-score, pi))
        for rank, (score, pi) in enumerate(sorted(scored)[:k], 1):
            out.add((qi, qs, pi, -score, rank))
    return out


def frames(spark, q, p):
    qdf = spark.createDataFrame(
        [(i, s, v.tolist()) for i, (s, v) in q.items()], "qid long, source string, qvec array<float>"
    )
    pdf = spark.createDataFrame(
        [(i, s, v.tolist(), f"text {i}") for i, (s, v) in p.items()],
        "passage_id long, source string, embedding array<float>, text string",
    )
    return qdf, pdf


@pytest.fixture(scope="module")
def clustered():
    """Clusters of different tightness; one source holds most rows, a third are copies."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    p, q = {}, {}
    for i in range(600):
        source = "big" if i % 10 else "small"
        v = centres[i % 12] + rng.normal(size=8) * 0.2
        p[i] = (source, np.float32(centres[0] if i % 3 == 0 else v))
    p[600] = ("big", np.zeros(8, dtype=np.float32))
    for i in range(80):
        v = centres[i % 12] + rng.normal(size=8) * 0.3
        q[i] = ("big" if i % 4 else "small", np.float32(v))
    q[80] = ("big", np.zeros(8, dtype=np.float32))
    q[81] = ("nowhere", np.ones(8, dtype=np.float32))
    return q, p


def got(df):
    return {(r["qid"], r["source"], r["passage_id"], r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(
    "limits",
    [
        BlockLimits(),
        BlockLimits(least_rows=8),
        BlockLimits(block_bytes=64 * 8 * 8, pivot_from_blocks=1000),
        BlockLimits(block_bytes=64 * 8 * 8, pivot_from_blocks=1),
        BlockLimits(block_bytes=64 * 8 * 8, pivot_from_blocks=1, max_pivots=3),
    ],
    ids=["one block", "blocks per core", "hash blocks", "pivots", "few pivots"],
)
@pytest.mark.parametrize("threshold", [0.55, 0.95])
def test_every_plan_is_exact(spark, clustered, limits, threshold):
    q, p = clustered
    qdf, pdf = frames(spark, q, p)
    hits = topk_join(
        qdf, pdf, sources=["big", "small", "nowhere"], k=5, threshold=threshold, limits=limits
    )
    assert got(hits) == brute_force(q, p, 5, threshold)


@pytest.mark.parametrize("task_bytes", [64 * 8 * 8, 200 * 8 * 8])
def test_bins_and_tasks_are_exact(spark, clustered, task_bytes):
    q, p = clustered
    qdf, pdf = frames(spark, q, p)
    limits = BlockLimits(block_bytes=64 * 8 * 8, pivot_from_blocks=1, task_bytes=task_bytes, least_rows=8)
    hits = topk_join(qdf, pdf, sources=["big", "small"], k=5, threshold=0.55, limits=limits)
    assert got(hits) == brute_force(q, p, 5, 0.55)


def test_queries_go_once_to_the_cells_of_a_bin(spark, clustered, monkeypatch):
    qdf, pdf = frames(spark, *clustered)
    sent, search = [], retrieval._search

    def watched(q, *rest):
        sent.append(q.count())
        return search(q, *rest)

    monkeypatch.setattr(retrieval, "_search", watched)
    limits = BlockLimits(block_bytes=64 * 8 * 8, pivot_from_blocks=1)
    topk_join(qdf, pdf, sources=["big", "small"], k=5, threshold=None, limits=limits)
    # All cells are in reach; each of the 81 queries goes to its own and to the bin of the others.
    assert len(sent) == 2 and max(sent) <= 81


def test_slices_bound_what_a_task_computes_at_once():
    rows = pa.record_batch({"source": ["a"] * 9000, "v": [[1.0, 2.0]] * 9000})
    seen = [x.shape for _, _, x in retrieval._with_angles([rows], "v", {"a": np.ones((4096, 2))})]
    assert sum(n for n, _ in seen) == 9000 and max(n * m for n, m in seen) <= retrieval.SLAB


def test_encoder_remembers_a_bounded_number_of_words():
    encode = vectors.HashingEncoder(dim=8).load()
    encode(pd.Series([" ".join(f"w{i}" for i in range(vectors.KNOWN_WORDS + 9000))]))
    bucket = inspect.getclosurevars(encode).nonlocals["bucket"]
    assert len(inspect.getclosurevars(bucket).nonlocals["bucket_of"]) == vectors.KNOWN_WORDS


def test_without_threshold_and_with_exclusion(spark, clustered):
    q, p = clustered
    qdf, pdf = frames(spark, q, p)
    hits = topk_join(
        qdf.withColumn("qk", F.col("qid").cast("string")),
        pdf.withColumn("pk", (F.col("passage_id") % 80).cast("string")),
        sources=["big", "small"],
        k=4,
        threshold=None,
        exclude=[("qk", "pk")],
        limits=BlockLimits(block_bytes=64 * 8 * 8),
    )
    same = lambda a, b: a == b % 80
    wanted = {k: v for k, v in q.items() if v[0] != "nowhere"}
    assert got(hits) == brute_force(wanted, p, 4, None, same)


def test_no_common_source(spark, clustered):
    q, p = clustered
    qdf, pdf = frames(spark, q, p)
    assert topk_join(qdf, pdf, sources=["nowhere"]).collect() == []


def test_search_plan_has_no_cross_join(spark, clustered):
    qdf, pdf = frames(spark, *clustered)
    plan = plan_text(topk_join(qdf, pdf, sources=["big", "small"]))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_splits():
    assert retrieval._split(100, 10, 1000, 1024, 8) == (1, 1)
    assert retrieval._split(100_000, 10, 1_000_000, 1024, 8) == (8, 1)
    assert retrieval._split(10, 100_000, 1_000_000, 1024, 8) == (1, 8)
    assert retrieval._split(100_000, 100_000, 10_000, 1024, 8) == (10, 10)
    assert retrieval._split(3000, 10, 1_000_000, 1024, 8) == (2, 1)


def test_kernel_ties_and_slabs():
    p = np.ones((50, 3))
    ids = np.arange(50)[::-1].copy()
    rows, found, scores, rank = block_topk(np.ones((2, 3)), p, ids, 3, 0.5)
    assert rows.tolist() == [0, 0, 0, 1, 1, 1]
    assert found.tolist() == [0, 1, 2, 0, 1, 2]
    assert rank.tolist() == [1, 2, 3, 1, 2, 3]
    assert set(scores) == {1.0}


def test_single_query_and_evidence(spark):
    encoder = HashingEncoder(4096)
    passages = spark.createDataFrame(
        [
            ("wiki", 1, "avro keyboard software for windows unicode"),
            ("wiki", 2, "the river padma flows to the sea"),
            ("wiki", 3, "avro keyboard"),
        ],
        "source string, passage_id long, text string",
    )
    index = retrieval.embed_passages(passages, encoder).cache()
    vector = encoder.load()(pd.Series(["avro keyboard software"]))[0].tolist()
    hits = retrieval.retrieve(index, vector, 5, 0.3).collect()
    assert hits[0]["passage_id"] in (1, 3) and {h["passage_id"] for h in hits} == {1, 3}
    far = encoder.load()(pd.Series(["entirely different zebra"]))[0].tolist()
    assert retrieval.retrieve(index, far, 5, 0.9).collect() == []

    queries = spark.createDataFrame(
        [(10, "wiki", vector), (11, "wiki", far)], "qid long, source string, qvec array<float>"
    )
    found = topk_join(queries, index, sources=["wiki"], threshold=0.3)
    texts = retrieval.hit_texts(found, index)
    rows = retrieval.evidence_of_hits(texts, ["qid"], 3).collect()
    assert len(rows) == 1 and rows[0]["n_retrieved"] == 2
    assert len(rows[0]["evidence"].split()) == 3
    assert rows[0]["retrieval_sim_max"] >= rows[0]["retrieval_sim_mean"]
    assert spark.createDataFrame([], passages.schema).count() == 0


def test_only_new_texts_are_encoded(spark):
    encoder = HashingEncoder(16)
    old = spark.createDataFrame(
        [("wiki", 1, "a b"), ("wiki", 2, "c d")], "source string, passage_id long, text string"
    )
    index = retrieval.embed_passages(old, encoder)
    new = spark.createDataFrame(
        [("wiki", 5, "a b"), ("wiki", 6, "e f"), ("idioms", 7, "c d")], old.schema
    )
    added = retrieval.embed_missing(new, index, encoder)
    assert {r["passage_id"] for r in added.collect()} == {6, 7}
    status = retrieval.index_status(new, ["wiki", "idioms", "grammar"]).collect()
    assert {(r["source"], r["n_passages"], r["status"]) for r in status} == {
        ("wiki", 2, "built"),
        ("idioms", 1, "built"),
        ("grammar", 0, "skipped"),
    }


def test_l2_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got_ = [r[0] for r in df.select(vectors.l2_normalise(F.col("v"))).collect()]
    assert np.allclose(got_[0], [0.6, 0.8]) and got_[1] == [0.0, 0.0]


def test_exemplars_never_leak(spark):
    encoder = HashingEncoder(32)
    schema = "id long, context string, prompt_bn string, response_bn string, label int"
    labelled = spark.createDataFrame(
        [
            (1, None, "what is a river", "water", 1),
            (2, "c", "what is a river ", "stone", 0),
            (3, None, "what is the river", "big water", 0),
            (4, None, "why is a river", "water", 1),
        ],
        schema,
    )
    exemplars = retrieval.exemplar_index(labelled, encoder)
    claims = labelled.where("id = 1").drop("label")
    hits = retrieval.exemplar_hits(claims, exemplars, encoder, k=3)
    # 1 and 2 share the question, 1 and 4 the answer.
    assert [r["passage_id"] for r in hits.collect()] == [3]
    lists = retrieval.exemplar_lists(hits, exemplars).first()
    assert lists["id"] == 1 and lists["exemplars"][0]["response_bn"] == "big water"


def test_a_slice_of_queries_takes_no_copy_of_the_passages():
    rng = np.random.default_rng(5)
    p, q = rng.random((32768, 256)), rng.random((64, 256))
    tracemalloc.start()
    rows, ids, scores, _ = block_topk(q, p, np.arange(len(p)), 3, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < p.nbytes
    cosine = (q @ p.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None, :])
    best = np.sort(cosine, axis=1)[:, ::-1][:, :3]
    assert np.allclose(scores.reshape(64, 3), best, atol=1e-6) and (np.repeat(np.arange(64), 3) == rows).all()


def test_held_passages_keep_their_type_and_are_widened_by_tiles(monkeypatch):
    rng = np.random.default_rng(6)
    p, q = rng.random((300, 8)).astype(np.float32), rng.random((40, 8)).astype(np.float32)
    listed = lambda x: pa.array(x.tolist(), pa.list_(pa.float32()))
    held = pa.record_batch({"passage_id": np.arange(300), "part": np.zeros(300, np.int32), "vector": listed(p)})
    vectors_, ids, part, keys = retrieval._held(held, 0)
    assert vectors_.dtype == np.float32
    norms = retrieval._norms(vectors_)
    assert np.array_equal(norms, np.sqrt((p.astype(np.float64) ** 2).sum(axis=1)))
    seen, topk = [], retrieval.block_topk

    def watched(q, p, *rest, **more):
        seen.append((len(p), p.dtype))
        return topk(q, p, *rest, **more)

    monkeypatch.setattr(retrieval, "TILE", 64)
    monkeypatch.setattr(retrieval, "block_topk", watched)
    asks = pa.record_batch({"vector": listed(q), "wanted": pa.nulls(40, pa.binary()), "kth": pa.nulls(40, pa.float64())})
    found = retrieval._answers(asks, (vectors_, ids, part, keys, norms), 3, None, 0)
    assert max(n for n, _ in seen) == 64 and {kind for _, kind in seen} == {np.dtype(np.float64)}
    for a, b in zip(found, topk(q.astype(np.float64), p.astype(np.float64), ids, 3, None), strict=True):
        assert np.allclose(a, b, atol=1e-6)


def test_an_encoder_is_given_bounded_parts_of_a_batch():
    seen, texts = [], pa.array(["a b", None, "c"] * 2000)
    encode = HashingEncoder(dim=8).load()

    def watched(part):
        seen.append(len(part))
        return encode(part)

    out = vectors.encoded(watched, texts)
    assert max(seen) == vectors.ENCODED_ROWS < sum(seen) == 6000
    assert out.type == pa.list_(pa.float32())
    assert np.array_equal(np.array(out.to_pylist(), np.float32), encode(pd.Series(texts.to_pylist())))
    assert len(vectors.encoded(watched, texts.slice(0, 0))) == 0


def _odd_rows(kind: str, n: int, dim: int, rng) -> np.ndarray:
    rows = rng.integers(0, 3, (n, dim)).astype(np.float64) if kind != "real" else rng.normal(size=(n, dim))
    rows[rng.integers(n)] = 0
    if kind == "large":  # their products do not fit in half a number
        rows[::3] *= 1500
    if kind == "odd":
        for x in (np.nan, np.inf, 1e40, 1e-40, 1e160, 1e-160):
            rows[rng.integers(n), rng.integers(dim)] = x
    return rows


@pytest.mark.parametrize("kind", ["counts", "real", "large", "odd"])
@pytest.mark.parametrize("threshold", [0.5, None, -0.2])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_single_precision_loses_no_hit(kind, threshold):
    rng = np.random.default_rng(7)
    for dim, n, m in ((1, 9, 5), (3, 41, 12), (24, 60, 20), (24, 3, 20)):
        q, p, ids = _odd_rows(kind, m, dim, rng), _odd_rows(kind, n, dim, rng), rng.permutation(n)
        norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((p * p).sum(axis=1))[None, :]
        raw = np.stack([(row * p).sum(axis=1) for row in q])
        scores = retrieval._rounded(np.divide(raw, norms, out=np.zeros_like(raw), where=norms > 0))
        want = []
        for row in range(m):
            ranked = sorted((-s, i) for s, i in zip(scores[row], ids) if s >= (-2 if threshold is None else threshold))
            want += [(row, i, -s) for s, i in ranked[:4]]
        rows, found, values, _ = block_topk(q, p, ids, 4, threshold)
        assert [(r, i) for r, i, _ in want] == list(zip(rows, found))
        assert np.allclose([s for _, _, s in want], values, atol=2e-6)


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    rng, seen, real = np.random.default_rng(3), [], retrieval._cosine

    def watched(*args):
        out = real(*args)
        seen.append(out.size)
        return out

    monkeypatch.setattr(retrieval, "_cosine", watched)
    q, p = rng.poisson(0.15, (50, 256)).astype(np.float64), rng.poisson(0.8, (5000, 256)).astype(np.float64)
    assert len(block_topk(q, p, np.arange(5000), 5, 0.2)[0]) == 250
    assert sum(seen) < 50 * 5000 / 20
