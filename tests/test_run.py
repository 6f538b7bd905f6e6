"""The whole run on a small Bengali set, and the stages it stores."""

import glob

import pytest

from claimcheck import session
from claimcheck.config import PipelineConfig, RetrievalConfig, RouterConfig
from claimcheck.functions.vectors import HashingEncoder
from claimcheck.operators import decide, retrieval
from claimcheck.plans.run import resume_claims, run_claims
from claimcheck.sources import logs

ENCODER = HashingEncoder(512)
CONFIG = PipelineConfig(
    router=RouterConfig(mode="static"), retrieval=RetrievalConfig(threshold=0.3), exemplar_top_k=1
)


@pytest.fixture(scope="module")
def tables(spark):
    claims = spark.createDataFrame(
        [
            (1, "[NULL]", "বাংলাদেশের রাজধানী কোনটি?", "ঢাকা শহর"),
            (2, "পাহাড়পুর বৌদ্ধ বিহার ধর্মপাল নির্মাণ করেন", "কে নির্মাণ করেন?", "ধর্মপাল"),
            (3, None, '"আদা-জল" এর ভাবার্থ কী?', "উঠে পড়ে লাগা"),
            (4, "", "শুধু একটি বাক্য", "হ্যাঁ"),
        ],
        "id long, context string, prompt_bn string, response_bn string",
    )
    passages = spark.createDataFrame(
        [("wiki", 1, "বাংলাদেশের রাজধানী ঢাকা শহর"), ("wiki", 2, "অন্য কিছু")],
        "source string, passage_id long, text string",
    )
    labelled = spark.createDataFrame(
        [(9, None, "বাংলাদেশের মুদ্রা কোনটি?", "টাকা", 1)],
        "id long, context string, prompt_bn string, response_bn string, label int",
    )
    return claims, retrieval.embed_passages(passages, ENCODER), retrieval.exemplar_index(labelled, ENCODER)


def test_run(spark, tables):
    claims, index, exemplars = tables
    scored = run_claims(claims, index, CONFIG, encoder=ENCODER, exemplars=exemplars)
    rows = {r["id"]: r for r in decide.debug_table(scored, CONFIG).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[1]["task_type"] == "general_fact_null" and rows[1]["evidence_source"] == "rag:wiki"
    assert rows[1]["context"] == "বাংলাদেশের রাজধানী ঢাকা শহর" and rows[1]["label"] == 1
    assert rows[2]["task_type"] == "context_grounded_fact"
    assert rows[2]["evidence_source"] == "original_context"
    assert rows[3]["evidence_relevance"] == "retrieval_empty" and rows[3]["rag_used"]
    assert rows[4]["rag_skipped_reason"] == "other_null_not_factual"
    assert {r["id"]: len(r["exemplars"]) for r in scored.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    decide.validate_submission(decide.submission(scored))


def test_run_without_router(spark, tables):
    claims, index, _ = tables
    config = PipelineConfig(router=RouterConfig(enabled=False))
    rows = {r["id"]: r["task_type"] for r in run_claims(claims, index, config).collect()}
    assert rows == {1: "other_null", 2: "context_grounded_other", 3: "other_null", 4: "other_null"}


def test_stages_can_be_dropped(spark, monkeypatch):
    # Only the stage of this test, not those that other tests still read.
    monkeypatch.setattr(session, "_stage_paths", {})
    stored = session.materialize(spark.range(5), "dropme")
    assert stored.count() == 5
    pattern = f"{session.shared_folder(spark)}/claimcheck-dropme-*"
    before = len(glob.glob(pattern))
    assert session.drop_stages(spark) == 1
    assert len(glob.glob(pattern)) == before - 1


def test_own_stages_go_at_the_end(spark):
    kept = session.materialize(spark.range(3), "keepme")
    with session.own_stages(spark):
        gone = session.materialize(spark.range(5), "ownme")
        path = gone.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert glob.glob(f"{path}/*.parquet")
    assert not glob.glob(path) and kept.count() == 3


def test_resumed_run_keeps_scores(spark, tables, tmp_path):
    claims, index, _ = tables
    config = PipelineConfig(router=RouterConfig(mode="static"))
    root = str(tmp_path / "run")

    def go(rows, **options):
        out = resume_claims(rows, index, root, config, encoder=ENCODER, **options)
        return {r["id"]: (r["label"], r["p_llm"], r["p_fast"]) for r in out.collect()}

    def log_size():
        return logs.read_log(spark, f"{root}/log").count()

    first = go(claims.where("id < 4"))
    assert sorted(first) == [1, 2, 3] and log_size() == 3
    # The checkpoint stands in for scoring, with stored evidence or evidence made again.
    assert go(claims.where("id < 4"), resume_evidence=True) == first and log_size() == 3
    assert go(claims.where("id < 4")) == first and log_size() == 3
    # One more claim: the checkpoint is of other claims, the log knows the three cases.
    more = go(claims)
    assert sorted(more) == [1, 2, 3, 4] and log_size() == 4
    assert {i: more[i] for i in first} == first
    assert go(claims, force=True) == more and log_size() == 8
