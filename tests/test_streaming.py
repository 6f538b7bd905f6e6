from claimcheck import schemas
from claimcheck.config import PipelineConfig, RouterConfig
from claimcheck.scorers import lexical_scorers
from claimcheck.rules.cues import BENGALI
from claimcheck.streaming import scoring as stream

SCHEMA = (
    "id long, task_type string, context_original string, context string, prompt_bn string, response_bn string"
)
CONFIG = PipelineConfig(router=RouterConfig(mode="static"))


def claims(spark, ids):
    return spark.createDataFrame(
        [(i, "other_null", None, f"evidence {i % 3}", "prompt", "evidence prompt") for i in ids], SCHEMA
    )


def drain(spark, tmp_path, state="state"):
    arriving = stream.claim_stream(
        spark, str(tmp_path / "in"), claims(spark, [0]).schema, files_per_batch=1
    )
    run = stream.start_scoring(
        arriving,
        CONFIG,
        lexical_scorers(BENGALI),
        str(tmp_path / "log"),
        str(tmp_path / state),
        until_drained=True,
    )
    run.awaitTermination()
    assert run.exception() is None
    return spark.read.schema(schemas.LOG).parquet(str(tmp_path / "log"))


def test_resumed_stream_scores_each_case_once(spark, tmp_path):
    claims(spark, [0, 1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert drain(spark, tmp_path).count() == 2
    # Case 0 comes again (as id 3), case 2 is new.
    claims(spark, [3, 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = drain(spark, tmp_path)
    assert log.count() == 3
    assert sorted(r["evidence"] for r in log.collect()) == ["evidence 0", "evidence 1", "evidence 2"]


def test_rerun_batch_leaves_the_same_rows(spark, tmp_path):
    write = stream.score_batch(CONFIG, lexical_scorers(BENGALI), str(tmp_path / "log"))
    write(claims(spark, [0, 1]), 0)
    write(claims(spark, [0, 2]), 1)
    write(claims(spark, [0, 2]), 1)
    log = spark.read.schema(schemas.LOG).parquet(str(tmp_path / "log"))
    assert log.count() == 3


def test_two_jobs_on_one_log_keep_each_others_rows(spark, tmp_path):
    claims(spark, [0, 1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert drain(spark, tmp_path).count() == 2
    claims(spark, [1, 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # A second job with a state of its own reads all files again, and scores case 2 only.
    log = drain(spark, tmp_path, "other-state")
    assert sorted(r["evidence"] for r in log.collect()) == ["evidence 0", "evidence 1", "evidence 2"]
    seqs = [r["seq"] for r in log.orderBy("evidence").collect()]
    assert seqs[0] == seqs[1] < seqs[2]


def test_batches_ask_the_state_and_not_the_log(spark, tmp_path, monkeypatch):
    claims(spark, [0, 1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert drain(spark, tmp_path).count() == 2

    def fail(*_):
        raise AssertionError("a batch read the log")

    monkeypatch.setattr(stream, "_log_of_others", fail)
    for ids in ([3, 4], [5, 8, 2]):
        claims(spark, ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = drain(spark, tmp_path)
    assert sorted(r["evidence"] for r in log.collect()) == ["evidence 0", "evidence 1", "evidence 2"]


def test_seeds_win_over_claims_of_the_first_batch(spark, tmp_path):
    claims(spark, [0, 1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(spark, tmp_path)
    # A new state meets known, repeated and new cases in its very first batch.
    claims(spark, [3, 4, 5, 8, 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = drain(spark, tmp_path, "other-state")
    assert sorted(r["evidence"] for r in log.collect()) == ["evidence 0", "evidence 1", "evidence 2"]
