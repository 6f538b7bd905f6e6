import math

import pytest
from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig
from claimcheck.functions.scoring import threshold_label
from claimcheck.operators import decide
from claimcheck.schemas import DEBUG_COLUMNS


def test_threshold(spark):
    df = spark.createDataFrame([(0.9,), (0.1,), (0.5,), (math.nan,), (None,)], "p double")
    assert [r[0] for r in df.select(threshold_label(F.col("p"))).collect()] == [1, 0, 1, 0, 0]


def test_submission_checks(spark):
    ok = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int")
    assert decide.validate_submission(ok) is ok
    for df in (
        ok.withColumn("extra", F.lit(1)),
        spark.createDataFrame([(1, 0), (1, 1)], "id long, label int"),
        spark.createDataFrame([(1, 2)], "id long, label int"),
        spark.createDataFrame([(1, None)], "id long, label int"),
    ):
        with pytest.raises(ValueError):
            decide.validate_submission(df)


def debug_input(spark):
    return spark.createDataFrame(
        [
            (1, "general_fact_null", None, "evidence A", "প্রশ্ন ১", "উত্তর ১", True, "wiki", "", "rag:wiki", "retrieved", 2, 0.8, 0.7, 0.9),
            (2, "idiom_meaning_null", None, None, "ভাবার্থ", "অর্থ", False, "", "index_missing:idioms", "none", "no_evidence", 0, None, None, 0.2),
        ],
        "id long, task_type string, context_original string, context string, prompt_bn string, "
        "response_bn string, rag_used boolean, rag_source string, rag_skipped_reason string, "
        "evidence_source string, evidence_relevance string, n_retrieved int, "
        "retrieval_sim_max double, retrieval_sim_mean double, p_llm double",
    )


def test_debug_schema(spark):
    out = decide.debug_table(debug_input(spark), PipelineConfig())
    assert out.columns == list(DEBUG_COLUMNS) and len(out.columns) == 39
    rows = out.orderBy("id").collect()
    assert [r["label"] for r in rows] == [1, 0]
    assert rows[0]["threshold_margin"] == pytest.approx(0.4)
    assert rows[0]["p_fast"] is None and rows[0]["think_changed_label"] is False
    assert rows[1]["think_reasons"] == "" and rows[1]["thinking_cot"] == ""


def test_label_change(spark):
    df = spark.createDataFrame([(0.9, 0.2), (0.9, 0.8), (0.9, None)], "p double, f double")
    got = [r[0] for r in df.select(decide.label_changed(F.col("p"), F.col("f"), 0.5)).collect()]
    assert got == [True, False, False]


def test_summary_and_borderline(spark):
    out = decide.debug_table(debug_input(spark), PipelineConfig())
    assert decide.run_summary(out).first().asDict() == {
        "n_rows": 2,
        "n_hallucinated": 1,
        "n_faithful": 1,
        "n_rag_used": 1,
        "n_think": 0,
        "n_nli_applied": 0,
    }
    assert [r["id"] for r in decide.borderline(out, 1).collect()] == [2]
