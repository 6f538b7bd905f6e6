import numpy as np
from pyspark.sql import functions as F

from claimcheck.operators import evaluate
from claimcheck.scorers import ColumnScorer

ROWS = [
    # id, label, truth, task, thought, changed, text, budget, reasons, rag, sim, p_fast, p_think, p
    (1, 1, 1, "a", True, True, "abc", 256, "x|y", True, 0.8, 0.4, 0.9, 0.9),
    (2, 1, 0, "a", True, True, "abcde", 256, "x", True, 0.6, 0.4, 0.9, 0.9),
    (3, 0, 0, "a", True, False, " ", 512, "", False, None, 0.4, 0.1, 0.1),
    (4, 0, 1, "b", False, False, None, None, None, None, None, 0.1, None, 0.1),
    (5, 1, 1, "b", None, None, None, None, None, False, None, 0.95, None, 0.95),
    (6, 1, 0, "b", False, False, "", None, "z", True, 0.9, 0.95, None, 0.95),
]
SCHEMA = (
    "id long, label int, truth int, task_type string, triggered_think boolean, think_changed_label boolean, "
    "thinking_cot string, think_max_tokens int, think_reasons string, rag_used boolean, "
    "retrieval_sim_max double, p_fast double, p_think double, p_llm double"
)


def judged(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns(
        {"prompt_bn": F.lit("q"), "response_bn": F.lit("r")}
    )
    truth = df.select("id", F.col("truth").alias("label"))
    return evaluate.join_truth(df.drop("truth"), truth)


def table(df, *key):
    return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}


def test_classification_report(spark):
    rng = np.random.default_rng(0)
    true, pred = rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    df = spark.createDataFrame(
        [(int(t), int(p)) for t, p in zip(true, pred, strict=True)], "label_true int, label_pred int"
    )
    got = table(evaluate.classification_report(df), "class")
    for c, name in ((0, "Hallucinated (0)"), (1, "Faithful (1)")):
        tp = int(((true == c) & (pred == c)).sum())
        precision, recall = tp / (pred == c).sum(), tp / (true == c).sum()
        row = got[(name,)]
        assert abs(row["precision"] - precision) < 1e-5 and abs(row["recall"] - recall) < 1e-5
        assert abs(row["f1"] - 2 * precision * recall / (precision + recall)) < 1e-5
        assert row["support"] == int((true == c).sum())
    assert abs(got[("accuracy",)]["f1"] - (true == pred).mean()) < 1e-5
    assert got[("macro avg",)]["support"] == 200


def test_one_sided_report_divides_by_nothing(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label_true int, label_pred int")
    got = table(evaluate.classification_report(df), "class")
    assert got[("Hallucinated (0)",)]["f1"] == 0.0 and got[("Faithful (1)",)]["f1"] == 1.0


def test_think_reports(spark):
    j = judged(spark)
    status = {r["id"]: r["think_status"] for r in evaluate.with_think_status(j).collect()}
    assert status == {
        1: "think_helped",
        2: "think_hurt",
        3: "think_no_change",
        4: "no_think",
        5: "no_think",
        6: "no_think",
    }
    assert [r["think_status"] for r in evaluate.think_outcomes(j).collect()] == list(
        evaluate.THINK_STATUS_ORDER
    )
    cover = evaluate.think_coverage(j).first()
    assert (cover["n_triggered"], cover["n_with_text"], cover["n_without_text"]) == (3, 2, 1)
    lengths = table(evaluate.thinking_lengths(j), "correct")
    assert lengths[(False,)]["max_chars"] == 5 and lengths[(True,)]["n"] == 2
    budgets = evaluate.wrong_budgets(j).collect()
    assert [(r["think_max_tokens"], r["n"], r["all_short"]) for r in budgets] == [(256, 1, True)]
    reasons = [(r["reason"], r["n"]) for r in evaluate.wrong_reasons(j).collect()]
    assert reasons == [("x", 1), ("z", 1)]
    assert [r["id"] for r in evaluate.hurt_rows(j).collect()] == [2]


def test_retrieval_and_confidence_reports(spark):
    j = judged(spark)
    lift = evaluate.retrieval_lift(j).first()
    assert (lift["n_rag"], lift["n_no_rag"]) == (3, 3)
    assert lift["rag_accuracy_pct"] == 33.3 and lift["delta_pp"] == -33.3
    by_task = table(evaluate.retrieval_by_task(j), "task_type")
    assert by_task[("b",)]["rag_pct"] == 0.0 and by_task[("b",)]["no_rag_pct"] == 50.0
    sims = evaluate.similarity_by_outcome(j).first()
    assert (sims["wrong_mean"], sims["right_mean"]) == (0.75, 0.8)
    sure = {r["task_type"]: r["n"] for r in evaluate.overconfident_wrong(j).collect()}
    assert sure == {"b": 2}
    errors = [(r["task_type"], r["errors"], r["error_rate_pct"]) for r in evaluate.errors_by_task(j).collect()]
    assert errors == [("b", 2, 66.7), ("a", 1, 33.3)]
    worst = evaluate.worst_samples(j, tasks=1, per_task=1, min_rows=3).collect()
    assert [(r["id"], r["pass"], r["rag_used"]) for r in worst] == [(4, "FAST", False)]
    cover = evaluate.coverage(j.select("id"), j.where("id < 4").select("id")).first()
    assert (cover["n_submitted"], cover["n_matched"], cover["n_unmatched"]) == (6, 3, 3)


def test_rule_comparison(spark):
    rows = [(1, 1, 1, 0.9, 0.05, 0.05), (2, 1, 0, 0.1, 0.6, 0.3), (3, 0, 1, 0.3, 0.2, 0.5), (4, 0, 0, 0.4, 0.4, 0.2)]
    df = spark.createDataFrame(
        rows, "id long, label_pred int, label_true int, p_entail double, p_contradict double, p_neutral double"
    ).withColumn("variant", F.lit("qa_en"))
    acc = {r["rule"]: r["accuracy"] for r in evaluate.nli_rules(df).collect()}
    assert acc == {
        "entail_gt_contradict": 1.0,
        "entail_gt_0.5": 0.75,
        "not_contradict_gt_0.5": 0.75,
        "argmax_neutral_as_faithful": 0.75,
        "argmax_neutral_as_hallucinated": 0.5,
        "hybrid_margin_0.2": 0.75,
        "hybrid_margin_0.35": 0.75,
    }
    best = evaluate.best_rules(evaluate.nli_rules(df)).collect()
    assert [(r["variant"], r["best_rule"], r["is_best"]) for r in best] == [
        ("qa_en", "entail_gt_contradict", True)
    ]
    wrong = evaluate.nli_errors(df, "qa_en", "argmax_neutral_as_hallucinated").collect()
    assert [r["id"] for r in wrong] == [3, 4]


def test_variants_cover_all_wordings(spark):
    j = judged(spark).withColumns({"context": F.lit("r"), "context_original": F.lit("r")})
    length = ColumnScorer(
        ("nli_hypothesis",),
        lambda h: F.struct(
            F.length(h).cast("double").alias("p_entail"),
            F.lit(0.0).alias("p_contradict"),
            F.lit(0.0).alias("p_neutral"),
        ),
    )
    out = evaluate.nli_variants(j, length, "a")
    assert out.count() == 12
    assert out.where("variant = 'answer_only'").first()["p_entail"] == 1.0


def test_audit_slice_fills_quotas(spark):
    tasks = ["other_null"] * 500 + ["math_other"] * 20 + ["calendar_arithmetic"] * 20 + ["bangla_grammar"] * 3
    df = spark.createDataFrame(list(enumerate(tasks)), "id long, task_type string")
    out = evaluate.audit_slice(df).groupBy("audit_group").count().collect()
    assert {r["audit_group"]: r["count"] for r in out} == {
        "other_null": 12,
        "math": 25,
        "bangla_grammar": 3,
    }
