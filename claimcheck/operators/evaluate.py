"""Evaluation reports over a debug table joined with truth."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.functions import prompts
from claimcheck.functions.scoring import threshold_label
from claimcheck.operators.cascade import run_stage
from claimcheck.rules import policy
from claimcheck.scorers import Scorer

# --- fixed values -----------------------------------------------------------------
THINK_STATUS_ORDER = ("no_think", "think_no_change", "think_helped", "think_hurt")
HYPOTHESIS_VARIANTS = ("answer_only", "qa_en", "qa_bn", "claim_bn")
RULE_ORDER = (
    "entail_gt_contradict",
    "entail_gt_0.5",
    "not_contradict_gt_0.5",
    "argmax_neutral_as_faithful",
    "argmax_neutral_as_hallucinated",
    "hybrid_margin_0.2",
    "hybrid_margin_0.35",
)
SHORT_THINK_TOKENS = 512
OVERCONFIDENT = (0.2, 0.8)
SNIPPETS = {"question": 120, "answer": 100, "thinking": 200}
# --- end of fixed values ------------------------------------------------------------


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def join_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with truth: ``label_pred``, ``label_true`` and ``correct``."""
    renamed = predicted.withColumnRenamed("label", "label_pred")
    return renamed.join(
        truth.select("id", F.col("label").cast("int").alias("label_true")), "id"
    ).withColumn("correct", F.col("label_pred") == F.col("label_true"))


def coverage(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """How many predictions have a truth row."""
    known = truth.select("id", F.lit(True).alias("_known"))
    return predicted.select("id").join(known, "id", "left").agg(
        F.count("*").alias("n_submitted"),
        F.count_if(F.col("_known")).alias("n_matched"),
        F.count_if(F.col("_known").isNull()).alias("n_unmatched"),
    )


def unmatched(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return predicted.select("id").join(truth.select("id"), "id", "left_anti")


def accuracy(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"),
    )


def confusion(judged: DataFrame) -> DataFrame:
    return judged.groupBy("label_true", "label_pred").agg(F.count("*").alias("n"))


def classification_report(judged: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with the usual three totals.

    The judged rows shrink to at most four confusion counts; the rest is arithmetic.
    """
    counts = confusion(judged)
    n = F.col("n")

    def cell(true: int, pred: int) -> Column:
        hit = (F.col("label_true") == true) & (F.col("label_pred") == pred)
        return F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias(f"n{true}{pred}")

    wide = counts.agg(*[cell(t, p) for t in (0, 1) for p in (0, 1)])

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    rows = {}
    for c in (0, 1):
        hit, support = F.col(f"n{c}{c}"), F.col(f"n{c}0") + F.col(f"n{c}1")
        precision = ratio(hit, F.col(f"n0{c}") + F.col(f"n1{c}"))
        recall = ratio(hit, support)
        f1 = ratio(2 * precision * recall, precision + recall)
        rows[c] = (precision, recall, f1, support)
    total = rows[0][3] + rows[1][3]
    acc = ratio(F.col("n00") + F.col("n11"), total)

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            F.round(precision, 6).alias("precision"),
            F.round(recall, 6).alias("recall"),
            F.round(f1, 6).alias("f1"),
            support.cast("long").alias("support"),
        )

    def mean(i: int) -> Column:
        return (rows[0][i] + rows[1][i]) / 2

    def weighted(i: int) -> Column:
        return ratio(rows[0][i] * rows[0][3] + rows[1][i] * rows[1][3], total)

    none = F.lit(None).cast("double")
    lines = F.array(
        line("Hallucinated (0)", *rows[0]),
        line("Faithful (1)", *rows[1]),
        line("accuracy", none, none, acc, total),
        line("macro avg", mean(0), mean(1), mean(2), total),
        line("weighted avg", weighted(0), weighted(1), weighted(2), total),
    )
    return wide.select(F.explode(lines).alias("line")).select("line.*")


def errors_by_task(judged: DataFrame) -> DataFrame:
    wrong = ~F.col("correct")
    return (
        judged.groupBy("task_type")
        .agg(
            F.count_if(wrong).alias("errors"),
            F.count("*").alias("total_rows"),
            F.round(100.0 * F.count_if(wrong) / F.count("*"), 1).alias("error_rate_pct"),
        )
        .orderBy(F.desc("errors"), "task_type")
    )


def _has_thinking() -> Column:
    return F.trim(F.coalesce("thinking_cot", F.lit(""))) != ""


def think_coverage(judged: DataFrame) -> DataFrame:
    thought = _flag("triggered_think")
    return judged.agg(
        F.count_if(thought).alias("n_triggered"),
        F.count_if(thought & _has_thinking()).alias("n_with_text"),
        F.count_if(thought & ~_has_thinking()).alias("n_without_text"),
    )


def with_think_status(judged: DataFrame) -> DataFrame:
    thought, changed = _flag("triggered_think"), _flag("think_changed_label")
    status = (
        F.when(~thought, "no_think")
        .when(~changed, "think_no_change")
        .when(F.col("correct"), "think_helped")
        .otherwise("think_hurt")
    )
    return judged.withColumn("think_status", status)


def think_outcomes(judged: DataFrame) -> DataFrame:
    position = F.array_position(
        F.array(*[F.lit(s) for s in THINK_STATUS_ORDER]), F.col("think_status")
    )
    return (
        with_think_status(judged)
        .groupBy("think_status")
        .agg(
            F.count("*").alias("n"),
            F.round(100 * F.avg(F.col("correct").cast("int")), 1).alias("accuracy_pct"),
        )
        .orderBy(position)
    )


def thinking_lengths(judged: DataFrame) -> DataFrame:
    """Length of the reasoning texts, wrong against right rows."""
    size = F.length(F.coalesce("thinking_cot", F.lit("")))
    return (
        judged.where(_flag("triggered_think"))
        .groupBy("correct")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg(size), 0).alias("mean_chars"),
            F.max(size).alias("max_chars"),
        )
    )


def wrong_budgets(judged: DataFrame) -> DataFrame:
    """Think budgets of wrong rows; ``all_short`` warns that none had a long budget."""
    budgets = (
        judged.where(~F.col("correct") & F.col("think_max_tokens").isNotNull())
        .groupBy("think_max_tokens")
        .agg(F.count("*").alias("n"))
    )
    # One row for each budget of the settings.
    longest = F.max("think_max_tokens").over(Window.partitionBy())
    return budgets.withColumn("all_short", longest <= SHORT_THINK_TOKENS)


def wrong_reasons(judged: DataFrame, top: int | None = None) -> DataFrame:
    """Think reasons of wrong rows by frequency."""
    reasons = F.split(F.coalesce("think_reasons", F.lit("")), r"\|")
    counts = (
        judged.where(~F.col("correct"))
        .select(F.explode(F.transform(reasons, F.trim)).alias("reason"))
        .where(F.col("reason") != "")
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "reason")
    )
    return counts if top is None else counts.limit(top)


def hurt_rows(judged: DataFrame) -> DataFrame:
    return (
        with_think_status(judged)
        .where(F.col("think_status") == "think_hurt")
        .select("id", "task_type", "p_fast", "p_think")
    )


def _accuracy_pct(where: Column) -> Column:
    return 100 * F.avg(F.when(where, F.col("correct").cast("int")))


def retrieval_lift(judged: DataFrame) -> DataFrame:
    used = _flag("rag_used")
    with_pct, without_pct = _accuracy_pct(used), _accuracy_pct(~used)
    return judged.agg(
        F.count_if(used).alias("n_rag"),
        F.count_if(~used).alias("n_no_rag"),
        F.round(with_pct, 1).alias("rag_accuracy_pct"),
        F.round(without_pct, 1).alias("no_rag_accuracy_pct"),
        F.round(with_pct - without_pct, 1).alias("delta_pp"),
    )


def retrieval_by_task(judged: DataFrame) -> DataFrame:
    used = _flag("rag_used")
    return (
        judged.groupBy("task_type")
        .agg(
            F.round(_accuracy_pct(F.lit(True)), 0).alias("overall_pct"),
            F.round(_accuracy_pct(used), 0).alias("rag_pct"),
            F.count_if(used).alias("n_rag"),
            F.round(_accuracy_pct(~used), 0).alias("no_rag_pct"),
            F.count_if(~used).alias("n_no_rag"),
        )
        .orderBy("task_type")
    )


def similarity_by_outcome(judged: DataFrame) -> DataFrame:
    def mean(where: Column) -> Column:
        return F.round(F.avg(F.when(where, F.col("retrieval_sim_max"))), 3)

    return judged.where(_flag("rag_used")).agg(
        mean(~F.col("correct")).alias("wrong_mean"), mean(F.col("correct")).alias("right_mean")
    )


def overconfident_wrong(judged: DataFrame) -> DataFrame:
    low, high = OVERCONFIDENT
    sure = (F.col("p_fast") > high) | (F.col("p_fast") < low)
    return (
        judged.where(~F.col("correct") & sure & ~_flag("triggered_think"))
        .groupBy("task_type")
        .agg(F.count("*").alias("n"))
    )


def score_spread(judged: DataFrame) -> DataFrame:
    return judged.groupBy("correct").agg(
        F.round(F.avg("p_llm"), 3).alias("mean_p"),
        F.round(F.stddev_samp("p_llm"), 3).alias("std_p"),
    )


def worst_samples(
    judged: DataFrame, tasks: int = 3, per_task: int = 3, min_rows: int = 5
) -> DataFrame:
    """First wrong rows of the tasks with most errors, with text snippets."""
    worst = errors_by_task(judged).where(F.col("total_rows") >= min_rows)
    worst = worst.orderBy(F.desc("errors"), "task_type").limit(tasks)
    order = Window.partitionBy("task_type").orderBy("id")
    thinking = F.coalesce("thinking_cot", F.lit(""))
    # ``tasks`` rows at most on the broadcast side.
    return (
        judged.where(~F.col("correct"))
        .join(F.broadcast(worst), "task_type")
        .withColumn("sample", F.row_number().over(order))
        .where(F.col("sample") <= per_task)
        .select(
            "task_type",
            "errors",
            "total_rows",
            "sample",
            "id",
            F.when(_flag("triggered_think"), "THINK").otherwise("FAST").alias("pass"),
            _flag("rag_used").alias("rag_used"),
            "label_pred",
            "label_true",
            F.round(F.coalesce("p_fast", "p_llm"), 3).alias("p_fast"),
            F.substring(F.coalesce("prompt_bn", F.lit("")), 1, SNIPPETS["question"]).alias(
                "question"
            ),
            F.substring(F.coalesce("response_bn", F.lit("")), 1, SNIPPETS["answer"]).alias(
                "answer"
            ),
            F.translate(F.substring(thinking, 1, SNIPPETS["thinking"]), "\n", " ").alias(
                "thinking"
            ),
        )
    )


# --- comparing entailment rules -----------------------------------------------------------


def _argmax(neutral_label: int) -> Column:
    """Label of the largest of entail, contradict, neutral (in that order on ties)."""
    e, c, n = F.col("p_entail"), F.col("p_contradict"), F.col("p_neutral")
    return (
        F.when((e >= c) & (e >= n), 1).when(c >= n, 0).otherwise(F.lit(neutral_label))
    )


def abstaining_label(margin: float) -> Column:
    """The verifier's label, unless entailment and contradiction are far enough apart."""
    e, c = F.col("p_entail"), F.col("p_contradict")
    return F.when(F.abs(e - c) < margin, F.col("label_pred")).otherwise((e > c).cast("int"))


def rule_labels() -> dict[str, Column]:
    e, c = F.col("p_entail"), F.col("p_contradict")
    return {
        "entail_gt_contradict": (e > c).cast("int"),
        "entail_gt_0.5": (e > 0.5).cast("int"),
        "not_contradict_gt_0.5": (c <= 0.5).cast("int"),
        "argmax_neutral_as_faithful": _argmax(1),
        "argmax_neutral_as_hallucinated": _argmax(0),
        "hybrid_margin_0.2": abstaining_label(0.2),
        "hybrid_margin_0.35": abstaining_label(0.35),
    }


def nli_variants(
    judged: DataFrame,
    scorer: Scorer,
    task: str = "context_grounded_fact",
    variants: Sequence[str] = HYPOTHESIS_VARIANTS,
) -> DataFrame:
    """Rows of one task scored under every hypothesis wording."""
    worded = F.array(
        *[
            F.struct(
                F.lit(v).alias("variant"),
                prompts.hypothesis(F.col("prompt_bn"), F.col("response_bn"), v).alias("text"),
            )
            for v in variants
        ]
    )
    rows = (
        judged.where(F.col("task_type") == task)
        .withColumn("nli_premise", F.coalesce("context_original", "context", F.lit("")))
        .withColumn("_v", F.explode(worded))
        .withColumns({"variant": F.col("_v.variant"), "nli_hypothesis": F.col("_v.text")})
        .drop("_v")
    )
    scored = run_stage(rows, scorer, "_nli", F.lit(True))
    return scored.select("*", "_nli.*").drop("_nli", "nli_premise", "nli_hypothesis")


def nli_rules(scored: DataFrame) -> DataFrame:
    """Accuracy of each decision rule per hypothesis wording."""
    right = {
        name: F.avg((label == F.col("label_true")).cast("int"))
        for name, label in rule_labels().items()
    }
    wide = scored.groupBy("variant").agg(
        F.count("*").alias("n"), *[value.alias(f"_{i}") for i, value in enumerate(right.values())]
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.round(F.col(f"_{i}"), 6).alias("accuracy"),
                F.lit(i).alias("rule_no"),
            )
            for i, name in enumerate(right)
        ]
    )
    return wide.select("variant", "n", F.explode(lines).alias("line")).select(
        "variant", "n", "line.*"
    )


def best_rules(rules: DataFrame) -> DataFrame:
    """Best rule per wording and whether it is the overall winner (first one on ties)."""
    best = rules.groupBy("variant").agg(
        F.max(F.struct("accuracy", (-F.col("rule_no")).alias("first"), "rule")).alias("best")
    )
    order = F.array_position(
        F.array(*[F.lit(v) for v in HYPOTHESIS_VARIANTS]), F.col("variant")
    )
    flat = best.select(
        "variant", F.col("best.rule").alias("best_rule"), F.col("best.accuracy").alias("accuracy")
    )
    top = flat.agg(F.max_by("variant", F.struct("accuracy", (-order).alias("first")))).scalar()
    return flat.withColumn("is_best", F.col("variant") == top)


def nli_errors(
    scored: DataFrame, variant: str, rule: str, n: int | None = None
) -> DataFrame:
    """Rows (or the first ``n``) on which one rule under one wording is wrong."""
    label = rule_labels()[rule]
    wrong = (
        scored.where(F.col("variant") == variant)
        .withColumn("nli_pred", label)
        .where(F.col("nli_pred") != F.col("label_true"))
        .select(
            "id",
            "label_true",
            "nli_pred",
            "label_pred",
            *[F.round(c, 2).alias(c) for c in ("p_entail", "p_contradict", "p_neutral")],
        )
        .orderBy("id")
    )
    return wrong if n is None else wrong.limit(n)


def task_baseline(judged: DataFrame, task: str = "context_grounded_fact") -> DataFrame:
    """Accuracy of the final and of the fast label on one task."""
    fast = threshold_label(F.col("p_fast"), 0.5) == F.col("label_true")
    return judged.where(F.col("task_type") == task).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("correct").cast("int")), 6).alias("verifier_accuracy"),
        F.round(F.avg(fast.cast("int")), 6).alias("p_fast_accuracy"),
    )


def audit_slice(
    routed: DataFrame, quotas: Mapping[str, int] = policy.AUDIT_QUOTAS, key: str = "id"
) -> DataFrame:
    """Fixed number of rows per task type, chosen by a hash of the id.

    The window keeps only the first rows, so each task cuts its share before the shuffle
    and a task with most of the rows is no heavier than the others.
    """
    task = F.col("task_type")
    group = F.when(task.isin(*policy.MATH_TASKS), F.lit("math")).otherwise(task)
    most = max(quotas.values())
    order = Window.partitionBy("audit_group").orderBy(F.md5(F.col(key).cast("string")), key)
    quota = functools.reduce(
        lambda acc, item: acc.when(F.col("audit_group") == item[0], item[1]),
        list(quotas.items())[1:],
        F.when(F.col("audit_group") == next(iter(quotas)), next(iter(quotas.values()))),
    )
    return (
        routed.withColumn("audit_group", group)
        .withColumn("audit_rank", F.row_number().over(order))
        .where(F.col("audit_rank") <= most)
        .where(F.col("audit_rank") <= quota)
    )
