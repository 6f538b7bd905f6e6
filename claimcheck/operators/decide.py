"""Labels, submission checks, the debug table and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig
from claimcheck.functions.scoring import threshold_label
from claimcheck.schemas import DEBUG_COLUMNS


def label_claims(scored: DataFrame, config: PipelineConfig) -> DataFrame:
    return scored.withColumn("label", threshold_label(F.col("p_llm"), config.threshold))


def submission(labelled: DataFrame) -> DataFrame:
    return labelled.select("id", F.col("label").cast("int").alias("label"))


def submission_report(candidate: DataFrame) -> DataFrame:
    """One row of counts; a valid submission has no duplicate id and no foreign label."""
    per_id = candidate.groupBy("id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad"),
    )
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_ids"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad_labels"),
    )


def validate_submission(candidate: DataFrame) -> DataFrame:
    """The frame itself, or ValueError with what is wrong."""
    if candidate.columns != ["id", "label"]:
        raise ValueError(f"submission must have columns id, label; got {candidate.columns}")
    report = submission_report(candidate).first()
    if report["n_duplicate_ids"]:
        raise ValueError(f"submission ids must be unique, {report['n_duplicate_ids']} are not")
    if report["n_bad_labels"]:
        raise ValueError(f"submission labels must be 0 or 1, {report['n_bad_labels']} are not")
    return candidate


def label_changed(p_final: Column, p_fast: Column, threshold: float) -> Column:
    """The final score lands on the other side of the threshold than the fast one."""
    known = p_fast.isNotNull() & ~F.isnan(p_fast)
    flipped = threshold_label(p_final, threshold) != threshold_label(p_fast, threshold)
    return F.when(known, flipped).otherwise(F.lit(False))


def debug_table(
    scored: DataFrame, config: PipelineConfig, logged: DataFrame | None = None
) -> DataFrame:
    """The 39 debug columns, in order.

    ``logged`` (from ``cache.debug_entries``) fills the scorer fields of a frame that has
    scores only; columns the frame already has win.
    """
    df = scored
    if logged is not None:
        fields = [c for c in logged.columns if c != "case_key" and c not in scored.columns]
        df = scored.join(logged.select("case_key", *fields), "case_key", "left")

    def column(name: str, default: Column) -> Column:
        return F.col(name) if name in df.columns else default

    null_double, null_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    p_llm = F.col("p_llm").cast("double")
    p_fast = column("p_fast", null_double)
    reasons = column("think_reasons", F.lit(""))
    if "think_reasons" in df.columns and df.schema["think_reasons"].dataType.typeName() == "array":
        reasons = F.array_join("think_reasons", "|")
    values = {
        "id": F.col("id"),
        "label": threshold_label(p_llm, config.threshold),
        "p_llm": p_llm,
        "threshold": F.lit(float(config.threshold)),
        "threshold_margin": p_llm - F.lit(float(config.threshold)),
        "task_type": column("task_type", F.lit("")),
        "p_fast": p_fast,
        "p_think": column("p_think", null_double),
        "triggered_think": F.coalesce(column("triggered_think", F.lit(False)), F.lit(False)),
        "think_max_tokens": column("think_max_tokens", F.lit(None)).cast("int"),
        "think_reasons": F.coalesce(reasons, F.lit("")),
        "verdict_parsed": column("verdict_parsed", null_text),
        "confidence_parsed": column("confidence_parsed", null_text),
        "think_changed_label": label_changed(p_llm, p_fast, config.threshold),
        "thinking_cot": F.coalesce(column("thinking_cot", F.lit("")), F.lit("")),
        "nli_eligible": column("nli_eligible", F.lit(False)),
        "nli_applied": column("nli_applied", F.lit(False)),
        "nli_skip_reason": column("nli_skip_reason", F.lit("")),
        "nli_p_entail": column("nli_p_entail", null_double),
        "nli_p_contradict": column("nli_p_contradict", null_double),
        "nli_p_neutral": column("nli_p_neutral", null_double),
        "nli_margin": column("nli_margin", null_double),
        "p_nli": column("p_nli", null_double),
        "rag_used": column("rag_used", F.lit(False)),
        "rag_source": column("rag_source", F.lit("")),
        "rag_skipped_reason": column("rag_skipped_reason", F.lit("")),
        "evidence_source": column("evidence_source", F.lit("")),
        "evidence_relevance": column("evidence_relevance", F.lit("")),
        "n_retrieved": column("n_retrieved", F.lit(0)),
        "retrieval_sim_max": column("retrieval_sim_max", null_double),
        "retrieval_sim_mean": column("retrieval_sim_mean", null_double),
        "context_original": column("context_original", F.col("context")),
        "context": F.col("context"),
        "prompt_bn": F.col("prompt_bn"),
        "response_bn": F.col("response_bn"),
        "run_timestamp": F.lit(config.run_timestamp),
        "hardware_profile": F.lit("spark"),
        "scorer_name": F.lit(config.scorer_name),
        "scorer_mode": F.lit(config.scorer_mode),
    }
    return df.select(*[values[name].alias(name) for name in DEBUG_COLUMNS])


def run_summary(debug: DataFrame) -> DataFrame:
    return debug.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("label") == 0).alias("n_hallucinated"),
        F.count_if(F.col("label") == 1).alias("n_faithful"),
        F.count_if("rag_used").alias("n_rag_used"),
        F.count_if("triggered_think").alias("n_think"),
        F.count_if("nli_applied").alias("n_nli_applied"),
    )


def borderline(debug: DataFrame, n: int = 20) -> DataFrame:
    """Rows closest to the threshold."""
    return debug.orderBy(F.abs("threshold_margin"), "id").limit(n)


def count_table(df: DataFrame, key: Column, top: int = 20) -> DataFrame:
    """Counts with percentages, most frequent first; what is left goes into one "…" row.

    One pass counts items and the total; all that follows sees ``top`` + 1 rows at most.
    """
    items = df.select(F.coalesce(key.cast("string"), F.lit("None")).alias("item"))
    # The total is the row without an item, and first.
    counts = items.rollup("item").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.col("item").isNotNull(), F.desc("n"), "item").limit(top + 1)
    shown = F.col("item").isNotNull()
    one = best.agg(
        F.max(F.when(~shown, F.col("n"))).alias("total"),
        F.coalesce(F.sum(F.when(shown, F.col("n"))), F.lit(0)).alias("covered"),
        F.array_sort(
            F.collect_list(F.when(shown, F.struct((-F.col("n")).alias("less"), "item", "n")))
        ).alias("best"),
    )
    rows = F.transform(
        "best",
        lambda r: F.struct(
            r["item"].alias("item"),
            r["n"].alias("n"),
            F.round(100.0 * r["n"] / F.col("total"), 1).alias("pct"),
        ),
    )
    rest = F.struct(
        F.lit("…").alias("item"),
        (F.col("total") - F.col("covered")).alias("n"),
        F.lit(None).cast("double").alias("pct"),
    )
    listed = F.when(F.col("total") > F.col("covered"), F.concat(rows, F.array(rest))).otherwise(rows)
    return one.select(F.inline(listed))
