"""Routing a claim table to task types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.config import RouterConfig
from claimcheck.functions import prompts, routing
from claimcheck.operators.cascade import run_stage
from claimcheck.rules import policy
from claimcheck.scorers import Scorer


def _context(claims: DataFrame) -> Column:
    return F.col("context_original" if "context_original" in claims.columns else "context")


def with_cues(claims: DataFrame, config: RouterConfig) -> DataFrame:
    """Add the cue flags in a projection of their own, so each is computed once."""
    response = F.col("response_bn") if "response_bn" in claims.columns else F.lit("")
    return claims.withColumns(
        routing.flags(_context(claims), F.col("prompt_bn"), response, config.cues)
    )


def route_static(claims: DataFrame, config: RouterConfig) -> DataFrame:
    """Add ``task_type`` from cues alone."""
    flagged = with_cues(claims, config)
    return flagged.withColumn("task_type", routing.static_task()).drop(*routing.flag_names())


def route_claims(
    claims: DataFrame, config: RouterConfig, category: Scorer | None = None
) -> DataFrame:
    """Add ``task_type`` and ``static_task_type``.

    The model is asked only where it can matter: everywhere in model mode, and in hybrid
    mode only for rows whose cues did not already settle the task.
    """
    flagged = with_cues(claims, config).withColumn("static_task_type", routing.static_task())
    if config.mode == "static" or category is None:
        return flagged.withColumn("task_type", F.col("static_task_type")).drop(
            *routing.flag_names()
        )
    static = F.col("static_task_type")
    wanted = F.lit(True) if config.mode == "model" else ~static.isin(*policy.LEXICAL_ONLY_TASKS)
    if "category_prompt" in category.inputs:
        prompt = prompts.category_prompt(F.col("prompt_bn"), F.col("response_bn"))
        flagged = flagged.withColumn("category_prompt", prompt)
    asked = run_stage(flagged, category, "_logits", wanted).withColumn(
        "_model_task", routing.task_of_category(routing.best_category(F.col("_logits")))
    )
    model = F.col("_model_task")
    task = model if config.mode == "model" else routing.merge_tasks(static, model)
    return asked.withColumn("task_type", task).drop(
        "_logits", "_model_task", "category_prompt", *routing.flag_names()
    )


def router_disagreement(routed: DataFrame, top: int | None = None) -> DataFrame:
    """Most frequent (static, final) pairs that differ, with the overall share of changes.

    The windows run over one row for each pair of task types.
    """
    changed = F.col("static_task_type") != F.col("task_type")
    everywhere = Window.partitionBy()
    pairs = (
        routed.groupBy("static_task_type", "task_type")
        .agg(F.count("*").alias("n"))
        .withColumn("_all", F.sum("n").over(everywhere))
        .withColumn("_changed", F.sum(F.when(changed, F.col("n"))).over(everywhere))
        .where(changed)
        .withColumn("disagreement_pct", F.round(100.0 * F.col("_changed") / F.col("_all"), 1))
        .drop("_all", "_changed")
        .orderBy(F.desc("n"), "static_task_type", "task_type")
    )
    return pairs if top is None else pairs.limit(top)
