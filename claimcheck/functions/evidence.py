"""Evidence policy as Column expressions: may this row retrieve, from where, and why not."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimcheck.functions import text as tx
from claimcheck.rules import policy


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Constant table as a map literal; NULL for unknown keys."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def source_for_task(task: Column) -> Column:
    return lookup(policy.RETRIEVAL_SOURCE, task)


def fallback_for_task(task: Column) -> Column:
    return lookup(policy.FALLBACK_SOURCE, task)


def instruction_for_task(task: Column) -> Column:
    default = F.lit(policy.INSTRUCTIONS[policy.DEFAULT_INSTRUCTION_TASK])
    return F.coalesce(lookup(policy.INSTRUCTIONS, task), default)


def skip_reason(task: Column, context: Column) -> Column:
    """Why a row must not retrieve; NULL when it may."""
    return (
        F.when(~tx.is_missing(context), F.lit("original_context_present"))
        .when(task.isin(*policy.NO_RETRIEVAL_TASKS), F.concat(F.lit("task_policy:"), task))
        .when(source_for_task(task).isNull(), F.concat(F.lit("no_rag_source:"), task))
    )


def may_retrieve(task: Column, context: Column, factual: Column) -> Column:
    """Skip rules, and an uncategorised question must at least ask for a fact."""
    return skip_reason(task, context).isNull() & ((task != "other_null") | factual)


def map_verdict(verdict: Column, confidence: Column) -> Column:
    """Score of a verdict word and a confidence word; unknown confidence counts as likely."""
    word = F.lower(tx.strip(verdict))
    sure = F.lower(tx.strip(F.coalesce(confidence, F.lit("likely"))))
    sure = F.when(sure.isin("strong", "likely", "uncertain"), sure).otherwise("likely")
    table = {f"{v}/{c}": s for (v, c), s in policy.VERDICT_SCORES.items()}
    return F.when(
        verdict.isNotNull() & (verdict != ""), lookup(table, F.concat_ws("/", word, sure))
    )
