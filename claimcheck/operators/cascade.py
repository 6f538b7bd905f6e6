"""Cost-ordered scoring: cache, fast score, entailment gate, deliberate pass, merge.

Each stage works only on rows that the cheaper ones left open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig
from claimcheck.functions import evidence as ev
from claimcheck.functions import parsing, prompts, scoring
from claimcheck.functions import text as tx
from claimcheck.operators import cache
from claimcheck.rules import policy
from claimcheck.scorers import Scorer, Scorers
from claimcheck.session import materialize



def with_prompts(claims: DataFrame) -> DataFrame:
    """Add the prompt texts that text-generating scorers read."""
    shots = F.col("exemplars") if "exemplars" in claims.columns else None
    if shots is None:
        shots = F.lit(None).cast(
            "array<struct<context:string,prompt_bn:string,response_bn:string,label:int>>"
        )
    case = [F.col(c) for c in ("task_type", "context", "prompt_bn", "response_bn")]
    return claims.withColumns(
        {
            "fast_prompt": prompts.fast_prompt(*case, shots),
            "think_prompt": prompts.think_prompt(*case, shots),
        }
    )


def run_stage(
    df: DataFrame,
    scorer: Scorer,
    out: str,
    where: Column,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add the output of a scorer for the rows that need it.

    A costly scorer gets those rows spread evenly over all tasks, similar work side by
    side; the frame is stored first because both branches read it.  ``prepare`` adds columns
    that only the scorer reads, such as prompts: it is applied to the rows that were picked,
    after they are dealt out, and what it adds is neither stored nor shuffled nor kept.
    """
    prepare = prepare or (lambda rows: rows)
    if not scorer.costly:
        return prepare(df).withColumn(out, scorer.column(where)).select(*df.columns, out)
    base = materialize(df.withColumn("_todo", F.coalesce(where, F.lit(False))), "open")
    order = [c for c in ("think_budget",) if c in df.columns]
    # The number of a stored row: it needs no key column, and equal rows are spread too.
    dealt = (
        base.where("_todo")
        .withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
        .repartition("_spread")
        .drop("_spread")
    )
    # Sorted by length alone, so that the sort does not carry what is prepared.
    length = F.length(F.col(scorer.inputs[0]).cast("string"))
    sized = prepare(dealt).select(*dealt.columns, length.alias("_length"))
    ready = prepare(sized.sortWithinPartitions(*order, "_length").drop("_length"))
    todo = ready.withColumn(out, scorer.column(F.lit(True))).select(*base.columns, out)
    rest = base.where(~F.col("_todo")).withColumn(out, F.lit(None).cast(todo.schema[out].dataType))
    return todo.unionByName(rest).drop("_todo")


def gate(
    df: DataFrame, config: PipelineConfig, scorer: Scorer, where: Column | None = None
) -> DataFrame:
    """Entailment gate: add the eight ``nli_*`` columns.

    ``where`` limits it to open rows; the others look as if the gate were switched off.
    """
    settings = config.nli
    blank = {
        "nli_eligible": F.lit(False),
        "nli_applied": F.lit(False),
        "nli_p_entail": F.lit(None).cast("double"),
        "nli_p_contradict": F.lit(None).cast("double"),
        "nli_p_neutral": F.lit(None).cast("double"),
        "nli_margin": F.lit(None).cast("double"),
        "p_nli": F.lit(None).cast("double"),
    }
    if not settings.enabled:
        return df.withColumns({**blank, "nli_skip_reason": F.lit("nli_disabled")})
    if "task_type" not in df.columns:
        return df.withColumns({**blank, "nli_skip_reason": F.lit("no_task_type")})

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    open_row = F.lit(True) if where is None else where
    context_original = optional("context_original", "string")
    prepared = df.withColumns(
        {
            "nli_premise": scoring.premise(context_original, F.col("context")),
            "nli_hypothesis": prompts.hypothesis(
                F.col("prompt_bn"), F.col("response_bn"), settings.hypothesis_style
            ),
        }
    )
    prepared = prepared.withColumn(
        "_block",
        F.when(
            open_row,
            scoring.nli_block(
                F.col("task_type"),
                F.col("nli_premise"),
                optional("rag_used", "boolean"),
                optional("retrieval_sim_max", "double"),
                settings,
            ),
        ).otherwise(F.lit("nli_disabled")),
    )
    eligible = F.col("_block").isNull()
    scored = run_stage(prepared, scorer, "_nli", eligible)
    entail, contradict, neutral = (
        F.col(f"_nli.{n}") for n in ("p_entail", "p_contradict", "p_neutral")
    )
    scored = scored.withColumn(
        "_objection",
        F.when(
            eligible,
            scoring.nli_objection(
                entail,
                contradict,
                neutral,
                F.col("nli_premise"),
                F.col("response_bn"),
                optional("p_fast", "double"),
                settings,
            ),
        ),
    )
    objection = F.col("_objection")
    unsure = F.coalesce(objection == "margin_too_low", F.lit(False))
    return scored.withColumns(
        {
            "nli_eligible": eligible,
            "nli_applied": eligible & objection.isNull(),
            "nli_skip_reason": F.coalesce(F.col("_block"), objection, F.lit("")),
            "nli_p_entail": entail,
            "nli_p_contradict": contradict,
            "nli_p_neutral": neutral,
            "nli_margin": F.abs(entail - contradict),
            "p_nli": F.when(
                eligible & ~unsure, scoring.nli_score(entail, contradict, settings)
            ),
        }
    ).drop("_block", "_nli", "_objection", "nli_premise", "nli_hypothesis")


def score_claims(
    claims: DataFrame,
    config: PipelineConfig,
    scorers: Scorers,
    log: DataFrame | None = None,
) -> DataFrame:
    """Score claims with evidence; cached cases keep their logged score."""
    keyed = cache.with_case_key(claims, config)
    if log is not None:
        rows = cache.with_cache(keyed, log, config)
        cached = F.col("logged.p_llm_final").isNotNull()
    else:
        rows, cached = keyed, F.lit(False)
    rows = rows.withColumn("cached", cached)
    prompted = {
        name: with_prompts if {"fast_prompt", "think_prompt"} & {*scorer.inputs} else None
        for name, scorer in (("fast", scorers.fast), ("think", scorers.think))
    }

    still_open = ~F.col("cached")
    rows = run_stage(rows, scorers.fast, "p_fast", still_open, prompted["fast"])
    cues = config.router.cues
    asks_fact = tx.holds(F.coalesce(F.col("prompt_bn"), F.lit("")), cues.factual)
    reasons = scoring.think_reasons(
        scoring.ThinkInputs(
            p_fast=F.col("p_fast"),
            task=F.col("task_type"),
            evidence=F.col("context"),
            context_original=F.col("context_original"),
            prompt=F.col("prompt_bn"),
            may_retrieve=ev.may_retrieve(F.col("task_type"), F.col("context_original"), asks_fact),
        ),
        config.think,
        cues,
    )
    rows = rows.withColumns(
        {
            "trigger_reasons": F.when(still_open, reasons),
            "think_budget": scoring.think_budget(F.col("task_type"), config.think),
        }
    )
    rows = gate(rows, config, scorers.nli, still_open)
    wants_think = F.coalesce(F.size("trigger_reasons") > 0, F.lit(False)) & ~F.col("nli_applied")
    think_now = wants_think if config.think.enabled else F.lit(False)
    rows = rows.withColumns(
        {"wants_think": still_open & wants_think, "thinks": still_open & think_now}
    )
    rows = run_stage(rows, scorers.think, "thinking_cot", F.col("thinks"), prompted["think"])
    return merge_scores(rows, log is not None)


def merge_scores(rows: DataFrame, has_cache: bool) -> DataFrame:
    """Final score per row: logged, else entailment, else a parsed verdict, else fast."""
    verdict = parsing.parse_verdict(F.col("thinking_cot"))
    rows = rows.withColumn("_verdict", F.when(F.col("thinks"), verdict))
    said = parsing.verdict_score(F.col("_verdict"))
    by_nli = F.col("nli_applied") & F.col("p_nli").isNotNull()
    p_open = F.coalesce(F.when(by_nli, F.col("p_nli")), F.when(F.col("thinks"), said), F.col("p_fast"))
    nothing = F.array().cast("array<string>")
    unparsed = F.when(F.col("_verdict").isNull(), F.array(F.lit("verdict_unparsed")))
    reasons = (
        F.when(by_nli, F.array(F.lit("nli_confident_skip_think")))
        .when(
            F.col("thinks"),
            F.concat(F.col("trigger_reasons"), F.coalesce(unparsed, nothing)),
        )
        .when(F.col("wants_think"), F.array(F.lit("think_pass_disabled")))
        .otherwise(nothing)
    )
    live = {
        "p_llm_final": p_open,
        "p_fast": F.col("p_fast"),
        "p_think": F.when(F.col("thinks"), p_open),
        "p_llm_no_think": F.col("p_fast"),
        "triggered_think": F.col("thinks"),
        "think_reasons": reasons,
        "think_max_tokens": F.when(F.col("thinks"), F.col("think_budget")),
        "thinking_cot": F.when(F.col("thinks"), F.col("thinking_cot")),
        "verdict_parsed": F.col("_verdict"),
        "confidence_parsed": F.lit(None).cast("string"),
    }
    if has_cache:
        live = {
            name: F.when(F.col("cached"), F.col(f"logged.{name}")).otherwise(column)
            for name, column in live.items()
        }
    out = rows.withColumns(live).withColumn("p_llm", F.col("p_llm_final"))
    spare = ["trigger_reasons", "think_budget", "wants_think", "thinks", "_verdict"]
    return out.drop(*spare, *(["logged"] if has_cache else []))


def log_entries(scored: DataFrame, config: PipelineConfig, seq: int) -> DataFrame:
    """Log rows for the claims that were scored now (cached ones are logged already)."""
    return scored.where(~F.col("cached")).select(
        F.lit(policy.CACHE_VERSION).alias("cache_version"),
        "case_key",
        F.lit(config.meta_hash()).alias("meta_hash"),
        F.lit(seq).cast("long").alias("seq"),
        F.col("context").alias("evidence"),
        "context_original",
        F.col("prompt_bn").alias("prompt"),
        F.col("response_bn").alias("response"),
        "task_type",
        (~tx.is_missing(F.col("context_original"))).alias("has_context"),
        "p_fast",
        "p_think",
        "p_llm_no_think",
        "p_llm_final",
        "triggered_think",
        "think_reasons",
        "think_max_tokens",
        "thinking_cot",
        "verdict_parsed",
        "confidence_parsed",
        "nli_eligible",
        "nli_applied",
        "nli_skip_reason",
        "nli_p_entail",
        "nli_p_contradict",
        "nli_p_neutral",
        "nli_margin",
        "p_nli",
    )
