"""Score arithmetic of the cascade as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimcheck.config import NliConfig, ThinkConfig
from claimcheck.functions import text as tx
from claimcheck.functions.evidence import lookup
from claimcheck.rules import policy
from claimcheck.rules.cues import CuePack

# --- fixed values -----------------------------------------------------------------
FAITHFUL_TOKENS = ("F", " F", "faithful", " Faithful")
HALLUCINATED_TOKENS = ("H", " H", "hallucinated", " Hallucinated")
GRAMMAR_BAND = (0.2, 0.8)
# --- end of fixed values ------------------------------------------------------------


def token_score(logits: Column) -> Column:
    """P(faithful) from next-token logits: softmax mass of F tokens against H tokens.

    The softmax denominator cancels, so only the listed tokens are needed; without any
    of them the answer is 0.5.
    """

    def listed(tokens: tuple[str, ...]) -> Column:
        return F.filter(
            F.array(*[F.try_element_at(logits, F.lit(t)) for t in tokens]),
            lambda x: x.isNotNull(),
        )

    f_logits, h_logits = listed(FAITHFUL_TOKENS), listed(HALLUCINATED_TOKENS)
    top = F.greatest(F.array_max(f_logits), F.array_max(h_logits))

    def mass(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))

    f_mass, h_mass = mass(f_logits), mass(h_logits)
    return F.when(top.isNull(), F.lit(0.5)).otherwise(f_mass / (f_mass + h_mass))


@dataclass(frozen=True)
class ThinkInputs:
    p_fast: Column
    task: Column
    evidence: Column
    context_original: Column
    prompt: Column
    may_retrieve: Column


def think_reasons(row: ThinkInputs, config: ThinkConfig, cues: CuePack) -> Column:
    """Ordered reasons to think a row over; an empty array means the fast score stands."""
    if config.force_all:
        return F.array(F.lit("force_think_all"))
    near = row.p_fast.between(config.low, config.high)
    wide = row.p_fast.between(*GRAMMAR_BAND) & (row.task == "bangla_grammar")
    rule_question = tx.holds(F.coalesce(row.prompt, F.lit("")), cues.grammar_rule_check)
    many_mentions = tx.mention_count(row.context_original, cues.date_or_entity) >= 2
    checks = (
        (near, "near_threshold"),
        (
            near & row.task.isin("famous_bn_fact_null", "famous_bn_fact_context"),
            "famous_bn_fact",
        ),
        (near & (row.task == "context_grounded_fact") & many_mentions, "multi_entity_context"),
        (near & row.task.isin(*policy.MATH_TASKS), "math_needs_check"),
        (wide & rule_question, "grammar_rule_check"),
        (wide & ~rule_question, "bangla_grammar_wide_window"),
        (near & (row.task == "translation_or_bilingual"), "translation_check"),
        (
            near & row.may_retrieve & tx.evidence_irrelevant(row.prompt, row.evidence),
            "evidence_missing_keyphrase",
        ),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(reason)) for test, reason in checks]))


def think_budget(task: Column, config: ThinkConfig) -> Column:
    by_task = lookup(dict(config.max_tokens_by_task), task) if config.max_tokens_by_task else None
    default = F.lit(config.max_tokens)
    return (default if by_task is None else F.coalesce(by_task, default)).cast("int")


def premise(context_original: Column, context: Column) -> Column:
    """The given context, else the retrieved evidence, else NULL."""
    return F.coalesce(
        tx.strip(tx.present(context_original)), tx.strip(tx.present(context))
    )


def nli_block(
    task: Column, premise_text: Column, rag_used: Column, sim_max: Column, config: NliConfig
) -> Column:
    """Reason why a row must not be settled by entailment; NULL when it is eligible.

    A similarity that is NULL or NaN counts as weak.
    """
    weak = F.lit(False)
    if config.min_retrieval_similarity > 0:
        low = F.isnan(sim_max) | (sim_max < config.min_retrieval_similarity)
        weak = F.coalesce(rag_used, F.lit(False)) & F.coalesce(low, F.lit(True))
    return (
        F.when(~task.isin(*config.tasks), F.lit("task_not_in_nli_list"))
        .when(premise_text.isNull(), F.lit("empty_premise"))
        .when(weak, F.lit("weak_rag_premise"))
    )


def override_mask(
    entail: Column,
    contradict: Column,
    margin: float,
    margin_faithful: float | None = None,
    margin_hallucinated: float | None = None,
) -> Column:
    """Entailment is sure enough to settle the row; each side has its own margin."""
    faithful = margin if margin_faithful is None else margin_faithful
    hallucinated = margin if margin_hallucinated is None else margin_hallucinated
    needed = F.when(entail > contradict, F.lit(faithful)).otherwise(F.lit(hallucinated))
    return F.abs(entail - contradict) >= needed


def nli_score(entail: Column, contradict: Column, config: NliConfig) -> Column:
    return F.when(entail > contradict, F.lit(config.faithful_score)).otherwise(
        F.lit(config.hallucinated_score)
    )


def nli_objection(
    entail: Column,
    contradict: Column,
    neutral: Column,
    premise_text: Column,
    response: Column,
    p_fast: Column,
    config: NliConfig,
) -> Column:
    """Why a scored row is still not settled; NULL when entailment settles it.

    Only a faithful outcome has to pass the extra guards.
    """
    sure = override_mask(
        entail, contradict, config.margin, config.margin_faithful, config.margin_hallucinated
    )
    faithful = entail > contradict
    reason = F.when(~sure, F.lit("margin_too_low"))
    if config.require_entail_over_neutral:
        reason = reason.when(faithful & (entail <= neutral), F.lit("entail_le_neutral"))
    if config.require_overlap:
        supported = tx.answer_in_premise(premise_text, response, config.overlap_min)
        reason = reason.when(faithful & ~supported, F.lit("faithful_low_overlap"))
    if config.block_on_fast_disagreement:
        against = p_fast.isNotNull() & ~F.isnan(p_fast) & (p_fast < config.fast_max_for_faithful)
        reason = reason.when(faithful & against, F.lit("faithful_fast_disagrees"))
    return reason


def threshold_label(score: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on.  Spark sorts NaN above every number, so it is ruled out here."""
    return F.when(~F.isnan(score) & (score >= threshold), F.lit(1)).otherwise(F.lit(0))
