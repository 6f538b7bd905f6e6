"""Prompt texts for pluggable scorers, assembled from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimcheck.functions import text as tx
from claimcheck.functions.evidence import instruction_for_task
from claimcheck.rules import buckets, policy

# --- fixed values: wording that scorers expect ---------------------------------------
NO_EVIDENCE = (
    "No evidence provided. Use your internal knowledge to judge the "
    "correctness of the answer based on the Rule."
)
FAST_CLOSING = (
    "Return one token only: F = faithful/correct/label 1; H = hallucinated/wrong/label 0.\n"
)
FAST_CUE = "V:"
THINK_OPENING = (
    "Instruction: Assess if candidate response 'A' to question 'Q' is correct and "
    "faithful (verdict: Faithful) or wrong/hallucinated (verdict: Hallucinated) "
    "based on the Rule and Evidence.\n"
)
THINK_CLOSING = "Reason briefly, then end with exactly:\nverdict: Faithful|Hallucinated"
PARTIAL_NOTE = (
    "A correct partial answer is Faithful — do NOT mark Hallucinated "
    "just because the answer omits details the evidence did not ask for."
)
PARTIAL_TASKS = ("context_grounded_fact", "context_grounded_other", "famous_bn_fact_context")
WORKING_NOTE = "Show your calculation step by step, then state the verdict."
WORKING_TASKS = (*policy.MATH_TASKS, "translation_or_bilingual")
CATEGORY_OPENING = (
    "Classify this Bengali question 'Q' and candidate answer 'A' into one of these categories:\n"
    "G: Grammar/Syntax/Spelling rules (কারক, বিভক্তি, সন্ধি, সমাস, বানান, ইত্যাদি)\n"
    "M: Mathematics, numbers, averages, speed, profit, or calendar arithmetic (গড়, লাভ-ক্ষতি, গতিবেগ, কাজ-সময়, ক্যালেন্ডার, ইত্যাদি)\n"
    "I: Idioms (বাগধারা/প্রবাদ-প্রবচন) or figurative/compositional meaning (শাব্দিক অর্থ, ইত্যাদি)\n"
    "T: Translation, English-Bengali bilingual terms, or definition comparison\n"
    "F: Factual knowledge (General knowledge, geography, famous Bengali history/literature/entities)\n"
    "O: Other general questions/uncategorized\n\n"
)
CATEGORY_CLOSING = (
    "Return exactly one character category code (G, M, I, T, F, or O):\nCategory:"
)
# --- end of fixed values ------------------------------------------------------------------


def _shown(text: Column) -> Column:
    return F.coalesce(text, F.lit("[NULL]"))


def hypothesis(prompt: Column, response: Column, style: str = "qa_en") -> Column:
    """Statement to test against a premise, in one of four published wordings."""
    q, a = _shown(prompt), _shown(response)
    if style == "answer_only":
        return a
    if style == "claim_bn":
        return F.concat(F.lit("প্রশ্ন: "), q, F.lit("\nউত্তর: "), a)
    if style == "qa_bn":
        return F.concat(F.lit("প্রশ্নের উত্তর: "), a)
    return F.concat(F.lit("The answer to the question '"), q, F.lit("' is: "), a)


def evidence_block(evidence: Column) -> Column:
    return F.when(tx.is_missing(evidence), F.lit(NO_EVIDENCE)).otherwise(
        F.concat(F.lit("<evidence>\n"), tx.strip(evidence), F.lit("\n</evidence>"))
    )


def exemplar_block(exemplars: Column) -> Column:
    """``exemplars``: array of (context, prompt_bn, response_bn, label) in rank order."""
    shots = F.transform(
        exemplars,
        lambda e, i: F.concat(
            F.lit("Ex "),
            (i + 1).cast("string"),
            F.lit("\nE: "),
            _shown(e["context"]),
            F.lit("\nQ: "),
            _shown(e["prompt_bn"]),
            F.lit("\nA: "),
            _shown(e["response_bn"]),
            F.lit("\nV: "),
            F.when(e["label"] == 1, F.lit("F")).otherwise(F.lit("H")),
            F.lit("\n\n"),
        ),
    )
    return F.coalesce(F.array_join(shots, ""), F.lit(""))


def _case_text(task: Column, evidence: Column, prompt: Column, response: Column) -> Column:
    return F.concat(
        F.lit("Task: "),
        task,
        F.lit("\nRule: "),
        instruction_for_task(task),
        F.lit("\n"),
        evidence_block(evidence),
        F.lit("\nQ: "),
        _shown(prompt),
        F.lit("\nA: "),
        _shown(response),
        F.lit("\n"),
    )


def fast_prompt(
    task: Column, evidence: Column, prompt: Column, response: Column, exemplars: Column
) -> Column:
    return F.concat(
        exemplar_block(exemplars),
        _case_text(task, evidence, prompt, response),
        F.lit(FAST_CLOSING + FAST_CUE),
    )


def think_instruction(task: Column) -> Column:
    note = F.concat_ws(
        " ",
        F.when(task.isin(*PARTIAL_TASKS), F.lit(PARTIAL_NOTE)),
        F.when(task.isin(*WORKING_TASKS), F.lit(WORKING_NOTE)),
    )
    line = F.when(note != "", F.concat(note, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(THINK_OPENING), line, F.lit(THINK_CLOSING))


def think_prompt(
    task: Column, evidence: Column, prompt: Column, response: Column, exemplars: Column
) -> Column:
    return F.concat(
        exemplar_block(exemplars),
        _case_text(task, evidence, prompt, response),
        think_instruction(task),
    )


def category_prompt(prompt: Column, response: Column) -> Column:
    return F.concat(
        F.lit(CATEGORY_OPENING + "Q: "),
        _shown(prompt),
        F.lit("\nA: "),
        F.coalesce(response, F.lit("")),
        F.lit("\n\n" + CATEGORY_CLOSING),
    )


def sort_prompt(text: Column, chars: int | None = None) -> Column:
    """Corpus-sort prompt with the whole text, since the answer replaces all of it.

    ``chars`` shows a model no more than its first characters; that limit is the model's own.
    """
    before, after = buckets.SORT_PROMPT.split("{text}")
    shown = text if chars is None else F.substring(text, 1, chars)
    return F.concat(F.lit(before), shown, F.lit(after))
