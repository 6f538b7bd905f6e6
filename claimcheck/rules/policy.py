"""Task policies: which corpus a task may retrieve from, and what to tell a scorer."""

from __future__ import annotations

# --- fixed values: task names and policy tables -------------------------------
TASKS = (
    "general_fact_null",
    "other_null",
    "famous_bn_fact_null",
    "idiom_meaning_null",
    "literal_meaning_null",
    "bangla_grammar",
    "context_grounded_fact",
    "context_grounded_other",
    "famous_bn_fact_context",
    "translation_or_bilingual",
    "math_work_rate",
    "math_speed_distance",
    "math_profit_loss",
    "math_average",
    "math_other",
    "calendar_arithmetic",
)

RETRIEVAL_SOURCE = {
    "general_fact_null": "wiki",
    "other_null": "wiki",
    "famous_bn_fact_null": "wiki",
    "idiom_meaning_null": "idioms",
    "literal_meaning_null": "literal",
    "bangla_grammar": "grammar",
}

FALLBACK_SOURCE = {
    "idiom_meaning_null": "wiki",
    "literal_meaning_null": "wiki",
}

SOURCES = ("wiki", "idioms", "literal", "grammar")

MATH_TASKS = (
    "math_work_rate",
    "math_speed_distance",
    "math_profit_loss",
    "math_average",
    "math_other",
    "calendar_arithmetic",
)

# A task that never retrieves, whatever the corpora hold.
NO_RETRIEVAL_TASKS = (
    "context_grounded_fact",
    "context_grounded_other",
    "famous_bn_fact_context",
    "translation_or_bilingual",
    *MATH_TASKS,
)

# Lexical routing wins over a model label for these.
LEXICAL_ONLY_TASKS = ("idiom_meaning_null", "literal_meaning_null", "bangla_grammar", *MATH_TASKS)

# A model may not turn one of these into a translation task.
STICKY_FACT_TASKS = (
    "context_grounded_fact",
    "context_grounded_other",
    "famous_bn_fact_context",
    "famous_bn_fact_null",
    "general_fact_null",
)

_COMPUTE = "Calculate internally. Mark F only if the computed answer matches the response."

INSTRUCTIONS = {
    "context_grounded_fact": (
        "Use only the evidence. Mark H for clear factual contradictions, wrong "
        "date/person/place, or claims the evidence directly refutes. "
        "Accept correct partial answers — a response does not need to list every detail "
        "the evidence mentions; it only needs to be factually correct for what it states."
    ),
    "context_grounded_other": (
        "Use only the evidence. Mark H for clear contradictions or factually wrong claims. "
        "Accept correct partial answers — do not reject an answer just because it omits "
        "details the evidence mentions."
    ),
    "famous_bn_fact_context": (
        "Use the evidence first. Watch for Bangladesh/literature swaps that contradict "
        "well-known facts."
    ),
    "idiom_meaning_null": (
        "Judge the Bengali ভাবার্থ / বাগধারা. Missing or irrelevant evidence alone is "
        "NOT H — use your knowledge of the figurative meaning. Mark F only if the "
        "response matches the true ভাবার্থ."
    ),
    "literal_meaning_null": (
        "Judge the শাব্দিক/compositional meaning. Missing or irrelevant evidence alone "
        "is NOT H — use compositional knowledge. Mark F only if the literal gloss is correct."
    ),
    "general_fact_null": (
        "Check the fact carefully. Watch for swapped people, dates, places, nearby "
        "events, and total-vs-part numbers. If the evidence is missing or silent on "
        "the fact, rely on your general knowledge to verify if the statement is correct."
    ),
    "famous_bn_fact_null": (
        "Check the Bangladesh/literature fact carefully. Watch for swapped people, "
        "dates, places, and nearby events. If the evidence is missing or silent on "
        "the fact, rely on your general knowledge to verify if the statement is correct."
    ),
    "bangla_grammar": (
        "Judge strictly by Bangla grammar rules (সমাস, সন্ধি, কারক, বিভক্তি, etc.). "
        "Use evidence when it states the rule or correct form; missing evidence alone "
        "is NOT hallucination — use your internal grammar knowledge. "
        "Accept minor spelling variants when the grammatical category is unambiguously correct. "
        "For সন্ধি: apply the actual phonological rule (e.g. আ+ঈ→এ, giving মহেশ not মহাঈশ; "
        "আ+আ→া, বিদ্যালয় not বিদ্যাআলয়). Reject naive concatenation."
    ),
    "translation_or_bilingual": (
        "Judge the English/Bengali translation or term. Watch for antonyms, wrong "
        "technical terms, and title/person confusion."
    ),
    "math_work_rate": _COMPUTE,
    "math_speed_distance": _COMPUTE,
    "math_profit_loss": _COMPUTE,
    "math_average": _COMPUTE,
    "math_other": (
        "Calculate internally (ratio, interest, area, mixture, etc.). "
        "Mark F only if the computed answer matches the response."
    ),
    "calendar_arithmetic": _COMPUTE,
    "other_null": (
        "No context is provided. Use general knowledge only when confident. If not "
        "clearly correct, mark H."
    ),
}
DEFAULT_INSTRUCTION_TASK = "other_null"

THINK_TOKENS = {
    "bangla_grammar": 768,
    "general_fact_null": 640,
    "idiom_meaning_null": 512,
    "translation_or_bilingual": 384,
    "literal_meaning_null": 384,
    "context_grounded_fact": 384,
    "context_grounded_other": 384,
    "famous_bn_fact_null": 384,
    "famous_bn_fact_context": 320,
    "other_null": 384,
    "math_work_rate": 320,
    "math_speed_distance": 288,
    "math_profit_loss": 288,
    "math_average": 256,
    "math_other": 288,
    "calendar_arithmetic": 288,
}

NLI_TASKS = (
    "context_grounded_fact",
    "context_grounded_other",
    "famous_bn_fact_context",
    "general_fact_null",
)

# (verdict, confidence) -> score
VERDICT_SCORES = {
    ("faithful", "strong"): 0.90,
    ("faithful", "likely"): 0.75,
    ("faithful", "uncertain"): 0.51,
    ("hallucinated", "uncertain"): 0.49,
    ("hallucinated", "likely"): 0.25,
    ("hallucinated", "strong"): 0.10,
}

# Rows per task in the stratified audit slice; "math" covers math_* and calendar_*.
AUDIT_QUOTAS = {
    "context_grounded_fact": 40,
    "general_fact_null": 30,
    "bangla_grammar": 18,
    "context_grounded_other": 18,
    "idiom_meaning_null": 15,
    "literal_meaning_null": 15,
    "famous_bn_fact_null": 14,
    "other_null": 12,
    "translation_or_bilingual": 8,
    "math": 25,
    "famous_bn_fact_context": 5,
}

CACHE_VERSION = "verifier-cache-v3"
# --- end of fixed values -------------------------------------------------------
