"""Explicit schemas of every table the pipeline reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


LONG, INT, STR, BOOL, DBL = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.BooleanType(),
    T.DoubleType(),
)

CLAIM = _struct(("id", LONG), ("context", STR), ("prompt_bn", STR), ("response_bn", STR))
LABELLED_CLAIM = _struct(
    ("id", LONG), ("context", STR), ("prompt_bn", STR), ("response_bn", STR), ("label", INT)
)
TRUTH = _struct(("id", LONG), ("label", INT))
CORPUS_LINE = _struct(("text", STR), ("passage", STR), ("_corrupt_record", STR))
PASSAGE = _struct(("source", STR), ("passage_id", LONG), ("text", STR))
INDEX = _struct(
    ("source", STR),
    ("passage_id", LONG),
    ("text", STR),
    ("passage_hash", STR),
    ("embedding", T.ArrayType(T.FloatType())),
)
ARTICLE = _struct(("title", STR), ("text", STR))

NLI_COLUMNS = (
    "nli_eligible",
    "nli_applied",
    "nli_skip_reason",
    "nli_p_entail",
    "nli_p_contradict",
    "nli_p_neutral",
    "nli_margin",
    "p_nli",
)

# Columns a score writes to the log, beside the case fields.
LOG = _struct(
    ("cache_version", STR),
    ("case_key", STR),
    ("meta_hash", STR),
    ("seq", LONG),
    ("evidence", STR),
    ("context_original", STR),
    ("prompt", STR),
    ("response", STR),
    ("task_type", STR),
    ("has_context", BOOL),
    ("p_fast", DBL),
    ("p_think", DBL),
    ("p_llm_no_think", DBL),
    ("p_llm_final", DBL),
    ("triggered_think", BOOL),
    ("think_reasons", T.ArrayType(STR)),
    ("think_max_tokens", INT),
    ("thinking_cot", STR),
    ("verdict_parsed", STR),
    ("confidence_parsed", STR),
    ("nli_eligible", BOOL),
    ("nli_applied", BOOL),
    ("nli_skip_reason", STR),
    ("nli_p_entail", DBL),
    ("nli_p_contradict", DBL),
    ("nli_p_neutral", DBL),
    ("nli_margin", DBL),
    ("p_nli", DBL),
)

SORT_LOG = _struct(
    ("line_no", LONG),
    ("input_text", STR),
    ("parsed_bucket", STR),
    ("reworded_facts", T.ArrayType(STR)),
    ("raw_model_output", STR),
    ("error", STR),
)

# --- fixed values: the 39 columns of the debug table, in order; the last two
# name the plugged-in scorer instead of one particular model -----------------------
DEBUG_COLUMNS = (
    "id",
    "label",
    "p_llm",
    "threshold",
    "threshold_margin",
    "task_type",
    "p_fast",
    "p_think",
    "triggered_think",
    "think_max_tokens",
    "think_reasons",
    "verdict_parsed",
    "confidence_parsed",
    "think_changed_label",
    "thinking_cot",
    "nli_eligible",
    "nli_applied",
    "nli_skip_reason",
    "nli_p_entail",
    "nli_p_contradict",
    "nli_p_neutral",
    "nli_margin",
    "p_nli",
    "rag_used",
    "rag_source",
    "rag_skipped_reason",
    "evidence_source",
    "evidence_relevance",
    "n_retrieved",
    "retrieval_sim_max",
    "retrieval_sim_mean",
    "context_original",
    "context",
    "prompt_bn",
    "response_bn",
    "run_timestamp",
    "hardware_profile",
    "scorer_name",
    "scorer_mode",
)
# --- end of fixed values ---------------------------------------------------------
