import pytest
from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig, RetrievalConfig, RouterConfig
from claimcheck.functions import evidence as ev
from claimcheck.functions import prompts
from claimcheck.functions.vectors import HashingEncoder
from claimcheck.operators import decide, evidence, retrieval
from claimcheck.rules import policy

CONFIG = PipelineConfig(
    router=RouterConfig(mode="static"), retrieval=RetrievalConfig(threshold=0.5, max_evidence_tokens=8)
)
ENCODER = HashingEncoder(256)


@pytest.mark.parametrize(
    "task,context,factual,allowed,source",
    [
        ("math_average", None, False, False, None),
        ("math_other", None, False, False, None),
        ("context_grounded_fact", "some context", False, False, None),
        ("translation_or_bilingual", None, False, False, None),
        ("general_fact_null", None, False, True, "wiki"),
        ("famous_bn_fact_null", None, False, True, "wiki"),
        ("idiom_meaning_null", None, False, True, "idioms"),
        ("literal_meaning_null", None, False, True, "literal"),
        ("bangla_grammar", None, False, True, "grammar"),
        ("bangla_grammar", "given", False, False, "grammar"),
        ("other_null", None, True, True, "wiki"),
        ("other_null", None, False, False, "wiki"),
    ],
)
def test_policy(spark, task, context, factual, allowed, source):
    row = spark.range(1).select(
        ev.may_retrieve(F.lit(task), F.lit(context).cast("string"), F.lit(factual)).alias("ok"),
        ev.source_for_task(F.lit(task)).alias("source"),
    )
    got = row.first()
    assert got["ok"] is allowed and got["source"] == source


def test_skip_reasons(spark):
    rows = [("math_other", None), ("math_other", "x"), ("other_null", None), ("unknown", None)]
    df = spark.createDataFrame(rows, "t string, c string")
    got = [r[0] for r in df.select(ev.skip_reason(F.col("t"), F.col("c"))).collect()]
    assert got == [
        "task_policy:math_other",
        "original_context_present",
        None,
        "no_rag_source:unknown",
    ]


def test_instructions(spark):
    rows = [("bangla_grammar",), ("never heard of",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(ev.instruction_for_task(F.col("t"))).collect()]
    assert "missing evidence alone is not" in got[0].lower() and "not RAG" not in got[0]
    assert got[1] == policy.INSTRUCTIONS["other_null"]
    assert set(policy.INSTRUCTIONS) == set(policy.TASKS)


def test_prompts(spark):
    row = spark.range(1).select(
        prompts.think_instruction(F.lit("general_fact_null")).alias("plain"),
        prompts.think_instruction(F.lit("math_other")).alias("math"),
        prompts.evidence_block(F.lit("[NULL]")).alias("none"),
        prompts.evidence_block(F.lit(" e ")).alias("some"),
        prompts.hypothesis(F.lit("q"), F.lit("a")).alias("h"),
        prompts.sort_prompt(F.lit("x" * 2000)).alias("sort"),
        prompts.sort_prompt(F.lit("x" * 2000), 1500).alias("short"),
    ).first()
    assert row["plain"].endswith("verdict: Faithful|Hallucinated")
    assert "Show your calculation" in row["math"] and "Show your calculation" not in row["plain"]
    assert row["none"] == prompts.NO_EVIDENCE and row["some"] == "<evidence>\ne\n</evidence>"
    assert row["h"] == "The answer to the question 'q' is: a"
    assert row["sort"].endswith("Input Text: " + "x" * 2000 + "\n")
    assert row["short"].endswith("Input Text: " + "x" * 1500 + "\n")


def test_router_disabled(spark):
    df = spark.createDataFrame([(1, "প্রসঙ্গ"), (2, None)], "id long, context string")
    rows = evidence.without_router(df).orderBy("id").collect()
    assert [r["task_type"] for r in rows] == ["context_grounded_other", "other_null"]
    assert [r["rag_used"] for r in rows] == [False, False]
    assert {r["rag_skipped_reason"] for r in rows} == {"router_disabled"}
    assert [r["evidence_source"] for r in rows] == ["original_context", "none"]


CLAIMS = [
    # found in its own source / only in the fallback / nowhere / no index / given / no fact
    (1, None, '"alpha beta" ভাবার্থ', "x"),
    (2, None, '"gamma delta" ভাবার্থ', "x"),
    (3, None, '"zeta eta" ভাবার্থ', "x"),
    (4, None, "সমাস", "x"),
    (5, "given text", "কোন", "y"),
    (6, None, "গাছ", "গাছ"),
    (7, None, "দূরত্ব", "গাছ"),
    (8, None, "gamma delta কোন", "গাছ"),
    (9, None, '"alpha beta" শাব্দিক অর্থ', "x"),
    (10, None, '"gamma delta" শাব্দিক অর্থ', "x"),
]
PASSAGES = [
    ("idioms", 1, "alpha beta"),
    ("wiki", 2, "gamma delta"),
    ("wiki", 3, "gamma delta কোন"),
    ("wiki", 4, "alpha beta more"),
]


@pytest.fixture(scope="module")
def selected(spark):
    claims = spark.createDataFrame(
        CLAIMS, "id long, context string, prompt_bn string, response_bn string"
    )
    passages = spark.createDataFrame(PASSAGES, "source string, passage_id long, text string")
    index = retrieval.embed_passages(passages, ENCODER)
    out = evidence.select_evidence(claims, index, CONFIG, ENCODER)
    return {r["id"]: r for r in out.collect()}


def test_every_claim_is_kept(selected):
    assert sorted(selected) == list(range(1, 11))


@pytest.mark.parametrize(
    "id_,source,origin,reason,relevance,used",
    [
        (1, "idioms", "rag:idioms", "", "retrieved", True),
        (2, "wiki", "rag:wiki(fallback)", "", "retrieved", True),
        (3, "idioms", "rag:idioms", "", "retrieval_empty", True),
        (4, "grammar", "none", "index_missing:grammar", "no_evidence", False),
        (5, "", "original_context", "original_context_present", "provided", False),
        (6, "", "none", "other_null_not_factual", "no_evidence", False),
        (7, "", "none", "task_policy:math_speed_distance", "no_evidence", False),
        (8, "wiki", "rag:wiki", "", "retrieved", True),
        # No literal index at all: the fallback is the resolved source, not a second try.
        (9, "wiki", "rag:wiki", "", "retrieved", True),
        (10, "wiki", "rag:wiki", "", "retrieved", True),
    ],
)
def test_evidence_annotations(selected, id_, source, origin, reason, relevance, used):
    row = selected[id_]
    assert row["rag_source"] == source
    assert row["evidence_source"] == origin
    assert row["rag_skipped_reason"] == reason
    assert row["evidence_relevance"] == relevance
    assert row["rag_used"] is used


def test_evidence_texts(selected):
    assert selected[1]["context"] == "alpha beta" and selected[1]["n_retrieved"] == 1
    assert selected[2]["context"].startswith("gamma delta")
    assert selected[3]["context"] is None and selected[3]["n_retrieved"] == 0
    assert selected[3]["retrieval_sim_max"] is None
    assert selected[5]["context"] == "given text"
    assert selected[2]["retrieval_sim_max"] == 1.0


def test_count_table_with_rest(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbccde"], "k string")
    rows = [tuple(r) for r in decide.count_table(df, F.col("k"), top=2).collect()]
    assert rows == [("a", 3, 33.3), ("b", 2, 22.2), ("…", 4, None)]
    assert decide.count_table(df, F.col("k")).count() == 5
