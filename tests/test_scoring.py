import pathlib
from claimcheck.operators.cascade import run_stage
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck.config import NliConfig, PipelineConfig, RouterConfig, ThinkConfig
from claimcheck.functions import evidence as ev
from claimcheck.functions import parsing, scoring
from claimcheck.operators import cascade
from claimcheck.rules.cues import BENGALI
from claimcheck.scorers import NLI_TYPE, BatchScorer, ColumnScorer, Scorers

CONFIG = PipelineConfig(router=RouterConfig(mode="static"))


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_verdict_texts(spark):
    rows = [
        ("reason: mismatch\nverdict: Hallucinated\n",),
        ("Verdict is: CORRECT",),
        ("verdict has no basis",),
        ("so it is unfaithful",),
        ("that was wrong",),
        ("x" * 10 + "wrong" + "y" * 150,),
        ("no idea",),
        ("verdict: f",),
        ("verdict = truthful, not false",),
    ]
    got = column(spark, rows, "t string", parsing.parse_verdict(F.col("t")))
    assert got == [
        "Hallucinated",
        "Faithful",
        "Hallucinated",
        "Faithful",
        "Hallucinated",
        None,
        None,
        "Faithful",
        "Faithful",
    ]
    scores = column(spark, rows[:2] + rows[6:7], "t string", parsing.verdict_score(parsing.parse_verdict(F.col("t"))))
    assert scores == [0.10, 0.90, None]


def test_verdict_score_table(spark):
    rows = [
        ("Faithful", "strong"),
        ("Faithful", "likely"),
        ("Hallucinated", "strong"),
        ("Faithful", "hm"),
        (" hallucinated ", None),
        ("", "strong"),
        (None, None),
        ("maybe", None),
    ]
    got = column(spark, rows, "v string, c string", ev.map_verdict(F.col("v"), F.col("c")))
    assert got == [0.90, 0.75, 0.10, 0.75, 0.25, None, None, None]


def reasons(spark, p, task, prompt, evidence="evidence", context=None, config=None, allowed=False):
    row = scoring.ThinkInputs(
        F.lit(p), F.lit(task), F.lit(evidence), F.lit(context).cast("string"), F.lit(prompt), F.lit(allowed)
    )
    config = config or ThinkConfig(low=0.35, high=0.65)
    return spark.range(1).select(scoring.think_reasons(row, config, BENGALI)).first()[0]


def test_think_triggers(spark):
    assert "near_threshold" in reasons(spark, 0.5, "general_fact_null", "কোন")
    assert reasons(spark, 0.5, "famous_bn_fact_null", "রবীন্দ্রনাথ", None) == [
        "near_threshold",
        "famous_bn_fact",
    ]
    assert reasons(spark, 0.95, "famous_bn_fact_null", "রবীন্দ্রনাথ", None) == []
    sandhi = "মহা' ও 'ঈশ' শব্দ দুটির সন্ধিতে কোন শব্দ গঠিত হয়?"
    assert reasons(spark, 0.7, "bangla_grammar", sandhi) == ["grammar_rule_check"]
    assert reasons(spark, 0.99, "bangla_grammar", sandhi) == []
    assert reasons(spark, 0.7, "bangla_grammar", "কারক") == ["bangla_grammar_wide_window"]
    assert reasons(spark, 0.05, "math_work_rate", "কাজ") == []
    assert reasons(spark, 0.5, "math_work_rate", "কাজ") == ["near_threshold", "math_needs_check"]
    two_years = "1971 সালে"
    assert "multi_entity_context" in reasons(
        spark, 0.5, "context_grounded_fact", "কোন", context=two_years
    )
    assert reasons(spark, 0.5, "translation_or_bilingual", "q")[-1] == "translation_check"
    assert reasons(spark, 0.5, "general_fact_null", "কোথায়", None, allowed=True)[-1] == (
        "evidence_missing_keyphrase"
    )
    forced = ThinkConfig(force_all=True)
    assert reasons(spark, 0.99, "other_null", "q", config=forced) == ["force_think_all"]


def test_think_budget(spark):
    config = ThinkConfig(
        max_tokens=512,
        max_tokens_by_task={
            "math_speed_distance": 256,
            "bangla_grammar": 768,
            "context_grounded_fact": 384,
        },
    )
    rows = [("math_speed_distance",), ("bangla_grammar",), ("other_null",)]
    got = column(spark, rows, "t string", scoring.think_budget(F.col("t"), config))
    assert got == [256, 768, 512]


def test_token_score(spark):
    rows = [
        ({"F": 1.0, "H": 1.0},),
        ({"F": 800.0, "H": 799.0},),
        ({"F": 0.0, " F": 0.0, "H": 0.0, "x": 50.0},),
        ({"x": 1.0},),
        ({"H": 3.0},),
    ]
    got = column(spark, rows, "l map<string,double>", scoring.token_score(F.col("l")))
    assert got == pytest.approx([0.5, 1 / (1 + math.exp(-1)), 2 / 3, 0.5, 0.0])


def test_override_mask_and_scores(spark):
    rows = [(0.70, 0.30), (0.70, 0.30), (0.20, 0.70)]
    mask = scoring.override_mask(F.col("e"), F.col("c"), 0.35, 0.45, 0.30)
    assert column(spark, rows, "e double, c double", mask) == [False, False, True]
    rows = [(0.8, 0.1), (0.55, 0.45), (0.1, 0.8)]
    even = scoring.override_mask(F.col("e"), F.col("c"), 0.35)
    assert column(spark, rows, "e double, c double", even) == [True, False, True]
    p = scoring.nli_score(F.col("e"), F.col("c"), NliConfig())
    assert column(spark, rows, "e double, c double", p) == [0.90, 0.90, 0.10]


PREMISE = "পাহাড়পুর বৌদ্ধ বিহার পাল রাজবংশের দ্বিতীয় রাজা ধর্মপাল নির্মাণ করেন।"
GATE_ROWS = [
    ("ধর্মপাল", 0.80, 0.75, 0.20, 0.05, True, "", 0.90),
    ("ধর্মপাল", 0.80, 0.60, 0.25, 0.15, False, "margin_too_low", None),
    ("দেবপাল", 0.80, 0.75, 0.20, 0.05, False, "faithful_low_overlap", 0.90),
    ("ধর্মপাল", 0.25, 0.75, 0.20, 0.05, False, "faithful_fast_disagrees", 0.90),
    ("ধর্মপাল", 0.80, 0.48, 0.02, 0.50, False, "entail_le_neutral", 0.90),
    ("ভুল নাম", 0.20, 0.20, 0.55, 0.25, True, "", 0.10),
]
GIVEN_NLI = ColumnScorer(("scores",), lambda s: s)


def gate_frame(spark, rows, task="context_grounded_fact", **extra):
    data = [
        (i, task, PREMISE, PREMISE, "কে নির্মাণ করেন?", r, p, False, None, (e, c, n))
        for i, (r, p, e, c, n, *_) in enumerate(rows)
    ]
    schema = (
        "id long, task_type string, context_original string, context string, prompt_bn string, "
        "response_bn string, p_fast double, rag_used boolean, retrieval_sim_max double, "
        "scores struct<p_entail:double,p_contradict:double,p_neutral:double>"
    )
    df = spark.createDataFrame(data, schema)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def test_gate_branches(spark):
    config = PipelineConfig(nli=NliConfig(tasks=("context_grounded_fact",)))
    out = cascade.gate(gate_frame(spark, GATE_ROWS), config, GIVEN_NLI).orderBy("id").collect()
    assert [r["nli_applied"] for r in out] == [g[5] for g in GATE_ROWS]
    assert [r["nli_skip_reason"] for r in out] == [g[6] for g in GATE_ROWS]
    assert [r["p_nli"] for r in out] == [g[7] for g in GATE_ROWS]
    assert all(r["nli_eligible"] for r in out)


@pytest.mark.parametrize(
    "task,extra,reason",
    [
        ("bangla_grammar", {}, "task_not_in_nli_list"),
        ("general_fact_null", {"rag_used": True, "retrieval_sim_max": 0.40}, "weak_rag_premise"),
        ("general_fact_null", {"rag_used": True, "retrieval_sim_max": float("nan")}, "weak_rag_premise"),
        ("general_fact_null", {"context_original": "[NULL]", "context": ""}, "empty_premise"),
    ],
)
def test_gate_skips(spark, task, extra, reason):
    out = cascade.gate(gate_frame(spark, GATE_ROWS[:1], task, **extra), PipelineConfig(), GIVEN_NLI)
    row = out.first()
    assert row["nli_skip_reason"] == reason and not row["nli_eligible"] and not row["nli_applied"]
    assert row["nli_p_entail"] is None


def test_gate_off_or_unrouted(spark):
    off = PipelineConfig(nli=NliConfig(enabled=False))
    df = gate_frame(spark, GATE_ROWS[:1])
    assert cascade.gate(df, off, GIVEN_NLI).first()["nli_skip_reason"] == "nli_disabled"
    bare = cascade.gate(df.drop("task_type"), PipelineConfig(), GIVEN_NLI).first()
    assert bare["nli_skip_reason"] == "no_task_type"


def counting(folder, inputs, dtype, answer):
    """Batch scorer that leaves one line per scored row in a folder."""

    def load():
        def score(batch: pd.DataFrame):
            import os
            import uuid

            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("".join(f"{v}\n" for v in batch[inputs[0]]))
            return answer(batch)

        return score

    return BatchScorer(inputs, dtype, load)


def scored_ids(folder):
    return sorted(int(v) for f in folder.iterdir() for v in f.read_text().split())


CASCADE_ROWS = [
    # id, task, context, response, p_fast, entail, contradict, think text
    (1, "context_grounded_fact", "ধর্মপাল রাজা", "ধর্মপাল", 0.5, 0.9, 0.05, "verdict: Hallucinated"),
    (2, "context_grounded_fact", "ধর্মপাল রাজা", "ধর্মপাল", 0.5, 0.5, 0.4, "verdict: Hallucinated"),
    (3, "bangla_grammar", None, "উত্তর", 0.5, 0.9, 0.05, "no verdict at all"),
    (4, "bangla_grammar", None, "উত্তর", 0.9, 0.9, 0.05, "verdict: Hallucinated"),
    (5, "other_null", None, "উত্তর", 0.1, 0.9, 0.05, "verdict: Faithful"),
]


def cascade_frame(spark):
    data = [
        (i, t, c, c, "প্রশ্ন", r, p, (e, k, round(1 - e - k, 2)), text)
        for i, t, c, r, p, e, k, text in CASCADE_ROWS
    ]
    return spark.createDataFrame(
        data,
        "id long, task_type string, context_original string, context string, prompt_bn string, "
        "response_bn string, given_fast double, "
        "given_nli struct<p_entail:double,p_contradict:double,p_neutral:double>, given_text string",
    )


@pytest.mark.parametrize("kind", ["column", "batch"])
def test_cascade_order_and_residual_work(spark, tmp_path, kind):
    fast_dir, nli_dir, think_dir = (tmp_path / n for n in ("fast", "nli", "think"))
    if kind == "column":
        scorers = Scorers(
            ColumnScorer(("given_fast",), lambda x: x),
            ColumnScorer(("given_nli",), lambda x: x),
            ColumnScorer(("given_text",), lambda x: x),
        )
    else:
        for folder in (fast_dir, nli_dir, think_dir):
            folder.mkdir()
        scorers = Scorers(
            counting(str(fast_dir), ("id", "given_fast"), T.DoubleType(), lambda b: b["given_fast"]),
            counting(
                str(nli_dir),
                ("id", "given_nli"),
                NLI_TYPE,
                lambda b: pd.DataFrame(
                    [dict(zip(NLI_TYPE.fieldNames(), r.values() if isinstance(r, dict) else r, strict=True)) for r in b["given_nli"]],
                    index=b.index,
                ),
            ),
            counting(str(think_dir), ("id", "given_text"), T.StringType(), lambda b: b["given_text"]),
        )
    out = {r["id"]: r for r in cascade.score_claims(cascade_frame(spark), CONFIG, scorers).collect()}
    assert {i: out[i]["p_llm"] for i in out} == {1: 0.90, 2: 0.10, 3: 0.5, 4: 0.9, 5: 0.1}
    assert out[1]["think_reasons"] == ["nli_confident_skip_think"] and not out[1]["triggered_think"]
    assert out[2]["triggered_think"] and out[2]["p_think"] == 0.10
    assert out[3]["think_reasons"][-1] == "verdict_unparsed" and out[3]["p_think"] == 0.5
    assert out[4]["think_reasons"] == [] and out[4]["p_think"] is None
    assert out[2]["think_max_tokens"] == 384 and out[5]["think_max_tokens"] is None
    if kind == "batch":
        assert scored_ids(fast_dir) == [1, 2, 3, 4, 5]
        assert scored_ids(nli_dir) == [1, 2]
        assert scored_ids(think_dir) == [2, 3]


def test_think_pass_disabled(spark):
    config = PipelineConfig(router=RouterConfig(mode="static"), think=ThinkConfig(enabled=False))
    scorers = Scorers(
        ColumnScorer(("given_fast",), lambda x: x),
        ColumnScorer(("given_nli",), lambda x: x),
        ColumnScorer(("given_text",), lambda x: x),
    )
    out = {r["id"]: r for r in cascade.score_claims(cascade_frame(spark), config, scorers).collect()}
    assert out[2]["think_reasons"] == ["think_pass_disabled"] and out[2]["p_llm"] == 0.5
    assert out[1]["think_reasons"] == ["nli_confident_skip_think"]
    assert out[5]["think_reasons"] == []
    assert not any(r["triggered_think"] for r in out.values())


def test_config_is_checked():
    for bad in (
        lambda: PipelineConfig(threshold=1.5),
        lambda: ThinkConfig(low=0.9, high=0.1),
        lambda: NliConfig(hypothesis_style="free"),
        lambda: RouterConfig(mode="random"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert PipelineConfig().meta_hash() != PipelineConfig(think=ThinkConfig(force_all=True)).meta_hash()


def test_scorers_may_read_prompts(spark):
    """A model that asks for prompt texts gets them assembled per row."""
    scorers = Scorers(
        ColumnScorer(("fast_prompt",), lambda t: F.when(t.endswith("V:"), 0.5)),
        ColumnScorer(("given_nli",), lambda x: x),
        ColumnScorer(("think_prompt",), lambda t: F.concat(F.lit("verdict: "), F.when(F.contains(t, F.lit("Task: bangla_grammar")), "Faithful"))),
    )
    out = {r["id"]: r for r in cascade.score_claims(cascade_frame(spark), CONFIG, scorers).collect()}
    assert out[3]["p_fast"] == 0.5 and out[3]["p_llm"] == 0.90


def test_prompts_are_built_after_rows_are_stored_and_dealt_out(spark):
    import pandas as pd

    long = "fixed words " * 300

    def load():
        def score(rows: pd.DataFrame) -> pd.Series:
            return rows["prompt"].str.len() + 0.0

        return score

    scorer = BatchScorer(("prompt",), T.DoubleType(), load)
    rows = spark.range(200).select("id", F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("text"))
    asked = (F.col("id") % 2 == 0) | F.when(F.col("id") < 10, F.lit(None).cast("boolean"))

    def prepare(df):
        return df.withColumn("prompt", F.concat(F.lit(long), F.col("text")))

    out = run_stage(rows, scorer, "score", asked, prepare)
    assert out.columns == ["id", "text", "score"]
    want = {k: len(long) + k % 9.0 if k % 2 == 0 else None for k in range(200)}
    assert {r["id"]: r["score"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    exchange = next(i for i, line in enumerate(plan) if "Exchange hash" in line)
    # Neither the stored frame nor what is dealt out holds the fixed words, and no sort carries them.
    assert not any("fixed words" in line for line in plan[exchange:] if "ArrowEvalPython" not in line)
    sort = next(i for i, line in enumerate(plan) if "Sort [" in line)
    assert sort < exchange and "_length" in plan[sort] and "prompt" not in plan[sort]
    cheap = ColumnScorer(("prompt",), F.length)
    assert run_stage(rows, cheap, "score", asked, prepare).columns == ["id", "text", "score"]


def test_a_worker_loads_a_model_once_and_batches_hold_one_budget(spark, tmp_path):
    import os

    import pandas as pd

    loads, calls = str(tmp_path / "loads"), str(tmp_path / "calls")
    os.makedirs(loads)
    os.makedirs(calls)

    def load():
        import uuid

        pathlib.Path(loads, f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def score(rows: pd.DataFrame) -> pd.Series:
            budgets = "_".join(map(str, sorted(rows["budget"].unique())))
            pathlib.Path(calls, f"{len(rows)}-{budgets}-{uuid.uuid4().hex}").touch()
            return rows["budget"] * 2.0

        return score

    scorer = BatchScorer(("budget",), T.DoubleType(), load, batch_rows=7, alike=("budget",))
    rows = spark.range(400).select((F.col("id") % 3).alias("budget")).repartition(40)
    # No column of that name: the stage spreads rows without a key.
    out = run_stage(rows, scorer, "score", F.col("budget") > 0)
    assert out.where("score = budget * 2 AND budget > 0").count() == 266
    assert out.where("score IS NULL AND budget = 0").count() == 134
    processes = [name.split("-")[0] for name in os.listdir(loads)]
    assert len(processes) == len(set(processes))
    made = [name.split("-")[:2] for name in os.listdir(calls)]
    assert all(int(n) <= 7 and budget in ("1", "2") for n, budget in made)
