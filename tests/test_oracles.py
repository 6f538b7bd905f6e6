"""Every registered query against its SQL oracle on the smallest tables, and its plan."""

import importlib
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from claimcheck.session import plan_text

check = importlib.import_module("check_oracle")
SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle.statements()
QUERIES = {name: fn for name, fn in entry.queries().items() if name in entry.registered.QUERIES}

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


def test_every_query_has_an_oracle():
    # Approximate hits have no SQL; test_approximate measures their recall.
    assert set(QUERIES) - set(ORACLES) == {"topk_lsh"} and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    result = check.compare(spark, duck, SF, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result


# The plans that carry the data, and reports that read a stored stage.
PLANS = [
    "clean_claims",
    "route_hybrid",
    "chunked_passages",
    "topk_vectors",
    "evidence_texts",
    "scored_claims",
    "classification_report",
    "worst_samples",
    "audit_slice",
    "cache_misses",
    "table_fingerprint",
    "related_pages",
    "sorted_facts",
]


@pytest.mark.parametrize("name", PLANS)
def test_plan_has_no_cross_join(spark, name):
    plan = plan_text(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_group_limits_cut_before_the_shuffle(spark):
    for name in ("audit_slice", "worst_samples", "title_lists_capped"):
        assert "WindowGroupLimit" in plan_text(QUERIES[name](spark, SF)), name


def test_reports_read_only_their_columns(spark):
    plan = plan_text(QUERIES["errors_by_task"](spark, SF))
    debug_scan = [line for line in plan.split("\n") if "ReadSchema" in line and "task_type" in line]
    assert debug_scan and all("thinking_cot" not in line for line in debug_scan)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["count"] for r in rows) == 34


def test_every_reason_and_nearly_every_bengali_flag_occurs(spark):
    rows = QUERIES["nli_gate_reasons"](spark, "/root/testdata/sf0.01").collect()
    assert {r.nli_skip_reason for r in rows} == {
        "", "task_not_in_nli_list", "empty_premise", "weak_rag_premise", "margin_too_low", "entail_le_neutral",
        "faithful_fast_disagrees",
    }
    flags = [r.asDict() for r in QUERIES["cue_flags_bn"](spark, "/root/testdata/sf0.01").collect()]
    seen = {name for row in flags for name, value in row.items() if name != "id" and value}
    assert len(seen) >= len(flags[0]) - 2
