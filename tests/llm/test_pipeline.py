from collections import Counter

import corpus_pipeline
import pytest

from claimcheck.llm import mixing, simhash, toxicity
from claimcheck.llm.common import stored

from .helpers import SF2, groups, nothing, odd
from .test_jaccard import slow_components
from .test_packing import check_places, slow_pieces
from .test_simhash import slow_groups


def slow_kept(rows):
    """The least id of each group that links of both kinds, close fingerprints and shared shingles, form."""
    at = {doc: i for i, (doc, _) in enumerate(rows)}
    found = [*slow_components(rows), *((doc, least) for doc, _, least in slow_groups(rows))]
    root = groups(len(rows), [(at[doc], at[least]) for doc, least in found])
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        least[r] = min(doc, least.get(r, doc))
    return sorted(least.values())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stored(stage(spark, rows, SF2), name)
        kept[name] = (before, rows)
        if name != "packing":
            assert rows.columns == docs.columns
    before, after = kept["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity.score(before, toxicity.trained(spark, before, SF2)).collect()}
    assert {r.doc_id for r in after.collect()} == {k for k, v in scores.items() if v < 0.5}
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    clean = labels.where("toxic = 0").join(before, "doc_id").count()
    assert labels.where("toxic = 0").join(after, "doc_id").count() >= 0.98 * clean
    before, after = kept["simhash"]
    assert sorted(r.doc_id for r in after.collect()) == slow_kept([(r.doc_id, r.text) for r in before.collect()])
    before, after = kept["mixing"]
    out, own = mixing.mixed(before, labels, mixing.QUALITY, keep=["doc_id"])
    want = Counter({r.doc_id: r[own].copies for r in out.collect()})
    assert Counter(r.doc_id for r in after.collect()) == +want
    before, after = kept["packing"]
    pieces = slow_pieces([(r.doc_id, r.text) for r in before.collect()])
    got = after.collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == pieces
    check_places(got)


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF2)
    assert got.columns[:3] == ["doc_id", "piece", "start"] and got.count() > 500


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_no_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, nothing(spark), SF2).collect() == []
    out = stage(spark, odd(spark), SF2)
    assert out.count() > 0
    if name != "packing":
        assert out.columns == odd(spark).columns


def test_simhash_keeps_rows_it_cannot_name(spark):
    assert simhash.deduplicated(odd(spark)).where("doc_id IS NULL").count() == 1
