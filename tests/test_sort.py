"""The sort job over files, its log, and what a dead run leaves."""

import json
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck import session
from claimcheck.operators import corpus
from claimcheck.plans import sort
from claimcheck.scorers import BatchScorer, ColumnScorer

ANSWER = ColumnScorer(
    ("input_text",),
    lambda t: F.concat(F.lit("bucket: grammar\nreworded:\n- "), F.replace(t, F.lit("; "), F.lit("\n- "))),
)


def counts(df):
    return {r["bucket"]: r["n"] for r in df.collect()}


def test_sort_job_resumes_and_forgets_dead_runs(spark, tmp_path):
    path, root, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"lang": "x", "text": "one; two"}\n\nbroken\n')
    job = (spark, path, root, log, ANSWER)

    assert counts(sort.sort_files(*job, dry_run=True)) == {"grammar": 1, "skip": 1}
    assert sort.earlier_log(spark, log) is None
    assert counts(sort.sort_files(*job, most=1)) == {"grammar": 1}
    assert counts(sort.sort_files(*job)) == {"grammar": 1, "skip": 1}

    # A run that wrote buckets but no log does not count.
    spark.createDataFrame([("stray",)], "value string").write.text(f"{root}/run=0-dead/bucket=grammar")
    (tmp_path / "in" / "b.jsonl").write_text('{"text": "three"}\n')
    assert counts(sort.sort_files(*job)) == {"grammar": 2, "skip": 1}
    rows = sorted(tuple(r) for r in sort.read_buckets(spark, root, log).collect())
    assert rows == [
        ("grammar", '{"lang":"x","text":"one"}'),
        ("grammar", '{"lang":"x","text":"two"}'),
        ("grammar", '{"text":"three"}'),
        ("skip", '{"text":"broken"}'),
    ]
    lines = sort.earlier_log(spark, log).select("line_no").collect()
    assert sorted(r["line_no"] for r in lines) == [1, 1, 3]


def test_annotated_runs_are_read_back(spark, tmp_path):
    path, root, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()
    facts = [f"number {n} {n * 7919 % 9973}" for n in range(500)]
    (tmp_path / "in" / "a.jsonl").write_text('{"text": "' + "; ".join(facts) + '"}\nbroken\n')
    sort.sort_files(spark, path, root, log, ANSWER, annotate=True)
    rows = [(r["bucket"], json.loads(r["value"])) for r in sort.read_buckets(spark, root, log).collect()]
    assert sorted(x["text"] for b, x in rows if b == "grammar") == sorted(facts)
    answer = "bucket: grammar\nreworded:\n- " + "\n- ".join(facts)
    assert {x["_sort_model_output"] for b, x in rows if b == "grammar"} == {answer}
    assert [x for b, x in rows if b == "skip"] == [
        {"text": "broken", "_sort_bucket": "skip", "_sort_line": 2, "_sort_model_output": "invalid_json"}
    ]
    assert sum(f.stat().st_size for f in (tmp_path / "out").rglob("part-*")) < len(facts) * len(answer) / 20


def test_a_job_leaves_no_stage_behind(spark, tmp_path, monkeypatch):
    path, root, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"text": "one; two"}\n{"text": ""}\nbroken\n')
    stored, real = [], session.scratch_path

    def watched(spark, name):
        stored.append(real(spark, name))
        return stored[-1]

    def model():
        return lambda rows: "bucket: grammar\nreworded:\n- " + rows["input_text"].str.replace("; ", "\n- ")

    monkeypatch.setattr(session, "scratch_path", watched)
    scorer = BatchScorer(("input_text",), T.StringType(), model)
    assert counts(sort.sort_files(spark, path, root, log, scorer)) == {"grammar": 1, "skip": 2}
    assert len(stored) >= 2 and not any(session.exists(spark, x) for x in stored)


def test_a_stored_sort_reads_like_the_sorted_lines(spark):
    values = ['{"text": "one; two", "n": [1]}', '{"passage": "three", "text": " "}', "[1]", "bare", '{"n": null}', '{"content": "  ; "}']
    lines = spark.createDataFrame(list(enumerate(values)), "line_no long, value string")
    rows = corpus.sort_lines(corpus.read_sort_lines(lines), ANSWER)
    kept = corpus.stored_sort(lambda: rows, spark)
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(corpus.fact_rows(kept)) == shown(corpus.fact_rows(rows))
    assert shown(corpus.sort_log(kept)) == shown(corpus.sort_log(rows))
    assert counts(corpus.bucket_counts(kept)) == counts(corpus.bucket_counts(rows))
    assert shown(kept.select("line_no", "facts", "error")) == shown(rows.select("line_no", "facts", "error"))


def test_a_stage_keeps_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    before = {str(x) for x in str(files().mkString("\n")).split("\n")}
    left = lambda: [x for x in str(files().mkString("\n")).split("\n") if "shuffle_" in x and x not in before]
    kept = session.materialize(spark.range(100_000).repartition(3, "id"), "shuffled")
    for _ in range(50):
        if not left():
            break
        time.sleep(0.1)
    assert not left() and kept.count() == 100_000
