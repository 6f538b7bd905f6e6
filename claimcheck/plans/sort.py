"""The sort job: numbered lines, a bucket and facts for each, bucket files and a log."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from claimcheck.operators import corpus
from claimcheck.rules import buckets
from claimcheck.scorers import Scorer
from claimcheck.session import exists, own_stages
from claimcheck.sources import corpus as corpus_files

LINE = ("file", "line_no")


def earlier_log(spark: SparkSession, log_path: str) -> DataFrame | None:
    """Log rows of all runs, or None before the first."""
    return spark.read.parquet(log_path) if exists(spark, log_path) else None


def read_buckets(spark: SparkSession, root: str, log_path: str) -> DataFrame:
    """``bucket, value`` of the runs that the log holds.

    A run writes its buckets first and its log last, so a run that died in between counts for
    nothing, and the next one sorts its lines again.
    """
    finished = spark.read.parquet(log_path).select("run").distinct()
    return corpus_files.read_buckets(spark, root).join(finished, "run", "left_semi").select("bucket", "value")


def sort_files(
    spark: SparkSession,
    path: str,
    root: str,
    log_path: str,
    scorer: Scorer,
    keys: Sequence[str] = buckets.TEXT_KEYS,
    annotate: bool = False,
    most: int = 0,
    dry_run: bool = False,
) -> DataFrame:
    """Sort the lines of files that no earlier run logged; lines per bucket over all runs.

    Buckets go to ``root/run=<key>/bucket=<name>``, the log to ``log_path/run=<key>``.
    ``most`` takes the first lines only; a dry run writes neither buckets nor log.
    """
    log = earlier_log(spark, log_path)
    lines = corpus_files.read_numbered_lines(spark, path)
    if log is not None:
        lines = corpus.unsorted_lines(lines, log, LINE)
    run = f"run={time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"
    stage = lambda: corpus.stored_sort(
        lambda: corpus.sort_lines(corpus.read_sort_lines(lines, keys, most), scorer), spark, keys
    )
    if dry_run:
        return corpus.bucket_counts(stage(), log)
    with own_stages(spark):
        rows = stage()
        # Before the log grows by this run's rows; a row for each bucket.
        counts = corpus.bucket_counts(rows, log)
        counts = spark.createDataFrame(counts.collect(), counts.schema)
        corpus_files.write_buckets(
            corpus.fact_rows(rows, keys), os.path.join(root, run), annotate=annotate
        )
        corpus.sort_log(rows).write.option("compression", "zstd").parquet(os.path.join(log_path, run))
    return counts
