"""Bench: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Every query is written to Spark's no-op sink.  Stored stages (index, evidence, scores) are
timed by the query that builds them; the reports after it read the stored stage.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from claimcheck.plans import queries  # noqa: E402
from claimcheck.session import local_session, ship_package  # noqa: E402


def run_all(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def stage(build):
    """Time the building of a stored stage."""
    return lambda spark, sf_dir: run_all(build(spark, sf_dir).limit(0))


def registered(name: str):
    return lambda spark, sf_dir: run_all(queries.QUERIES[name](spark, sf_dir))


HEADLINES = {
    "clean_text": registered("clean_text"),
    "clean_claims": registered("clean_claims"),
    "route_hybrid": registered("route_hybrid"),
    "chunked_passages": registered("chunked_passages"),
    "index_build": stage(queries.index),
    "routed_build": stage(queries.routed),
    "topk_vectors": registered("topk_vectors"),
    "topk_vectors_cells": registered("topk_vectors_cells"),
    "topk_vectors_by_source": registered("topk_vectors_by_source"),
    "evidence_hits": registered("evidence_hits"),
    "evidence_build": stage(queries.with_evidence),
    "exemplar_hits": registered("exemplar_hits"),
    "scores_build": stage(queries.scored),
    "scored_claims_batch": registered("scored_claims_batch"),
    "cached_scores": registered("cached_scores"),
    "debug_build": stage(queries.debug),
    "submission": registered("submission"),
    "classification_report": registered("classification_report"),
    "worst_samples": registered("worst_samples"),
    "nli_rules": registered("nli_rules"),
    "audit_slice": registered("audit_slice"),
    "table_fingerprint": registered("table_fingerprint"),
    "stream_scoring": registered("stream_scoring"),
    "run_resumed": registered("run_resumed"),
    "sort_resumed": registered("sort_resumed"),
    "article_categories": registered("article_categories"),
    "related_pages": registered("related_pages"),
    "sorted_lines": registered("sorted_lines"),
    "sorted_facts": registered("sorted_facts"),
}


def warm_up(spark: SparkSession) -> None:
    """Start the JVM tasks and the Python workers."""
    doubled = F.pandas_udf(lambda s: s * 2, "long")
    spark.range(1000).repartition(8).select(doubled("id")).count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    ship_package(spark)
    warm_up(spark)
    seconds: dict[str, float] = {}
    for name, job in HEADLINES.items():
        start = time.perf_counter()
        job(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
