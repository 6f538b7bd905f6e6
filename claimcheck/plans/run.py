"""The whole run: clean, route, retrieve, score, decide."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig
from claimcheck.functions.vectors import Encoder, HashingEncoder
from claimcheck.operators import cache, cascade, decide, evidence, retrieval
from claimcheck.operators.clean import clean_claims
from claimcheck.scorers import Scorers, lexical_scorers
from claimcheck.session import exists, materialize
from claimcheck.sources import claims as claim_files
from claimcheck.sources import logs


def evidence_stage(
    claims: DataFrame,
    index: DataFrame,
    config: PipelineConfig,
    scorers: Scorers,
    encoder: Encoder,
    limits: retrieval.BlockLimits = retrieval.BlockLimits(),
) -> DataFrame:
    cleaned = clean_claims(claims)
    if not config.router.enabled:
        return evidence.without_router(cleaned)
    return evidence.select_evidence(cleaned, index, config, encoder, scorers, limits)


def run_claims(
    claims: DataFrame,
    index: DataFrame,
    config: PipelineConfig | None = None,
    scorers: Scorers | None = None,
    encoder: Encoder | None = None,
    log: DataFrame | None = None,
    exemplars: DataFrame | None = None,
    limits: retrieval.BlockLimits = retrieval.BlockLimits(),
) -> DataFrame:
    """Scored and labelled claims; ``decide.debug_table`` and ``decide.submission`` read it."""
    config = config or PipelineConfig()
    scorers = scorers or lexical_scorers(config.router.cues)
    encoder = encoder or HashingEncoder()
    rows = evidence_stage(claims, index, config, scorers, encoder, limits)
    if config.exemplar_top_k > 0 and exemplars is not None:
        hits = retrieval.exemplar_hits(
            rows, exemplars, encoder, k=config.exemplar_top_k, limits=limits
        )
        rows = rows.join(retrieval.exemplar_lists(hits, exemplars), "id", "left")
    scored = materialize(cascade.score_claims(rows, config, scorers, log), "scored")
    return decide.label_claims(scored, config)


def resume_claims(
    claims: DataFrame,
    index: DataFrame,
    root: str,
    config: PipelineConfig | None = None,
    scorers: Scorers | None = None,
    encoder: Encoder | None = None,
    resume_evidence: bool = False,
    force: bool = False,
    limits: retrieval.BlockLimits = retrieval.BlockLimits(),
) -> DataFrame:
    """A run that keeps its evidence, score log and checkpoint under ``root``.

    A checkpoint of these claims, evidence and settings stands in for scoring; else cases
    that the log holds keep their score, and the others are scored and logged.
    ``resume_evidence`` takes the stored evidence as it is, ``force`` scores everything anew.
    Gives the columns of the evidence, ``case_key``, ``p_llm``, ``label`` and the debug fields
    of the log, whichever way the scores came.
    """
    spark = claims.sparkSession
    config = config or PipelineConfig()
    scorers = scorers or lexical_scorers(config.router.cues)
    encoder = encoder or HashingEncoder()
    evidence_path, log_path, saved_path = (
        os.path.join(root, name) for name in ("evidence", "log", "checkpoint")
    )
    if not (resume_evidence and exists(spark, evidence_path)):
        rows = evidence_stage(claims, index, config, scorers, encoder, limits)
        claim_files.write_table(rows, evidence_path)
    rows = cache.with_case_key(spark.read.parquet(evidence_path), config)
    meta = {
        "meta_hash": config.meta_hash(),
        "scorer": config.scorer_name,
        "evidence": cache.fingerprint(rows).first()["fingerprint"],
    }
    values = None
    if not force and exists(spark, saved_path):
        values = cache.load_checkpoint(spark.read.parquet(saved_path), rows, "p_llm", meta)
    if values is None:
        log = logs.read_log(spark, log_path) if not force and exists(spark, log_path) else None
        scored = materialize(cascade.score_claims(rows, config, scorers, log), "scored")
        seq = time.time_ns() // 1_000_000 * 1_000_000
        logs.append_log(cascade.log_entries(scored, config, seq), log_path)
        claim_files.write_table(cache.checkpoint_rows(scored, "p_llm", meta), saved_path)
        values = spark.read.parquet(saved_path).select("id", "p_llm")
    logged = cache.latest_entries(cache.matching_log(logs.read_log(spark, log_path), config))
    full = rows.join(values, "id").join(logged, "case_key", "left")
    fields = [F.col(f"logged.{f}").alias(f) for f in cache.LOGGED_FIELDS]
    return decide.label_claims(full.select(*rows.columns, "p_llm", *fields), config)
