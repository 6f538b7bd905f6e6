"""Score cache, fingerprints and checkpoints as joins and aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig
from claimcheck.rules import policy

# Cleaned text cannot contain this, so joined fields stay apart.
SEPARATOR = "\x1f"

LOGGED_FIELDS = (
    "p_llm_final",
    "p_fast",
    "p_think",
    "p_llm_no_think",
    "triggered_think",
    "think_reasons",
    "think_max_tokens",
    "thinking_cot",
    "verdict_parsed",
    "confidence_parsed",
)


def _joined(columns: Sequence[Column]) -> Column:
    return F.concat_ws(
        SEPARATOR, *[F.coalesce(c.cast("string"), F.lit("[NULL]")) for c in columns]
    )


def case_key(
    task: Column,
    context_original: Column,
    evidence: Column,
    prompt: Column,
    response: Column,
    meta_hash: str,
) -> Column:
    """Identity of one scoring case under one configuration."""
    parts = [F.lit(policy.CACHE_VERSION), task, context_original, evidence, prompt, response]
    return F.sha2(_joined([*parts, F.lit(meta_hash)]), 256)


def with_case_key(claims: DataFrame, config: PipelineConfig) -> DataFrame:
    return claims.withColumn(
        "case_key",
        case_key(
            *[
                F.col(c)
                for c in ("task_type", "context_original", "context", "prompt_bn", "response_bn")
            ],
            config.meta_hash(),
        ),
    )


def matching_log(log: DataFrame, config: PipelineConfig) -> DataFrame:
    """Log rows of this cache version and exactly these settings."""
    return log.where(
        (F.col("cache_version") == policy.CACHE_VERSION)
        & (F.col("meta_hash") == config.meta_hash())
    )


def latest_entries(log: DataFrame) -> DataFrame:
    """Newest log row per case as ``case_key, logged``.

    ``max_by`` combines before the shuffle, so a case logged very often is no hot group.
    """
    return log.groupBy("case_key").agg(
        F.max_by(F.struct(*LOGGED_FIELDS), F.col("seq")).alias("logged")
    )


def debug_entries(log: DataFrame) -> DataFrame:
    """Newest logged debug fields per case, reasons as one pipe-joined text."""
    latest = latest_entries(log).select("case_key", "logged.*")
    return latest.withColumn("think_reasons", F.array_join("think_reasons", "|"))


def with_cache(claims: DataFrame, log: DataFrame, config: PipelineConfig) -> DataFrame:
    """Attach ``logged`` (NULL on a miss) to claims that carry a ``case_key``."""
    return claims.join(latest_entries(matching_log(log, config)), "case_key", "left")


def cache_misses(claims: DataFrame, log: DataFrame, config: PipelineConfig) -> DataFrame:
    known = matching_log(log, config).select("case_key").distinct()
    return claims.join(known, "case_key", "left_anti")


FINGERPRINT_FIELDS = (
    "id",
    "context",
    "context_original",
    "prompt_bn",
    "response_bn",
    "task_type",
    "rag_source",
    "rag_skipped_reason",
    "evidence_source",
)


def fingerprint(df: DataFrame, fields: Sequence[str] = FINGERPRINT_FIELDS) -> DataFrame:
    """One-row digest of the fields that can change a score.

    Row digests are added up as four 64-bit numbers, so neither row order nor partitioning
    matters and no row has to leave its task.
    """
    names = [f for f in fields if f in df.columns]
    digest = F.sha2(_joined([F.col(f) for f in names]), 256)
    words = [
        F.sum(F.conv(F.substring("_digest", 16 * i + 1, 16), 16, 10).cast("decimal(28,0)"))
        for i in range(4)
    ]
    total = F.concat_ws(
        ":",
        F.count("*").cast("string"),
        *[F.coalesce(w, F.lit(0).cast("decimal(38,0)")).cast("string") for w in words],
    )
    return df.select(digest.alias("_digest")).agg(F.sha2(total, 256).alias("fingerprint"))


def checkpoint_rows(
    scored: DataFrame, value: str, metadata: Mapping[str, str], key: str = "id"
) -> DataFrame:
    """``id``, the value and the settings as constant columns."""
    return scored.select(
        key, value, *[F.lit(str(v)).alias(name) for name, v in sorted(metadata.items())]
    )


def checkpoint_check(
    saved: DataFrame,
    claims: DataFrame,
    value: str,
    metadata: Mapping[str, str],
    key: str = "id",
) -> DataFrame:
    """One row that says whether a saved score table may stand in for scoring ``claims``."""
    number = F.col(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    if all(name in saved.columns for name in metadata):
        same = F.lit(True)
        for name, expected in metadata.items():
            same = same & F.col(name).cast("string").eqNullSafe(F.lit(str(expected)))
    else:
        same = F.lit(False)
    left = (
        saved.select(F.col(key).alias("_saved"), finite.alias("_ok"), same.alias("_same"))
        .groupBy("_saved")
        .agg(
            F.count("*").alias("_n"),
            F.count_if(~F.col("_ok")).alias("_bad"),
            F.count_if(~F.col("_same")).alias("_foreign"),
        )
    )
    right = claims.groupBy(F.col(key).alias("_expected")).agg(F.count("*").alias("_m"))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    both = left.join(right, F.col("_saved") == F.col("_expected"), "full")
    report = both.agg(
        total("_n").alias("n_saved"),
        total("_m").alias("n_expected"),
        F.count_if(F.col("_n").isNull()).alias("n_missing"),
        F.count_if(F.col("_m").isNull()).alias("n_unexpected"),
        F.count_if(F.col("_n") != F.col("_m")).alias("n_other_count"),
        total("_bad").alias("n_not_finite"),
        total("_foreign").alias("n_other_settings"),
    )
    clean = F.lit(True)
    for problem in (
        "n_missing",
        "n_unexpected",
        "n_other_count",
        "n_not_finite",
        "n_other_settings",
    ):
        clean = clean & (F.col(problem) == 0)
    return report.withColumn("valid", clean)


def load_checkpoint(
    saved: DataFrame,
    claims: DataFrame,
    value: str,
    metadata: Mapping[str, str],
    key: str = "id",
) -> DataFrame | None:
    """The saved scores, or None when they do not belong to these claims and settings."""
    if value not in saved.columns:
        return None
    row = checkpoint_check(saved, claims, value, metadata, key).first()
    return saved.select(key, value) if row and row["valid"] else None
