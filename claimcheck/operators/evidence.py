"""Evidence policy on claim tables: skip, resolve a source, retrieve, fall back, fill in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig, RetrievalConfig
from claimcheck.functions import evidence as ev
from claimcheck.functions import text as tx
from claimcheck.functions.vectors import Encoder, encode_text
from claimcheck.operators import retrieval
from claimcheck.operators.route import route_claims
from claimcheck.rules.cues import CuePack
from claimcheck.scorers import Scorers
from claimcheck.session import materialize


def keep_original_context(claims: DataFrame) -> DataFrame:
    """Start every run from the given context, whatever an earlier run filled in."""
    if "context_original" in claims.columns:
        return claims.withColumn("context", F.col("context_original"))
    return claims.withColumn("context_original", F.col("context"))


def without_router(claims: DataFrame) -> DataFrame:
    """Policy with the router switched off: given context or nothing, no retrieval."""
    claims = keep_original_context(claims)
    given = ~tx.is_missing(F.col("context_original"))
    return claims.withColumns(
        {
            "task_type": F.when(given, F.lit("context_grounded_other")).otherwise(
                F.lit("other_null")
            ),
            "n_retrieved": F.lit(0),
            "retrieval_sim_max": F.lit(None).cast("double"),
            "retrieval_sim_mean": F.lit(None).cast("double"),
            "rag_used": F.lit(False),
            "rag_source": F.lit(""),
            "rag_skipped_reason": F.lit("router_disabled"),
            "evidence_source": F.when(given, F.lit("original_context")).otherwise(F.lit("none")),
            "evidence_relevance": F.when(given, F.lit("provided")).otherwise(
                F.lit("no_evidence")
            ),
        }
    )


def with_policy(routed: DataFrame, cues: CuePack) -> DataFrame:
    """Add what the policy allows per row, before looking at any index."""
    task, context = F.col("task_type"), F.col("context_original")
    asks_fact = tx.holds(F.coalesce(F.col("prompt_bn"), F.lit("")), cues.factual)
    return routed.withColumns(
        {
            "skip_reason": ev.skip_reason(task, context),
            "may_retrieve": ev.may_retrieve(task, context, asks_fact),
            "preferred_source": ev.source_for_task(task),
            "fallback_source": ev.fallback_for_task(task),
        }
    )


def with_available_source(
    rows: DataFrame, index: DataFrame, sources: Sequence[str]
) -> DataFrame:
    """Resolve the first of (preferred, fallback) that has an index.

    ``index_found`` says whether it does, ``second_source`` is a fallback left to try.
    """
    # At most one row per registered source, so the broadcast is bounded by the policy.
    known = F.broadcast(index.select("source").where(F.col("source").isin(*sources)).distinct())
    has_preferred = known.select(F.col("source").alias("preferred_source"), F.lit(True).alias("_p"))
    has_fallback = known.select(F.col("source").alias("fallback_source"), F.lit(True).alias("_f"))
    joined = rows.join(has_preferred, "preferred_source", "left").join(
        has_fallback, "fallback_source", "left"
    )
    resolved = F.coalesce(
        F.when(F.col("_p"), F.col("preferred_source")),
        F.when(F.col("_f"), F.col("fallback_source")),
        F.col("preferred_source"),
    )
    return joined.withColumns(
        {
            "resolved_source": resolved,
            "index_found": F.coalesce(F.col("_p"), F.col("_f"), F.lit(False)),
        }
    ).withColumn(
        "second_source",
        F.when(
            F.col("_f") & (F.col("fallback_source") != F.col("resolved_source")),
            F.col("fallback_source"),
        ),
    ).drop("_p", "_f")


def retrieval_queries(rows: DataFrame, config: RetrievalConfig) -> DataFrame:
    """One row per claim and source to search: the resolved one, and a fallback if any.

    Searching both at once costs the fallback of a few word-meaning rows, and saves a
    second pass over the index.
    """
    query = tx.retrieval_query(
        F.col("prompt_bn"), F.col("response_bn"), F.col("task_type"), config.query_mode
    )
    targets = F.array_compact(F.array("resolved_source", "second_source"))
    return rows.where(F.col("may_retrieve") & F.col("index_found")).select(
        F.col("id").alias("qid"), query.alias("query"), F.explode(targets).alias("source")
    )


def evidence_per_claim(found: DataFrame) -> DataFrame:
    """Collect the (at most two) searched sources of a claim: ``id, found``."""
    fields = ["source", "evidence", "n_retrieved", "retrieval_sim_max", "retrieval_sim_mean"]
    return found.groupBy(F.col("qid").alias("id")).agg(
        F.collect_list(F.struct(*fields)).alias("found")
    )


def _pick(found: Column, resolved: Column) -> Column:
    """Evidence of the resolved source, or of the fallback if the former is empty."""
    from_resolved = F.get(F.filter(found, lambda e: e["source"] == resolved), F.lit(0))
    from_fallback = F.get(
        F.filter(found, lambda e: (e["source"] != resolved) & ~tx.is_missing(e["evidence"])),
        F.lit(0),
    )
    usable = ~tx.is_missing(from_resolved["evidence"])
    return F.coalesce(F.when(usable, from_resolved), from_fallback, from_resolved)


def fill_evidence(rows: DataFrame, per_claim: DataFrame) -> DataFrame:
    """Annotate every claim and put retrieved text in place of the missing context.

    A row that searched and found nothing still counts as ``rag_used``.
    """
    given = ~tx.is_missing(F.col("context_original"))
    searched = F.col("may_retrieve") & F.col("index_found")
    no_index = F.col("may_retrieve") & ~F.col("index_found")
    text = tx.present(F.col("hit.evidence"))
    by_fallback = F.coalesce(F.col("hit.source") != F.col("resolved_source"), F.lit(False))
    source = F.coalesce(F.col("hit.source"), F.col("resolved_source"))
    label = F.concat(
        F.lit("rag:"), source, F.when(by_fallback, F.lit("(fallback)")).otherwise(F.lit(""))
    )
    return (
        rows.join(per_claim, "id", "left")
        .withColumn("hit", _pick(F.col("found"), F.col("resolved_source")))
        .withColumns(
            {
                "context": F.when(searched, text).otherwise(F.col("context_original")),
                "n_retrieved": F.coalesce(F.when(searched, F.col("hit.n_retrieved")), F.lit(0)),
                "retrieval_sim_max": F.when(searched, F.col("hit.retrieval_sim_max")),
                "retrieval_sim_mean": F.when(searched, F.col("hit.retrieval_sim_mean")),
                "rag_used": searched,
                "rag_source": F.when(searched, source)
                .when(no_index, F.col("resolved_source"))
                .otherwise(F.lit("")),
                "rag_skipped_reason": F.when(searched, F.lit(""))
                .when(no_index, F.concat(F.lit("index_missing:"), F.col("resolved_source")))
                .otherwise(F.coalesce(F.col("skip_reason"), F.lit("other_null_not_factual"))),
                "evidence_source": F.when(searched, label)
                .when(given, F.lit("original_context"))
                .otherwise(F.lit("none")),
                "evidence_relevance": F.when(searched & text.isNotNull(), F.lit("retrieved"))
                .when(searched, F.lit("retrieval_empty"))
                .when(given, F.lit("provided"))
                .otherwise(F.lit("no_evidence")),
            }
        )
        .drop(
            "hit",
            "found",
            "skip_reason",
            "preferred_source",
            "fallback_source",
            "resolved_source",
            "second_source",
            "index_found",
        )
    )


def select_evidence(
    claims: DataFrame,
    index: DataFrame,
    config: PipelineConfig,
    encoder: Encoder,
    scorers: Scorers | None = None,
    limits: retrieval.BlockLimits = retrieval.BlockLimits(),
) -> DataFrame:
    """Route claims and give each the evidence its task is allowed to use."""
    claims = keep_original_context(claims)
    category = scorers.category if scorers else None
    routed = route_claims(claims, config.router, category)
    # Read by the search and by the join back, and deep enough that pushing a filter
    # through its expressions would multiply them.
    routed = materialize(with_policy(routed, config.router.cues), "routed")
    rows = with_available_source(routed, index, config.retrieval.sources)
    queries = retrieval_queries(rows, config.retrieval)
    hits = retrieval.topk_join(
        queries.select("qid", "source", encode_text(encoder)(F.col("query")).alias("qvec")),
        index,
        sources=config.retrieval.sources,
        k=config.retrieval.top_k,
        threshold=config.retrieval.threshold,
        dim=getattr(encoder, "dim", None),
        limits=limits,
    )
    # Partitioned by claim once: both groupings and the join back reuse it.
    texts = retrieval.hit_texts(materialize(hits, "hits"), index).repartition("qid")
    found = retrieval.evidence_of_hits(
        texts, ["qid", "source"], config.retrieval.max_evidence_tokens
    )
    return fill_evidence(rows, evidence_per_claim(found))
