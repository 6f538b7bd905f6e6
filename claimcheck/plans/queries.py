"""Registered queries: every operator run over the shipped tables.

Expensive intermediate tables (index, evidence, scores) are stored once per session and
read by all queries that start from them, as separate jobs would.
"""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck import schemas
from claimcheck.functions import evidence as ev
from claimcheck.functions import parsing, prompts, routing, scoring, vectors
from claimcheck.functions import text as tx
from claimcheck.operators import (
    approximate,
    cache,
    cascade,
    clean,
    corpus,
    decide,
    evaluate,
    evidence,
    retrieval,
    route,
)
from claimcheck.operators.cells import CellIndex
from claimcheck.plans import run, sort, tables
from claimcheck.rules import buckets, policy
from claimcheck.rules.cues import BENGALI
from claimcheck.scorers import (
    Scorers,
    BatchScorer,
    ColumnScorer,
    lexical_batch_scorers,
    lexical_fast,
    lexical_nli,
    lexical_scorers,
    lexical_think,
)
from claimcheck.session import materialize, scratch_path
from claimcheck.sources import claims as claim_files
from claimcheck.sources import corpus as corpus_files
from claimcheck.sources import logs
from claimcheck.sources.compacted import CompactedLog
from claimcheck.streaming import scoring as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STAGES: dict[tuple[str, str, str], DataFrame] = {}

CONFIG = tables.CONFIG
CUES = CONFIG.router.cues
SCORERS = lambda: lexical_scorers(CUES)  # noqa: E731  (columns need a running session)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def forget_stages() -> None:
    """Make the next query rebuild its intermediate tables."""
    _STAGES.clear()


def _stage(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = materialize(build(spark, sf_dir), name)
    return _STAGES[key]


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "index", tables.index)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_claims(tables.claims(spark, sf_dir))


def _build_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.keep_original_context(cleaned(spark, sf_dir))
    routed = route.route_claims(rows, CONFIG.router, SCORERS().category)
    return evidence.with_policy(routed, CUES)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "routed", _build_routed)


def _build_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.evidence_stage(
        tables.claims(spark, sf_dir), index(spark, sf_dir), CONFIG, SCORERS(), tables.ENCODER
    )


def with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "evidence", _build_evidence)


def _build_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cascade.score_claims(with_evidence(spark, sf_dir), CONFIG, SCORERS())
    return decide.label_claims(scored, CONFIG)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "scored", _build_scored)


def debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(
        spark, sf_dir, "debug", lambda s, d: decide.debug_table(scored(s, d), CONFIG)
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.join_truth(debug(spark, sf_dir), tables.truth(spark, sf_dir))


# --- cleaning and text -----------------------------------------------------------------------


def dirtied(text: Column) -> Column:
    """Text with invisible characters, odd blanks and decomposed letters."""
    spaced = F.replace(text, F.lit(" the "), F.lit("\u00a0the\u200b \u00ad\u2003"))
    return F.replace(spaced, F.lit("é"), F.lit("e\u0301"))


@query
def clean_text(spark, sf_dir):
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", tx.clean_text(dirtied(F.col("text"))).alias("cleaned"))


@query
def clean_claims(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query
def context_counts(spark, sf_dir):
    return clean.context_counts(cleaned(spark, sf_dir))


@query
def label_counts(spark, sf_dir):
    return clean.label_counts(tables.table(spark, sf_dir, "labels"), "quality")


@query
def truncated_texts(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.truncate_words(F.col("text"), 50).alias("first_words"))


@query
def date_mentions(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    count = tx.mention_count(F.col("text"), BENGALI.date_or_entity)
    return docs.select("doc_id", count.alias("n_mentions"), (count >= 2).alias("many"))


@query
def chunked_passages(spark, sf_dir):
    return tables.passages(spark, sf_dir)


@query
def retrieval_queries(spark, sf_dir):
    quoted = F.replace(F.col("prompt_bn"), F.lit(","), F.lit('"'))
    rows = cleaned(spark, sf_dir).withColumn("prompt", quoted)
    text = tx.retrieval_query(
        F.col("prompt"), F.col("response_bn"), F.lit("idiom_meaning_null"), "prompt_response"
    )
    return rows.select("id", tx.quoted_lemma(F.col("prompt")).alias("lemma"), text.alias("query"))


@query
def hypotheses(spark, sf_dir):
    prompt, response = F.col("prompt_bn"), F.col("response_bn")
    return cleaned(spark, sf_dir).select(
        "id",
        *[prompts.hypothesis(prompt, response, v).alias(v) for v in evaluate.HYPOTHESIS_VARIANTS],
    )


@query
def answer_overlap(spark, sf_dir):
    premise = F.concat_ws(" ", "prompt_bn", "context")
    first = F.get(tx.words(F.col("response_bn")), F.lit(0))
    return cleaned(spark, sf_dir).select(
        "id",
        tx.answer_in_premise(premise, F.col("response_bn"), 0.15).alias("supported"),
        tx.answer_in_premise(premise, first, 0.4).alias("first_word_supported"),
    )


@query
def irrelevant_evidence(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "id", tx.evidence_irrelevant(F.col("prompt_bn"), F.col("context")).alias("irrelevant")
    )


# --- routing -----------------------------------------------------------------------------------


@query
def cue_flags(spark, sf_dir):
    rows = route.with_cues(cleaned(spark, sf_dir), CONFIG.router)
    return rows.select(
        "id", *[F.col(n).alias(n.removeprefix(routing.FLAG_PREFIX)) for n in routing.flag_names()]
    )


#: Every cue of the Bengali pack once, in the order of its predicates.
BENGALI_CUES = tuple(
    dict.fromkeys(
        cue
        for field in dataclasses.fields(BENGALI)
        if isinstance(predicate := getattr(BENGALI, field.name), tuple)
        for rule in predicate
        for group in rule
        for cue in group
    )
)


@query
def cue_flags_bn(spark, sf_dir):
    """The Bengali pack over the claims, each question with two of its cues put in."""
    words = F.array(*[F.lit(x) for x in BENGALI_CUES])
    cue = lambda by: F.get(words, (F.col("id") % 10007 * by % len(BENGALI_CUES)).cast("int"))
    asked = F.concat_ws(" ", F.substring_index("prompt_bn", " ", 3), cue(1), F.lit("ও"), cue(31))
    rows = cleaned(spark, sf_dir).withColumn("prompt_bn", asked)
    rows = route.with_cues(rows, dataclasses.replace(CONFIG.router, cues=BENGALI))
    return rows.select(
        "id", *[F.col(n).alias(n.removeprefix(routing.FLAG_PREFIX)) for n in routing.flag_names()]
    )


@query
def route_static(spark, sf_dir):
    return route.route_static(cleaned(spark, sf_dir), CONFIG.router).select("id", "task_type")


@query
def route_hybrid(spark, sf_dir):
    rows = route.route_claims(cleaned(spark, sf_dir), CONFIG.router, SCORERS().category)
    return rows.select("id", "static_task_type", "task_type")


@query
def route_model(spark, sf_dir):
    from dataclasses import replace

    rows = route.route_claims(
        cleaned(spark, sf_dir), replace(CONFIG.router, mode="model"), SCORERS().category
    )
    return rows.select("id", "task_type")


@query
def model_categories(spark, sf_dir):
    logits = SCORERS().category.column(F.lit(True))
    return cleaned(spark, sf_dir).select("id", routing.best_category(logits).alias("category"))


@query
def router_disagreement(spark, sf_dir):
    return route.router_disagreement(routed(spark, sf_dir))


@query
def router_disabled(spark, sf_dir):
    return evidence.without_router(cleaned(spark, sf_dir)).select(
        "id",
        "task_type",
        "rag_used",
        "rag_skipped_reason",
        "evidence_source",
        "evidence_relevance",
        "n_retrieved",
    )


@query
def task_instructions(spark, sf_dir):
    return routed(spark, sf_dir).select(
        "id", ev.instruction_for_task(F.col("task_type")).alias("instruction")
    )


# --- evidence ------------------------------------------------------------------------------------


@query
def evidence_policy(spark, sf_dir):
    return routed(spark, sf_dir).select(
        "id", "task_type", "preferred_source", "fallback_source", "skip_reason", "may_retrieve"
    )


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.with_available_source(
        routed(spark, sf_dir), index(spark, sf_dir), CONFIG.retrieval.sources
    )


@query
def source_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "id", "resolved_source", "second_source", "index_found"
    )


@query
def index_status(spark, sf_dir):
    return retrieval.index_status(tables.passages(spark, sf_dir), CONFIG.retrieval.sources)


@query
def embedded_passages(spark, sf_dir):
    rows = tables.index(spark, sf_dir)
    return (
        rows.select("source", "passage_id", F.posexplode("embedding").alias("bucket", "w"))
        .where(F.col("w") > 0)
        .select("source", "passage_id", "bucket", F.col("w").cast("int").alias("weight"))
    )


def _labelled_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables.table(spark, sf_dir, "labels").select("doc_id")
    docs = tables.documents(spark, sf_dir).join(labels, "doc_id", "left_semi")
    return corpus.chunk_documents(docs)


@query
def passages_to_encode(spark, sf_dir):
    known = _labelled_passages(spark, sf_dir).withColumn(
        "passage_hash", retrieval.passage_hash(F.col("source"), F.col("text"))
    )
    missing = retrieval.missing_from_index(tables.passages(spark, sf_dir), known)
    return missing.select("source", "passage_id")


@query
def embedded_missing(spark, sf_dir):
    known = materialize(
        retrieval.embed_passages(_labelled_passages(spark, sf_dir), tables.ENCODER), "known"
    )
    added = retrieval.embed_missing(tables.passages(spark, sf_dir), known, tables.ENCODER)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return added.select(
        "source", "passage_id", "passage_hash", total.cast("long").alias("n_words")
    )


@query
def unit_vectors(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = vectors.l2_normalise(scaled)
    return rows.select(
        "vec_id",
        F.round(vectors.l2_norm(scaled), 4).alias("norm"),
        F.posexplode(unit).alias("pos", "value"),
    ).select("vec_id", "norm", "pos", F.round(F.col("value").cast("double"), 4).alias("value"))


def _vector_search(
    spark: SparkSession, sf_dir: str, source: Column, k: int, threshold: float, **options) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings").withColumn("source", source)
    return retrieval.topk_join(
        rows.select(
            F.col("vec_id").alias("qid"),
            "source",
            F.col("embedding").alias("qvec"),
            F.col("vec_id").alias("self"),
        ),
        rows.select(
            "source", F.col("vec_id").alias("passage_id"), "embedding", F.col("vec_id").alias("self")
        ),
        sources=["all", *[str(i) for i in range(10)]],
        k=k,
        threshold=threshold,
        exclude=[("self", "self")], **options)


@query
def topk_vectors(spark, sf_dir):
    return _vector_search(spark, sf_dir, F.lit("all"), 5, 0.2)


#: So small that the tables fall into many cells, as large ones do.
SMALL_BLOCKS = retrieval.BlockLimits(block_bytes=1 << 16)


@query
def topk_vectors_cells(spark, sf_dir):
    return _vector_search(spark, sf_dir, F.lit("all"), 5, 0.2, limits=SMALL_BLOCKS)


@query
def index_cells_appended(spark, sf_dir):
    """An index built from some vectors, the others appended in two batches, one of them twice."""
    rows = tables.table(spark, sf_dir, "embeddings").withColumn("source", F.lit("all"))
    index = rows.select("source", F.col("vec_id").alias("passage_id"), "embedding", F.col("vec_id").alias("self"))
    kept = CellIndex(spark, scratch_path(spark, "cells"), cell_rows=64, limits=SMALL_BLOCKS)
    third = F.pmod(F.xxhash64("passage_id"), F.lit(3))
    for batch, part in (("first", 0), ("second", 1), ("third", 2), ("third", 2)):
        kept.append(index.where(third == part), batch)
    queries = rows.select(
        F.col("vec_id").alias("qid"), "source", F.col("embedding").alias("qvec"), F.col("vec_id").alias("self")
    )
    return kept.search(queries, 5, 0.2, exclude=[("self", "self")])


@query
def topk_vectors_by_source(spark, sf_dir):
    return _vector_search(spark, sf_dir, F.col("label").cast("string"), 5, 0.1)


#: Queries lie at about this cosine to one vector and at 0.53 to another.
NEAR, BESIDE = 0.85, 0.53


def _near_search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
    """A query beside each vector: most of it, and some of the vector with the next id."""
    rows = tables.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("half"), (F.col("vec_id") % 2).cast("string")).alias("source"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    mixed = F.zip_with("embedding", "next", lambda x, y: NEAR * x + BESIDE * y)
    beside = rows.join(after, "vec_id", "left").select(
        F.col("vec_id").alias("qid"), "source", F.coalesce(mixed, "embedding").alias("qvec")
    )
    queries = _stage(spark, sf_dir, "near_queries", lambda s, d: beside)
    index = rows.withColumnRenamed("vec_id", "passage_id")
    return queries, index, {"sources": ["half0", "half1"], "k": 5, "threshold": 0.55}


def _near_join(spark: SparkSession, sf_dir: str) -> approximate.LshJoin:
    queries, index, options = _near_search(spark, sf_dir)
    return approximate.LshJoin(queries, index, similar=NEAR - 0.05, **options)


@query
def topk_lsh(spark, sf_dir):
    return _near_join(spark, sf_dir).hits()


@query
def topk_lsh_recall(spark, sf_dir):
    """Whether the approximate search keeps nine of ten hits, and with fewer comparisons."""
    queries, index, options = _near_search(spark, sf_dir)
    join = _near_join(spark, sf_dir)
    counts = index.groupBy("source").count().join(queries.groupBy("source").agg(F.count("*").alias("n")), "source")
    pairs = counts.select("source", (F.col("count") * F.col("n")).alias("all_pairs"))
    report = approximate.recall_report(retrieval.topk_join(queries, index, **options), join.hits(), join.work(), pairs)
    return report.select(
        "source", "n_exact", (F.col("recall") >= 0.9).alias("enough"), "all_pairs",
        (F.col("pairs") < F.col("all_pairs")).alias("fewer"),
    )


SINGLE_QUERY = "the of and to in that is for it on"


@query
def single_retrieval(spark, sf_dir):
    import pandas as pd

    vector = tables.ENCODER.load()(pd.Series([SINGLE_QUERY]))[0]
    return retrieval.retrieve(index(spark, sf_dir), vector.tolist(), 5, 0.3)


def _build_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.retrieval_queries(_resolved(spark, sf_dir), CONFIG.retrieval)
    vector = vectors.encode_text(tables.ENCODER)(F.col("query")).alias("qvec")
    return retrieval.topk_join(
        rows.select("qid", "source", vector),
        index(spark, sf_dir),
        sources=CONFIG.retrieval.sources,
        k=CONFIG.retrieval.top_k,
        threshold=CONFIG.retrieval.threshold,
        dim=tables.ENCODER.dim,
    )


@query
def evidence_hits(spark, sf_dir):
    return _build_hits(spark, sf_dir)


@query
def evidence_texts(spark, sf_dir):
    hits = _stage(spark, sf_dir, "hits", _build_hits)
    texts = retrieval.hit_texts(hits, index(spark, sf_dir))
    return retrieval.evidence_of_hits(
        texts, ["qid", "source"], CONFIG.retrieval.max_evidence_tokens
    )


@query
def selected_evidence(spark, sf_dir):
    return _build_evidence(spark, sf_dir).select(
        "id",
        "task_type",
        "context",
        "n_retrieved",
        "retrieval_sim_max",
        "retrieval_sim_mean",
        "rag_used",
        "rag_source",
        "rag_skipped_reason",
        "evidence_source",
        "evidence_relevance",
    )


@query
def evidence_counts(spark, sf_dir):
    rows = with_evidence(spark, sf_dir)
    kinds = {
        "task": (rows, "task_type"),
        "source": (rows.where("rag_used"), "rag_source"),
        "skipped": (rows.where(F.col("rag_skipped_reason") != ""), "rag_skipped_reason"),
    }
    out = None
    for kind, (part, column) in kinds.items():
        counts = decide.count_table(part, F.col(column), top=5).withColumn("kind", F.lit(kind))
        out = counts if out is None else out.unionByName(counts)
    return out


def _exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = cleaned(spark, sf_dir).join(tables.truth(spark, sf_dir), "id")
    return _stage(
        spark,
        sf_dir,
        "exemplars",
        lambda s, d: retrieval.exemplar_index(labelled, tables.ENCODER),
    )


@query
def exemplar_hits(spark, sf_dir):
    return retrieval.exemplar_hits(
        cleaned(spark, sf_dir), _exemplars(spark, sf_dir), tables.ENCODER, k=3
    )


@query
def exemplar_hits_cells(spark, sf_dir):
    return retrieval.exemplar_hits(
        cleaned(spark, sf_dir),
        _exemplars(spark, sf_dir),
        tables.ENCODER,
        k=3,
        limits=SMALL_BLOCKS,
    )


def _with_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _stage(spark, sf_dir, "exemplar_hits", exemplar_hits)
    lists = retrieval.exemplar_lists(hits, _exemplars(spark, sf_dir))
    return with_evidence(spark, sf_dir).join(lists, "id", "left")


@query
def fast_prompts(spark, sf_dir):
    return cascade.with_prompts(_with_exemplars(spark, sf_dir)).select("id", "fast_prompt")


@query
def think_prompts(spark, sf_dir):
    return cascade.with_prompts(with_evidence(spark, sf_dir)).select("id", "think_prompt")


@query
def category_prompts(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "id", prompts.category_prompt(F.col("prompt_bn"), F.col("response_bn")).alias("prompt")
    )


@query
def sort_prompts(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", prompts.sort_prompt(F.col("text")).alias("prompt"))


# --- scoring ---------------------------------------------------------------------------------------


@query
def token_scores(spark, sf_dir):
    size, asked = F.length("response_bn"), F.length("prompt_bn")
    logits = F.create_map(
        F.lit("F"), size / 100.0, F.lit(" F"), asked / 200.0,
        F.lit("H"), asked / 50.0, F.lit("hallucinated"), F.lit(1.0), F.lit("other"), F.lit(9.0),
    )
    return cleaned(spark, sf_dir).select(
        "id", F.round(scoring.token_score(logits), 6).alias("p_fast")
    )


@query
def fast_scores(spark, sf_dir):
    rows = cascade.run_stage(
        with_evidence(spark, sf_dir), SCORERS().fast, "p_fast", F.lit(True)
    )
    return rows.select("id", "p_fast")


@query
def fast_scores_batch(spark, sf_dir):
    rows = cascade.run_stage(
        with_evidence(spark, sf_dir), lexical_batch_scorers(CUES).fast, "p_fast", F.lit(True)
    )
    return rows.select("id", "p_fast")


@query
def think_triggers(spark, sf_dir):
    p_fast = lexical_fast(F.col("context"), F.col("prompt_bn"), F.col("response_bn"))
    rows = with_evidence(spark, sf_dir).withColumn("p_fast", p_fast)
    reasons = scoring.think_reasons(
        scoring.ThinkInputs(
            F.col("p_fast"),
            F.col("task_type"),
            F.col("context"),
            F.col("context_original"),
            F.col("prompt_bn"),
            F.col("may_retrieve"),
        ),
        CONFIG.think,
        CUES,
    )
    return rows.withColumn("_r", reasons).select(
        "id",
        F.array_join("_r", "|").alias("reasons"),
        (F.size("_r") > 0).alias("triggered"),
        scoring.think_budget(F.col("task_type"), CONFIG.think).alias("budget"),
    )


@query
def nli_gate(spark, sf_dir):
    p_fast = lexical_fast(F.col("context"), F.col("prompt_bn"), F.col("response_bn"))
    rows = with_evidence(spark, sf_dir).withColumn("p_fast", p_fast)
    return cascade.gate(rows, CONFIG, SCORERS().nli).select("id", *schemas.NLI_COLUMNS)


@query
def nli_gate_reasons(spark, sf_dir):
    """The gate over entailment scores of all kinds, so that every reason it knows occurs."""
    share = lambda by, of: (F.col("id") % 997 * by % of) / F.lit(float(of))
    rows = cleaned(spark, sf_dir).select(
        "id", "prompt_bn", "response_bn",
        F.when(F.col("id") % 7 == 0, "other_null").otherwise(policy.NLI_TASKS[0]).alias("task_type"),
        F.lit(None).cast("string").alias("context_original"),
        F.when(F.col("id") % 11 != 0, "premise").alias("context"),
        (F.col("id") % 3 == 0).alias("rag_used"),
        share(29, 64).alias("retrieval_sim_max"),
        share(13, 128).alias("p_fast"),
    )
    scores = F.struct(share(37, 32).alias("p_entail"), share(53, 16).alias("p_contradict"), share(71, 64).alias("p_neutral"))
    settings = dataclasses.replace(CONFIG, nli=dataclasses.replace(CONFIG.nli, require_overlap=False))
    out = cascade.gate(rows, settings, ColumnScorer(("id",), lambda _: scores))
    return out.select("id", "nli_eligible", "nli_applied", "nli_skip_reason")


@query
def nli_masks(spark, sf_dir):
    nli = lexical_nli(F.col("prompt_bn"), F.col("response_bn"))
    e, c = F.col("s.p_entail"), F.col("s.p_contradict")
    return (
        cleaned(spark, sf_dir)
        .select("id", nli.alias("s"))
        .select(
            "id",
            scoring.override_mask(e, c, 0.2).alias("even"),
            scoring.override_mask(e, c, 0.35, 0.3, 0.1).alias("uneven"),
            scoring.nli_score(e, c, CONFIG.nli).alias("score"),
        )
    )


@query
def think_verdicts(spark, sf_dir):
    text = lexical_think(F.col("context"), F.col("prompt_bn"), F.col("response_bn"))
    verdict = parsing.parse_verdict(F.col("text"))
    return (
        cleaned(spark, sf_dir)
        .select("id", text.alias("text"))
        .select("id", "text", verdict.alias("verdict"))
        .withColumn("score", parsing.verdict_score(F.col("verdict")))
    )


@query
def free_text_verdicts(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    lang = F.col("lang")
    opening = (
        F.when(lang == "en", F.lit("Verdict is: CORRECT because "))
        .when(lang == "fr", F.lit("the verdict has no basis. "))
        .when(lang == "de", F.lit(""))
        .otherwise(F.lit("verdict = wrong. "))
    )
    closing = F.when(lang == "de", F.lit(" so this seems incorrect.")).otherwise(F.lit(""))
    text = F.concat(opening, "text", closing)
    return docs.select("doc_id", parsing.parse_verdict(text).alias("verdict"))


@query
def verdict_scores(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels")
    verdict = F.when(F.col("quality") == 1, F.lit("Faithful ")).otherwise(F.lit("HALLUCINATED"))
    sure = F.when(F.col("toxic") == 1, F.lit("Strong")).when(
        F.col("quality") == 0, F.lit("uncertain")
    )
    return labels.select("doc_id", ev.map_verdict(verdict, sure).alias("score"))


SCORE_COLUMNS = (
    "id",
    "p_fast",
    "p_think",
    "p_llm",
    "label",
    "triggered_think",
    "think_max_tokens",
    "verdict_parsed",
    "nli_applied",
    "nli_skip_reason",
)


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select(*SCORE_COLUMNS, F.array_join("think_reasons", "|").alias("think_reasons"))


@query
def scored_claims(spark, sf_dir):
    return _scores(_build_scored(spark, sf_dir))


@query
def scored_claims_batch(spark, sf_dir):
    rows = cascade.score_claims(
        with_evidence(spark, sf_dir), CONFIG, lexical_batch_scorers(CUES)
    )
    return _scores(decide.label_claims(rows, CONFIG))


# --- decision -----------------------------------------------------------------------------------------


@query
def submission(spark, sf_dir):
    return decide.validate_submission(decide.submission(scored(spark, sf_dir)))


@query
def submission_report(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations")
    return decide.submission_report(
        turns.select(F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("label"))
    )


@query
def debug_table(spark, sf_dir):
    return decide.debug_table(scored(spark, sf_dir), CONFIG)


@query
def run_summary(spark, sf_dir):
    return decide.run_summary(debug(spark, sf_dir))


@query
def label_distribution(spark, sf_dir):
    return decide.count_table(debug(spark, sf_dir), F.col("label"))


@query
def borderline_rows(spark, sf_dir):
    return decide.borderline(debug(spark, sf_dir), 15).select("id", "threshold_margin")


# --- evaluation -----------------------------------------------------------------------------------------


@query
def truth_join(spark, sf_dir):
    return judged(spark, sf_dir).select("id", "label_pred", "label_true", "correct")


@query
def truth_coverage(spark, sf_dir):
    return evaluate.coverage(debug(spark, sf_dir), tables.truth(spark, sf_dir))


@query
def unmatched_claims(spark, sf_dir):
    return evaluate.unmatched(debug(spark, sf_dir), tables.truth(spark, sf_dir))


def _report(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    def report(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(judged(spark, sf_dir))

    QUERIES[name] = report


_report("accuracy", evaluate.accuracy)
_report("classification_report", evaluate.classification_report)
_report("errors_by_task", evaluate.errors_by_task)
_report("think_coverage", evaluate.think_coverage)
_report("think_outcomes", evaluate.think_outcomes)
_report("thinking_lengths", evaluate.thinking_lengths)
_report("wrong_budgets", evaluate.wrong_budgets)
_report("wrong_reasons", evaluate.wrong_reasons)
_report("hurt_rows", evaluate.hurt_rows)


def _changed_by_length(judged: DataFrame) -> DataFrame:
    """As if thinking had changed the label of long questions, so all four outcomes occur."""
    changed = F.col("triggered_think") & (F.length("prompt_bn") > 60)
    return judged.withColumn("think_changed_label", changed)


_report("hurt_rows_changed", lambda j: evaluate.hurt_rows(_changed_by_length(j)))
_report("think_outcomes_changed", lambda j: evaluate.think_outcomes(_changed_by_length(j)))
_report("retrieval_lift", evaluate.retrieval_lift)
_report("retrieval_by_task", evaluate.retrieval_by_task)
_report("similarity_by_outcome", evaluate.similarity_by_outcome)
_report("overconfident_wrong", evaluate.overconfident_wrong)
_report("score_spread", evaluate.score_spread)
_report("worst_samples", evaluate.worst_samples)
_report("task_baseline", evaluate.task_baseline)


@query
def document_report(spark, sf_dir):
    """Classification report of a lexical rule on documents against their quality labels."""
    docs = tables.table(spark, sf_dir, "documents")
    rule = (F.size(tx.words(F.col("text"))) >= 40) & ~F.col("text").rlike(r"[#$%&*!]{2,}")
    predicted = docs.select(F.col("doc_id").alias("id"), rule.cast("int").alias("label"))
    labels = tables.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    return evaluate.classification_report(evaluate.join_truth(predicted, labels))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(
        spark,
        sf_dir,
        "variants",
        lambda s, d: evaluate.nli_variants(judged(s, d), SCORERS().nli, "context_grounded_other"),
    )


@query
def nli_rules(spark, sf_dir):
    return evaluate.nli_rules(_variants(spark, sf_dir))


@query
def nli_best_rules(spark, sf_dir):
    return evaluate.best_rules(evaluate.nli_rules(_variants(spark, sf_dir)))


@query
def nli_errors(spark, sf_dir):
    return evaluate.nli_errors(_variants(spark, sf_dir), "qa_en", "hybrid_margin_0.2")


@query
def abstaining_labels(spark, sf_dir):
    return _variants(spark, sf_dir).select(
        "id",
        "variant",
        evaluate.abstaining_label(0.2).alias("label_02"),
        evaluate.abstaining_label(0.35).alias("label_035"),
    )


@query
def audit_slice(spark, sf_dir):
    return evaluate.audit_slice(routed(spark, sf_dir)).select(
        "id", "task_type", "audit_group", "audit_rank"
    )


# --- cache ----------------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two runs: all claims, then once more the claims with a context.

    The first run has other settings for claims without a context, so those are misses.
    """
    rows = scored(spark, sf_dir)
    first = cascade.log_entries(rows, CONFIG, 1).withColumn(
        "meta_hash", F.when(F.col("has_context"), F.col("meta_hash")).otherwise("other")
    )
    again = cascade.log_entries(rows.where("has_context"), CONFIG, 2).withColumn(
        "p_llm_final", F.round(1 - F.col("p_llm_final"), 6)
    )
    return first.unionByName(again)


@query
def case_keys(spark, sf_dir):
    return cache.with_case_key(with_evidence(spark, sf_dir), CONFIG).select("id", "case_key")


@query
def cache_latest(spark, sf_dir):
    latest = cache.debug_entries(_log(spark, sf_dir))
    return latest.select("case_key", "p_llm_final", "p_fast", "triggered_think", "think_reasons")


@query
def log_compacted(spark, sf_dir):
    """The two runs as deltas, the first of them in a snapshot, the second open."""
    rows = materialize(_log(spark, sf_dir), "log")
    log = CompactedLog(spark, scratch_path(spark, "compacted"), part_rows=500)
    log.append(rows.where("seq = 1"), "run-1")
    log.compact()
    log.append(rows.where("seq = 2"), "run-2")
    latest = cache.debug_entries(log.read())
    return latest.select("case_key", "p_llm_final", "p_fast", "triggered_think", "think_reasons")


@query
def log_lookup(spark, sf_dir):
    """Logged scores of the claims with a context, from a snapshot of both runs."""
    rows = materialize(_log(spark, sf_dir), "log")
    log = CompactedLog(spark, scratch_path(spark, "compacted"), part_rows=500)
    for seq in (1, 2):
        log.append(rows.where(F.col("seq") == seq), f"run-{seq}")
        log.compact()
    keyed = cache.with_case_key(with_evidence(spark, sf_dir), CONFIG)
    wanted = materialize(keyed.where("context_original IS NOT NULL").select("id", "case_key"), "wanted")
    latest = cache.debug_entries(log.lookup(wanted))
    return wanted.join(latest, "case_key").select("id", "p_llm_final", "think_reasons")


@query
def cache_misses(spark, sf_dir):
    keyed = cache.with_case_key(with_evidence(spark, sf_dir), CONFIG)
    return cache.cache_misses(keyed, _log(spark, sf_dir), CONFIG).select("id", "case_key")


@query
def cached_scores(spark, sf_dir):
    log = materialize(_log(spark, sf_dir), "log")
    rows = cascade.score_claims(with_evidence(spark, sf_dir), CONFIG, SCORERS(), log)
    return rows.select("id", "cached", "p_llm", "nli_skip_reason")


@query
def logged_debug(spark, sf_dir):
    """Debug fields looked up in the log for a frame that holds scores only."""
    log = materialize(_log(spark, sf_dir), "log")
    bare = cache.with_case_key(with_evidence(spark, sf_dir), CONFIG).join(
        scored(spark, sf_dir).select("id", "p_llm"), "id"
    )
    out = decide.debug_table(bare, CONFIG, cache.debug_entries(cache.matching_log(log, CONFIG)))
    return out.select("id", "label", "p_llm", "p_fast", "think_reasons", "think_changed_label")


@query
def table_fingerprint(spark, sf_dir):
    return cache.fingerprint(with_evidence(spark, sf_dir))


@query
def checkpoint_check(spark, sf_dir):
    path = scratch_path(spark, "checkpoint")
    meta = {"meta_hash": CONFIG.meta_hash(), "scorer": CONFIG.scorer_name}
    claim_files.write_table(cache.checkpoint_rows(scored(spark, sf_dir), "p_llm", meta), path)
    saved = spark.read.parquet(path)
    claims = tables.claims(spark, sf_dir)
    wrong = cache.checkpoint_check(saved, claims, "p_llm", {**meta, "scorer": "another"})
    shorter = cache.checkpoint_check(saved, claims.where("context is not null"), "p_llm", meta)
    good = cache.checkpoint_check(saved, claims, "p_llm", meta)
    return (
        good.withColumn("case", F.lit("good"))
        .unionByName(wrong.withColumn("case", F.lit("other settings")))
        .unionByName(shorter.withColumn("case", F.lit("other claims")))
    )


@query
def stream_scoring(spark, sf_dir):
    """Claims arrive as files, are scored per micro-batch and appended to the log."""
    root = scratch_path(spark, "stream")
    incoming, log_path = os.path.join(root, "in"), os.path.join(root, "log")
    rows = with_evidence(spark, sf_dir)
    rows.repartition(3).write.parquet(incoming)
    arriving = stream.claim_stream(spark, incoming, rows.schema, files_per_batch=1)
    job = stream.start_scoring(
        arriving, CONFIG, SCORERS(), log_path, os.path.join(root, "state"), until_drained=True
    )
    job.awaitTermination()
    if job.exception() is not None:
        raise job.exception()
    return spark.read.schema(schemas.LOG).parquet(log_path).select(
        "case_key", "p_fast", "p_llm_final", "triggered_think", "nli_applied"
    )


@query
def stream_resumed(spark, sf_dir):
    """Two jobs with states of their own on one log; the second meets the first one's claims."""
    root = scratch_path(spark, "streams")
    rows = with_evidence(spark, sf_dir)
    parts = {"first": rows.where("context_original is not null"), "second": rows}
    for name, part in parts.items():
        incoming = os.path.join(root, name)
        part.repartition(2).write.parquet(incoming)
        job = stream.start_scoring(
            stream.claim_stream(spark, incoming, rows.schema, files_per_batch=1),
            CONFIG,
            SCORERS(),
            os.path.join(root, "log"),
            os.path.join(root, f"state-{name}"),
            until_drained=True,
        )
        job.awaitTermination()
        if job.exception() is not None:
            raise job.exception()
    return spark.read.schema(schemas.LOG).parquet(os.path.join(root, "log")).select(
        "case_key", "p_fast", "p_llm_final", "triggered_think", "nli_applied"
    )


def _no_scorers() -> Scorers:
    """Scorers that fail on the first claim they are asked about."""

    def fail(kind: str) -> Callable[..., Column]:
        return lambda *_: F.raise_error(F.lit("scored again")).cast(kind)

    nli = "struct<p_entail:double,p_contradict:double,p_neutral:double>"
    return Scorers(
        fast=ColumnScorer(("context",), fail("double")),
        nli=ColumnScorer(("nli_premise",), fail(nli)),
        think=ColumnScorer(("context",), fail("string")),
        category=SCORERS().category,
    )


@query
def run_resumed(spark, sf_dir):
    """A whole run, and the same run again that finds its checkpoint and scores nothing."""
    root = scratch_path(spark, "run")
    claims, passages = tables.claims(spark, sf_dir), index(spark, sf_dir)
    run.resume_claims(claims, passages, root, CONFIG, SCORERS(), tables.ENCODER)
    again = run.resume_claims(
        claims, passages, root, CONFIG, _no_scorers(), tables.ENCODER, resume_evidence=True
    )
    return again.select("id", "label", "p_llm", "p_fast", "triggered_think")


# --- corpus jobs ----------------------------------------------------------------------------------------------------


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(
        spark,
        sf_dir,
        "classified",
        lambda s, d: corpus.classify_articles(tables.articles(s, d), tables.CATEGORIES),
    )


@query
def category_lines(spark, sf_dir):
    lines = corpus.category_lines(F.col("text"), tables.CATEGORIES)
    return tables.articles(spark, sf_dir).select("page_id", F.array_join(lines, "|").alias("lines"))


@query
def article_categories(spark, sf_dir):
    rows = corpus.classify_articles(tables.articles(spark, sf_dir), tables.CATEGORIES)
    return rows.select("page_id", F.array_join("categories", "|").alias("categories"))


ENABLED = ("writers_poets", "books_literature", "technology_computing")


@query
def enabled_articles(spark, sf_dir):
    rows = corpus.enabled_articles(_classified(spark, sf_dir), ENABLED)
    return corpus.passages_of_articles(rows).select("page_id", "category", "text")


@query
def category_counts(spark, sf_dir):
    return corpus.category_counts(_classified(spark, sf_dir))


@query
def category_metrics(spark, sf_dir):
    return corpus.category_metrics(_classified(spark, sf_dir), ENABLED)


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.resolve_titles(
        tables.document_titles(spark, sf_dir), tables.langlinks(spark, sf_dir)
    )
    return corpus.related_pages(found, tables.page_categories(spark, sf_dir), tables.KEYWORDS)


@query
def resolved_titles(spark, sf_dir):
    return corpus.resolve_titles(
        tables.document_titles(spark, sf_dir), tables.langlinks(spark, sf_dir)
    )


@query
def related_pages(spark, sf_dir):
    return _related(spark, sf_dir)


@query
def counterpart_passages(spark, sf_dir):
    pages = tables.articles(spark, sf_dir).select(F.col("title").alias("en_title"), "text")
    return corpus.counterpart_passages(_related(spark, sf_dir), pages)


def sort_answer(text: Column) -> Column:
    """Stand-in for the sorting model: reasoning, a fenced answer, then an echo."""
    bucket = (
        F.when(F.length(text) < 40, F.lit("unclear"))
        .when(F.contains(text, F.lit("ouan")), F.lit("IDIOM"))
        .when(F.contains(text, F.lit("eaux")), F.lit("literal"))
        .when(F.contains(text, F.lit("tionth")), F.lit("famous_bn"))
        .when(F.contains(text, F.lit("ción")), F.lit("discard"))
        .otherwise(F.lit("grammar"))
    )
    facts = F.replace(text, F.lit(". "), F.lit(".\n2. "))
    return F.concat(
        F.lit("<think>short or\nlong</think>\n```yaml\nbucket: "),
        bucket,
        F.lit("\nreworded:\n- "),
        facts,
        F.lit("\n```\nInput Text: "),
        text,
    )


def _build_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.read_sort_lines(tables.sort_input(spark, sf_dir))
    return corpus.sort_lines(rows, ColumnScorer(("input_text",), sort_answer))


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage(spark, sf_dir, "sorted", _build_sorted)


@query
def sort_line_errors(spark, sf_dir):
    rows = corpus.read_sort_lines(tables.sort_input(spark, sf_dir))
    return rows.select("line_no", "input_text", "error")


@query
def sorted_lines(spark, sf_dir):
    return _build_sorted(spark, sf_dir).select(
        "line_no",
        "parsed_bucket",
        "unparsed",
        "error",
        F.size("facts").alias("n_facts"),
        F.array_join("reworded_facts", "\n").alias("reworded"),
    )


def _sort_model():
    """The stand-in for a model that reads prompts in batches; it answers like ``sort_answer``."""
    before, after = buckets.SORT_PROMPT.split("{text}")
    cues = {"ouan": "IDIOM", "eaux": "literal", "tionth": "famous_bn", "ción": "discard"}

    def one(prompt: str) -> str:
        text = prompt[len(before) : len(prompt) - len(after)]
        bucket = next((b for cue, b in cues.items() if cue in text), "grammar")
        bucket = "unclear" if len(text) < 40 else bucket
        facts = text.replace(". ", ".\n2. ")
        return (
            f"<think>short or\nlong</think>\n```yaml\nbucket: {bucket}\nreworded:\n- {facts}\n```\n"
            f"Input Text: {text}"
        )

    def answer(rows: pd.DataFrame) -> pd.Series:
        return rows["sort_prompt"].map(one)

    return answer


@query
def sorted_lines_batch(spark, sf_dir):
    """Sorting by a batch scorer that sees the prompts alone, 64 at a time."""
    rows = corpus.read_sort_lines(tables.sort_input(spark, sf_dir))
    model = BatchScorer(("sort_prompt",), T.StringType(), _sort_model, batch_rows=64)
    return corpus.sort_lines(rows, model).select(
        "line_no",
        "parsed_bucket",
        "unparsed",
        "error",
        F.size("facts").alias("n_facts"),
        F.array_join("reworded_facts", "\n").alias("reworded"),
    )


@query
def sort_resumed(spark, sf_dir):
    """Files sorted by two jobs, the second after more files came: a log row for each line."""
    root = scratch_path(spark, "sort-job")
    path, log_path = os.path.join(root, "in"), os.path.join(root, "log")
    # Bare texts of several lines become one.
    lines = tables.sort_input(spark, sf_dir).select(F.translate("value", "\n", " ").alias("value"))
    model = BatchScorer(("sort_prompt",), T.StringType(), _sort_model, batch_rows=64)
    job = (spark, path, os.path.join(root, "out"), log_path, model)
    is_object = F.startswith(F.col("value"), F.lit("{"))
    for part in (lines.where(is_object), lines.where(~is_object)):
        part.select("value").repartition(4).write.mode("append").text(path)
        sort.sort_files(*job, annotate=True)
    # A dry run finds nothing left to do, and writes nothing.
    counts = sort.sort_files(*job, dry_run=True).select("bucket", F.col("n").alias("n_in_bucket"))
    written = sort.read_buckets(spark, os.path.join(root, "out"), log_path)
    written = written.groupBy("bucket").agg(F.count("*").alias("n_written"))
    log = sort.earlier_log(spark, log_path).withColumnRenamed("parsed_bucket", "bucket")
    # One row for each bucket, so the log is not dealt out by bucket.
    return log.join(F.broadcast(counts), "bucket").join(F.broadcast(written), "bucket").select(
        "bucket",
        "input_text",
        "error",
        F.array_join("reworded_facts", "\n").alias("reworded"),
        "n_in_bucket",
        "n_written",
    )


@query
def sorted_facts(spark, sf_dir):
    rows = corpus.fact_rows(_sorted(spark, sf_dir))
    stored = F.coalesce(
        *[F.get_json_object("line", f"$.{k}") for k in ("text", "passage", "content")]
    )
    return rows.select(
        "bucket", F.col("_sort_line").alias("line_no"), "fact_no", "fact", stored.alias("stored")
    )


def _earlier_sort_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sort_log(_sorted(spark, sf_dir).where(F.col("parsed_bucket") == "skip"))


@query
def unsorted_lines(spark, sf_dir):
    rows = _sorted(spark, sf_dir).select("line_no", "parsed_bucket")
    return corpus.unsorted_lines(rows, _earlier_sort_log(spark, sf_dir))


@query
def sort_bucket_counts(spark, sf_dir):
    log = _earlier_sort_log(spark, sf_dir)
    fresh = corpus.unsorted_lines(_sorted(spark, sf_dir), log)
    return corpus.bucket_counts(fresh, log)


# --- files ---------------------------------------------------------------------------------------------------------------


@query
def claims_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    claim_files.write_csv(tables.claims(spark, sf_dir), path)
    return claim_files.read_claims_csv(spark, path)


@query
def claims_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    tables.claims(spark, sf_dir).write.json(path)
    return claim_files.read_claims_json(spark, path, array=False)


def _json_arrays(claims: DataFrame) -> str:
    """Files that hold one JSON array each, of about a thousand claims."""
    path = scratch_path(claims.sparkSession, "json-array")
    parts = F.lit(1 + claims.count() // 1000)
    arrays = claims.groupBy(F.pmod(F.xxhash64("id"), parts).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*claims.columns))).alias("value")
    )
    arrays.write.partitionBy("part").text(path)
    return path


@query
def claims_json_array(spark, sf_dir):
    claims = tables.claims(spark, sf_dir)
    return claim_files.read_claims_json(spark, _json_arrays(claims)).select(*claims.columns)


def _awkward_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose questions hold quotes, separators, brackets and line breaks."""
    question = F.replace("prompt_bn", F.lit(" the "), F.lit(' "the",\n}]{ '))
    return tables.claims(spark, sf_dir).withColumn("prompt_bn", question)


@query
def claims_csv_split(spark, sf_dir):
    path = scratch_path(spark, "csv-split")
    claim_files.write_csv(_awkward_claims(spark, sf_dir), path)
    return claim_files.read_claims_csv_split(spark, path)


@query
def claims_json_split(spark, sf_dir):
    claims = _awkward_claims(spark, sf_dir)
    return claim_files.read_claims_json_split(spark, _json_arrays(claims)).select(*claims.columns)


@query
def processed_claims(spark, sf_dir):
    path = scratch_path(spark, "processed")
    claim_files.write_processed(cleaned(spark, sf_dir), path)
    return spark.read.parquet(path)


def _corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects under both keys, bare text and blank lines."""
    docs = tables.documents(spark, sf_dir).withColumn(
        "value",
        F.when(F.col("source") == "wiki", F.to_json(F.struct("text")))
        .when(F.col("source") == "idioms", F.to_json(F.struct(F.col("text").alias("passage"))))
        .otherwise(F.translate("text", "\n", " ")),
    )
    return docs.select("source", "value")


def _corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "corpus")
    _corpus_lines(spark, sf_dir).write.partitionBy("source").text(root)
    lines = spark.read.text(root).select("source", "value")
    return corpus_files.parse_corpus_lines(lines)


@query
def corpus_jsonl(spark, sf_dir):
    return corpus_files.corpus_passages(_corpus_files(spark, sf_dir))


@query
def corpus_malformed(spark, sf_dir):
    return (
        _corpus_files(spark, sf_dir)
        .groupBy("source")
        .agg(F.count("*").alias("n_lines"), F.count_if("malformed").alias("n_malformed"))
    )


@query
def corpus_folder(spark, sf_dir):
    """A typed corpus read by source folder, with the number of broken lines of the source."""
    root = scratch_path(spark, "corpus-folder")
    lines = _corpus_lines(spark, sf_dir)
    sources = ("wiki", "idioms", "literal")
    for source in sources:
        lines.where(F.col("source") == source).select("value").write.text(f"{root}/{source}")
    rows = corpus_files.read_corpus(spark, root, sources, "*.txt")
    broken = corpus_files.malformed_lines(rows).groupBy("source").agg(
        F.sum("n_malformed").alias("n_broken")
    )
    return rows.join(broken, "source", "left").select("source", "text", "malformed", "n_broken")


@query
def limited_articles(spark, sf_dir):
    """A trial run's articles: the first fifty."""
    rows = corpus_files.limit_articles(tables.articles(spark, sf_dir), 50)
    return rows.select("page_id", "title")


@query
def first_text_keys(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    fields = [
        F.when(F.col("lang") == "en", F.col("text")).otherwise(F.lit(" \n")),
        F.when(F.col("lang") == "fr", F.concat(F.lit("\t"), "text")),
        F.col("source"),
    ]
    return docs.select("doc_id", corpus_files.first_text(fields).alias("first_text"))


@query
def bucket_files(spark, sf_dir):
    root = scratch_path(spark, "buckets")
    corpus_files.write_buckets(corpus.fact_rows(_sorted(spark, sf_dir)), root, annotate=True)
    # One look at each line, which holds a whole answer of the model.
    note = F.from_json("value", "_sort_bucket string, _sort_line long").alias("note")
    lines = corpus_files.read_buckets(spark, root).select("bucket", note)
    return lines.groupBy("bucket", F.col("note._sort_bucket").alias("noted")).agg(
        F.count("*").alias("n_lines"), F.sum("note._sort_line").alias("line_sum")
    )


@query
def category_files(spark, sf_dir):
    root = scratch_path(spark, "categories")
    corpus_files.write_categories(
        corpus.enabled_articles(_classified(spark, sf_dir), ENABLED), root
    )
    return spark.read.schema("text string, category string").json(root).select("category", "text")


@query
def title_lists(spark, sf_dir):
    root = scratch_path(spark, "titles")
    rows = corpus_files.limit_articles(_classified(spark, sf_dir), 0)
    corpus_files.write_titles(rows, root)
    return corpus_files.read_titles(spark, root)


@query
def title_lists_capped(spark, sf_dir):
    """The first ten titles of each list, as a trial run takes them."""
    root = scratch_path(spark, "titles")
    corpus_files.write_titles(corpus_files.limit_articles(_classified(spark, sf_dir), 0), root)
    return corpus_files.read_titles(spark, root, per_category=10)


@query
def index_table(spark, sf_dir):
    root = scratch_path(spark, "index")
    corpus_files.write_index(index(spark, sf_dir), root, tables.ENCODER.name)
    rows = corpus_files.read_index(spark, root, policy.SOURCES, tables.ENCODER.name)
    return rows.select("source", "passage_id", "passage_hash", F.size("embedding").alias("dim"))


@query
def score_log(spark, sf_dir):
    path = scratch_path(spark, "log")
    logs.append_log(_log(spark, sf_dir), path, "json")
    return logs.read_log(spark, path, "json").select(
        "case_key", "seq", "p_fast", "p_llm_final", F.array_join("think_reasons", "|").alias("why")
    )


@query
def latest_run(spark, sf_dir):
    root = scratch_path(spark, "runs")
    rows = decide.submission(scored(spark, sf_dir))
    flipped = rows.withColumn("label", 1 - F.col("label"))
    claim_files.write_submission(flipped, root, "20260101_000000")
    claim_files.write_submission(rows, root, "20260102_000000")
    return claim_files.read_latest_run(spark, root)
