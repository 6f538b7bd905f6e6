import math

from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig, RouterConfig, ThinkConfig
from claimcheck.operators import cache, cascade
from claimcheck.rules import policy
from claimcheck.scorers import ColumnScorer, Scorers

CONFIG = PipelineConfig(router=RouterConfig(mode="static"))
SCORERS = Scorers(
    ColumnScorer(("given",), lambda x: x),
    ColumnScorer(("given",), lambda x: F.struct(x.alias("p_entail"), x.alias("p_contradict"), x.alias("p_neutral"))),
    ColumnScorer(("given",), lambda x: F.lit("verdict: Faithful")),
)


def claims(spark, rows):
    data = [(i, "other_null", None, c, "p", "r", g) for i, c, g in rows]
    return spark.createDataFrame(
        data,
        "id long, task_type string, context_original string, context string, prompt_bn string, "
        "response_bn string, given double",
    )


def test_key_depends_on_evidence_and_settings(spark):
    df = claims(spark, [(1, "evidence A", 0.1), (2, "evidence B", 0.9), (3, "evidence A", 0.5)])
    keys = {r["id"]: r["case_key"] for r in cache.with_case_key(df, CONFIG).collect()}
    assert keys[1] != keys[2] and keys[1] == keys[3]
    other = PipelineConfig(router=RouterConfig(mode="static"), think=ThinkConfig(low=0.2))
    again = {r["id"]: r["case_key"] for r in cache.with_case_key(df, other).collect()}
    assert not set(keys.values()) & set(again.values())


def test_cache_round(spark):
    rows = [(1, "evidence A", 0.1), (2, "evidence B", 0.95)]
    scored = cascade.score_claims(claims(spark, rows), CONFIG, SCORERS)
    log = cascade.log_entries(scored, CONFIG, 1)
    newer = log.where("evidence = 'evidence A'").withColumns(
        {"seq": F.lit(2).cast("long"), "p_llm_final": F.lit(0.77)}
    )
    foreign = log.withColumns({"meta_hash": F.lit("x"), "seq": F.lit(9).cast("long")})
    old = log.withColumns({"cache_version": F.lit("v0"), "seq": F.lit(9).cast("long")})
    full = log.unionByName(newer).unionByName(foreign).unionByName(old)
    # The fast scores changed since, yet logged cases keep their score.
    again = claims(spark, [(1, "evidence A", 0.3), (2, "evidence B", 0.2), (3, "evidence C", 0.05)])
    out = {r["id"]: r for r in cascade.score_claims(again, CONFIG, SCORERS, full).collect()}
    assert [out[i]["cached"] for i in (1, 2, 3)] == [True, True, False]
    assert [out[i]["p_llm"] for i in (1, 2, 3)] == [0.77, 0.95, 0.05]
    assert out[1]["p_fast"] == 0.1 and out[1]["nli_skip_reason"] == "nli_disabled"
    new = cascade.log_entries(cascade.score_claims(again, CONFIG, SCORERS, full), CONFIG, 3)
    assert [r["evidence"] for r in new.collect()] == ["evidence C"]
    keyed = cache.with_case_key(again, CONFIG)
    assert [r["id"] for r in cache.cache_misses(keyed, full, CONFIG).collect()] == [3]
    entries = cache.debug_entries(cache.matching_log(full, CONFIG)).collect()
    assert len(entries) == 2 and {r["p_fast"] for r in entries} == {0.1, 0.95}
    assert policy.CACHE_VERSION == "verifier-cache-v3"


def test_fingerprint(spark):
    df = claims(spark, [(1, "a", 0.1), (2, "b", 0.2), (3, "b", 0.3)])
    base = cache.fingerprint(df).first()[0]
    assert cache.fingerprint(df.repartition(5).orderBy(F.desc("id"))).first()[0] == base
    changed = df.withColumn("context", F.when(F.col("id") == 2, "c").otherwise(F.col("context")))
    assert cache.fingerprint(changed).first()[0] != base
    swapped = df.withColumn("id", F.when(F.col("id") == 2, 4).otherwise(F.col("id")))
    assert cache.fingerprint(swapped).first()[0] != base
    assert cache.fingerprint(df.limit(0)).count() == 1


def test_checkpoint(spark):
    meta = {"scorer": "x", "settings": "y"}
    claims_ = spark.createDataFrame([(101,), (102,), (103,)], "id long")
    scored = spark.createDataFrame([(101, 0.1), (102, 0.9), (103, 0.4)], "id long, p_llm double")
    saved = cache.checkpoint_rows(scored, "p_llm", meta)
    loaded = cache.load_checkpoint(saved, claims_, "p_llm", meta)
    assert {tuple(r) for r in loaded.collect()} == {(101, 0.1), (102, 0.9), (103, 0.4)}

    def rejected(saved_, claims__=claims_, meta_=meta, value="p_llm"):
        return cache.load_checkpoint(saved_, claims__, value, meta_) is None

    assert rejected(saved, claims_.where("id < 103"))
    assert rejected(saved.where("id < 103"))
    assert rejected(saved, meta_={**meta, "scorer": "z"})
    assert rejected(saved, meta_={**meta, "third": "z"})
    assert rejected(saved, value="other")
    assert rejected(saved.withColumn("p_llm", F.lit(math.nan)))
    assert rejected(saved.withColumn("p_llm", F.lit(None).cast("double")))
    assert rejected(saved.unionByName(saved.where("id = 101")))
