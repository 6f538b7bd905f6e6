"""The shipped tables seen as claims, corpora, articles and truth.

``conversations`` become claims (a user turn and the assistant turn after it, with the
system text of the conversation as context), ``documents`` a typed corpus, ``pages``
articles whose link lists act as category lines, and ``labels`` the truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.config import PipelineConfig, RouterConfig
from claimcheck.functions.vectors import HashingEncoder
from claimcheck.operators import corpus, retrieval
from claimcheck.rules.categories import TABLE_DEMO as DEMO_CATEGORIES
from claimcheck.rules.cues import TABLE_DEMO

CONFIG = PipelineConfig(
    router=RouterConfig(mode="hybrid", cues=TABLE_DEMO), run_timestamp="20260101_000000"
)
ENCODER = HashingEncoder(dim=256)
CATEGORIES = DEMO_CATEGORIES

# Spanish feeds the same corpus as English, so the grammar corpus has no index.
SOURCE_OF_LANG = {"en": "wiki", "es": "wiki", "fr": "idioms", "de": "literal"}
TURN_SPAN = 2**32
KEYWORDS = ("nung", "tionth", "ouan", "eaux", "ciónen")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, context, prompt_bn, response_bn``, one row per answered user turn.

    Joined on (conversation, turn), so a very long conversation is spread like any other.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt_bn")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_bn")
    )
    context = (
        turns.where(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("context"))
    )
    return (
        asked.join(answered, ["conv_id", "turn"])
        .join(context, "conv_id", "left")
        .select(
            (F.col("conv_id") * TURN_SPAN + F.col("turn")).alias("id"),
            "context",
            "prompt_bn",
            "response_bn",
        )
    )


def conv_id(claim_id: Column) -> Column:
    return F.shiftright(claim_id, 32)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label`` for claims whose conversation number carries a quality label."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("conv_id"), F.col("quality").alias("label")
    )
    ids = claims(spark, sf_dir).select("id").withColumn("conv_id", conv_id(F.col("id")))
    return ids.join(labels, "conv_id").select("id", "label")


def _source(lang: Column) -> Column:
    entries = [F.lit(x) for pair in SOURCE_OF_LANG.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), lang)


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deal rows out to all tasks when a scan has fewer splits than there are cores.

    Splitting and encoding texts is heavy per row; a table of many splits is left alone.
    ``key`` is unique, so the parts are even.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        _source(F.col("lang")).alias("source"), "doc_id", "text"
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk_documents(documents(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.embed_passages(passages(spark, sf_dir), ENCODER)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, title, text``: paragraphs as lines, then the link list as lines."""
    html = F.col("html")
    paragraphs = F.regexp_extract_all(html, F.lit("<p>([^<]*)"), F.lit(1))
    links = F.regexp_extract_all(html, F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.array_join(F.concat(paragraphs, links), "\n").alias("text"),
    )


def langlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``title, en_title``: a non-English document and the page with the same number."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang") != "en")
    pages = articles(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "title")
    return docs.join(pages, "doc_id").select(
        F.concat_ws("/", docs["source"], docs["doc_id"]).alias("title"),
        F.col("title").alias("en_title"),
    )


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``category, title`` with the document language as category."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("category"), F.concat_ws("/", "source", "doc_id").alias("title")
    )


def page_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all(
        F.col("html"), F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1)
    )
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("en_title"),
        F.explode(links).alias("category"),
    )


def sort_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, value``: JSON lines of every shape the sort job meets.

    Documents become objects whose text key depends on the language (blank for German),
    benchmark items bare text, and conversation turns arrays.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    lang = F.col("lang")
    key = F.when(lang == "fr", "passage").when(lang == "es", "content").otherwise("text")
    body = F.when(lang == "de", F.lit("  ")).otherwise(F.col("text"))
    doc_lines = docs.select(
        (F.col("doc_id") * 4).alias("line_no"),
        F.to_json(F.create_map(F.lit("lang"), lang, key, body)).alias("value"),
    )
    bench_lines = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") * 4 + 1).alias("line_no"), F.col("text").alias("value")
    )
    label_lines = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") * 4 + 2).alias("line_no"),
        F.to_json(F.array("quality", "toxic")).alias("value"),
    )
    return doc_lines.unionByName(bench_lines).unionByName(label_lines)
