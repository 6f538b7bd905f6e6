"""Corpus jobs: chunking, article categories, cross-language titles, corpus sorting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.functions import parsing, prompts
from claimcheck.functions import text as tx
from claimcheck.operators.cascade import run_stage
from claimcheck.rules import buckets
from claimcheck.rules.categories import BENGALI, REGION_KEYWORDS, CategoryPack, ClassRule
from claimcheck.scorers import Scorer
from claimcheck.session import materialize_alone

CHUNKS_PER_DOC = 10_000_000


# --- passages -------------------------------------------------------------------------------


def chunk_documents(
    docs: DataFrame, size: int = 220, overlap: int = 50, min_chars: int = 0
) -> DataFrame:
    """``source, doc_id, text`` to passages of overlapping word windows."""
    windows = F.explode(tx.word_windows(F.col("text"), size, overlap, min_chars))
    return docs.select("source", "doc_id", windows.alias("w")).select(
        "source",
        (F.col("doc_id") * CHUNKS_PER_DOC + F.col("w.chunk_no")).alias("passage_id"),
        F.col("w.text").alias("text"),
    )


def passages_of_articles(articles: DataFrame) -> DataFrame:
    """Title and text as one passage."""
    return articles.withColumn("text", F.concat_ws("\n", "title", "text"))


# --- article categories --------------------------------------------------------------------


def category_lines(text: Column, pack: CategoryPack) -> Column:
    """Short lines without a sentence end, read from the bottom of the article up.

    Reading stops at the first other line that follows three collected ones.  Among the
    other lines, the m-th at position p has p - m collected lines before it, so the stop is
    the first with p - m >= 3 and no running state is needed.
    """
    lines = F.reverse(
        F.filter(F.transform(F.split(text, "\n"), tx.strip), lambda x: x != "")
    )

    def is_category(line: Column) -> Column:
        ok = F.length(line) < 100
        for end in pack.sentence_ends:
            ok = ok & ~F.endswith(line, F.lit(end))
        return ok

    def from_bottom(ls: Column) -> Column:
        others = F.filter(
            F.transform(ls, lambda x, i: F.when(~is_category(x), i)), lambda i: i.isNotNull()
        )
        stops = F.filter(
            F.transform(others, lambda p, m: F.when(p - m >= 3, p)), lambda p: p.isNotNull()
        )
        stop = F.coalesce(F.get(stops, F.lit(0)), F.size(ls))
        return F.filter(F.slice(ls, F.lit(1), stop), is_category)

    return tx.let(lines, from_bottom)


def _announces(rule: ClassRule, line: Column) -> Column:
    hit = F.lit(False)
    for word in rule.inner:
        hit = hit | F.contains(line, F.lit(word))
    for word in rule.endings:
        hit = hit | F.endswith(line, F.lit(word))
    return hit


def _family_classes(lines: Column, family: Sequence[ClassRule]) -> Column:
    """Classes a family finds in the lines; the first matching rule of a line wins."""
    return F.transform(
        lines,
        lambda x: F.coalesce(*[F.when(_announces(r, x), F.lit(r.category)) for r in family]),
    )


# --- fixed values: year ranges that open a biography ------------------------------------------
LIFE_SPANS = (r"\(\s*\d{4}\s*[-–—]", r"[-–—]\s*\d{4}\s*\)")
INTRO_CHARS = 200
# --- end of fixed values ------------------------------------------------------------------------


def classify_articles(articles: DataFrame, pack: CategoryPack = BENGALI) -> DataFrame:
    """Add ``categories``: all categories of an article in fixed order, or the default."""
    found = articles.withColumn("_lines", category_lines(tx.nfc(F.col("text")), pack))
    found = found.withColumn(
        "_found",
        F.array_compact(
            F.flatten(F.array(*[_family_classes(F.col("_lines"), f) for f in pack.families]))
        ),
    )
    intro = F.substring("text", 1, INTRO_CHARS)

    def has_class(names: Sequence[str]) -> Column:
        return F.arrays_overlap(F.col("_found"), F.array(*[F.lit(n) for n in names]))

    life = F.lit(False)
    for pattern in LIFE_SPANS:
        life = life | intro.rlike(f"(?U){pattern}")
    by_intro = F.array_compact(
        F.array(
            F.when(~has_class(pack.people) & life, F.lit(pack.people_fallback)),
            F.when(
                ~has_class(pack.places) & tx.contains_any(intro, pack.intro_place_cues),
                F.lit(pack.place_fallback),
            ),
        )
    )
    ordered = F.array_intersect(
        F.array(*[F.lit(c) for c in pack.order]), F.concat(F.col("_found"), by_intro)
    )
    categories = F.when(F.size(ordered) > 0, ordered).otherwise(F.array(F.lit(pack.default)))
    return found.withColumn("categories", categories).drop("_lines", "_found")


def enabled_articles(
    classified: DataFrame, enabled: Sequence[str] | None = None, pack: CategoryPack = BENGALI
) -> DataFrame:
    """Keep articles with an enabled category, one row per article and enabled category.

    By default everything but the catch-all is enabled; an empty list switches the filter off.
    """
    names = list(pack.order) if enabled is None else list(enabled)
    targets = F.col("categories")
    if names:
        targets = F.array_intersect(targets, F.array(*[F.lit(n) for n in names]))
    return classified.withColumn("category", F.explode(targets))


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("categories").alias("category")).groupBy("category").agg(
        F.count("*").alias("n_articles")
    )


def category_metrics(
    classified: DataFrame, enabled: Sequence[str] | None = None, pack: CategoryPack = BENGALI
) -> DataFrame:
    names = list(pack.order) if enabled is None else list(enabled)
    kept = F.lit(True)
    if names:
        kept = F.arrays_overlap("categories", F.array(*[F.lit(n) for n in names]))
    return classified.agg(
        F.count("*").alias("n_processed"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(~kept).alias("n_skipped"),
    )


# --- cross-language counterparts ---------------------------------------------------------------


def resolve_titles(titles: DataFrame, langlinks: DataFrame) -> DataFrame:
    """``category, title`` to the counterpart title; a title has one counterpart."""
    links = langlinks.groupBy("title").agg(F.min("en_title").alias("en_title"))
    return titles.select("category", "title").distinct().join(links, "title")


def related_pages(
    resolved: DataFrame, page_categories: DataFrame, keywords: Sequence[str] = REGION_KEYWORDS
) -> DataFrame:
    """Pages whose title names a keyword, or one of whose category titles does."""
    by_category = (
        page_categories.where(tx.contains_any(F.lower("category"), keywords))
        .select("en_title", F.lit(True).alias("_related"))
        .distinct()
    )
    by_title = tx.contains_any(F.lower("en_title"), keywords)
    return (
        resolved.join(by_category, "en_title", "left")
        .where(by_title | F.col("_related"))
        .drop("_related")
    )


def counterpart_passages(
    related: DataFrame, en_articles: DataFrame, min_chars: int = 100
) -> DataFrame:
    """Texts of the related pages that are longer than a stub; a title has one text."""
    texts = en_articles.groupBy("en_title").agg(F.min("text").alias("text"))
    bodies = texts.where(F.length(tx.strip(F.col("text"))) > min_chars)
    joined = related.join(bodies, "en_title")
    return joined.select("category", "en_title", F.concat_ws("\n", "en_title", "text").alias("text"))


# --- corpus sorting ------------------------------------------------------------------------------


def read_sort_lines(
    lines: DataFrame, keys: Sequence[str] = buckets.TEXT_KEYS, most: int = 0
) -> DataFrame:
    """``line_no, value`` to ``line_no, fields, input_text, error``; blank lines are dropped.

    Parsing as a variant keeps broken JSON, JSON that is no object, and objects without
    text apart; a struct schema would turn all three into NULL fields.  ``fields`` is the
    object itself, or the raw line under "text" when there is none.  ``most`` takes the
    first lines only, for a trial run.  Further columns, such as the file, are kept.
    """
    raw = tx.strip(F.col("value"))
    kept = [c for c in lines.columns if c not in ("line_no", "value")]
    parsed = lines.select(*kept, "line_no", raw.alias("raw")).where(F.col("raw") != "")
    if most > 0:
        parsed = parsed.orderBy(*kept, "line_no").limit(most)
    parsed = parsed.withColumn("_v", F.try_parse_json("raw"))
    is_object = F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))
    texts = [
        F.when(
            F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant")) == "STRING",
            tx.strip(F.try_variant_get("_v", f"$.{k}", "string")),
        )
        for k in keys
    ]
    text = F.coalesce(*[F.when(t != "", t) for t in texts])
    broken = F.when(F.col("_v").isNull(), F.lit("invalid_json")).when(
        ~is_object, F.lit("not_object")
    )
    bare = F.create_map(F.lit("text"), F.col("raw").cast("variant"))
    return parsed.withColumn("_broken", broken).select(
        *kept,
        "line_no",
        F.when(F.col("_broken").isNull(), F.from_json("raw", "map<string,variant>"))
        .otherwise(bare)
        .alias("fields"),
        F.when(F.col("_broken").isNotNull(), F.col("raw"))
        .otherwise(F.coalesce(text, F.lit("")))
        .alias("input_text"),
        F.coalesce(F.col("_broken"), F.when(text.isNull(), F.lit("missing_text"))).alias("error"),
    )


def sort_lines(rows: DataFrame, scorer: Scorer, text_column: str = "input_text") -> DataFrame:
    """Ask the scorer for a bucket and a rewording of each readable line, and read its answer.

    Adds ``raw_model_output``, ``unparsed`` and ``parsed_bucket``, ``facts`` and
    ``reworded_facts`` (the facts, or the rewording as it is when it has none).
    """
    readable = F.col("error").isNull()

    def prompted(lines: DataFrame) -> DataFrame:
        return lines.withColumn("sort_prompt", prompts.sort_prompt(F.col(text_column)))

    asked = run_stage(rows, scorer, "_answer", readable, prompted if "sort_prompt" in scorer.inputs else None)
    cleaned = asked.withColumn("_clean", parsing.clean_model_output(F.col("_answer")))
    read = cleaned.withColumns(
        {
            "_bucket": F.when(readable, parsing.output_bucket(F.col("_clean"))),
            "_reworded": F.when(
                readable, parsing.output_rewording(F.col("_clean"), F.col(text_column))
            ).otherwise(F.col(text_column)),
        }
    )
    bucket = F.coalesce(F.col("_bucket"), F.lit("skip"))
    none = F.array().cast("array<string>")
    facts = F.when(
        readable & (bucket != "skip") & (F.col("_reworded") != ""),
        parsing.fact_lines(F.col("_reworded")),
    )
    return (
        read.withColumns(
            {
                "raw_model_output": F.coalesce(F.col("error"), tx.strip(F.col("_answer"))),
                "unparsed": readable & F.col("_bucket").isNull(),
                "parsed_bucket": bucket,
                "facts": F.coalesce(facts, none),
            }
        )
        .withColumn(
            "reworded_facts",
            F.when(F.size("facts") > 0, F.col("facts")).otherwise(F.array("_reworded")),
        )
        .drop("_answer", "_clean", "_bucket", "_reworded")
    )


def sort_log(sorted_rows: DataFrame) -> DataFrame:
    """The log of a sort job, with the file of each line where there are several."""
    return sorted_rows.select(
        *[c for c in ("file",) if c in sorted_rows.columns],
        "line_no", "input_text", "parsed_bucket", "reworded_facts", "raw_model_output", "error"
    )


def _has_facts() -> Column:
    return (F.col("parsed_bucket") != "skip") & (F.size("facts") > 0)


def _emptied(keys: Sequence[str]) -> tuple[Column, Column]:
    """The first text key that an object has, and the object without the text that facts replace."""
    present = F.coalesce(
        *[F.when(F.map_contains_key("fields", F.lit(k)), F.lit(k)) for k in keys], F.lit("")
    )
    return present, F.transform_values(
        "fields", lambda k, v: F.when(~_has_facts() | (k != present), v)
    )


def stored_sort(rows: Callable[[], DataFrame], spark: SparkSession, keys: Sequence[str] = buckets.TEXT_KEYS) -> DataFrame:
    """Sorted lines as a stage: ``bucket_counts``, ``sort_log`` and ``fact_rows`` read them as they read ``rows``.

    A text is stored once where columns repeat it: the facts are those of ``reworded_facts``, and the
    text that facts replace is left out of ``fields``.  The stages that ``rows`` stores are deleted.
    """

    def slim() -> DataFrame:
        found = F.size("facts") > 0
        return rows().withColumns({"fields": _emptied(keys)[1], "facts": found})

    kept = materialize_alone(spark, slim, "sort")
    nothing = F.array().cast("array<string>")
    return kept.withColumn("facts", F.when(F.col("facts"), F.col("reworded_facts")).otherwise(nothing))


def fact_rows(sorted_rows: DataFrame, keys: Sequence[str] = buckets.TEXT_KEYS) -> DataFrame:
    """One output object per fact; lines without facts keep their object as it is.

    ``line`` is the JSON object with the fact in place of the first text key it has.  That
    text goes before the facts spread, so an object travels with each fact without it.
    ``_sort_note`` has the ``_sort_*`` columns as JSON, made once for all facts of a line.
    """
    has_facts = _has_facts()
    facts = F.when(has_facts, F.col("facts")).otherwise(F.array(F.lit(None).cast("string")))
    present, emptied = _emptied(keys)
    notes = {
        "_sort_bucket": F.col("parsed_bucket"),
        "_sort_line": F.col("line_no"),
        "_sort_model_output": F.col("raw_model_output"),
    }
    note = F.to_json(F.struct(*[value.alias(name) for name, value in notes.items()]))
    spread = sorted_rows.withColumn("_sort_note", note).select(
        F.col("parsed_bucket").alias("bucket"),
        emptied.alias("fields"),
        present.alias("_key"),
        F.posexplode(facts).alias("fact_no", "fact"),
        *[value.alias(name) for name, value in notes.items()],
        "_sort_note",
    )
    replaced = F.transform_values(
        "fields",
        lambda k, v: F.when(
            F.col("fact").isNotNull() & (k == F.col("_key")), F.col("fact").cast("variant")
        ).otherwise(v),
    )
    return spread.withColumn("line", F.to_json(replaced)).drop("fields", "_key")


def unsorted_lines(
    rows: DataFrame, log: DataFrame, keys: Sequence[str] = ("line_no",)
) -> DataFrame:
    """Lines an earlier run has not logged yet."""
    return rows.join(log.select(*keys).distinct(), list(keys), "left_anti")


def bucket_counts(sorted_rows: DataFrame, earlier_log: DataFrame | None = None) -> DataFrame:
    """Lines per bucket over this run and the log of earlier ones, with unreadable answers."""
    now = sorted_rows.select("parsed_bucket", F.col("unparsed").cast("int").alias("u"))
    if earlier_log is not None:
        earlier = earlier_log.where(F.col("parsed_bucket").isNotNull())
        now = now.unionByName(earlier.select("parsed_bucket", F.lit(0).alias("u")))
    return now.groupBy(F.col("parsed_bucket").alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("u").alias("n_unparsed")
    )
