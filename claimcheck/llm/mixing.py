"""Mixing to target weights: soft domains of documents, and rates whose token totals match targets.

Everything is built-in column functions.  A naive Bayes classifier, fitted on a labelled
table, gives each document a probability of each domain.  Each document's rate is how often
it is to be expected in the mix; rates are at least zero, and projected-gradient steps bring
the expected tokens of each domain, ``sum(rate * tokens * probability)``, to the targets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import stored, table

#: Upper ends of the bins of each feature.
BINS = {
    "signs": (0.0, 0.005, 0.02, 0.08, 0.2),
    "distinct": (0.1, 0.3, 0.5, 0.65, 0.8, 0.9),
    "length": (4.5, 5.5, 6.0, 6.5, 7.5, 9.0),
    "words": (20, 100, 300, 1000),
    "marked": (0, 1, 2, 5),
}
#: Labelled documents that the list of telling words is taken from, at most so many of the
#: first domain and of the others, and the size of the list.  All other counts cover all rows.
SAMPLE_ROWS, LEXICON, LEAST_DOCS = 2000, 64, 5
ROUNDS, TOLERANCE = 30, 1e-5
SEED = 17
_BLANKS = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Domains:
    """Names and target shares of the domains, and which domain a labelled row is.

    ``of`` is an SQL expression over the labelled table that gives a name (null: no label).
    The first name is the domain that the words of the others are told from.
    """

    of: str
    targets: dict[str, float] = field(default_factory=dict)


#: Toxic documents, and among the others those of low quality.
QUALITY_AND_TOXIC = Domains(
    "CASE WHEN toxic > 0 THEN 'toxic' WHEN quality = 0 THEN 'low' WHEN quality > 0 THEN 'clean' END",
    {"clean": 0.87, "low": 0.08, "toxic": 0.05},
)
QUALITY = Domains("CASE WHEN quality > 0 THEN 'high' WHEN quality = 0 THEN 'low' END", {"high": 0.9, "low": 0.1})


def _words(text: Column) -> Column:
    """The words of a text between white space; a text without any has one empty word."""
    return F.split(F.btrim(text, F.lit(_BLANKS)), r"\s+")


def _measured(docs: DataFrame, own: str, lexicon: list[str]) -> DataFrame:
    """``docs`` with a struct of tokens and the bin of each feature of the text.

    Made in steps, so that a text is split once however many features read its words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.array(*map(F.lit, lexicon)) if lexicon else F.array().cast("array<string>")
    signs = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]"))
    rows = docs.withColumn(own, F.struct(F.length(text).alias("chars"), signs.alias("signs"), _words(text).alias("words")))
    x = F.col(own)
    empty = (F.size(x["words"]) == 1) & (F.get(x["words"], F.lit(0)) == "")
    counted = F.struct(
        x["chars"].alias("chars"),
        x["signs"].alias("signs"),
        F.when(empty, 0).otherwise(F.size(x["words"])).alias("n"),
        F.array_distinct(x["words"]).alias("distinct"),
    )
    rows = rows.withColumn(own, counted)
    some = F.greatest(x["n"], F.lit(1))
    raw = F.struct(
        x["n"].cast("long").alias("tokens"),
        (x["signs"] / F.greatest(x["chars"], F.lit(1))).alias("signs"),
        (F.size(x["distinct"]) / some).alias("distinct"),
        (x["chars"] / some).alias("length"),
        x["n"].alias("words"),
        F.size(F.array_intersect(x["distinct"], marked)).alias("marked"),
    )
    rows = rows.withColumn(own, raw)
    bins = [_bin(x[part], ends).alias(part) for part, ends in BINS.items()]
    return rows.withColumn(own, F.struct(x["tokens"].alias("tokens"), *bins))


def _bin(value: Column, ends: tuple[float, ...]) -> Column:
    out = F.lit(0)
    for k, end in enumerate(ends):
        out = F.when(value > end, k + 1).otherwise(out)
    return out


def _labelled(labels: DataFrame, domains: Domains) -> DataFrame:
    """One row for each labelled id; of an id labelled twice the smallest name counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(domains.of).alias("domain"))
    rows = rows.where(F.col("domain").isin(list(domains.targets)) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.min("domain").alias("domain"))


def telling_words(docs: DataFrame, labelled: DataFrame, first: str) -> list[str]:
    """Words of the sample that stand in other domains' documents far oftener than in the first's."""
    other = F.col("domain") != first
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = labelled.where(~other).orderBy(*order).limit(SAMPLE_ROWS)
    sample = sample.union(labelled.where(other).orderBy(*order).limit(SAMPLE_ROWS))
    sample = sample.select("doc_id", other.cast("int").alias("other"))
    # At most 2 x SAMPLE_ROWS ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    sizes = sample.agg(F.coalesce(F.sum("other"), F.lit(0)), F.count("*")).first()
    a, b = sizes[0], sizes[1] - sizes[0]
    words = rows.select("other", F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("word"))
    counts = words.where("word != ''").groupBy("word").agg(
        F.sum("other").alias("x"), F.sum(1 - F.col("other")).alias("y")
    )
    odds = F.log((F.col("x") + 0.5) / (a + 1.0)) - F.log((F.col("y") + 0.5) / (b + 1.0))
    best = counts.where(F.col("x") >= LEAST_DOCS).withColumn("odds", odds).where("odds > 1")
    best = best.orderBy((F.col("odds") * F.sqrt("x")).desc(), "word").limit(LEXICON)
    return [r["word"] for r in best.collect()]


def bayes_logs(bins: DataFrame, labelled: DataFrame, domains: Domains) -> dict[str, dict[str, list[float]]]:
    """For each domain, its log share and, for each feature, the log share of each bin.

    ``bins`` has ``doc_id`` and a bin for each feature.  Counts are taken over all labelled
    documents; there are as many as domains x features x bins.
    """
    names, parts = list(domains.targets), list(BINS)
    rows = bins.select("doc_id", *parts).join(labelled, "doc_id")
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("bin")) for p in parts)))
    counted = rows.select("domain", pairs.alias("x")).groupBy("domain", "x.part", "x.bin").count().collect()
    counts = {(r["domain"], r["part"], r["bin"]): r["count"] for r in counted}
    size = {d: sum(v for (x, p, _), v in counts.items() if x == d and p == parts[0]) for d in names}
    out = {}
    for name in names:
        out[name] = {"": [math.log((size[name] + 1) / (sum(size.values()) + len(names)))]}
        for part in parts:
            ends = len(BINS[part]) + 1
            logs = [math.log((counts.get((name, part, k), 0) + 1) / (size[name] + ends)) for k in range(ends)]
            out[name][part] = logs
    return out


def posteriors(logs: dict[str, dict[str, list[float]]], bins: Column) -> Column:
    """The probabilities of the domains in their order, an array, from a struct of bins."""
    sums = []
    for own in logs.values():
        total = F.lit(own[""][0])
        for part in BINS:
            total = total + F.get(F.array(*map(F.lit, own[part])), bins[part])
        sums.append(total)
    most = F.greatest(*sums) if len(sums) > 1 else sums[0]
    shifted = [F.exp(x - most) for x in sums]
    whole = sum(shifted[1:], shifted[0])
    return F.array(*(x / whole for x in shifted))


def rate(p: Column, steps: list[list[float]]) -> Column:
    """A document's rate after the steps: each takes off ``p . step`` and cuts at zero."""
    size = len(steps[0]) if steps else 0
    out = F.lit(1.0)
    if not steps:
        return out
    history = F.array(*(F.array(*map(F.lit, s)) for s in steps))

    def move(r: Column, s: Column) -> Column:
        dot = F.lit(0.0)
        for d in range(size):
            dot = dot + F.get(p, F.lit(d)) * F.get(s, F.lit(d))
        return F.greatest(F.lit(0.0), r - dot)

    return F.aggregate(history, out, move)


def fit(rows: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Steps of projected gradient for rows of ``tokens`` and ``p`` (an array), from rates of one.

    With M the sum of p p' over the tokens of documents whose rate is above zero, the squared
    distance from the targets is taken in the norm of M's inverse; its gradient for a document
    is ``p . inverse(M) . (expected - target)``, so one vector of the length of the targets is
    a step for all documents.  A round reads the rows once and sums a number for each pair of
    domains.  A rate follows from the steps and the document's own p, so no round writes
    anything.  It ends when no total is further from its target than the tolerance, or moves
    by more than a tenth of it (targets out of reach), as a share of all tokens.
    """
    size = len(targets)
    goal = np.array(targets) / sum(targets)
    at = lambda d: F.get("p", F.lit(d))
    weight = F.col("tokens") * F.col("r")
    there = F.col("tokens") * (F.col("r") > 0).cast("double")
    sums = [F.sum(weight * at(d)) for d in range(size)]
    moments = [F.sum(there * at(a) * at(b)) for a in range(size) for b in range(size)]
    steps: list[list[float]] = []
    last = None
    for _ in range(rounds):
        found = rows.withColumn("r", rate(F.col("p"), steps)).agg(F.sum("tokens"), *sums, *moments).first()
        if not found[0]:
            break
        numbers = np.array(found[1:], dtype=float) / found[0]
        expected, metric = numbers[:size], numbers[size:].reshape(size, size) + 1e-9 * np.eye(size)
        if np.abs(expected - goal).max() < tolerance:
            break
        if last is not None and np.abs(expected - last).max() < tolerance / 10:
            break
        steps.append(np.linalg.solve(metric, expected - goal).tolist())
        last = expected
    return steps


def _free(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def mixed(
    docs: DataFrame, labels: DataFrame, domains: Domains = QUALITY_AND_TOXIC, keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """``docs`` (of its columns ``keep``, ``doc_id`` among them; all by default) with a column ``tokens, p, rate, copies``, a struct, and that column's name.

    ``copies`` is the rate made whole: its whole part, and one more for the share of ids whose
    hash lies below the rest.  Null, empty and blank texts have no tokens, and a rate like
    any other.  Rows without an id or label only lack a part in fitting; rows of one id have
    one draw.  Without labels all domains are equally likely; an empty table gives an empty
    one.  Texts are read twice, once for the list of telling words.
    """
    labelled = stored(_labelled(labels, domains), "labelled")
    names = list(domains.targets)
    lexicon = telling_words(docs, labelled, names[0])
    own = _free(docs.columns, "mix")
    measured = _measured(docs, own, lexicon)
    rows = stored(measured.select(*keep, own) if keep else measured, "features")
    binned = rows.select(F.col("doc_id").cast("long").alias("doc_id"), f"{own}.*")
    logs = bayes_logs(binned, labelled, domains)
    # Documents of equal bins have equal probabilities, so fitting needs their sums only: no
    # more rows than there are combinations of bins.
    sums = binned.groupBy(*BINS).agg(F.sum("tokens").alias("tokens"))
    soft = sums.select("tokens", posteriors(logs, F.struct(*BINS)).alias("p"))
    steps = fit(stored(soft, "soft"), [domains.targets[n] for n in names])
    out = rows.withColumn(own, F.struct(F.col(own)["tokens"].alias("tokens"), posteriors(logs, F.col(own)).alias("p")))
    out = out.withColumn(own, F.col(own).withField("rate", rate(F.col(own)["p"], steps)))
    whole = F.floor(F.col(own)["rate"])
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long")), F.lit(2**40)) / 2**40
    copies = whole + (draw < F.col(own)["rate"] - whole).cast("long")
    return out.withColumn(own, F.col(own).withField("copies", copies)), own


def resampled(docs: DataFrame, labels: DataFrame, domains: Domains = QUALITY) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with no other columns."""
    out, own = mixed(docs, labels, domains)
    again = F.sequence(F.lit(1).cast("long"), F.col(own)["copies"])
    out = out.where(F.col(own)["copies"] > 0).withColumn(own, F.explode(again))
    return out.select(*(out[c] for c in docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, own = mixed(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    names = list(QUALITY_AND_TOXIC.targets)
    shares = [F.get(F.col(own)["p"], F.lit(k)).alias(f"p_{n}") for k, n in enumerate(names)]
    mix = F.col(own)
    return out.select("doc_id", mix["tokens"].alias("tokens"), *shares, mix["rate"].alias("rate"), mix["copies"].alias("copies"))
