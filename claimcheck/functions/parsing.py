"""Reading what a text-generating scorer returned, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimcheck.functions import text as tx
from claimcheck.functions.evidence import lookup
from claimcheck.rules import buckets

# --- fixed values: answer patterns and scores -----------------------------------------
VERDICT = r"verdict\s*[:=is\s]*\s*(faithful|hallucinated|correct|wrong|truthful|false|f|h)"
FAITHFUL_WORDS = ("faithful", "correct", "truthful", "f")
TAIL_CHARS = 150
TAIL_FAITHFUL = ("faithful", "correct")
TAIL_HALLUCINATED = ("hallucinated", "wrong")
FAITHFUL_SCORE = 0.90
HALLUCINATED_SCORE = 0.10
THINK_BLOCK = r"<think>.*?(?:</think>|$)"
FENCE = r"```[A-Za-z0-9_-]*"
ECHO = r"input\s+text\s*:"
BUCKET_FIELD = r"bucket\s*[:=]\s*(\w+)"
REWORDED_FIELD = r"reworded\s*[:=]\s*(.+)"
TEXT_FIELD = r"text\s*[:=]\s*(.+)"
BULLET = r"^[-*•\d.]+\s*"
HEADER_WORDS = ("reworded", "bucket", "category")
# --- end of fixed values --------------------------------------------------------------------


# Only the digits need Unicode mode, so they are named directly.
BULLET_JAVA = BULLET.replace(r"\d", r"\p{Nd}").replace(r"\s*", tx.SPACES[:-1] + "*")


def _field(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?isU){pattern}", 1), F.lit(""))


def parse_verdict(text: Column) -> Column:
    """Faithful / Hallucinated / NULL: the first stated verdict, else a word near the end."""
    stated = F.lower(_field(text, VERDICT))
    tail = F.lower(F.right(text, F.lit(TAIL_CHARS)))
    return (
        F.when(stated.isin(*FAITHFUL_WORDS), F.lit("Faithful"))
        .when(stated.isNotNull(), F.lit("Hallucinated"))
        .when(tx.contains_any(tail, TAIL_FAITHFUL), F.lit("Faithful"))
        .when(tx.contains_any(tail, TAIL_HALLUCINATED), F.lit("Hallucinated"))
    )


def verdict_score(verdict: Column) -> Column:
    return F.when(verdict == "Faithful", F.lit(FAITHFUL_SCORE)).when(
        verdict == "Hallucinated", F.lit(HALLUCINATED_SCORE)
    )


def clean_model_output(raw: Column) -> Column:
    """Drop the reasoning block, code fences and everything from an echoed input on."""
    body = tx.strip(F.regexp_replace(raw, f"(?s){THINK_BLOCK}", ""))
    body = tx.strip(F.regexp_replace(body, FENCE, ""))

    def before_echo(text: Column) -> Column:
        echoed = F.contains(F.lower(text), F.lit("input text:"))
        return F.when(echoed, tx.strip(F.split(text, f"(?iU){ECHO}", 2)[0])).otherwise(text)

    return tx.let(body, before_echo)


def parse_bucket(text: Column) -> Column:
    """First word that is a bucket alias, else the first alias that occurs anywhere."""
    plain = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\-]+", " ")

    def find(p: Column) -> Column:
        known = F.array(*[F.lit(alias) for alias in buckets.ALIASES])
        word = F.get(F.filter(F.split(p, " "), lambda t: F.array_contains(known, t)), F.lit(0))
        inside = F.coalesce(
            *[F.when(F.contains(p, F.lit(a)), F.lit(b)) for a, b in buckets.ALIASES.items()]
        )
        return F.coalesce(lookup(buckets.ALIASES, word), inside)

    return tx.let(plain, find)


def output_bucket(cleaned: Column) -> Column:
    return parse_bucket(F.coalesce(_field(cleaned, BUCKET_FIELD), cleaned))


def output_rewording(cleaned: Column, original: Column) -> Column:
    """Reworded text of the answer, or the original when the answer has none."""
    stated = F.coalesce(_field(cleaned, REWORDED_FIELD), _field(cleaned, TEXT_FIELD))
    return tx.let(
        stated,
        lambda s: F.when(
            s.isNotNull(), tx.strip(F.translate(tx.strip(s), "\ufffd", ""))
        ).otherwise(original),
    )


def fact_lines(rewording: Column) -> Column:
    """One fact per line: headers out, bullets and leading numbers off, blanks out."""
    lines = F.transform(F.split(rewording, "\n"), tx.strip)

    def is_fact(line: Column) -> Column:
        low = F.lower(line)
        keep = line != ""
        for word in HEADER_WORDS:
            keep = keep & ~F.startswith(low, F.lit(word))
        return keep

    bare = F.transform(
        F.filter(lines, is_fact), lambda f: tx.strip(F.regexp_replace(f, BULLET_JAVA, ""))
    )
    return F.filter(bare, lambda f: f != "")
