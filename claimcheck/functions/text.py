"""Text cleaning and string scalars as Column expressions.

White space is spelt out: Java's ``\\s`` is ASCII-only, its Unicode mode is slow and still
leaves out U+001C..U+001F.
"""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck.rules.cues import Predicate

SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACES = (
    r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)

# --- fixed values -----------------------------------------------------------------
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
MISSING_WORDS = ("", "[NULL]", "None", "nan")
# --- end of fixed values ------------------------------------------------------------


@functools.cache
def _unsettled() -> str:
    """A character class: what NFC changes, reorders or may join to the character before it.

    These are the characters whose NFC quick check is not "yes".  A text without them is NFC
    already, whatever else it holds (curly quotes, dashes, CJK, invisible characters).
    """
    found = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]  # vowels and finals that Hangul joins
    for point in range(0x300, 0x30000):  # planes above hold no such character
        char = chr(point)
        if unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char):
            found.append(point)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.append(int(parts[1], 16))
    points = sorted({x for x in found if x >= 0x300})
    runs: list[list[int]] = []
    for point in points:
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    # The long list is asked about characters from U+0300 on only, as most lie below.
    return r"[\x{300}-\x{2ffff}&&[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]]"


@F.arrow_udf(T.StringType())
def _nfc_udf(texts: pa.Array) -> pa.Array:
    settled, normal = unicodedata.is_normalized, unicodedata.normalize
    out = [t if t is None or settled("NFC", t) else normal("NFC", t) for t in texts.to_pylist()]
    return pa.array(out, type=pa.string())


def nfc(text: Column) -> Column:
    """NFC form.  Spark has no such function, so an Arrow UDF computes it.

    Only texts with a character that NFC may touch cross to the Python worker, others as NULL.
    """
    doubtful = F.when(text.rlike(_unsettled()), text)
    return F.coalesce(_nfc_udf(doubtful), text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times.

    A column that a lambda captures is evaluated for every element; as the element of a
    one-item array it is a bound variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean_text(text: Column) -> Column:
    """NFC, invisible characters dropped, white space collapsed; nothing left means NULL."""
    flat = collapse(F.translate(nfc(text.cast("string")), INVISIBLE, ""))
    return F.when((flat != "") & (F.lower(flat) != "null") & (flat != "[NULL]"), flat)


def is_missing(text: Column) -> Column:
    """True for NULL and for every spelling of "nothing" that later stages accept."""
    return text.isNull() | strip(text).isin(*MISSING_WORDS)


def present(text: Column) -> Column:
    """The text, or NULL when it is missing."""
    return F.when(~is_missing(text), text)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def truncate_words(text: Column, limit: int | None) -> Column:
    """First ``limit`` words; a text within the limit keeps its own spacing."""
    if limit is None or limit <= 0:
        return text
    return let(
        words(text),
        lambda parts: F.when(F.size(parts) <= limit, text).otherwise(
            F.array_join(F.slice(parts, 1, limit), " ")
        ),
    )


def word_windows(text: Column, size: int = 220, overlap: int = 50, min_chars: int = 0) -> Column:
    """Sliding word windows as an array of ``(chunk_no, text)``, all words in some window.

    ``min_chars`` drops shorter windows; by default none is dropped.
    """
    step = max(1, size - overlap)

    def windows(parts: Column) -> Column:
        starts = F.when(
            F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1, F.lit(step))
        )
        return F.transform(
            starts,
            lambda s, i: F.named_struct(
                F.lit("chunk_no"),
                i,
                F.lit("text"),
                F.array_join(F.slice(parts, s + 1, F.lit(size)), " "),
            ),
        )

    return F.filter(let(words(text), windows), lambda w: F.length(w["text"]) >= min_chars)


def contains_any(text: Column, cues: Iterable[str]) -> Column:
    return functools.reduce(operator.or_, [F.contains(text, F.lit(cue)) for cue in cues])


def holds(text: Column, predicate: Predicate) -> Column:
    """Evaluate a cue predicate (OR of rules, AND of groups, OR of cues)."""
    rules = [
        functools.reduce(operator.and_, [contains_any(text, group) for group in rule])
        for rule in predicate
    ]
    return functools.reduce(operator.or_, rules)


def has_word(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def mention_count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"(?U){pattern}")), F.lit(0))


# --- fixed values -----------------------------------------------------------------
QUOTED = "(?d)[“\"‘'«](.+?)[”\"’'»]"
# --- end of fixed values ------------------------------------------------------------


def quoted_lemma(text: Column) -> Column:
    """Longest quoted stretch, the first one on a tie; NULL when there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), strip)
    ranked = F.transform(
        found,
        lambda q, i: F.named_struct(F.lit("n"), F.length(q), F.lit("first"), -i, F.lit("q"), q),
    )
    best = F.array_max(ranked)["q"]
    return F.when(best != "", best)


def retrieval_query(prompt: Column, response: Column, task: Column, mode: str) -> Column:
    """What to search for: the quoted lemma for word-meaning tasks, else the question."""
    lemma = F.when(
        task.isin("idiom_meaning_null", "literal_meaning_null"), quoted_lemma(prompt)
    )
    text = prompt
    if mode == "prompt_response":
        text = F.concat_ws(" ", prompt, response)
    return F.coalesce(lemma, text)


def long_tokens(text: Column, min_chars: int) -> Column:
    return F.filter(F.split(text, SPACES), lambda t: F.length(t) >= min_chars)


def token_hits(text: Column, tokens: Column) -> Column:
    """How many of the tokens occur in the text."""
    return let(
        text, lambda body: F.size(F.filter(tokens, lambda t: F.contains(body, t)))
    )


def answer_in_premise(premise: Column, answer: Column, min_share: float = 0.3) -> Column:
    """Guard for accepting an answer as supported: enough of its words occur in the premise."""
    premise = F.coalesce(premise, F.lit(""))
    bare = strip(F.translate(F.coalesce(answer, F.lit("")), "*_", ""))

    def supported(b: Column) -> Column:
        tokens, short = long_tokens(b, 3), long_tokens(b, 2)
        enough = F.when(
            F.size(tokens) > 0,
            token_hits(premise, tokens) / F.size(tokens) >= F.lit(float(min_share)),
        ).otherwise(token_hits(premise, short) > 0)
        return (
            F.when((F.length(b) < 2) | (strip(premise) == ""), F.lit(False))
            .when(F.contains(premise, b), F.lit(True))
            .otherwise(enough)
        )

    return let(bare, supported)


def evidence_irrelevant(prompt: Column, evidence: Column) -> Column:
    """No word of the question occurs in the evidence (missing evidence counts as irrelevant)."""
    tokens = long_tokens(F.coalesce(prompt, F.lit("")), 3)
    none_hit = (F.size(tokens) > 0) & (token_hits(strip(evidence), tokens) == 0)
    return F.when(is_missing(evidence), F.lit(True)).otherwise(none_hit)
