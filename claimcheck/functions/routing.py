"""Task routing as Column expressions over named cue flags.

``flags`` computes each predicate once; the task expressions only combine flags, so a
frame should add the flags in one projection and the task in the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimcheck.functions import text as tx
from claimcheck.rules import policy
from claimcheck.rules.cues import CuePack

# Cue predicates that decide a task on their own, strongest first.
LEXICAL_ORDER = (
    ("idiom", "idiom_meaning_null"),
    ("literal", "literal_meaning_null"),
    ("grammar", "bangla_grammar"),
)
MATH_ORDER = (
    ("calendar", "calendar_arithmetic"),
    ("work_rate", "math_work_rate"),
    ("speed", "math_speed_distance"),
    ("profit", "math_profit_loss"),
    ("average", "math_average"),
    ("math_other", "math_other"),
)
FLAG_PREFIX = "_cue_"


def flags(context: Column, prompt: Column, response: Column, cues: CuePack) -> dict[str, Column]:
    """Boolean columns the task expressions need, keyed by column name."""
    question = F.coalesce(prompt, F.lit(""))
    answer = F.coalesce(response, F.lit(""))
    names = [name for name, _ in LEXICAL_ORDER + MATH_ORDER] + ["famous", "factual"]
    found = {name: tx.holds(question, getattr(cues, name)) for name in names}
    found["translation"] = tx.holds(F.lower(question), cues.translation)
    found["foreign"] = tx.has_word(question, cues.foreign_word) | tx.has_word(
        answer, cues.foreign_word
    )
    found["context"] = ~tx.is_missing(context)
    return {FLAG_PREFIX + name: column for name, column in found.items()}


def _flag(name: str) -> Column:
    return F.col(FLAG_PREFIX + name)


def flag_names() -> list[str]:
    rest = ["famous", "factual", "translation", "foreign", "context"]
    return [FLAG_PREFIX + n for n, _ in LEXICAL_ORDER + MATH_ORDER] + [FLAG_PREFIX + n for n in rest]


def _first(order: tuple[tuple[str, str], ...]) -> Column:
    """Task of the first flag that is set, else NULL."""
    return F.coalesce(*[F.when(_flag(name), F.lit(task)) for name, task in order])


def math_task() -> Column:
    return _first(MATH_ORDER)


def _fact_task() -> Column:
    grounded = F.when(
        _flag("famous") & _flag("factual"), F.lit("famous_bn_fact_context")
    ).otherwise(F.lit("context_grounded_fact"))
    open_fact = F.when(_flag("famous"), F.lit("famous_bn_fact_null")).otherwise(
        F.lit("general_fact_null")
    )
    return F.when(_flag("context"), grounded).otherwise(open_fact)


def _other_task() -> Column:
    return F.when(_flag("context"), F.lit("context_grounded_other")).otherwise(
        F.lit("other_null")
    )


def static_task() -> Column:
    """Task from cues alone.

    Foreign words mean a translation task only if the question does not ask for a fact;
    a translation cue always does.  Without a context, a famous name alone makes a fact.
    """
    translation = _flag("translation") | (_flag("foreign") & ~_flag("factual"))
    asks_fact = _flag("factual") | (_flag("famous") & ~_flag("context"))
    return F.coalesce(
        _first(LEXICAL_ORDER),
        math_task(),
        F.when(translation, F.lit("translation_or_bilingual")),
        F.when(asks_fact, _fact_task()),
        _other_task(),
    )


def task_of_category(category: Column) -> Column:
    """Task for a one-letter model category, refined by the cues of the row."""
    return (
        F.when(category == "G", F.lit("bangla_grammar"))
        .when(category == "M", F.coalesce(math_task(), F.lit("math_other")))
        .when(
            category == "I",
            F.coalesce(_first(LEXICAL_ORDER[:1]), F.lit("literal_meaning_null")),
        )
        .when(category == "T", F.lit("translation_or_bilingual"))
        .when(category == "F", _fact_task())
        .otherwise(_other_task())
    )


def merge_tasks(static: Column, model: Column) -> Column:
    """Hybrid routing: cues keep what they are sure of, the model decides the rest.

    The model may not demote a fact into a translation, nor claim a word-meaning,
    grammar or arithmetic task that no cue supports.
    """
    keep_static = (
        static.isin(*policy.LEXICAL_ONLY_TASKS)
        | model.isin("idiom_meaning_null", "literal_meaning_null", "bangla_grammar")
        | ((model == "translation_or_bilingual") & static.isin(*policy.STICKY_FACT_TASKS))
        | (model.isin(*policy.MATH_TASKS) & math_task().isNull())
    )
    return F.when(keep_static, static).otherwise(model)


# --- fixed values: category letters in tie-break order ------------------------------
CATEGORY_LETTERS = ("G", "M", "I", "T", "F", "O")
# --- end of fixed values --------------------------------------------------------------


def best_category(logits: Column) -> Column:
    """Letter with the highest logit (first letter on a tie); "O" without any logit."""
    ranked = F.array(
        *[
            F.struct(
                F.try_element_at(logits, F.lit(letter)).alias("logit"),
                F.lit(-i).alias("first"),
                F.lit(letter).alias("letter"),
            )
            for i, letter in enumerate(CATEGORY_LETTERS)
        ]
    )
    best = F.array_max(F.filter(ranked, lambda r: r["logit"].isNotNull()))
    return F.coalesce(best["letter"], F.lit("O"))
