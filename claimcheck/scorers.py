"""Pluggable scorers.

A scorer turns input columns into one output column.  ``ColumnScorer`` stays in the JVM;
``BatchScorer`` runs any Python model on Arrow batches.  Both take a mask and work only
where it holds, because a Python UDF inside ``when`` would still see every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck.loading import load_once, model_key
from claimcheck.functions import text as tx
from claimcheck.rules.cues import CuePack

NLI_TYPE = T.StructType(
    [
        T.StructField("p_entail", T.DoubleType()),
        T.StructField("p_contradict", T.DoubleType()),
        T.StructField("p_neutral", T.DoubleType()),
    ]
)


class Scorer(Protocol):
    inputs: tuple[str, ...]
    costly: bool

    def column(self, where: Column) -> Column:
        """Output column, NULL where the mask does not hold."""
        ...


@dataclass(frozen=True)
class ColumnScorer:
    inputs: tuple[str, ...]
    expr: Callable[..., Column]
    costly: bool = False

    def column(self, where: Column) -> Column:
        return F.when(where, self.expr(*[F.col(name) for name in self.inputs]))


def _calls(rows: pd.DataFrame, alike: list[str], most: int | None) -> Iterator[pd.DataFrame]:
    """Rows in the batches that a model is called with."""
    groups = [g for _, g in rows.groupby(alike, sort=False, dropna=False)] if alike else [rows]
    for group in groups:
        size = most or max(1, len(group))
        for at in range(0, len(group), size):
            yield group.iloc[at : at + size]


@dataclass(frozen=True)
class BatchScorer:
    """``load`` builds the model once per worker process and returns a function from a frame
    of the inputs to one value per row (a frame of fields for struct types).

    ``costly`` asks the cascade to spread the masked rows over all tasks first.  A call of the
    model sees at most ``batch_rows`` rows (None: an Arrow batch), and rows of one value of
    the ``alike`` inputs only, such as a budget.
    """

    inputs: tuple[str, ...]
    dtype: T.DataType
    load: Callable[[], Callable[[pd.DataFrame], pd.Series | pd.DataFrame]]
    costly: bool = True
    batch_rows: int | None = None
    alike: tuple[str, ...] = ()

    def column(self, where: Column) -> Column:
        inputs, load, dtype = self.inputs, self.load, self.dtype
        alike, most, key = list(self.alike), self.batch_rows, model_key(self.load)
        is_struct = isinstance(dtype, T.StructType)
        names = dtype.fieldNames() if is_struct else []

        def run(batches):
            model = load_once(key, load)
            for batch in batches:
                wanted = batch["_wanted"].fillna(False).astype(bool)
                if is_struct:
                    out = pd.DataFrame(float("nan"), index=batch.index, columns=names)
                else:
                    out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
                for part in _calls(batch.loc[wanted, list(inputs)], alike, most):
                    out.loc[part.index] = model(part)
                yield out

        run.__annotations__ = {
            "batches": Iterator[pd.DataFrame],
            "return": Iterator[pd.DataFrame] if is_struct else Iterator[pd.Series],
        }
        model_udf = F.pandas_udf(run, dtype).asNondeterministic()
        packed = F.struct(
            where.alias("_wanted"),
            *[F.when(where, F.col(name)).alias(name) for name in inputs],
        )
        # A model call is costly: never let the optimizer evaluate it twice.
        return F.when(where, model_udf(packed))


@dataclass(frozen=True)
class Scorers:
    """The three stages of the cascade, and the optional router model."""

    fast: Scorer
    nli: Scorer
    think: Scorer
    category: Scorer | None = None


# --- built-in lexical scorers: deterministic stand-ins for real models -------------------


# Answers paraphrase, so a word that is found weighs as much as this many that are not.
HIT_WEIGHT = 4


def _with_overlap(
    evidence: Column, response: Column, body: Callable[[Column, Column], Column]
) -> Column:
    """``body(hits, total)``: answer words of two characters and more, found and in all."""
    tokens = tx.long_tokens(F.coalesce(response, F.lit("")), 2)
    hits = tx.token_hits(F.coalesce(evidence, F.lit("")), tokens)
    counts = F.struct(hits.alias("hits"), F.size(tokens).alias("total"))
    return tx.let(counts, lambda c: body(c["hits"], c["total"]))


def lexical_fast(evidence: Column, prompt: Column, response: Column) -> Column:
    """Smoothed weight of answer words found in the evidence, or in the question without any."""

    def score(hits: Column, total: Column) -> Column:
        found = hits * HIT_WEIGHT
        return F.round((found + F.lit(1.0)) / (total - hits + found + F.lit(2.0)), 6)

    return _with_overlap(F.coalesce(tx.present(evidence), prompt), response, score)


def lexical_nli(premise: Column, hypothesis: Column) -> Column:
    def entail(hits: Column, total: Column) -> Column:
        found = hits * HIT_WEIGHT
        share = F.try_divide(found, total - hits + found)
        return F.round(F.coalesce(share, F.lit(0.0)), 6)

    return tx.let(
        _with_overlap(premise, hypothesis, entail),
        lambda e: F.named_struct(
            F.lit("p_entail"),
            e,
            F.lit("p_contradict"),
            F.round((1 - e) * 0.6, 6),
            F.lit("p_neutral"),
            F.round((1 - e) * 0.4, 6),
        ),
    )


def lexical_think(evidence: Column, prompt: Column, response: Column) -> Column:
    """Answer text in the shape a reasoning model gives; undecided when little overlaps."""

    def answer(hits: Column, total: Column) -> Column:
        verdict = (
            F.when(hits * 5 >= total, F.lit("verdict: Faithful"))
            .when(hits * 10 >= total, F.lit("verdict: Hallucinated"))
            .otherwise(F.lit("no decision"))
        )
        found = F.format_string("Found %d of %d words.\n", hits, total)
        return F.concat(found, verdict)

    return _with_overlap(F.coalesce(tx.present(evidence), prompt), response, answer)


def lexical_category(cues: CuePack) -> Callable[[Column, Column], Column]:
    """Category logits from cue hits: a count per letter, with a small prior for "O"."""

    def logits(prompt: Column, response: Column) -> Column:
        question = F.coalesce(prompt, F.lit(""))
        letters = {
            "G": (cues.grammar,),
            "M": (cues.calendar, cues.speed, cues.profit, cues.average, cues.math_other),
            "I": (cues.idiom, cues.literal),
            "T": (cues.translation,),
            "F": (cues.factual, cues.famous),
        }
        entries: list[Column] = []
        for letter, predicates in letters.items():
            total = F.lit(0.0)
            for predicate in predicates:
                total = total + tx.holds(question, predicate).cast("double")
            entries += [F.lit(letter), total]
        foreign = tx.has_word(F.coalesce(response, F.lit("")), cues.foreign_word)
        entries += [F.lit("O"), F.lit(0.5) + foreign.cast("double")]
        return F.create_map(*entries)

    return logits


def lexical_scorers(cues: CuePack) -> Scorers:
    return Scorers(
        fast=ColumnScorer(("context", "prompt_bn", "response_bn"), lexical_fast),
        nli=ColumnScorer(("nli_premise", "nli_hypothesis"), lexical_nli),
        think=ColumnScorer(("context", "prompt_bn", "response_bn"), lexical_think),
        category=ColumnScorer(("prompt_bn", "response_bn"), lexical_category(cues)),
    )


# The same fast and think scores as batch models, to run the Python path.


def _batch_overlap(row_texts: pd.DataFrame) -> list[tuple[int, int]]:
    found = []
    for evidence, prompt, response in row_texts.itertuples(index=False):
        body = evidence or prompt or ""
        tokens = [t for t in (response or "").split() if len(t) >= 2]
        found.append((sum(t in body for t in tokens), len(tokens)))
    return found


def _load_batch_fast() -> Callable[[pd.DataFrame], pd.Series]:
    def score(batch: pd.DataFrame) -> pd.Series:
        # Rounded half up, as Spark does.
        values = [
            math.floor((HIT_WEIGHT * h + 1.0) / (n - h + HIT_WEIGHT * h + 2.0) * 1e6 + 0.5) / 1e6
            for h, n in _batch_overlap(batch)
        ]
        return pd.Series(values, index=batch.index)

    return score


def _load_batch_think() -> Callable[[pd.DataFrame], pd.Series]:
    def score(batch: pd.DataFrame) -> pd.Series:
        texts = []
        for h, n in _batch_overlap(batch):
            verdict = "no decision"
            if h * 5 >= n:
                verdict = "verdict: Faithful"
            elif h * 10 >= n:
                verdict = "verdict: Hallucinated"
            texts.append(f"Found {h} of {n} words.\n{verdict}")
        return pd.Series(texts, index=batch.index)

    return score


def lexical_batch_scorers(cues: CuePack) -> Scorers:
    base = lexical_scorers(cues)
    inputs = ("context", "prompt_bn", "response_bn")
    return Scorers(
        fast=BatchScorer(inputs, T.DoubleType(), _load_batch_fast, costly=False),
        nli=base.nli,
        think=BatchScorer(inputs, T.StringType(), _load_batch_think, costly=True),
        category=base.category,
    )
