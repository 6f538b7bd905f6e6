import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import automaton
from claimcheck.llm.queries import QUERIES

from .helpers import SF, nothing, odd


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


class SlowAutomaton:
    """States, arcs and failure arcs as dictionaries, walked token by token."""

    def __init__(self, texts, order, mass):
        self.order, self.mass = order, mass
        self.grams = Counter()
        for text in texts:
            row = ["\t", *tokens(text)]
            for i in range(1, len(row)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        self.grams[tuple(row[i - k + 1 : i + 1])] += 1
        self.states = Counter()
        for gram, n in self.grams.items():
            self.states[gram[:-1]] += n
        self.n = sum(n for g, n in self.grams.items() if len(g) == 1)
        self.words = sum(1 for g in self.grams if len(g) == 1)

    def weight(self, state, token):
        if not state:
            return (self.grams[token,] + 0.5) / (self.n + 0.5 * (self.words + 1))
        total = self.states[state]
        lower = self.weight(state[1:], token)
        if self.grams[*state, token]:
            return (self.grams[*state, token] + self.mass * lower) / (total + self.mass)
        return self.mass / (total + self.mass) * lower

    def read(self, text):
        state, total, base = ("\t",)[: self.order - 1], 0.0, 0.0
        for token in tokens(text):
            total += math.log10(self.weight(state, token))
            base += math.log10(self.weight((), token))
            state = (*state, token)[-(self.order - 1) :] if self.order > 1 else ()
        return total, base


def compare(spark, docs, order, mass):
    rows = [(r.doc_id, r.held, r.text) for r in docs.select("doc_id", "held", "text").collect()]
    model = SlowAutomaton([t for _, h, t in rows if not h], order, mass)
    got = sorted(automaton.scores(docs, order, mass).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    rows.sort(key=lambda r: (r[0] is None, r[0], len(tokens(r[2]))))
    assert len(got) == len(rows)
    for r, (doc, held, text) in zip(got, rows, strict=True):
        score, base = model.read(text)
        known = sum(model.grams[t,] > 0 for t in tokens(text))
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known) == (doc, bool(held), len(tokens(text)), known)
        assert r.train_tokens == model.n
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)
    return model


@pytest.mark.parametrize(("order", "mass"), [(1, 5.0), (2, 500.0), (3, 3.0), (4, 1.0)])
def test_against_walking_dictionaries(spark, order, mass, monkeypatch):
    monkeypatch.setattr(automaton, "PART_KEYS", 4000)  # many parts
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900").repartition(3)
    docs = docs.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    compare(spark, docs, order, mass)


def closed_form(block, places, counts, n, texts, words, mass):
    """The same scores without an automaton: counts interpolated, shorter contexts first."""
    seen = [counts[p] for p in places]
    weight = (seen[0] + 0.5) / (n + 0.5 * (words + 1))
    for k in range(2, len(seen) + 1):
        context = np.concatenate([[0.0], seen[k - 2][:-1]])
        if k == 2:
            context[block.place == 0] = texts
        inside = block.place >= k - 2
        context = np.where(inside, context, 0.0)
        weight = (np.where(inside, seen[k - 1], 0.0) + mass * weight) / (context + mass)
    return np.add.reduceat(np.log10(weight), block.firsts)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("few", [0, 3, 10**9])
def test_walk_equals_closed_form(order, few, monkeypatch):
    monkeypatch.setattr(automaton, "FEW", few)
    rng = np.random.default_rng(order)
    sizes = [0, 0, 1, 1, 2, 5, 40, 300, *rng.integers(0, 30, 40)]
    codes = rng.zipf(1.4, sum(sizes)).clip(max=60) - 1
    cells = {
        "ids": np.arange(len(sizes)),
        "marks": (np.arange(len(sizes)) % 3 == 1).astype(np.uint8),
        "offsets": np.concatenate([[0], np.cumsum(sizes)]),
        "codes": codes.astype(np.uint32),
        "hashes": np.array([automaton._hash(f"w{k}") for k in range(60)], dtype=np.uint64),
    }
    block = automaton.Block({k: automaton._packed(v) for k, v in cells.items()}, order)
    distinct, counts, places = block.asked()
    n, texts = int(block.sizes[block.learnt].sum()), int(block.learnt.sum())
    words = int(((distinct & np.uint64(1) == 1) & (counts > 0)).sum())
    args = (places, counts.astype(float), n, texts, words, 7.0)
    base, score, known = block.read(*args)
    assert score == pytest.approx(closed_form(block, *args), rel=1e-12)
    if order == 1:
        assert score == pytest.approx(base, rel=1e-12)
    held = counts[places[0]] == 0
    assert held.any() and (known <= block.sizes).all()
    # Nothing learnt: every arc but those of the empty context is gone.
    blind = block.read(places, counts * 0.0, 0, 0, 0, 7.0)
    assert (blind[1] == 0).all() and (blind[2] == 0).all()


def test_odd_rows(spark):
    docs = odd(spark).withColumn("held", F.col("doc_id") == 7)
    model = compare(spark, docs, 2, 10.0)
    # The weights of a state sum to one, all words unknown to training counted as one.
    for state in ((), ("\t",), ("one",), ("word",), ("nowhere",)):
        seen = [g[0] for g in model.grams if len(g) == 1]
        assert sum(model.weight(state, w) for w in [*seen, "unknown"]) == pytest.approx(1.0)
    empty = nothing(spark).withColumn("held", F.lit(False))
    assert automaton.scores(empty).collect() == []


def test_without_training_texts(spark):
    docs = odd(spark).withColumn("held", F.lit(True))
    rows = automaton.scores(docs).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0.0 for r in rows) and len(rows) == 9


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    rows = QUERIES["op9_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_packed_numbers_come_back():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (automaton._unpacked_keys(automaton._packed_keys(keys)) == keys).all()
    assert len(automaton._unpacked(automaton._packed(np.zeros(0, dtype=np.int64)))) == 0
