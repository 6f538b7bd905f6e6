import gc
import itertools
import tracemalloc
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import toxicity

from .helpers import SF2, nothing, odd


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF2}/documents.parquet")


@pytest.fixture(scope="module")
def chars(docs):
    return toxicity.char_model(docs)


def test_character_counts_cover_all_texts(spark):
    rows = spark.createDataFrame([(1, "Ab c"), (2, None), (3, ""), (4, "É9 9é")], "doc_id long, text string")
    got = {r.gram: r.n for r in rows.select("text").mapInArrow(toxicity._char_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    want = {}
    # One partition may hold any of the rows; edges between texts are one edge either way.
    for text in (" ab c ", " é é "):
        symbols = [toxicity._symbol(c) for c in text]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            want[(a * 28 + b) * 28 + c] = want.get((a * 28 + b) * 28 + c, 0) + 1
    assert {k: got.get(k, 0) for k in want} == want
    model = toxicity.char_model(rows)
    assert np.allclose(np.exp(model).sum(axis=2), 1.0)


@pytest.mark.parametrize("word", ["1d10t", "tr@$h", "st00pid", "b.a.d", "looooser", "m0r0n", "$cum", "p4th3tic"])
def test_decoding_against_all_paths(chars, word):
    channel = toxicity.Channel(chars)
    best = (-np.inf, "")
    for path in itertools.product(*channel._lattice(word)):
        letters = "".join(x for x, _ in path)
        a = b = toxicity._EDGE
        total = sum(c for _, c in path)
        for x in [*letters, " "]:
            c = toxicity._symbol(x)
            total, a, b = total + chars[a][b][c], b, c
        best = max(best, (total, letters))
    assert channel.decode(word) == best[1]


def test_restored_texts(spark, chars):
    channel = toxicity.Channel(chars)
    assert channel.text("an 1d10t in") == "an idiot in"
    assert channel.text("i d i o t !") == "idiot !"
    assert channel.text("tr@sh, TRASH") == "trash trash"
    assert channel.text("plain words. 12 times a b") == "plain words 12 times a b"
    words = ["Plain", "tr@sh", "1d10t,", "aaaah", "x.y.z.w", "12", "***", "ÉTÉ", "idioooot!", "İx", ""]
    assert channel.words(words) == [channel.word(w) for w in words]
    got = {r.doc_id: r.restored for r in toxicity.restored(odd(spark), chars).collect()}
    assert got[2] == got[3] == got[4] == "" and len(got[6].split()) == 60_000


def slow_scores(rows, model):
    channel = toxicity.Channel(model.chars)
    out = []
    for doc, text in rows:
        own = set()
        for word in channel.text(text or "").split(" "):
            own |= toxicity._pieces(word) if word else set()
        for raw in (text or "").split():
            word = channel.word(raw)
            own |= toxicity._pieces(word) if word else set()
        total = model.bias + sum(w for p, w in zip(model.pieces, model.weights, strict=True) if p in own)
        out.append((doc, 1 / (1 + np.exp(-total))))
    return out


def test_scores_against_slow_ones_and_held_out_rows(spark, docs):
    model = toxicity.trained(spark, docs, SF2)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = dict(slow_scores([tuple(r) for r in docs.select("doc_id", "text").limit(300).collect()], model))
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    labels = spark.read.parquet(f"{SF2}/labels.parquet").where(toxicity.held_out()).collect()
    right = sum((got[r.doc_id] >= 0.5) == (r.toxic > 0) for r in labels if r.doc_id in got)
    assert right >= 0.9 * sum(r.doc_id in got for r in labels)
    clean = [r.doc_id for r in labels if r.toxic == 0]
    assert sum(got[k] >= 0.5 for k in clean) <= 0.02 * len(clean)


def test_disguised_words_count(spark):
    texts = [(k, f"der word is {w} here") for k, w in enumerate(["moronic", "calm"] * 40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    probe = ["moronic", "m0r0nic", "m o r o n i c", "m.o.r.o.n.i.c", "MORONIC!!", "morooonic", "calm", ""]
    frame = spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(frame, model).collect()}
    assert [got[k] for k in range(6)] == [True] * 6 and not got[6] and not got[7]


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(odd(spark), labels)
    assert toxicity.score(odd(spark), model).count() == 9
    assert toxicity.score(nothing(spark), model).collect() == []
    kept = toxicity.accepted(odd(spark), model)
    assert kept.schema == odd(spark).schema and toxicity.accepted(nothing(spark), model).collect() == []
    none = toxicity.train(odd(spark), labels.limit(0))
    assert none.pieces == () and {r.score for r in toxicity.score(odd(spark), none).collect()} == {0.5}


def test_a_very_long_word_is_looked_at_once():
    import time

    channel = toxicity.Channel(np.zeros((28, 28, 28)))
    begun = time.time()
    for word in ("ab-" * 350_000, "-" * 1_000_000 + "a", "é" * 1_000_000, "a_" * 500_000):
        assert channel.words([word])
    assert time.time() - begun < 10


def test_characters_are_counted_in_spans():
    """Spans count what the whole step counts, across their borders, with little memory."""
    def counted(texts):
        (out,) = toxicity._char_counts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
        return dict(zip(*(x.to_pylist() for x in out.columns), strict=True))

    texts = ["Some  words, w\u00f6rds \U0001f600 \ud7ff and - -- 12 more", None, "", " a ", "b" * 50, ".", ". , ."] * 9
    whole = counted(texts)
    symbols = [0]
    for char in " " + " ".join(x or "" for x in texts) + " ":
        low = char.lower()
        one = toxicity._symbol(low) if ord(char) < 0x300 else 27
        if one or symbols[-1]:
            symbols.append(one)
    plain = Counter((a * 28 + b) * 28 + c for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
    assert whole == plain
    with pytest.MonkeyPatch.context() as patch:
        for span in (1, 2, 3, 7):
            patch.setattr(toxicity, "SPAN_CHARS", span)
            assert counted(texts) == whole
    text = "some words of a text " * 150_000
    tracemalloc.start()
    counted([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text)


def test_a_channel_ends_with_its_task():
    channel = toxicity.Channel(np.zeros((28, 28, 28)))
    assert channel.word("id10t") == channel.word("id10t")
    gone = weakref.ref(channel)
    gc.disable()
    try:
        del channel
        assert gone() is None
    finally:
        gc.enable()
