import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from claimcheck.llm import packing

from .helpers import ODD, SF, nothing, odd

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def slow_pieces(rows):
    out = []
    for doc, text in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            out.append((doc, n, at, len(part), crc))
    return sorted(out, key=repr)


def check_places(rows):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.packed(docs).collect()
    want = slow_pieces([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == want
    used, least = check_places(rows), -(-sum(r.length for r in rows) // 2048)
    assert used <= least + 2


def test_odd_rows(spark):
    rows = packing.packed(odd(spark)).collect()
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == slow_pieces(ODD)
    check_places(rows)
    assert packing.packed(nothing(spark)).collect() == []


def test_special_strings_and_spaces(spark):
    texts = [
        "a<|endoftext|>b <|startoftext|> don't WE'LL x", "<|startoftext|>", "nb sp   line\x1cfile \x85 é",
        "tab\tnew\nform\x0cfeed", "1234 !!! ...a.b", "﻿​ zero", "漢字 かな 한글 😀😀", "İstanbul ſ K",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r) for r in packing.pieces(docs).collect()), key=repr)
    assert got == slow_pieces(list(enumerate(texts)))


def test_the_memory_of_words_is_bounded():
    import pyarrow as pa

    own = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER), remembered=10)
    for k in range(20):
        text = " ".join(f"word{k} part{j}" for j in range(8))
        ids, _ = own.encode(pa.array([text]))
        assert ids.tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        assert len(own.new.number) <= 30 and len(own.old.number) <= 30


def test_words_of_every_kind_have_the_tokenizers_ids():
    import pyarrow as pa

    rng = random.Random(9)
    signs = "'aZé\u00df\u0130\u017f\u00aa\u00b2\u00d7\u0301.,-_!`{|}~<>@[]^\\9²ñÿĀ\u4e2d\u0e01\u200b\ufeff\u3000\u00a0😀"
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 6))) for _ in range(20_000)]
    words += ["don't", "we'll.", "<|endoftext|>", "end<|endoftext|>", "<|startoftext|>x", "Ünïcode,", "a" * 5000, "a." * 3000]
    own = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    ids, _ = own.encode(pa.array([" ".join(words)]))
    assert ids.tolist() == [x for w in words for x in TOKENIZER.encode(w, add_special_tokens=False).ids]


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_every_capacity_holds(measure):
    rng = np.random.default_rng(0)
    needs = np.stack([rng.integers(1, 100, 400), np.ones(400), rng.integers(1, 500, 400)], axis=1)
    capacities = (100, 4, 900)
    bins = packing.best_fit(needs, capacities, measure=measure)
    sums = np.zeros((bins.max() + 1, 3))
    np.add.at(sums, bins, needs)
    assert (sums <= np.array(capacities) + 1e-6).all()
    least = max(np.ceil(needs.sum(axis=0) / capacities))
    assert bins.max() + 1 <= 1.15 * least
    with pytest.raises(ValueError):
        packing.best_fit(np.array([[101, 1, 1]]), capacities)
    assert len(packing.best_fit(np.zeros((0, 3)), capacities)) == 0


def test_packed_keeps_capacities_that_bind(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(50)], "doc_id long, text string")
    got = packing.packed(docs, capacities=(2048, 2, 400)).collect()
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append(r.length)
    assert len(got) == 50
    assert all(len(x) <= 2 and sum(n * n for n in x) <= 400 for x in full.values())
    assert len({r.sequence_id for r in packing.packed(docs).collect()}) == 1 < len(full)


def test_pieces_are_merged_once_for_all_their_words():
    words = ["Haus", "haus,", "HAUS.", "haus", "Über,", "über.", "x!?", "É", "é!?", "ÿ.", "ß,", "don't", "a1", "×"]
    found = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    seen, pieces = [], found._pieces
    found._pieces = lambda part: (seen.extend(part), pieces(part))[1]
    numbers = found.known(words)
    ids, sizes = found.new.ids_of(numbers)
    assert len(seen) == len(set(seen)) and {"haus", "über", ",", "!?"} <= set(seen)
    want = [TOKENIZER.encode(w, add_special_tokens=False).ids for w in words]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert found.known([]).tolist() == []


def test_a_worker_holds_no_words_after_its_task():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["held words", None])], ["doc_id", "text"])
    cut = packing._cutter(packing.TOKENIZER, packing.SEQUENCE, packing.CLOSING_ID)
    own = packing.word_tokenizer(packing.TOKENIZER)
    assert sum(x.num_rows for x in cut(iter([batch]))) == 2
    assert not own.new.number and not own.old.number
    stopped = cut(iter([batch, batch]))
    next(stopped)
    assert own.new.number
    stopped.close()
    assert not own.new.number and packing.word_tokenizer(packing.TOKENIZER) is own


def test_words_that_are_forgotten_are_learned_again():
    import pyarrow as pa

    own = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    first, _ = own.encode(pa.array(["Some words, twice"]))
    own.forget()
    assert not own.new.number and not own.old.number
    assert own.encode(pa.array(["Some words, twice"]))[0].tolist() == first.tolist()
