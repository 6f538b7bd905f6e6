import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimcheck.functions import text as tx
from claimcheck.operators.clean import clean_claims, context_counts, label_counts
from claimcheck.rules.cues import BENGALI


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_clean_text_fixture(spark):
    rows = [
        (None,),
        ("উইন্ডোজে​ ইউনিকোড‌ ভিত্তিক",),
        ("   ",),
        ("[NULL]",),
        ("Null",),
        ("a \u001c b\n\tc ",),
        ("cáfe­",),
    ]
    assert values(spark, tx.clean_text(F.col("t")), rows) == [
        None,
        "উইন্ডোজে ইউনিকোড ভিত্তিক",
        None,
        None,
        None,
        "a b c",
        "cáfe",
    ]
    assert one(spark, tx.clean_text(F.lit(12345))) == "12345"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\0"), max_size=30)))
def test_nfc_and_strip_match_python(spark, texts):
    pairs = [(i, t) for i, t in enumerate(texts + ["é", "ো", "য়", "\x1c x　"])]
    df = spark.createDataFrame(pairs, "i int, t string")
    got = df.select("i", tx.nfc(F.col("t")), tx.strip(F.col("t"))).collect()
    for i, normal, stripped in got:
        assert normal == unicodedata.normalize("NFC", pairs[i][1])
        assert stripped == pairs[i][1].strip()


def test_clean_claims_keeps_literal_answers(spark):
    df = spark.createDataFrame(
        [(1, "None", "q", "None", 1), (2, "ctx", " q ", "a", 0), (3, "nan", "q", "NULL", 0)],
        "id long, context string, prompt_bn string, response_bn string, label int",
    )
    out = clean_claims(df)
    rows = {r["id"]: r for r in out.collect()}
    assert [rows[i]["has_context"] for i in (1, 2, 3)] == [False, True, False]
    assert [rows[i]["response_bn"] for i in (1, 2, 3)] == ["None", "a", None]
    assert context_counts(out).first().asDict() == {
        "n_rows": 3,
        "n_with_context": 1,
        "n_without_context": 2,
    }
    assert [tuple(r) for r in label_counts(out).collect()] == [(0, 2), (1, 1)]


def test_truncate_words(spark):
    rows = [("a  b c",), ("a b c d",), ("",)]
    assert values(spark, tx.truncate_words(F.col("t"), 3), rows) == ["a  b c", "a b c", ""]
    assert values(spark, tx.truncate_words(F.col("t"), 0), rows) == ["a  b c", "a b c d", ""]


def windows_by_hand(text, size, overlap, least):
    parts = text.split()
    out = []
    for no, start in enumerate(range(0, len(parts), max(1, size - overlap))):
        chunk = " ".join(parts[start : start + size])
        if len(chunk) >= least:
            out.append((no, chunk))
    return out


@pytest.mark.parametrize("size,overlap,least", [(4, 1, 1), (3, 3, 5), (220, 50, 50)])
def test_word_windows(spark, size, overlap, least):
    texts = ["", " \n", "one two three four five six seven", " ".join(f"w{i}" for i in range(500))]
    got = values(spark, tx.word_windows(F.col("t"), size, overlap, least), [(t,) for t in texts])
    for text, windows in zip(texts, got, strict=True):
        assert [tuple(w) for w in windows or []] == windows_by_hand(text, size, overlap, least)


def test_date_mentions(spark):
    rows = [("১৯৭১ সালে",), ("1/2 1999",), ("জানুয়ারি",), (None,), ("none",)]
    got = values(spark, tx.mention_count(tx.nfc(F.col("t")), BENGALI.date_or_entity), rows)
    assert got == [2, 2, 1, 0, 0]


def test_quoted_lemma_and_query(spark):
    rows = [('"ab" and “xyz” and «uvw»',), ('" "',), ("none",)]
    assert values(spark, tx.quoted_lemma(F.col("t")), rows) == ["xyz", None, None]
    query = tx.retrieval_query(
        F.col("t"), F.lit("ans"), F.lit("idiom_meaning_null"), "prompt_response"
    )
    assert values(spark, query, rows) == ["xyz", '" " ans', "none ans"]
    plain = tx.retrieval_query(F.col("t"), F.lit("ans"), F.lit("other_null"), "prompt")
    assert values(spark, plain, rows) == [r[0] for r in rows]


PREMISE = "পাহাড়পুর বৌদ্ধ বিহার পাল রাজবংশের দ্বিতীয় রাজা ধর্মপাল নির্মাণ করেন।"


def test_answer_in_premise(spark):
    def check(premise, answer, share=0.3):
        return one(spark, tx.answer_in_premise(F.lit(premise), F.lit(answer), share))

    assert check(PREMISE, "ধর্মপাল") is True
    assert check(PREMISE, "দেবপাল") is False
    assert check("abc def", "*abc*") is True
    assert check("abc def", "zzz abc qqq", 0.4) is False
    assert check("abc def", "zzz abc qqq", 0.3) is True
    assert check("ab cd", "ab xx") is True
    assert check("ab cd", "a b") is False
    assert check("", "abc") is False
    assert check("abc", "x") is False


def test_evidence_irrelevant(spark):
    rows = [("abc xx", "has abc"), ("abc", "nothing"), ("a b", "text"), ("abc", None), ("q", "[NULL]")]
    got = values(
        spark, tx.evidence_irrelevant(F.col("p"), F.col("e")), rows, "p string, e string"
    )
    assert got == [False, True, False, True, True]


def test_nfc_looks_only_at_what_may_change(spark):
    import unicodedata

    from claimcheck.functions import text as tx

    rng = random.Random(3)
    marks = "e\u0301\u0323\u09be\u09c7\u09d7\u1100\u1161\u11a8\uac00\u212b\uf900\u2019\u4e2d\u200b\u0958\U0001d15e"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    # All characters with themselves before them and an e before them.
    texts += ["".join(chr(c) + chr(c) + "e" + chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 256)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = dict(frame.select("id", tx.nfc(F.col("text"))).collect())
    assert found == {k: unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}
    settled = frame.where(~F.col("text").rlike(tx._unsettled())).collect()
    assert all(unicodedata.is_normalized("NFC", r.text) for r in settled) and len(settled) > 100
    plain = spark.createDataFrame([("\u2019\u4e2d\u200b\u00ad\u2014",)], "text string")
    assert plain.where(F.col("text").rlike(tx._unsettled())).count() == 0
