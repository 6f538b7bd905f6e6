import random

import numpy as np

from claimcheck.llm import licenses

from .helpers import SF2, nothing, odd


def slow_held(text, template):
    """Longest common subsequence of all of both."""
    row = [0] * (len(text) + 1)
    for word in template:
        last = 0
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], last + 1 if x == word else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_the_whole_table():
    rng = random.Random(0)
    for _ in range(200):
        template = rng.choices("abcdefgh", k=rng.randrange(4, 25))
        copy = [w for w in template if rng.random() > 0.1]
        if copy and rng.random() < 0.5:
            copy.insert(rng.randrange(len(copy)), "z")
        before = ["x"] * rng.randrange(30)
        text = before + copy + ["y"] * rng.randrange(30)
        held, first, last = licenses.align(text, template, len(before), band=8)
        assert held == slow_held(copy, template)
        if held:
            assert slow_held(text[first : last + 1], template) == held
            assert text[first] in template and text[last] in template


def test_winnowing_keeps_one_hash_of_each_window():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50):
        hashes = rng.integers(0, 20, n).astype(np.uint64)
        for window in (1, 2, 4):
            kept = licenses.winnow(hashes, window).tolist()
            for a in range(max(0, n - window + 1)):
                best = min(hashes[a : a + window])
                assert any(a <= k < a + window and hashes[k] == best for k in kept)


def test_notices_in_texts():
    index = licenses.Index(licenses.TEMPLATES)
    rng = random.Random(1)
    for name, notice in licenses.TEMPLATES.items():
        text = "Some lines before. " + notice.upper().replace(" ", "\n * ") + " And after."
        found = licenses.matches(text, index)
        assert [f[0] for f in found] == [name]
        assert found[0][1] == 1.0 and text[found[0][4] : found[0][5]].lower().startswith(notice.split()[0].lower())
        words = notice.split()
        if len(words) > 20:
            words[rng.randrange(3, len(words) - 3)] = "changed"
            del words[10]
            changed = licenses.matches(" ".join(words), index)
            assert [f[0] for f in changed] == [name] and 0.8 <= changed[0][1] < 1.0
    assert licenses.matches("the license of the version is under the general public", index) == []


def test_every_notice_of_the_table_is_found(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    short = {k: v for k, v in licenses.TEMPLATES.items() if k in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0")}
    want = {(r.doc_id, k) for r in docs.collect() for k, v in short.items() if v in (r.text or "")}
    assert got == want and want


def test_odd_rows(spark):
    assert licenses.scan(odd(spark)).collect() == [] and licenses.scan(nothing(spark)).collect() == []
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, mit), (1, mit), (None, "a " * 50_000 + mit), (3, f"{mit}. {mit}!"), (4, "released under the")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.first_word) for r in got) == [(0, 50_000), (1, 0), (1, 0), (3, 0), (3, 5)]
