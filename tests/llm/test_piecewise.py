import hashlib
import random

from claimcheck.llm import piecewise

from .helpers import ODD, SF, nothing, odd


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_rows(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (doc, text), (_, after) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = (piecewise.fingerprint(x.encode()) for x in (text, edited, after))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        near = piecewise.likeness(own, other), piecewise.likeness(own, following)
        out.append((doc, len(text), digest, own, other, *near))
    return sorted(out, key=repr)


def test_against_a_sorted_list(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    want = slow_rows([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in piecewise.piecewise(docs).collect()), key=repr) == want
    near = [r[5] for r in want if r[1] > 200]
    assert sum(near) / len(near) > 0.6 and sum(r[6] > 0.5 for r in want) < 0.1 * len(want)


def test_odd_rows(spark):
    got = sorted((tuple(r) for r in piecewise.piecewise(odd(spark)).collect()), key=repr)
    assert got == slow_rows(ODD)
    assert piecewise.piecewise(nothing(spark)).collect() == []
    one = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert [r.near_next for r in piecewise.piecewise(one).collect()] == [1.0]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(70))) for _ in range(2))
        assert piecewise.edit_distance(a, b) == slow_distance(a, b)


def test_an_edit_changes_few_chunks():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)).encode()
    other = text[:9000] + b"INSERTED WORDS" + text[9000:]
    assert piecewise.likeness(piecewise.fingerprint(text), piecewise.fingerprint(other)) > 0.9
    assert piecewise.likeness(piecewise.fingerprint(text), piecewise.fingerprint(bytes(reversed(text)))) == 0.0
    block, one, two = piecewise.fingerprint(text).split(":")
    assert int(block) * 64 >= len(text) and 16 <= len(one) <= 128 and len(two) <= len(one)
    assert piecewise.fingerprint(b"") == "3::"


def test_periodic_text_has_chunks_of_bounded_size():
    same = b"na " * 5000
    block, one, _ = piecewise.fingerprint(same).split(":")
    assert len(one) == -(-len(same) // (piecewise.LONGEST * int(block)))
    assert piecewise.likeness(piecewise.fingerprint(same), piecewise.fingerprint(same[:11000] + b"x" * 4000)) > 0.5
