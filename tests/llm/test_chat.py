import random

from claimcheck.llm import chat
from claimcheck.session import plan_text

LOG = "conv_id long, turn long, seq long, kind string, role string, text string, formatted int, turns int"
TURNS = "conv_id long, turn long, role string, text string, loss string, items int, void int"


def slow_fold(rows):
    rows = [(c, t, s, (k or "message").lower(), r, x or "") for c, t, s, k, r, x in rows]
    out = []
    for c, t in {r[:2] for r in rows}:
        voids = [r[2] for r in rows if r[0] == c and r[3] == "regenerate" and r[1] < t]
        own = sorted(r[2:] for r in rows if r[:2] == (c, t) and (not voids or r[2] > max(voids)))
        if not own:
            continue
        text, role = "", None
        for _, kind, r, x in own:
            text = x if kind in ("edit", "regenerate") else text + x
            role = r or role
        out.append((c, t, role, text))
    return sorted(out)


def test_fold_of_random_logs(spark):
    rng = random.Random(5)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "MESSAGE", None]
    rows = []
    for conv in range(60):
        for seq in range(rng.randrange(1, 30)):
            role = rng.choice(["user", "assistant", "assistant"])
            rows.append((conv, rng.randrange(4), seq, rng.choice(kinds), role, rng.choice(["a", "<b>", "", None, "\\#c"])))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], LOG)
    assert sorted(tuple(r) for r in chat.fold(frame).collect()) == slow_fold(rows)


def test_streamed_answer_with_edit_and_regeneration(spark):
    rows = [
        (1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hel"),
        (1, 1, 3, "delta", None, "lo"), (1, 2, 4, "message", "user", "More"), (1, 0, 5, "edit", "user", "Hi there"),
        (1, 1, 6, "regenerate", "assistant", "Bet"), (1, 1, 7, "delta", None, "ter"), (1, 3, 8, "message", "user", "Ok"),
    ]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], LOG)
    got = sorted(tuple(r) for r in chat.fold(frame).collect())
    assert got == [(1, 0, "user", "Hi there"), (1, 1, "assistant", "Better"), (1, 3, "user", "Ok")]


def read_back(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)
    rendered = chat.render(chat.fold(chat.as_log(frame)))
    read = rendered.select("conv_id", "formatted", "loss_spans", chat.parse(rendered["formatted"]).alias("turns"))
    read = read.withColumn("loss", chat.loss_text(read["turns"], read["loss_spans"]))
    return {r.conv_id: r for r in read.collect()}


def test_log_of_finished_turns(spark):
    rng = random.Random(11)
    texts = ["", None, "short", "é😀" * 40, "x" * 23, "y" * 24, "z" * 25, "long <text> # " * 700, "w" * 64 * 24, "v" * 64 * 24 + "u"]
    roles = ["user", "assistant", None, "system"]
    rows = [(conv, t, rng.choice(roles), rng.choice(texts)) for conv in [*range(25), None] for t in [0, 1, 1, 2, None, 3]]
    rows += [(99, 0, "user", "again"), (99, 0, "user", "again"), (98, 5, None, None)]
    log = chat.as_log(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS))
    events = [tuple(r) for r in log.collect()]
    kinds = {r[3] for r in events}
    assert kinds == {"message", "delta", "edit", "regenerate"}
    assert len({r[:1] + r[2:3] for r in events}) == len(events)
    assert len(events) > 3 * len(rows)
    low = lambda x: (x is not None, x)
    want = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), low(r[2]), low(r[3])))
        want += [(conv, k, r[2], r[3] or "") for k, r in enumerate(own, 1)]
    got = [tuple(r) for r in chat.fold(log).collect()]
    order = lambda r: (low(r[0]), r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    # What is shown without folding differs: void turns and wrong texts are in the log.
    assert any(r[3] == "delta" and r[5] == "void" for r in events)
    assert {r[:2] for r in events} > {r[:2] for r in got}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["###", "\\", "<", "</turn>", "\n", ": ", "#", "\\b", "\\l", "é", "😀", "### Assistant: ", "</turn>\n", "x", "$1", "\\Q"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "a:b", "<r>", "\\c"])
            rows.append((conv, turn, role, "".join(rng.choices(bits, k=rng.randrange(12)))))
    got = read_back(spark, rows)
    for conv in range(40):
        own = [r for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == [r[2:] for r in own]
        assert got[conv].loss == "".join(r[3] for r in own if r[2] == "assistant")
        for span in got[conv].loss_spans:
            turn = got[conv].turns[span.turn]
            written = turn.written[span.begin : span.begin + span.length]
            assert turn.written.endswith(written) and "<" not in written and "#" not in written


def test_odd_turns(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (None, 0, "assistant", "lone"),
        (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, None, "user", "first"), (3, 5, "assistant", "a"),
        (4, 0, "assistant", "long " * 200_000),
    ]
    got = read_back(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("assistant", "")]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x")] and got[None].loss == "lone"
    assert [t.text for t in got[3].turns] == ["first", "a", "a", "b"] and got[3].loss == "aab"
    assert len(got[4].loss) == 1_000_000
    empty = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.render(chat.fold(chat.as_log(empty)))).collect() == []


def test_one_shuffle_and_no_python(spark):
    plan = plan_text(chat.op6_chat_formatting(spark, "/root/testdata/sf0.001"))
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and "Python" not in tree and "Arrow" not in tree
