import hashlib
import zlib

import numpy as np
import pytest

from claimcheck.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key_a int, place int, run string, rep int"


def read(rows):
    """Turns of each conversation in order, nulls as empty."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    return {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def slow(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = {x for x in members if x[:-1] == node and x}
        inner = {x[:-1] for x in members if x}
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        out.append(
            (
                min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids),
                sum(x not in inner for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)


def made(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        same = rng.integers(0, 3)
        for t in range(int(rng.integers(0, 9))):
            text = ["hello", "hé", "", None, f"only {c}"][rng.integers(0, 5) if t > same else same]
            rows.append((c if rng.integers(0, 40) else None, t if rng.integers(0, 9) else None, ["user", None][rng.integers(0, 2) if t > 2 else 0], text))
    return rows + rows[:5]


def test_rebuilt_conversations_against_all_nodes(spark, tmp_path):
    rows = made(330, 4)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = trie.op12_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == slow(rebuilt(read(rows)))


@pytest.mark.parametrize("run", [1, 2, 5, 4096])
def test_runs_of_any_length_give_the_same_trie(spark, run):
    rows = made(40, 5)
    rows += [(900 + c, t, "user", "same" if t < 20 + c // 2 else f"end {c}") for c in range(6) for t in range(25)]
    steps = trie.placed(frame(spark, rows), run)
    ids = frame(spark, rows).where("conv_id IS NOT NULL").select("conv_id").distinct()
    found = trie.prefix_trie(steps, ids.union(spark.createDataFrame([(5000,)], "conv_id long")), run).collect()
    assert sorted((tuple(r) for r in found), key=repr) == slow({**read(rows), 5000: []})


def test_turn_orders_and_places(spark):
    rows = [(1, 5, "b", "x"), (1, None, "z", "first"), (1, 5, "a", "y"), (1, -3, "q", None), (1, 5, "a", "y"), (None, 1, "a", "b")]
    found = {r.place: r.chars for r in trie.placed(frame(spark, rows), 2).collect()}
    assert found == {1: 5, 2: 0, 3: 1, 4: 1, 5: 1}


def test_no_conversation_and_only_empty_ones(spark):
    none = frame(spark, [])
    steps, ids = trie.placed(none), none.select("conv_id")
    assert trie.prefix_trie(steps, ids).collect() == []
    two = spark.createDataFrame([(3,), (2,)], "conv_id long")
    assert [tuple(r) for r in trie.prefix_trie(steps, two).collect()] == slow({3: [], 2: []})


def test_very_long_text_and_conversation(spark):
    rows = [(1, t, "user", "w" * 300_000 if t == 0 else "x") for t in range(1500)] + [(2, 0, "user", "w" * 300_000)]
    found = trie.prefix_trie(trie.placed(frame(spark, rows), 100), spark.range(1, 3).withColumnRenamed("id", "conv_id"), 100)
    facts = {r.depth: r for r in found.collect()}
    assert len(facts) == 1501 and facts[0].saved_tokens == facts[1].saved_tokens == 300_000
    assert facts[2].saved_tokens == 0 and facts[0].n_leaves == 1 and facts[1].n_convs == 2


def test_lists_of_ends_in_parts(spark):
    ends = spark.range(0, 1000, 3).selectExpr("id AS conv_id", "id % 2 AS depth", "7L AS key_a", "id % 2 AS key_b")
    found = {r.depth: r.ends_sha256 for r in trie.end_digests(ends, 50).collect()}
    for d in (0, 1):
        told = ",".join(str(c) for c in range(0, 1000, 3) if c % 2 == d)
        assert found[d] == hashlib.sha256(told.encode()).hexdigest()
