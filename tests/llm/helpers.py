"""Small frames for the operators' edge cases."""

from __future__ import annotations

from collections.abc import Iterable

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
#: Null ids, null, empty, blank and very long texts, repeated rows, ties.
ODD = [
    (1, "one two three four five"),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (None, "no id here"),
    (5, "one two three four five"),
    (5, "one two three four five"),
    (6, "word " * 60_000),
    (7, "é" * 9),
]
ODD_SCHEMA = "doc_id long, text string, component_id string, fingerprint int, bits double, key string, tokens int, mix int, score int"


def odd(spark):
    """The odd rows with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2.0, "k", 3, 4, 5) for r in ODD], ODD_SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def groups(n: int, links: Iterable[tuple[int, int]]) -> list[int]:
    """The smallest member of each one's component."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
