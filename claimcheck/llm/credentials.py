"""Secrets in texts: sure spans, and weak parts of credentials that complete each other.

Assigned secrets, access keys and long hexadecimal runs are reported wherever they stand.
Weaker parts (a user name, a short password, an opaque string, a key that was cut short, an
endpoint) are reported only in company: an identifier and a secret must lie in one scope, and
an endpoint in the scope of such a pair.  The scope of a part is the block of lines around it
that no blank line divides, up to ``REACH`` code points away.  Parts meet by an interval join:
each is dealt to the bins of the text that it, or its reach, covers.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import stored, table

#: Code points that may lie between two parts of one credential; also the width of a bin.
REACH = 400


def either(word: str) -> str:
    """A pattern of the letters of ``word`` in either case; what follows a backslash is kept."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "([A-Za-z0-9+/_.=-]+)"
#: Kind: role, pattern, group whose length counts, least and most characters.  In order of report.
KINDS: dict[str, tuple[str, str, int, int, int | None]] = {
    "assign": ("secret", f"({either('password|passwd|secret|token|api_?key')}){_SET}{_VALUE}", 2, 12, None),
    "access": ("identifier", "AKIA[A-Z0-9]+", 0, 18, None),
    "hex": ("secret", "[0-9a-f]+", 0, 16, None),
    "id": (
        "identifier",
        f"({either('user_?name|user|login|account|client_?id|access_?key_?id|access_?key|key_?id|app_?id')}){_SET}([A-Za-z0-9+/_.@=-]+)",
        2, 3, None,
    ),
    "short": ("identifier", "AKIA[A-Z0-9]+", 0, 8, 17),
    "weak": (
        "secret",
        f"({either('password|passwd|passphrase|pass|pwd|secret|token|api_?key|private_?key|auth|bearer')}){_SET}{_VALUE}",
        2, 4, None,
    ),
    "endpoint": (
        "endpoint",
        "((https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://"
        f"|({either('host_?name|host|server|endpoint')}){_SET})([A-Za-z0-9._~:/?#@!$&*+,;=%-]+)",
        4, 4, None,
    ),
    "opaque": ("secret", "[A-Za-z0-9+/_=-]+", 0, 20, None),
}
SURE = ("assign", "access", "hex")
#: An opaque string has a character of each of these sets.
MIXED = ("[A-Z]", "[a-z]", "[0-9]")
BREAK = r"\n[\x20\t\r]*\n"
_ORDER = {kind: k for k, kind in enumerate(KINDS)}
_PATTERNS = {kind: re.compile(pattern) for kind, (_, pattern, _, _, _) in KINDS.items()}
# Maximal runs of one set, so a least length in the pattern drops the same matches sooner.
_PATTERNS["hex"], _PATTERNS["opaque"] = re.compile("[0-9a-f]{16,}"), re.compile("[A-Za-z0-9+/_=-]{20,}")
_MIXED = [re.compile(x) for x in MIXED]
_BREAK = re.compile(BREAK)


def matches(text: str, kind: str) -> list[tuple[int, int]]:
    """Leftmost matches of a kind that do not overlap, those of a wrong length dropped."""
    if "AKIA" in KINDS[kind][1] and "AKIA" not in text:
        return []
    _, _, group, least, most = KINDS[kind]
    out = []
    for m in _PATTERNS[kind].finditer(text):
        a, b = m.span(group)
        if b - a >= least and (most is None or b - a <= most):
            out.append(m.span())
    if kind == "opaque":
        out = [(a, b) for a, b in out if all(x.search(text, a, b) for x in _MIXED)]
    return out


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of the taken ones."""
    taken = sorted(taken)
    # The ends of spans of several kinds need not ascend with their starts.
    reach, ends = 0, []
    for _, end in taken:
        reach = max(reach, end)
        ends.append(reach)
    out = []
    for a, b in spans:
        k = bisect.bisect_left(taken, (b, 0))  # those that begin before b
        if not k or ends[k - 1] <= a:
            out.append((a, b))
    return out


def parts(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Sure spans ``(start, kind, end)`` and weak parts ``(start, kind, end, block)``, kinds by number.

    A weak part that overlaps a sure span is dropped, an opaque string also if it overlaps
    another weak part.  The block is the number of blank lines before.
    """
    sure = {kind: matches(text, kind) for kind in SURE}
    taken = [x for spans in sure.values() for x in spans]
    weak = {kind: apart(matches(text, kind), taken) for kind in KINDS if kind not in SURE and kind != "opaque"}
    taken += [x for spans in weak.values() for x in spans]
    weak["opaque"] = apart(matches(text, "opaque"), taken)
    flat = lambda found: sorted((a, _ORDER[kind], b) for kind, spans in found.items() for a, b in spans)
    if not any(weak.values()):
        return flat(sure), []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    own = flat(sure) + flat(weak)
    return flat(sure), [(*x, bisect.bisect_left(breaks, x[0])) for x in own]


_ROLES = [KINDS[kind][0] for kind in KINDS]
_SPAN = "struct<start:int,kind:int,end:int>"
_PART = "struct<start:int,kind:int,end:int,block:int>"
_FOUND = f"doc_id long, sure array<{_SPAN}>, key_a long, key_b long, parts array<{_PART}>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([(x, pa.int32()) for x in ("start", "kind", "end")])
    part = pa.struct([*span, ("block", pa.int32())])
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for value in batch.column("text"):
            text = value.as_py() or ""
            sure, found = parts(text)
            roles = {_ROLES[x[1]] for x in found}
            key = (None, None)
            if roles >= {"identifier", "secret"} and len(found) > len(sure):
                whole = xxhash.xxh3_128_intdigest(text.encode())
                key = (whole >> 64) - 2**63, (whole & (2**64 - 1)) - 2**63
            else:  # nothing here can complete another part
                found = []
            columns[0].append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in sure])
            columns[1].append(key[0])
            columns[2].append(key[1])
            columns[3].append([dict(zip(("start", "kind", "end", "block"), x, strict=True)) for x in found])
        kinds = [pa.list_(span), pa.int64(), pa.int64(), pa.list_(part)]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "sure", "key_a", "key_b", "parts"])


_NAME = ["key_a", "key_b", "block", "start", "kind", "end"]


def near(one: DataFrame, other: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts of ``one`` that have one of ``other`` in their scope, by an interval join.

    Both have ``key_a, key_b, block, start, kind, end``.  Parts in scope do not overlap, share
    key and block, and at most ``reach`` code points lie between them.  Bins are ``reach`` wide,
    so a bin holds a bounded number of parts, whatever the length of the text.
    """
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach))).alias("bin")
    left = one.select(*_NAME, bins(F.col("start") - reach, F.col("end") + reach))
    right = other.select(
        *[F.col(c).alias(f"other_{c}") for c in _NAME], bins(F.col("start"), F.col("end")).alias("other_bin")
    )
    same = [F.col(c) == F.col(f"other_{c}") for c in ("key_a", "key_b", "block", "bin")]
    before = (F.col("other_end") <= F.col("start")) & (F.col("start") - F.col("other_end") <= reach)
    after = (F.col("other_start") >= F.col("end")) & (F.col("other_start") - F.col("end") <= reach)
    return left.join(right, [*same, before | after], "left_semi").select(*_NAME).distinct()


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``key_a, key_b, more``: the weak parts that complete others, for texts that have any."""
    texts = found.where("key_a IS NOT NULL").groupBy("key_a", "key_b").agg(F.first("parts").alias("parts"))
    rows = texts.select("key_a", "key_b", F.explode("parts").alias("p")).select("key_a", "key_b", "p.*").select(*_NAME)
    rows = stored(rows, "credentials-parts")
    of = lambda role: rows.where(F.col("kind").isin([k for k, r in enumerate(_ROLES) if r == role]))
    pairs = near(of("identifier"), of("secret"), reach).union(near(of("secret"), of("identifier"), reach))
    pairs = stored(pairs, "credentials-pairs")
    out = pairs.union(near(of("endpoint"), pairs, reach)).where(F.col("kind") >= len(SURE))
    return out.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, sure, more`` for every row of ``docs``: arrays of ``start, kind, end``, kinds by number.

    Places are code points, ends are exclusive.  Null and empty texts hold nothing.  Each row
    counts, also one whose doc_id is null or repeats; equal texts are joined once.  Other
    columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stored(rows.mapInArrow(_find, _FOUND), "credentials")
    none = F.array().cast(f"array<{_SPAN}>")
    alone = found.where("key_a IS NULL").select("doc_id", "sure", none.alias("more"))
    some = found.where("key_a IS NOT NULL").join(linked(found, reach), ["key_a", "key_b"], "left")
    return alone.union(some.select("doc_id", "sure", F.coalesce("more", none)))


def _told(spans: str):
    kinds = F.array(*[F.lit(x) for x in KINDS])
    line = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: numbers and digest of its sure spans, and all spans."""
    found = secrets(table(spark, sf_dir, "documents")).withColumn("spans", F.concat("sure", "more"))
    count = lambda k: F.size(F.filter("sure", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(SURE)],
        F.sha2(F.encode(_told("sure"), "UTF-8"), 256).alias("base_sha256"),
        _told("spans").alias("spans"),
    )


def _sql_matches(pattern: str, group: int) -> str:
    """All matches of a pattern with their places: the lengths of matches and of what is between add up."""
    quoted = pattern.replace("'", "''")
    return f"""(
    SELECT *, stop - length(whole) AS start FROM (
    SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop FROM (
    SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS whole, unnest(counted) AS part,
      unnest(gaps[1:len(found)]) AS gap
    FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}', 0) AS found,
      regexp_extract_all(text, '{quoted}', {group}) AS counted, string_split_regex(text, '{quoted}') AS gaps FROM texts))))"""


def _sql_spans(kind: str) -> str:
    role, pattern, group, least, most = KINDS[kind]
    held = f"length(part) >= {least}" + (f" AND length(part) <= {most}" if most else "")
    if kind == "opaque":
        held += "".join(f" AND regexp_matches(part, '{x}')" for x in MIXED)
    return f"""
  SELECT doc_id, '{kind}' AS kind, {_ORDER[kind]} AS ord, '{role}' AS role, start, stop AS "end"
  FROM {_sql_matches(pattern, group)} WHERE {held}"""


def oracle() -> str:
    """The query in DuckDB's SQL, with pairs of parts joined by their distance."""
    union = "\n  UNION ALL".join(_sql_spans(kind) for kind in KINDS)
    sure = ", ".join(f"'{kind}'" for kind in SURE)
    close = (
        'a.doc_id = b.doc_id AND a.block = b.block AND (b."end" <= a.start AND a.start - b."end" <= '
        f'{REACH} OR b.start >= a."end" AND b.start - a."end" <= {REACH})'
    )
    over = 'a.doc_id = b.doc_id AND b.start < a."end" AND a.start < b."end"'
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS MATERIALIZED ({union}
), apart AS MATERIALIZED (
  SELECT * FROM spans a WHERE kind IN ({sure}) OR NOT EXISTS (SELECT 1 FROM spans b WHERE {over} AND b.kind IN ({sure}))
), clear AS MATERIALIZED (
  SELECT * FROM apart a WHERE kind <> 'opaque' OR NOT EXISTS (SELECT 1 FROM apart b WHERE {over} AND b.kind <> 'opaque')
), breaks AS MATERIALIZED (
  SELECT doc_id, start FROM {_sql_matches(BREAK, 0)}
), placed AS MATERIALIZED (
  SELECT a.*, (SELECT count(*) FROM breaks b WHERE b.doc_id = a.doc_id AND b.start < a.start) AS block FROM clear a
), pairs AS MATERIALIZED (
  SELECT * FROM placed a WHERE role = 'identifier' AND EXISTS (SELECT 1 FROM placed b WHERE {close} AND b.role = 'secret')
  UNION ALL
  SELECT * FROM placed a WHERE role = 'secret' AND EXISTS (SELECT 1 FROM placed b WHERE {close} AND b.role = 'identifier')
), told AS (
  SELECT * FROM pairs WHERE kind NOT IN ({sure})
  UNION ALL SELECT * FROM placed WHERE kind IN ({sure})
  UNION ALL SELECT * FROM placed a WHERE role = 'endpoint' AND EXISTS (SELECT 1 FROM pairs b WHERE {close})
), lines AS (
  SELECT doc_id, kind, kind || ':' || start || ':' || "end" AS line, start, ord FROM told
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(line, ',' ORDER BY start, ord) FILTER (kind IN ({sure})), '')) AS base_sha256,
  coalesce(string_agg(line, ',' ORDER BY start, ord), '') AS spans
FROM texts LEFT JOIN lines USING (doc_id) GROUP BY doc_id
"""
