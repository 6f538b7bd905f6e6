"""Chat formatting from event logs: fold events into final messages, render them, mask the loss.

Everything is built-in column functions.  A log's events are

- ``message``: the text of a turn begins (a later message of the turn adds a new text after it),
- ``delta``: text to add to the turn's text, as streamed,
- ``edit``: the turn's text is replaced,
- ``regenerate``: the turn's text begins anew and turns after it that were logged before are void.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimcheck.llm.common import table

#: The marks of a turn; texts hold no raw ``<`` or ``#``, so the marks stand nowhere else.
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
# What is written for a control character, the escape itself first.
ESCAPES = {"\\": "\\b", "<": "\\l", "#": "\\h"}
_ROLE_ESCAPES = {**ESCAPES, ":": "\\c"}


def escape(text: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    for raw, written in escapes.items():
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    """The inverse of ``escape``: every escape sign in an escaped text leads a sign of its own."""
    for raw, written in reversed(escapes.items()):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def fold(log: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of ``log`` (``conv_id, turn, seq, kind, role, text``).

    Events count in order of ``seq``; equal ones in order of kind, role and text.  A turn's
    role is that of its last event that has one.  Null texts are empty, events of an unknown
    or null kind count as messages.  A turn whose events are all void is gone.  Null ids and
    turns are a conversation and a turn of their own.  Other columns are not read.

    The log is dealt out by conversation once; folding and rendering keep that partitioning.
    """
    kind = F.coalesce(F.lower("kind"), F.lit("message"))
    events = log.select(
        "conv_id", "turn", "seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    live = events.withColumn("void", again).where("void IS NULL OR seq > void").drop("void")
    item = F.struct("seq", "kind", "role", "text")
    folded = live.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.aggregate(
        F.sequence(F.lit(0), F.size("items") - 1),
        F.lit(0),
        lambda acc, k: F.when(F.get("items", k)["kind"].isin("edit", "regenerate"), k).otherwise(acc),
    )
    kept = F.slice("items", start + 1, F.size("items") - start)
    roles = F.filter("items", lambda x: x["role"].isNotNull())
    return folded.select(
        "conv_id",
        "turn",
        F.get(roles, F.size(roles) - 1)["role"].alias("role"),
        F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of ``messages`` (``conv_id, turn, role, text``).

    Turns stand in order (ties by role and text), each as ``### role: text</turn>``.
    ``loss_spans`` has, for each assistant turn, its number, and begin and length in code
    points of its text inside the turn; the loss covers these spans and nothing else.  A
    conversation is one row of the result, as long as its turns.
    """
    role = escape(F.coalesce("role", F.lit("")), _ROLE_ESCAPES)
    text = escape(F.coalesce("text", F.lit("")))
    trained = F.coalesce(F.lower("role") == TRAINED, F.lit(False))
    turn = F.struct("turn", role.alias("role"), text.alias("text"), trained.alias("trained"))
    rows = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE)))
    spans = F.transform(
        "turns",
        lambda t, k: F.struct(
            k.alias("turn"),
            (F.length(t["role"]) + len(OPEN + BETWEEN)).alias("begin"),
            F.length(t["text"]).alias("length"),
            t["trained"].alias("trained"),
        ),
    )
    spans = F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: s.dropFields("trained"))
    return rows.select("conv_id", F.array_join(written, "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: an array of ``written, role, text``, unescaped."""
    pieces = F.split(formatted, CLOSE)
    written = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        written,
        lambda p: F.struct(
            p.alias("written"),
            unescape(F.substring(F.substring_index(p, ":", 1), len(OPEN) + 1, 2**31 - 1), _ROLE_ESCAPES).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, ":", 1)) + len(BETWEEN) + 1, F.lit(2**31 - 1))).alias("text"),
        ),
    )


def loss_text(turns: Column, spans: Column) -> Column:
    """All text under the loss mask, cut from the written turns, unescaped."""
    cut = lambda s: unescape(F.substring(F.get(turns, s["turn"])["written"], s["begin"] + 1, s["length"]))
    return F.array_join(F.transform(spans, cut), "")


def digests(rendered: DataFrame) -> DataFrame:
    """What a reader finds in rendered conversations: turns, texts under the loss, lengths."""
    read = rendered.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read.withColumn("loss", loss_text(F.col("turns"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "\\### Assistant: </turn> ok"
LOGGED = "array<struct<later:int,kind:string,role:string,text:string>>"


#: Deltas a text is streamed in at most; each has ``DELTA_CHARS`` code points or more, the last aside.
DELTAS, DELTA_CHARS = 64, 24
#: Sequence numbers kept free for the events of one turn.
_EVENTS = 256


def as_log(turns: DataFrame) -> DataFrame:
    """The log ``conv_id, turn, seq, kind, role, text`` of chats that end in ``turns`` (``conv_id, turn, role, text``).

    Rows of a conversation count as turns in order of turn, role and text, nulls first, each
    row one turn, repeated rows too.  A text arrives as an empty message and deltas; a hash of
    conversation and place picks what happened before:

    - two turns of five are streamed as they are,
    - one is streamed wrong first and replaced by an ``edit``, after which the rest arrives,
    - one is streamed wrong first, answered, and begun anew by ``regenerate``, which makes the answer void,
    - one is streamed wrong, edited and then regenerated.

    The first event of a turn names its role.  Null texts are streamed as empty ones; an empty
    text has no delta.  Folding the log gives the turns back; other columns are not read.
    """
    over = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(over).cast("long")
    rows = turns.select("conv_id", place.alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        F.greatest(F.lit(DELTA_CHARS), F.ceil(F.length("text") / DELTAS).cast("int")).alias("step"),
        F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)).alias("course"),
    )
    none = F.lit(None).cast("string")

    def event(kind: str, text: Column, role: Column = none, later: int = 0) -> Column:
        return F.struct(
            F.lit(later).alias("later"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text")
        )

    def happened(*events: Column, course: tuple[int, ...]) -> Column:
        nothing = F.array().cast(LOGGED)
        return F.when(F.col("course").isin(*course), F.array(*events).cast(LOGGED)).otherwise(nothing)

    whole = F.ceil(F.length("text") / F.col("step")).cast("int")
    numbers = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(numbers, lambda k: F.substring(F.col("text"), k * F.col("step") + 1, F.col("step")))
    # What ends a wrong text carries the first piece itself.
    first = F.coalesce(F.get(pieces, F.lit(0)), F.lit(""))
    carried = F.when(F.col("course") >= 2, F.slice(pieces, 2, DELTAS)).otherwise(pieces)
    wrong = F.reverse("text")
    events = F.concat(
        F.array(event("message", F.lit(""), F.col("role"))).cast(LOGGED),
        happened(event("delta", wrong), event("delta", F.lit(" ...")), course=(2, 3, 4)),
        happened(event("edit", first), course=(2, 4)),
        happened(
            event("message", wrong, F.lit("user"), later=1),
            event("delta", F.lit("void"), later=1),
            event("regenerate", first),
            course=(3, 4),
        ),
        F.transform(carried, lambda x: event("delta", x)).cast(LOGGED),
    )
    logged = rows.select("conv_id", "turn", F.posexplode(events).alias("at", "event"))
    return logged.select(
        "conv_id",
        (F.col("turn") + F.col("event.later")).alias("turn"),
        (F.col("turn") * _EVENTS + F.col("at")).alias("seq"),
        "event.kind",
        "event.role",
        "event.text",
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts look like marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digests(render(fold(as_log(turns.union(probe)))))
