"""Records of CSV files and JSON arrays, read by ranges of one file.

Spark's text reader cuts a file into ranges and its pieces at a separator; whether a separator
ends a record depends on all that stands before it.  So a first pass sums up each range: the
parity of its quotes, and how far brackets open in it for either state it may begin in.  A
prefix over the ranges of a file, one small row each, tells in which state each range begins
and which record is open there.  The second pass needs nothing but its range and that row; only
records that lie across an edge are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimcheck.session import materialize

_RANGE = ["file", "block"]


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _pieces(spark: SparkSession, path: str, separator: str, brackets: bool) -> DataFrame:
    """``file, block, at, value, flips, opened, opened_inside``: what stands between separators.

    ``flips`` is the number of quotes; the other two say how much deeper brackets are after the
    piece and its separator if it begins outside a string, or inside one.
    """
    pieces = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    if not brackets:
        none = F.lit(0).cast("long")
        return pieces.select(
            "*", _count(F.col("value"), '"').alias("flips"), none.alias("opened"), none.alias("opened_inside")
        )
    plain = F.regexp_replace("value", r"\\[\s\S]", "")
    pieces = pieces.withColumn("plain", plain).withColumn("flips", _count(F.col("plain"), '"'))

    def deeper(inside: int) -> Column:
        text = F.concat(F.lit('"' * inside), F.col("plain"))
        outside = F.regexp_replace(text, '"[^"]*("|$)', "")
        ends_inside = F.pmod(F.col("flips") + inside, F.lit(2)) == 1
        opened = _count(outside, "{") + _count(outside, "[") - _count(outside, "}") - _count(outside, "]")
        return (opened - F.when(ends_inside, 0).otherwise(1)).cast("long")

    return pieces.select(
        "file", "block", "at", "value", "flips", deeper(0).alias("opened"), deeper(1).alias("opened_inside")
    )


def _ends(pieces: DataFrame, depth: int) -> DataFrame:
    """``pieces`` with ``ends`` (a record ends here) from the state in which their range begins."""
    upto = Window.partitionBy(*_RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    after = F.pmod(F.col("quoted") + F.sum("flips").over(upto), F.lit(2))
    before = F.pmod(F.col("after") + F.col("flips"), F.lit(2))
    opened = F.when(F.col("before") == 0, F.col("opened")).otherwise(F.col("opened_inside"))
    level = F.col("level") + F.sum("step").over(upto)
    return (
        pieces.withColumn("after", after)
        .withColumn("before", before)
        .withColumn("step", opened)
        .withColumn("ends", (F.col("after") == 0) & (level == depth))
        .drop("after", "before", "step", "opened", "opened_inside", "flips")
    )


def ranges(pieces: DataFrame, depth: int) -> DataFrame:
    """One row for each range: the state in which it begins, its records, and which is open at its begin.

    ``quoted`` and ``level`` are the state, ``n_ends`` the records that end in the range;
    ``owner`` and ``owned`` name the record that is open when the range begins by the range in
    which it began and its number there.
    """
    facts = pieces.drop("value")
    upto = Window.partitionBy(*_RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.pmod(F.sum("flips").over(upto) - F.col("flips"), F.lit(2)) == 1
    either = facts.withColumn("inside", inside).groupBy(*_RANGE).agg(
        F.pmod(F.sum("flips"), F.lit(2)).alias("turned"),
        F.sum(F.when(F.col("inside"), F.col("opened_inside")).otherwise(F.col("opened"))).alias("opened"),
        F.sum(F.when(F.col("inside"), F.col("opened")).otherwise(F.col("opened_inside"))).alias("opened_inside"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.pmod(F.coalesce(F.sum("turned").over(earlier), F.lit(0)), F.lit(2))
    step = F.when(F.col("quoted") == 0, F.col("opened")).otherwise(F.col("opened_inside"))
    begins = (
        either.withColumn("quoted", quoted)
        .withColumn("step", step)
        .withColumn("level", F.coalesce(F.sum("step").over(earlier), F.lit(0)))
        .select(*_RANGE, "quoted", "level")
    )
    counted = _ends(facts.join(begins, _RANGE), depth).groupBy(*_RANGE, "quoted", "level")
    counted = counted.agg(F.count_if("ends").alias("n_ends"))
    last = F.last(F.when(F.col("n_ends") > 0, F.struct("block", "n_ends")), ignorenulls=True).over(earlier)
    whole = Window.partitionBy("file")
    return counted.withColumn("last", last).select(
        *_RANGE,
        "quoted",
        "level",
        "n_ends",
        F.coalesce(F.col("last.block"), F.min("block").over(whole)).alias("owner"),
        F.coalesce(F.col("last.n_ends"), F.lit(0)).cast("long").alias("owned"),
    )


def _records(spark: SparkSession, path: str, separator: str, brackets: bool) -> DataFrame:
    """``file, block, number, record, ended``: all records with the range and place where they begin.

    The row of a range is stored when this is called; the records are not.
    """
    depth = 1 if brackets else 0
    pieces = _pieces(spark, path, separator, brackets)
    states = materialize(ranges(pieces, depth), "ranges")
    before = Window.partitionBy(*_RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = _ends(pieces.join(states, _RANGE), depth).withColumn(
        "number", F.coalesce(F.count_if("ends").over(before), F.lit(0)).cast("long")
    )
    listed = F.sort_array(F.collect_list(F.struct("at", "value")))
    # A range's rows are together after the windows, so this deals nothing out again.
    parts = placed.groupBy(*_RANGE, "number", "n_ends", "owner", "owned").agg(
        F.array_join(F.transform(listed, lambda x: x["value"]), separator).alias("text"),
        F.bool_or("ends").alias("ended"),
    )
    at_edge = (F.col("number") == 0) | (F.col("number") == F.col("n_ends"))
    inner = parts.where(~at_edge).select(*_RANGE, "number", F.col("text").alias("record"), "ended")
    head = F.col("number") == 0
    in_order = F.sort_array(F.collect_list(F.struct("part", "text")))
    edges = (
        parts.where(at_edge)
        .select(
            "file",
            F.when(head, F.col("owner")).otherwise(F.col("block")).alias("begin"),
            F.when(head, F.col("owned")).otherwise(F.col("number")).alias("number"),
            F.col("block").alias("part"),
            "text",
            "ended",
        )
        .groupBy("file", F.col("begin").alias("block"), "number")
        .agg(
            F.array_join(F.transform(in_order, lambda x: x["text"]), separator).alias("record"),
            F.bool_or("ended").alias("ended"),
        )
    )
    return inner.unionByName(edges)


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``record``: the records of CSV files, whatever line breaks their quoted fields hold.

    Quotes stand around fields and doubled inside them, nowhere else; files that have single
    quotes inside bare fields belong to the plain reader.  The first record of each file is its
    header.  Blank lines are no records; what follows a quote that is never closed is one.
    """
    records = _records(spark, path, "\n", brackets=False)
    if header:
        # A file's first range begins at its first byte.
        records = records.where("block <> 0 OR number <> 0")
    return records.select(F.regexp_replace("record", "\r$", "").alias("record")).where("trim(record) <> ''")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the objects of JSON arrays, one array a file, written in one line or in many.

    Elements that are no objects are left out.  Objects of a file that is cut short count as far
    as they are complete, but for a last bracket.
    """
    records = _records(spark, path, "}", brackets=True).where("ended")
    return records.select(F.concat(F.regexp_replace("record", r"^[^{]*", ""), F.lit("}")).alias("record"))
