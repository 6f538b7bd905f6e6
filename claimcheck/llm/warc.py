"""WARC archives: written one record for each page, read back with salvage of damaged files.

A record is a gzip member of its own.  Pages whose payload another page has already are
revisit records that refer to it.  The reader checks every member and record; where a check
fails it searches for the next member or version line, goes on there and logs the bytes it
had to leave out.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import stored, table
from claimcheck.session import scratch_path

LEAST_SHARED = 100
#: Payload bytes that one archive file is made for.
ARCHIVE_BYTES = 16_000_000
VERSION = b"WARC/1.1\r\n"
_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r?\n")
#: Bytes that a member is unpacked by, and a damaged one.
_SLICE, _STEP = 16_384, 4096
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_ID = "urn:page:"
_NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    """Bytes of a file that belong to no valid record: where, how many, and what failed first."""

    offset: int
    length: int
    reason: str


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member; line ends in header values become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items()]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass")
    return gzip.compress(VERSION + head + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _parse(data: bytes, at: int) -> tuple[Record, int] | str:
    """The record that begins at ``at`` and the place after it, or what is wrong with it."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        return "no version line"
    end = re.compile(rb"\r?\n\r?\n").search(data, line.end() - 1)
    if not end:
        return "header does not end"
    headers: dict[str, str] = {}
    for raw in data[line.end() : end.start()].splitlines():
        name, colon, value = raw.partition(b":")
        if not colon:
            return "header line without a name"
        headers[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    if not (headers.get("WARC-Type") and headers.get("WARC-Record-ID")):
        return "no type or record id"
    size = headers.get("Content-Length", "")
    if not size.isascii() or not size.isdigit():
        return "no content length"
    stop = end.end() + int(size)
    if stop > len(data):
        return "block is cut short"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "block does not end where its length says"
    block = data[end.end() : stop]
    digest = headers.get("WARC-Block-Digest")
    if digest and digest != "sha256:" + hashlib.sha256(block).hexdigest():
        return "block digest differs"
    return Record(headers, block), stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """What the gzip member at ``at`` holds and the place after it, or what is wrong with it."""
    unpack, out, stop = zlib.decompressobj(31), [], at
    view = memoryview(data)
    try:
        # In slices, as what follows the member is copied out of the last of them.
        while not unpack.eof and stop < len(data):
            piece = view[stop : stop + _SLICE]
            out.append(unpack.decompress(piece))
            stop += len(piece)
    except zlib.error as error:
        return f"member is damaged: {error}"
    if not unpack.eof:
        return "member is cut short"
    return b"".join(out), stop - len(unpack.unused_data)


def _plain(data: bytes, base: int) -> Iterator[tuple[int, Record] | Gap]:
    """Records of plain bytes; after a failure the next version line that begins a valid record."""
    at, bad, why = 0, -1, ""
    while at < len(data):
        got = _parse(data, at)
        if not isinstance(got, str):
            if bad >= 0:
                yield Gap(base + bad, at - bad, why)
                bad = -1
            yield base + at, got[0]
            at = got[1]
            continue
        if bad < 0:
            bad, why = at, got
        following = _VERSION_LINE.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad >= 0:
        yield Gap(base + bad, len(data) - bad, why)


def _unpacked(data: bytes, at: int) -> tuple[bytes, list[tuple[int, int]], bool]:
    """What the member at ``at`` gives before its damage, step by step, and whether it was only cut short.

    The steps are places in the file with the bytes that came out up to there.
    """
    unpack, out, marks = zlib.decompressobj(31), [], [(at, 0)]
    got = 0
    for begin in range(at, len(data), _STEP):
        try:
            out.append(unpack.decompress(data[begin : begin + _STEP]))
        except zlib.error:
            # Once more, byte by byte, for what the step gave before its damage.
            unpack = _replayed(data, at, begin)
            for k in range(begin, min(begin + _STEP, len(data))):
                try:
                    out.append(unpack.decompress(data[k : k + 1]))
                except zlib.error:
                    break
                got += len(out[-1])
                marks.append((k + 1, got))
            return b"".join(out), marks, False
        got += len(out[-1])
        marks.append((min(begin + _STEP, len(data)), got))
    return b"".join(out), marks, True


def _replayed(data: bytes, at: int, stop: int) -> zlib._Decompress:
    unpack = zlib.decompressobj(31)
    unpack.decompress(data[at:stop])
    return unpack


def _before_damage(data: bytes, at: int) -> tuple[list[Record], int]:
    """Complete records of the damaged member at ``at``, and the place by which the last had come out.

    The member's own check is lost, so a record counts if it names a digest of its block and
    that is right; one without a digest only if the member is cut short, not damaged, and a
    version line follows the record.
    """
    out, marks, cut = _unpacked(data, at)
    kept: list[Record] = []
    place = end = 0
    while place < len(out):
        got = _parse(out, place)
        if isinstance(got, str):
            following = _VERSION_LINE.search(out, place + 1)
            place = following.start() if following else len(out)
            continue
        place = got[1]
        if "WARC-Block-Digest" in got[0].headers or (cut and _VERSION_LINE.match(out, place)):
            kept.append(got[0])
            end = place
    if not kept:
        return [], at
    begin, have = max((m for m in marks if m[1] < end), default=marks[0])
    unpack = _replayed(data, at, begin)
    while have < end:
        have += len(unpack.decompress(data[begin : begin + 1]))
        begin += 1
    return kept, begin


def salvage(data: bytes) -> Iterator[tuple[int, Record] | Gap]:
    """All records of an archive file with their places, and the gaps between them.

    After a damaged member, plain bytes may be what it stored; a plain record there counts
    only if it names a digest of its block, and that is right.  Gzip members and plain records may follow each other.  The place of a record is the byte
    of the file where it, or its member, begins; a damaged record inside a sound member is a
    gap of the member's length.  What a damaged or cut member gave before its damage is read too
    (``_before_damage``): its records stand at the member's place, its bytes stay a gap.  Empty
    members and an empty file hold nothing.
    """
    at, bad, why, doubt = 0, -1, "", False
    while at < len(data):
        zipped = data.startswith(_MAGIC, at)
        got = _member(data, at) if zipped else _parse(data, at)
        if doubt and not zipped and not isinstance(got, str) and "WARC-Block-Digest" not in got[0].headers:
            got = "no digest after a damaged member"
        if not isinstance(got, str):
            if bad >= 0:
                yield Gap(bad, at - bad, why)
                bad = -1
            doubt = False
            if not zipped:
                yield at, got[0]
            elif got[0]:
                for found in _plain(got[0], 0):
                    if isinstance(found, Gap):
                        yield Gap(at, got[1] - at, found.reason)
                    else:
                        yield at, found[1]
            at = got[1]
            continue
        if bad < 0:
            bad, why = at, got
        doubt = doubt or zipped
        after = at + 1
        if zipped:
            saved, past = _before_damage(data, at)
            yield from ((at, x) for x in saved)
            after = max(after, past)
        member, line = data.find(_MAGIC, after), _VERSION_LINE.search(data, after)
        at = min([x for x in (member, line.start() if line else -1) if x >= 0], default=len(data))
    if bad >= 0:
        yield Gap(bad, len(data) - bad, why)


def with_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: which page each one repeats (null: none).

    Of pages with equal payloads of at least ``LEAST_SHARED`` bytes that with the smallest
    page_id is the response; rows that repeat that id are responses too, and so is a payload
    whose pages all lack an id.  Finding the first shuffles ids and digests; joining it back deals
    every page out by its digest once, payload included.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.length("payload") >= LEAST_SHARED).groupBy("digest")
    first = shared.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = F.when((F.length("payload") >= LEAST_SHARED) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", repeats.alias("refers_to"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block = b"" if refers is not None else payload
            headers = {
                "WARC-Type": "response" if refers is None else "revisit",
                "WARC-Record-ID": f"<{_ID}{'' if page is None else page}>",
                "WARC-Target-URI": url or "",
                "WARC-Payload-Digest": f"sha256:{digest}",
                "WARC-Block-Digest": f"sha256:{digest if refers is None else _NOTHING}",
            }
            if refers is not None:
                headers["WARC-Refers-To"] = f"<{_ID}{refers}>"
            out.append(record(headers, block))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``page_id, url, html`` as archive files under ``path``, on any file system of Spark.

    Each row of the text writer is a record's member; its line end is an empty member, so that
    the files are plain concatenations of members.  A task begins a new file after as many
    records as pages of mean size fill ``archive_bytes``, so no payload is dealt out for it.
    """
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)))).first()[0] or 0
    most = max(1, int(archive_bytes // max(1, mean)))
    members = with_types(pages).mapInArrow(_records, "value binary")
    members = members.select(F.col("value").cast("string").alias("value"))
    line_end = _EMPTY_MEMBER.decode("latin-1")
    writer = members.write.option("encoding", "ISO-8859-1").option("lineSep", line_end)
    writer.option("maxRecordsPerFile", most).text(path)


_READ = (
    "path string, offset long, gap_bytes long, reason string, type string, page_id long, url string, "
    "payload_digest string, refers_to long, block_bytes long, block_digest string"
)


def _number(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(_ID)
    return int(text) if re.fullmatch(r"-?\d{1,19}", text) else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in _READ.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            path, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            rows = []
            for found in salvage(data):
                if isinstance(found, Gap):
                    rows.append((path, found.offset, found.length, found.reason, *[None] * 7))
                    continue
                at, item = found
                h = item.headers
                digest = (h.get("WARC-Payload-Digest") or "").removeprefix("sha256:") or None
                # A digest that the record names has been checked when it was parsed.
                named = (h.get("WARC-Block-Digest") or "").removeprefix("sha256:")
                own = named or hashlib.sha256(item.block).hexdigest()
                refers = _number(h.get("WARC-Refers-To"))
                page, url = _number(h.get("WARC-Record-ID")), h.get("WARC-Target-URI")
                rows.append((path, at, None, None, h.get("WARC-Type"), page, url, digest, refers, len(item.block), own))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records and the quarantined gaps of all archive files under ``path``.

    Records: ``path, offset, type, page_id, url, payload_digest, refers_to, block_bytes,
    block_digest``.  Gaps: ``path, offset, gap_bytes, reason``.  A file is read whole by one
    task, so files should be of bounded size, as ``write_archives`` makes them, and only once:
    what was read, without the payloads, is stored.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    read = stored(files.mapInArrow(_read, _READ), "records")
    records = read.where("gap_bytes IS NULL").drop("gap_bytes", "reason")
    return records, read.where("gap_bytes IS NOT NULL").select("path", "offset", "gap_bytes", "reason")


def resolved(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from records read back.

    Digest and length are those of the bytes read; a revisit has those of the response that it
    refers to, and null where that response is lost or its digest is not the one named.
    """
    responses = records.where("type = 'response'").select(
        "page_id",
        F.col("block_bytes").alias("payload_bytes"),
        F.col("block_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = records.where("type = 'revisit'").select("page_id", "type", "refers_to", "payload_digest")
    full = records.where("type = 'response' AND page_id IS NOT NULL").groupBy(
        F.col("page_id").alias("refers_to"), F.col("block_digest").alias("payload_digest")
    ).agg(F.max("block_bytes").alias("payload_bytes"))
    joined = revisits.join(full.withColumn("sound", F.lit(True)), ["refers_to", "payload_digest"], "left")
    joined = joined.select(
        "page_id",
        "payload_bytes",
        F.when(F.col("sound"), F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
    return responses.unionByName(joined)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records, _ = read_archives(spark, path)
    return resolved(records)
