import gzip
import hashlib
import random

from claimcheck.llm import warc
from claimcheck.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest int, payload string, path int"


def member(k, block):
    return warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{k}>"}, block)


def slow(rows):
    """page_id, bytes, digest, type, refers_to."""
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = first.get(data) if len(data) >= 100 and page != first.get(data) else None
        kind = "response" if to is None else "revisit"
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, to))
    return sorted(out, key=repr)


def test_round_trip_of_odd_pages(spark, tmp_path):
    rows = [
        (1, "http://a", "x" * 150), (2, None, "x" * 150), (3, "http://a\r\nWARC-Type: x", "x" * 150), (4, "u", None),
        (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", "x" * 150), (8, "u", "é" * 50),
        (9, "u", "é" * 50), (10, "u", "é" * 49), (11, "u", "é" * 49), (12, "u", "\r\n\r\nWARC/1.1\r\n\r\n\x1f\x8b\x08" * 9),
        (13, "u", "big " * 500_000), (1, "http://a", "x" * 150), (-5, "u", "y" * 100), (0, "u", "y" * 100),
    ]
    pages = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, archive_bytes=400_000)
    records, gaps = warc.read_archives(spark, path)
    assert gaps.collect() == []
    got = sorted((tuple(r) for r in warc.resolved(records).collect()), key=repr)
    assert got == slow(rows)
    empty = scratch_path(spark, "warc-empty")
    warc.write_archives(pages.limit(0), empty)
    assert warc.resolved(warc.read_archives(spark, empty)[0]).collect() == []


def ids(data):
    found = list(warc.salvage(data))
    records = [x[1].headers["WARC-Record-ID"] for x in found if not isinstance(x, warc.Gap)]
    return [int(r.strip("<>").removeprefix("urn:page:")) for r in records], [x for x in found if isinstance(x, warc.Gap)]


def test_salvage_after_damage():
    members = [member(k, bytes([65 + k]) * 300) for k in range(6)]
    whole = b"".join(members)
    assert ids(whole) == (list(range(6)), [])
    at = len(members[0]) + len(members[1])
    broken = bytearray(whole)
    broken[at + 15] ^= 0xFF
    kept, gaps = ids(bytes(broken))
    assert kept == [0, 1, 3, 4, 5]
    assert [(g.offset, g.length) for g in gaps] == [(at, len(members[2]))]
    kept, gaps = ids(whole[: len(whole) - 10])
    assert kept == [0, 1, 2, 3, 4] and gaps[0].offset == len(whole) - len(members[5])
    kept, gaps = ids(b"junk\x1f\x8b\x08junk" + whole + b"tail")
    assert kept == list(range(6)) and [(g.offset, g.length) for g in gaps] == [(0, 11), (11 + len(whole), 4)]
    assert ids(b"") == ([], []) and ids(b"no archive")[1][0].length == 10


def test_salvage_of_plain_records():
    plain = [gzip.decompress(member(k, b"WARC/1.1\r\nnot a record" * 3)) for k in range(4)]
    assert ids(b"".join(plain))[0] == [0, 1, 2, 3]
    short = plain[1][:-30]
    kept, gaps = ids(plain[0] + short + plain[2] + plain[3])
    assert kept == [0, 2, 3] and [(g.offset, g.length) for g in gaps] == [(len(plain[0]), len(short))]
    changed = plain[1].replace(b"not a", b"not A")
    kept, gaps = ids(plain[0] + changed + plain[2])
    assert kept == [0, 2] and gaps[0].reason == "block digest differs" if b"Block-Digest" in changed else True
    assert ids(plain[0] + member(9, b"z") + plain[2])[0] == [0, 9, 2]
    inside = gzip.compress(plain[0] + plain[1][:50])
    kept, gaps = ids(inside + member(7, b"ok"))
    assert kept == [0, 7] and gaps[0].length == len(inside)


def plain_record(k, block, digest):
    headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{k}>"}
    if digest:
        headers["WARC-Block-Digest"] = "sha256:" + hashlib.sha256(block).hexdigest()
    return gzip.decompress(warc.record(headers, block))


def test_records_before_the_damage_of_a_long_member():
    rng = random.Random(3)
    for digest in (True, False):
        for level in (0, 1, 9):
            blocks = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(20, 3000))) for _ in range(50)]
            plain = [plain_record(k, b, digest) for k, b in enumerate(blocks)]
            whole = gzip.compress(b"".join(plain), level)
            kept, gaps = ids(whole[:-200])
            # The last record may be cut off; without a digest one needs a successor.
            assert kept == list(range(len(kept))) and len(kept) >= 48 and len(kept) < 51
            assert [(g.offset, g.length) for g in gaps] == [(0, len(whole) - 200)]
            next_one = member(70, b"sound" * 99)
            broken = bytearray(whole)
            at = len(whole) * 3 // 4
            broken[at : at + 40] = bytes(rng.randrange(256) for _ in range(40))
            kept, gaps = ids(bytes(broken) + next_one)
            assert kept[-1] == 70 and gaps[0].offset == 0
            assert len(set(kept)) == len(kept)
            if digest:
                assert kept[:-1] == sorted(kept[:-1]) and len(kept) >= 30
            for k, record in [(int(x[1].headers["WARC-Record-ID"][10:-1]), x[1]) for x in warc.salvage(bytes(broken)) if not isinstance(x, warc.Gap)]:
                assert record.block == blocks[k]


def test_every_byte_is_in_a_record_or_a_gap():
    rng = random.Random(0)
    # Text that deflate does not store as it is, so a member holds no plain record.
    members = [member(k, bytes(rng.choice(b"abcd") for _ in range(900))) for k in range(5)]
    whole = b"".join(members)
    for _ in range(200):
        broken = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        kept, gaps = ids(bytes(broken))
        assert sum(g.length for g in gaps) == len(whole) - sum(len(members[k]) for k in kept)


def test_a_lost_response_leaves_its_revisits_unresolved(spark):
    rows = [(1, "u", "x" * 150), (2, "u", "x" * 150)]
    path = scratch_path(spark, "warc-lost")
    warc.write_archives(spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA), path)
    records, _ = warc.read_archives(spark, path)
    row = warc.resolved(records.where("type = 'revisit'")).first()
    assert (row.page_id, row.payload_bytes, row.payload_digest, row.refers_to) == (2, None, None, 1)
