import csv
import json
import random

import pytest

from claimcheck.sources import claims as claim_files
from claimcheck.sources import split

BITS = ["word", '"', "\n", "\r\n", ",", "\\", "{", "}", "[", "]", "é", "😀", " ", "\\n", '\\"', "}]", "a,b"]


@pytest.fixture
def small_ranges(spark):
    """Ranges of few bytes, so that every record lies across an edge somewhere."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def choose(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield choose
    for name, value in old.items():
        spark.conf.set(name, value)


def rows(seed, n):
    rng = random.Random(seed)

    def text():
        return "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 12)))

    return [(k, f"c{text()}c", f"p{text()}p", None if k % 7 == 3 else f"r{text()}r") for k in range(n)]


def as_tuples(frame):
    found = [tuple(r) for r in frame.select("id", "context", "prompt_bn", "response_bn").collect()]
    return sorted(found, key=repr)


@pytest.mark.parametrize("size", [23, 64, 1000, 10_000_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_by_ranges(spark, tmp_path, small_ranges, size, end):
    for part in range(2):
        with open(tmp_path / f"{part}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["id", "context", "prompt_bn", "response_bn"])
            writer.writerows([("" if x is None else x) for x in r] for r in rows(part, 25))
            out.write(end)
    small_ranges(size)
    want = sorted(rows(0, 25) + rows(1, 25), key=repr)
    got = as_tuples(claim_files.read_claims_csv_split(spark, str(tmp_path)))
    assert got == want
    if size == 64:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("size", [23, 64, 1000, 10_000_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_by_ranges(spark, tmp_path, small_ranges, size, indent):
    names = ["id", "context", "prompt_bn", "response_bn"]
    for part in range(2):
        data = [dict(zip(names, r, strict=True)) | {"more": [{"x": {"y": "}"}}, "]"]} for r in rows(part, 25)]
        text = json.dumps(data, ensure_ascii=bool(part), indent=indent)
        (tmp_path / f"{part}.json").write_text(text, encoding="utf-8")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "nothing.json").write_text("")
    small_ranges(size)
    got = as_tuples(claim_files.read_claims_json_split(spark, str(tmp_path)))
    assert got == sorted(rows(0, 25) + rows(1, 25), key=repr)


def test_one_record_over_many_ranges_and_open_quotes(spark, tmp_path, small_ranges):
    long = "x\n" * 400
    (tmp_path / "a.csv").write_text(f'id,context,prompt_bn,response_bn\n1,"{long}",p,r\n\n2,c,p,"never\nclosed\n')
    small_ranges(50)
    got = sorted(r["record"] for r in split.csv_records(spark, str(tmp_path / "a.csv")).collect())
    assert got == [f'1,"{long}",p,r', '2,c,p,"never\nclosed']


def test_text_is_dealt_out_by_range_once(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("id,context,prompt_bn,response_bn\n" + "1,c,p,r\n" * 50)
    small_ranges(64)
    frame = claim_files.read_claims_csv_split(spark, str(tmp_path / "a.csv"))
    assert len(frame.collect()) == 50
    final = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Both halves of the union read one exchange of the text.
    assert final.count("FileScan text") == 1 and "ReusedExchange" in final
