import json

from pyspark.sql import functions as F

from claimcheck.functions import parsing
from claimcheck.operators import corpus
from claimcheck.rules.categories import BENGALI
from claimcheck.scorers import ColumnScorer
from claimcheck.sources import corpus as files


def column(spark, rows, expr, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_bucket_words(spark):
    rows = [("bucket: famous_bn",), ("IDIOM",), ("discard this",), ("xgrammarx",), ("huh",), ("none of wiki",)]
    got = column(spark, rows, parsing.parse_bucket(F.col("t")))
    assert got == ["wiki", "idioms", "skip", "grammar", None, "skip"]


def test_model_output(spark):
    raw = "<think>a\nb</think>\n```yaml\nbucket: wiki\nreworded:\n- A fact.\n2. Another\n1971 was\nCategory: x\n```\nInput Text: echo"
    cleaned = parsing.clean_model_output(F.col("t"))
    text = parsing.output_rewording(cleaned, F.lit("orig"))
    df = spark.createDataFrame([(raw,), ("<think>never closed",), ("text: only this�",), ("bucket:skip",)], "t string")
    rows = df.select(
        parsing.output_bucket(cleaned).alias("b"), text.alias("r"), parsing.fact_lines(text).alias("f")
    ).collect()
    assert [r["b"] for r in rows] == ["wiki", None, None, "skip"]
    # A leading year goes with the bullet, as in the published rule.
    assert rows[0]["f"] == ["A fact.", "Another", "was"]
    assert rows[1]["r"] == "orig" and rows[2]["r"] == "only this"


def lines_by_hand(text):
    out = []
    for line in reversed([x.strip() for x in text.split("\n") if x.strip()]):
        if len(line) < 100 and line[-1] not in "।.?":
            out.append(line)
        elif len(out) >= 3:
            break
    return out


def test_category_lines(spark):
    texts = [
        "",
        "one sentence.",
        "a\nb\nc\nlong sentence.\nd",
        "deep\nstop.\nx\ny\nz\nshort stop.\nq",
        "\n".join(["p1.", "c1", "p2.", "c2", "c3", "p3.", "c4"]),
        "x" * 120 + "\nc1\nc2\nc3",
    ]
    got = column(spark, [(t,) for t in texts], corpus.category_lines(F.col("t"), BENGALI))
    assert got == [lines_by_hand(t) for t in texts]


def classify(spark, texts):
    df = spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "title string, text string")
    return corpus.classify_articles(df)


def test_article_categories(spark):
    texts = [
        "প্রবন্ধ।\nবাঙালি কবি\nবাংলাদেশের নদী",
        "প্রবন্ধ।\n১৯৪০-এ জন্ম",
        "নাম (১৯২০ – ১৯৮০) ছিলেন।",
        "এটি ঢাকায় অবস্থিত।",
        "কিছু নয়।",
        "প্রবন্ধ।\nঢাকা বিভাগ",
        "প্রবন্ধ।\nবাংলাদেশের ব্যাংক\nগ্রিক দার্শনিক\nবাঙালি গায়ক",
        "নাম (1920-) ছিলেন।\nবাঙালি কবি",
    ]
    out = classify(spark, texts)
    rows = [r["categories"] for r in out.orderBy("title").collect()]
    assert rows == [
        ["writers_poets", "water_bodies"],
        ["other_people"],
        ["other_people"],
        ["other_places"],
        ["other"],
        ["administrative_units", "government_bodies"],
        ["scientists_scholars", "artists_performers", "companies_businesses"],
        ["writers_poets"],
    ]
    kept = corpus.enabled_articles(out)
    assert kept.where("category = 'other'").count() == 0
    assert corpus.enabled_articles(out, []).where("category = 'other'").count() == 1
    assert corpus.category_metrics(out).first().asDict() == {
        "n_processed": 8,
        "n_kept": 7,
        "n_skipped": 1,
    }
    counts = {r["category"]: r["n_articles"] for r in corpus.category_counts(out).collect()}
    assert counts["writers_poets"] == 2 and counts["other"] == 1


def test_counterparts(spark):
    titles = spark.createDataFrame(
        [("c", "ক"), ("c", "ক"), ("d", "ক"), ("c", "খ"), ("c", "গ"), ("c", "ঘ")], "category string, title string"
    )
    links = spark.createDataFrame(
        [("ক", "Dhaka"), ("খ", "Paris"), ("গ", "Tea"), ("ঙ", "Unused")], "title string, en_title string"
    )
    cats = spark.createDataFrame(
        [("Tea", "Category:Drinks"), ("Tea", "Economy of Bangladesh"), ("Tea", "Bengali food"), ("Paris", "Cities")],
        "en_title string, category string",
    )
    found = corpus.related_pages(corpus.resolve_titles(titles, links), cats)
    assert {(r["category"], r["title"], r["en_title"]) for r in found.collect()} == {
        ("c", "ক", "Dhaka"),
        ("d", "ক", "Dhaka"),
        ("c", "গ", "Tea"),
    }
    pages = spark.createDataFrame(
        [("Dhaka", "x" * 101), ("Dhaka", "x" * 101), ("Tea", " " * 200 + "short")],
        "en_title string, text string",
    )
    out = corpus.counterpart_passages(found, pages).collect()
    assert sorted(r["category"] for r in out) == ["c", "d"]
    assert out[0]["text"] == "Dhaka\n" + "x" * 101


SORT_LINES = [
    (1, '{"text": " first fact. ", "n": 1}'),
    (2, "not json"),
    (3, "[1, 2]"),
    (4, '{"text": "", "passage": "second"}'),
    (5, '{"text": 5}'),
    (6, "   "),
    (7, '{"content": "third"}'),
    (8, '"just text"'),
]


def sorted_rows(spark):
    rows = corpus.read_sort_lines(spark.createDataFrame(SORT_LINES, "line_no long, value string"))
    answer = ColumnScorer(
        ("input_text",),
        lambda t: F.when(t == "third", F.lit("dunno")).otherwise(
            F.concat(F.lit("bucket: wiki\nreworded:\n- "), t, F.lit("\n- more"))
        ),
    )
    return rows, corpus.sort_lines(rows, answer)


def test_sort_job(spark, tmp_path):
    rows, out = sorted_rows(spark)
    errors = {r["line_no"]: (r["input_text"], r["error"]) for r in rows.collect()}
    assert errors == {
        1: ("first fact.", None),
        2: ("not json", "invalid_json"),
        3: ("[1, 2]", "not_object"),
        4: ("second", None),
        5: ("", "missing_text"),
        7: ("third", None),
        8: ('"just text"', "not_object"),
    }
    got = {r["line_no"]: r for r in out.collect()}
    assert {n: r["parsed_bucket"] for n, r in got.items()} == {
        1: "wiki", 2: "skip", 3: "skip", 4: "wiki", 5: "skip", 7: "skip", 8: "skip",
    }
    assert got[1]["facts"] == ["first fact.", "more"] and got[7]["unparsed"]
    assert got[2]["reworded_facts"] == ["not json"] and got[2]["raw_model_output"] == "invalid_json"

    facts = corpus.fact_rows(out).orderBy("_sort_line", "fact_no").collect()
    lines = [(r["_sort_line"], r["bucket"], json.loads(r["line"])) for r in facts]
    assert lines == [
        (1, "wiki", {"text": "first fact.", "n": 1}),
        (1, "wiki", {"text": "more", "n": 1}),
        (2, "skip", {"text": "not json"}),
        (3, "skip", {"text": "[1, 2]"}),
        # The first text key that is present takes the fact, even if it was blank.
        (4, "wiki", {"text": "second", "passage": "second"}),
        (4, "wiki", {"text": "more", "passage": "second"}),
        (5, "skip", {"text": 5}),
        (7, "skip", {"content": "third"}),
        (8, "skip", {"text": '"just text"'}),
    ]
    root = str(tmp_path / "out")
    files.write_buckets(corpus.fact_rows(out), root, annotate=True)
    files.write_buckets(corpus.fact_rows(out), root, append=True)
    back = spark.read.text(root)
    assert back.count() == 18
    noted = [json.loads(r["value"]) for r in back.where("bucket = 'wiki'").collect()]
    assert sum("_sort_line" in n for n in noted) == 4


def test_annotated_lines_do_not_repeat_answers_on_disk(spark, tmp_path):
    """A line of many facts is written once for each, with the model's whole answer."""
    facts = [f"fact {n} {n * n * 7919 % 100003}" for n in range(2000)]
    lines = [(1, json.dumps({"text": "; ".join(facts), "n": 1})), (2, "not json"), (3, "{}")]
    rows = corpus.read_sort_lines(spark.createDataFrame(lines, "line_no long, value string"))
    answer = ColumnScorer(
        ("input_text",),
        lambda t: F.concat(F.lit("bucket: wiki\nreworded:\n- "), F.replace(t, F.lit("; "), F.lit("\n- "))),
    )
    out = corpus.sort_lines(rows, answer)
    root = str(tmp_path / "out")
    files.write_buckets(corpus.fact_rows(out), root, annotate=True)
    back = [json.loads(r["value"]) for r in files.read_buckets(spark, root).where("bucket = 'wiki'").collect()]
    assert sorted(x["text"] for x in back) == sorted(facts)
    whole = "bucket: wiki\nreworded:\n- " + "\n- ".join(facts)
    assert all(x == {"text": x["text"], "n": 1, "_sort_bucket": "wiki", "_sort_line": 1, "_sort_model_output": whole} for x in back)
    rest = files.read_buckets(spark, root).where("bucket = 'skip'")
    assert sorted((r["_sort_line"], r["_sort_model_output"]) for r in (json.loads(x["value"]) for x in rest.collect())) == [
        (2, "invalid_json"), (3, "missing_text"),
    ]
    on_disk = sum(f.stat().st_size for f in (tmp_path / "out").rglob("part-*"))
    assert on_disk < len(facts) * len(whole) / 50


def test_sort_resume(spark):
    rows, out = sorted_rows(spark)
    lines = spark.createDataFrame(SORT_LINES, "line_no long, value string")
    assert sorted(r["line_no"] for r in corpus.read_sort_lines(lines, most=2).collect()) == [1, 2]
    log = corpus.sort_log(out.where("line_no <= 3"))
    left = corpus.unsorted_lines(rows, log)
    assert sorted(r["line_no"] for r in left.collect()) == [4, 5, 7, 8]
    rest = out.where("line_no > 3")
    counts = {r["bucket"]: (r["n"], r["n_unparsed"]) for r in corpus.bucket_counts(rest, log).collect()}
    assert counts == {"wiki": (2, 0), "skip": (5, 1)}
