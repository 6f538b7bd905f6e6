import pytest
from pyspark.sql import functions as F

from claimcheck.config import RouterConfig
from claimcheck.functions import routing
from claimcheck.operators import route
from claimcheck.operators.clean import clean_claims
from claimcheck.rules.cues import BENGALI
from claimcheck.scorers import BatchScorer, ColumnScorer

FIXTURE = [
    (None, "‘লাঠালাঠি’ শব্দটির সমাস –", "কর্মধারায়", "bangla_grammar"),
    (None, '"জো-হুকুমের দল" এর ভাবার্থ কী?', "আজ্ঞাবহ", "idiom_meaning_null"),
    (None, '"ফ্ল্যাট" এর শাব্দিক অর্থ কী?', "চ্যাপ্টা", "literal_meaning_null"),
    ("কিছু প্রসঙ্গ আছে", "ঢাকায় কে জন্মগ্রহণ করেন?", "কেউ", "context_grounded_fact"),
    (None, "বাংলাদেশের রাজধানী কোনটি?", "ঢাকা", "general_fact_null"),
    (None, "রবীন্দ্রনাথ কবে জন্মগ্রহণ করেন?", "১৮৬১", "famous_bn_fact_null"),
    (None, "একটি গাড়ির গতিবেগ ৬০ কিমি/ঘণ্টায়, দূরত্ব কত?", "১২০", "math_speed_distance"),
    (
        None,
        "কোনো একদিন বুধবার বার হলে, তার ৫১ দিন পরবর্তী দিনটি সপ্তাহের কোন বার হবে?",
        "বৃহস্পতিবার",
        "calendar_arithmetic",
    ),
    (None, "দুই সংখ্যার অনুপাত ৩:৫ হলে…", "১৫", "math_other"),
    (
        None,
        "পারমাণবিক চুল্লিতে তাপ পরিবাহক হিসেবে কোন ধাতু ব্যবহৃত হয়?",
        "সোডিয়াম",
        "general_fact_null",
    ),
    (None, "জাতিসংঘের কোন সংস্থা জনসংখ্যা বিষয়ে কাজ করে?", "UNFPA", "general_fact_null"),
    (None, "গাছ", "tree", "translation_or_bilingual"),
    (None, "term for গাছ", "গাছ", "translation_or_bilingual"),
    ("প্রসঙ্গ", "রবীন্দ্রনাথ কবে?", "১৮৬১", "famous_bn_fact_context"),
    ("প্রসঙ্গ", "রবীন্দ্রনাথ", "হ", "context_grounded_other"),
    (None, "রবীন্দ্রনাথ", "হ", "famous_bn_fact_null"),
    (None, "১০ জন লোক ৫ দিনে করতে পারে", "হ", "math_work_rate"),
    (None, "শুদ্ধ বানান", "হ", "bangla_grammar"),
    (None, "বয়স ৩ গুণ", "হ", "math_other"),
]


def claims(spark, rows):
    data = [(i, c, p, r) for i, (c, p, r) in enumerate(rows)]
    return clean_claims(
        spark.createDataFrame(data, "id long, context string, prompt_bn string, response_bn string")
    )


def test_static_routes(spark):
    df = claims(spark, [row[:3] for row in FIXTURE])
    out = route.route_static(df, RouterConfig(mode="static")).orderBy("id").collect()
    assert [r["task_type"] for r in out] == [row[3] for row in FIXTURE]


def test_cues_are_nfc(spark):
    # Precomposed letters in a text meet the same cue after cleaning.
    df = claims(spark, [(None, "গড়মান কত", "হ")])
    out = route.route_static(df, RouterConfig(mode="static")).first()
    assert out["task_type"] == "math_average"


CATEGORY_CASES = [
    # letter, context, prompt, expected by the model alone, expected in hybrid mode
    ("G", None, "গাছ", "bangla_grammar", "other_null"),
    ("M", None, "গাছ", "math_other", "other_null"),
    ("M", None, "দূরত্ব", "math_speed_distance", "math_speed_distance"),
    ("I", None, "গাছ", "literal_meaning_null", "other_null"),
    ("I", None, "প্রবাদ", "idiom_meaning_null", "idiom_meaning_null"),
    ("T", None, "গাছ", "translation_or_bilingual", "translation_or_bilingual"),
    ("T", None, "গাছ কোন", "translation_or_bilingual", "general_fact_null"),
    ("F", None, "গাছ", "general_fact_null", "general_fact_null"),
    ("F", "প্রসঙ্গ", "গাছ", "context_grounded_fact", "context_grounded_fact"),
    ("F", None, "পদ্মা", "famous_bn_fact_null", "famous_bn_fact_null"),
    ("F", "প্রসঙ্গ", "পদ্মা কোন", "famous_bn_fact_context", "famous_bn_fact_context"),
    ("O", "প্রসঙ্গ", "গাছ কোন", "context_grounded_other", "context_grounded_other"),
    ("O", None, "গাছ কোন", "other_null", "other_null"),
    ("O", None, "সমাস", "other_null", "bangla_grammar"),
]


@pytest.mark.parametrize("mode,expected", [("model", 3), ("hybrid", 4)])
def test_model_routes(spark, mode, expected):
    data = [(i, c, p, "উত্তর", letter) for i, (letter, c, p, *_) in enumerate(CATEGORY_CASES)]
    df = spark.createDataFrame(
        data, "id long, context string, prompt_bn string, response_bn string, letter string"
    )
    scorer = ColumnScorer(("letter",), lambda letter: F.create_map(letter, F.lit(1.0)))
    out = route.route_claims(df, RouterConfig(mode=mode), scorer).orderBy("id").collect()
    assert [r["task_type"] for r in out] == [case[expected] for case in CATEGORY_CASES]


def test_best_category_prefers_the_first_letter_on_ties(spark):
    df = spark.createDataFrame(
        [({"T": 1.0, "G": 1.0},), ({"O": 0.1, "F": 3.0},), ({},)], "l map<string,double>"
    )
    got = [r[0] for r in df.select(routing.best_category(F.col("l"))).collect()]
    assert got == ["G", "F", "O"]


def test_model_sees_only_open_rows(spark, tmp_path):
    """In hybrid mode a row that cues settle never reaches the model."""
    from pyspark.sql import types as T

    folder = str(tmp_path)

    def load():
        def score(batch):
            import os
            import uuid

            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(batch["prompt_bn"]))
            return batch["prompt_bn"].map(lambda p: {"O": 1.0})

        return score

    scorer = BatchScorer(("prompt_bn",), T.MapType(T.StringType(), T.DoubleType()), load)
    df = claims(spark, [(None, "সমাস", "হ"), (None, "গাছ", "হ"), (None, "দূরত্ব", "হ")])
    route.route_claims(df, RouterConfig(mode="hybrid"), scorer).collect()
    seen = {line for f in tmp_path.iterdir() for line in f.read_text().split("\n")}
    assert seen == {"গাছ"}


def test_disagreement_report(spark):
    df = spark.createDataFrame(
        [("a", "b"), ("a", "b"), ("a", "a"), ("c", "b")], "static_task_type string, task_type string"
    )
    rows = [tuple(r) for r in route.router_disagreement(df).collect()]
    assert rows == [("a", "b", 2, 75.0), ("c", "b", 1, 75.0)]


def test_pack_has_all_predicates():
    assert BENGALI.factual[0][0][0].startswith("কত")
