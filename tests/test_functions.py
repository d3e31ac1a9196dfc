from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from venuematch.config import WHITESPACE, Settings
from venuematch.functions import parsing
from venuematch.functions.numbers import round_exact
from venuematch.functions.text import strip, title_case


def evaluate(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.out for r in frame.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_title_follow_python(spark):
    texts = [
        "  a b ", "　x\xa0", "\x1c\x85tab\t", "", "   ", "tex-mex", "5th avenue", "glen's", "NORTH indian",
        "été à LYON", "a1b2c3", "ünder_score", "中a国b", "o'neill-mc DONALD", "éa",
    ]
    assert evaluate(spark, texts, "STRING", strip) == [t.strip() for t in texts]
    assert evaluate(spark, texts, "STRING", title_case) == [t.title() for t in texts]


def test_round_exact_follows_python(spark):
    pick = random.Random(7)
    values = [2.675, 4.125, 4.675, 2.665, 0.005, 1.005, 5.0, 0.0, 4.35, 0.125, 0.375, 9.995 / 2]
    values += [k / 1000 for k in range(0, 5000, 5)] + [pick.uniform(0, 5) for _ in range(2000)]
    values += [pick.uniform(0, 1e6) for _ in range(500)]
    for digits in (1, 2):
        got = evaluate(spark, values, "DOUBLE", lambda c: round_exact(c, digits))
        assert got == [round(v, digits) for v in values]


@pytest.mark.parametrize("as_type", ["STRING"])
def test_ratings(spark, as_type):
    cases = {
        "4.1/5": 4.1, "4.0/5": 4.0, " 3.9 /5": 3.9, "NEW": None, "new": None, "-": None, "": None, None: None,
        "nan": None, "None": None, "8/10": 4.0, "9.35/10": 4.67, "5": 5.0, "5.01": 2.5, "10": 5.0, "10.1": None,
        "-3": 3.0, "rated 4.25 of 5": 4.25, "4.": 4.0, ".5": 5.0, "4.126": 4.13, "9" * 400: None, "0": 0.0,
    }
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i INT, rate STRING")
    rows = parsing.with_rating(frame, F.col("rate")).orderBy("i").collect()
    assert {r.rate: r.rating for r in rows} == cases


def test_costs(spark):
    cases = {
        "800": 800, "1,200": 1200, "-": None, "": None, None: None, "none": None, "800.0": 8000, "-500": 500,
        "300-500": None, "100000": 100000, "100001": None, "0": 0, "Rs 450 ": 450, "9" * 30: None, "000000000000000000000700": 700,
    }
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i INT, cost STRING")
    rows = parsing.with_cost(frame, F.col("cost")).orderBy("i").collect()
    assert {r.cost: r.cost_for_two for r in rows} == cases


def test_cities(spark):
    cases = {
        "942, 21st Main Road, Banashankari, Bangalore": "Bangalore",
        "Jayanagar, Bengaluru": "Bangalore",
        "Connaught Place, New Delhi": "Delhi",
        "somewhere in delhi": None,
        "Some local road, Banashankari": None,
        "gurugram near MUMBAI": "Gurgaon",
        "Pune Road, Chennai": "Chennai",
        "": None,
        None: None,
    }
    assert evaluate(spark, cases, "STRING", lambda c: parsing.extract_city(F.lower(c))) == list(cases.values())


def test_budget_bands(spark):
    costs = [None, 0, 1, 400, 500, 501, 1500, 1501, 100000]
    want = ["unknown", "unknown", "low", "low", "low", "medium", "medium", "high", "high"]
    assert evaluate(spark, costs, "INT", parsing.budget_band) == want
    own = Settings(budget_low_max=10, budget_medium_max=20)
    assert evaluate(spark, [10, 20, 21], "INT", lambda c: parsing.budget_band(c, own)) == ["low", "medium", "high"]


def test_locations(spark):
    texts = ["bengaluru", " NEW delhi ", "bombay", "mg road", "hsr-layout 2nd", "Gurugram"]
    want = ["Bangalore", "Delhi", "Mumbai", "Mg Road", "Hsr-Layout 2Nd", "Gurgaon"]
    assert evaluate(spark, texts, "STRING", parsing.normalize_location) == want
    assert [parsing.location_target(t) for t in texts] == [w.lower() for w in want]


def test_cuisines_and_free_text(spark):
    assert evaluate(spark, [" North Indian ", "", None, "  "], "STRING", parsing.normalize_cuisine) == [
        "north indian", "unknown", "unknown", "unknown"
    ]
    assert evaluate(spark, [" Any", "*", "ALL ", "thai"], "STRING", parsing.is_any_cuisine) == [True, True, True, False]
    long = "é" * 600
    assert evaluate(spark, [long, " ", None, " x "], "STRING", parsing.free_text) == [long[:500], None, None, "x"]


def test_stable_id(spark):
    import hashlib

    got = spark.range(1).select(
        parsing.stable_id(F.lit("Café"), F.lit("Delhi"), F.lit("CP"), F.lit(12))
    ).first()[0]
    assert got == hashlib.sha256("Café|Delhi|CP|12".encode()).hexdigest()[:16]


def test_settings_must_be_positive():
    with pytest.raises(ValueError):
        Settings(top_n=0)
    assert Settings().effective_top_n(None) == Settings().effective_top_n(-3) == 30
    assert Settings().effective_top_n(7) == 7
