"""Texts of values against Python's own."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import functions as F

from tests.test_replies import CARDS, item, replies, reply
from venuematch.functions.python_text import float_text, json_string, string_repr
from venuematch.operators.prompts import build_prompts
from venuematch.operators.replies import parse_replies, reconcile_replies

TEXTS = [
    "", "plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "a\nb\tc\rd", "\b\f\x00\x01\x1f\x7f", "café ₹500", "\x85\xa0\xad",
    "​ ﻿", "\U0001f600 \U000e0001", "　x", "$1 \\1 {}", "\\n",
]


def test_floats(spark):
    pick = random.Random(1)
    numbers = [0.0, -0.0, 1.0, -2.5, 4.35, 0.1, 1e-4, 0.00012, 1.5e-4, 9.9e-5, 1e-5, 123456.789, 1e7, 12345678.5, 1e15, 1234567890123456.0,
               1e16, 1.5e16, 1e22, 1e100, -1e300, 2.2250738585072014e-308, math.inf, -math.inf, math.nan]
    numbers += [round(pick.uniform(-5, 5) * 10.0 ** pick.randrange(-8, 20), pick.randrange(9)) for _ in range(300)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i INT, x DOUBLE")
    got = [r.text for r in frame.select("i", float_text(F.col("x")).alias("text")).orderBy("i").collect()]
    assert got == [repr(x) for x in numbers]


def test_strings(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + [None])], "i INT, t STRING")
    got = frame.select("i", json_string(F.col("t")).alias("j"), string_repr(F.col("t")).alias("r")).orderBy("i").collect()
    assert [(r.j, r.r) for r in got] == [(json.dumps(t, ensure_ascii=False), repr(t)) for t in TEXTS] + [(None, None)]


def test_prompts_are_python_texts(spark):
    schema = replies(spark, ["x"]).schema["candidates"].dataType.simpleString()
    cards = [(*CARDS[0][:1], *t) for t in [("A\"\n\x01", "p\\", "c", "café", 4.0, 100, "low"), ("B", "", "c", "x", None, None, "low"), ("C", "p", "c", "x", 4.35, 0, "low")]]
    rows = [(i, t or "x", "low", "any", x, t or None, cards[: 1 + i % 3]) for i, (t, x) in enumerate(zip(TEXTS, [0.0, 3.5, 4.75, 5.0, 1e-05] * 3))]
    frame = spark.createDataFrame(
        rows, f"pref_id BIGINT, location STRING, budget STRING, cuisine STRING, min_rating DOUBLE, additional_preferences STRING, candidates {schema}"
    )
    got = {r.pref_id: r.prompt for r in build_prompts(frame, top_k=2).collect()}
    for i, location, budget, cuisine, floor, more, listed in rows:
        wishes = {"location": location, "budget": budget, "cuisine": cuisine, "min_rating": floor}
        payload = {
            "preferences": wishes | ({"additional_preferences": more} if more else {}),
            "candidates": [
                {"id": c[0], "name": c[1], "cuisine": c[4], "rating": "N/A" if c[5] is None else c[5],
                 "cost_for_two": "N/A" if c[6] is None else c[6], "location": c[2]}
                for c in listed
            ],
            "request_top_k": min(2, len(listed)),
        }
        assert got[i] == json.dumps(payload, indent=2, ensure_ascii=False)


def test_ids_of_any_shape(spark):
    deep = [1]
    for _ in range(60):
        deep = [deep]
    ids = [["x", 1, None, True, 1.5, 2.0, -0.0, 1e-7, 1e20], {"b": {"a'": [TEXTS]}, "a": []}, [], {}, deep, [[{"z": 1, "a": [False]}]],
           ["v7"], [math.nan, math.inf, -math.inf], math.nan, math.inf, -math.inf, 1e22, 10**25, [10**25], "NaN", ["NaN, Infinity"]]
    texts = [reply(*map(item, ids)), json.dumps({"recommendations": [3, None, "x", item(["v7", {"q": 2}])]}, indent=3)]
    got = reconcile_replies(replies(spark, texts)).orderBy("pref_id").collect()
    warned = lambda values: [f"Hallucinated candidate ID '{str(v).strip()}' dropped." for v in values]
    assert got[0].warnings == warned(ids)
    assert got[1].warnings == warned([["v7", {"q": 2}]])


def test_what_the_reader_takes_beside_json(spark):
    texts = [
        '{"summary":"NaN, Infinity \\\\","recommendations":[{"id":"v7","rank":NaN,"x":-Infinity},{"id":"v9","rank":7, "y": [NaN,Infinity]}]}',
        '{"summary":"\\"NaN","recommendations":NaN}', "NaN", "-Infinity", '{"a":NaN', '{"a":-NaN}', '{"a":+Infinity}', '{"a":NaNa}', '{"a":1NaN}',
        '{NaN:1}', '{"recommendations":[NaN,{"id":"v7"}]}', '{"recommendations":[{"id":"v7","rank":Infinity}]}', '{"summary":NaN,"recommendations":[]}',
    ]

    def expected(text):
        try:
            value = json.loads(text)
        except ValueError:
            return "not_json", None
        if not isinstance(value, dict):
            return "not_object", None
        summary = value.get("summary")
        return None if isinstance(value.get("recommendations"), list) else "no_list", summary if isinstance(summary, str) else None

    got = parse_replies(replies(spark, texts)).orderBy("pref_id").collect()
    assert [(r.parse_error, r.summary) for r in got] == [expected(t) for t in texts]
    first, infinite = (r for r in reconcile_replies(replies(spark, [texts[0], texts[11]])).orderBy("pref_id").collect())
    assert [r.restaurant.id for r in first.recommendations] == ["v9", "v7"] and infinite.reply_error == "rank"


def test_long_texts_are_read_in_one_pass(spark):
    text = json.dumps({"summary": 'x\\"' * 100_000, "recommendations": [item(["y" * 100_000, math.nan])]})
    row = parse_replies(replies(spark, [text])).first()
    assert row.parse_error is None and len(row.summary) == 300_000 and row["items"][0].id == str(["y" * 100_000, math.nan])


def test_plain_texts_are_written_without_formatting(spark):
    """Numbers of the JVM's own text, and those just outside of it; each is written once, so a plan holds few patterns."""
    numbers = [4.1, 0.0, -0.0, 0.001, 0.0009999, 9999999.0, 1e7, 1234567.89012345, 1234567.890123456, 2.0e-3, 0.1 + 0.2, 100.5, -3.25]
    rows = spark.createDataFrame([(x,) for x in numbers], "x DOUBLE").select("x", float_text(F.col("x")).alias("text"))
    assert all(row["text"] == repr(row["x"]) for row in rows.collect())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("format_string(") <= 6
    texts = ["plain", "", 'a "b"', "\\", "\x01", "\x7f", "Café", "tab\t"]
    shown = spark.createDataFrame([(x,) for x in texts], "x STRING").select("x", json_string(F.col("x")).alias("text"))
    assert all(row["text"] == json.dumps(row["x"], ensure_ascii=False) for row in shown.collect())
