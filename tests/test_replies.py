from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import samples
from venuematch import schemas
from venuematch.operators.batch import build_match_index
from venuematch.operators.display import preview_lines, result_badges, result_cards
from venuematch.operators.envelope import envelopes
from venuematch.operators.prompts import build_prompts
from venuematch.operators.replies import parse_replies, parse_strict, reconcile_replies, strip_fences
from venuematch.operators.single import match_one
from venuematch.plans.recommend import match_preferences, recommend_batch, recommend_one, stored_ranker

CARDS = [
    ("v7", "Blue Kiln", "Jayanagar", "Bangalore", "italian", 4.4, 1250, "medium"),
    ("v9", "Green Stair", "Ulsoor", "Bangalore", "italian", 4.2, 980, "medium"),
    ("42", "Forty Two", "Ulsoor", "Bangalore", "italian", None, None, "medium"),
]


def replies(spark, texts):
    cards = f"ARRAY<STRUCT<{schemas.CATALOG.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' INT', ': INT')}>>"
    return spark.createDataFrame(
        [(i, text, CARDS) for i, text in enumerate(texts)], f"pref_id BIGINT, raw_response STRING, candidates {cards}"
    )


def reconcile_one(spark, text):
    return reconcile_replies(replies(spark, [text])).first()


def item(id, **fields):
    return {"id": id, **fields}


def reply(*items, **fields):
    return json.dumps({**fields, "recommendations": list(items)}, ensure_ascii=False)


def test_only_whole_json_texts_are_accepted(spark):
    cases = {
        '{"a":1}': True, ' [1] ': True, '{"a":1} xyz': False, '{"a":1}}': False, '{"a":1}] x': False,
        '{"a":1},{"b":2}': False, '{"a":1}\n{"b":2}': False, "": False, "{'a':1}": False, '{"a":01}': False,
        '{"a":1,}': False, "{ malformed json }": False, '"text"': True, "7": True, '1], [2': False, '{"a":"x\ny"}': False, '{"a":NaN}': False,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "text STRING")
    got = frame.select("text", parse_strict(F.col("text")).isNotNull().alias("ok")).collect()
    assert {r.text: r.ok for r in got} == cases


def test_repeated_keys_keep_the_last(spark):
    row = reconcile_one(spark, '{"recommendations":[{"id":"ghost","id":"v7","rank":5,"rank":2}]}')
    assert [r.restaurant.id for r in row.recommendations] == ["v7"]


def test_fences(spark):
    cases = {
        "```json\n{}\n```": "{}", "  ```\n{}``` ": "{}", "{}": "{}", "```JSON{}\xa0```": "{}", "a ``` b": "a ``` b",
        "```json x": "x", None: None,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "text STRING")
    got = frame.select("text", strip_fences(F.col("text")).alias("body")).collect()
    assert {r.text: r.body for r in got} == cases


def test_top_level_errors(spark):
    texts = ["nope", "[1]", "null", '{"summary":"x"}', '{"recommendations":{"id":"1"}}', '{"recommendations":null}', '{"recommendations":[]}', None]
    got = [r.parse_error for r in parse_replies(replies(spark, texts)).orderBy("pref_id").collect()]
    assert got == ["not_json", "not_object", "not_object", "no_list", "no_list", "no_list", None, "not_json"]


def test_summaries(spark):
    texts = [reply(summary=s) for s in [" fine ", "", "  ", 7, None, ["x"], {"a": 1}]]
    got = [r.summary for r in parse_replies(replies(spark, texts)).orderBy("pref_id").collect()]
    assert got == ["fine"] + [None] * 6


def test_order_and_facts(spark):
    row = reconcile_one(spark, reply(
        item("v9", rank=10, explanation=" Good ", name="Fake", rating=1.0, cost_for_two=1),
        item("v7", rank=5, explanation="Better"),
    ))
    assert [(r.rank, r.restaurant.id, r.restaurant.name, r.restaurant.rating, r.explanation) for r in row.recommendations] == [
        (1, "v7", "Blue Kiln", 4.4, "Better"), (2, "v9", "Green Stair", 4.2, "Good"),
    ]
    assert (row.warnings, row.reply_error) == ([], None)


def test_unknown_ids_become_warnings(spark):
    row = reconcile_one(spark, reply(item("ghost", rank=1), item(" v7 ", rank=2), item(True), item(1.0), item("")))
    assert [r.restaurant.id for r in row.recommendations] == ["v7"]
    assert row.warnings == [f"Hallucinated candidate ID '{x}' dropped." for x in ["ghost", "True", "1.0", ""]]


def test_nothing_valid_is_a_parse_error(spark):
    assert reconcile_one(spark, reply(item("ghost"))).reply_error == "parse"
    assert reconcile_one(spark, reply()).reply_error == "parse"
    assert reconcile_one(spark, "oops").reply_error == "parse"


def test_odd_items_are_skipped(spark):
    row = reconcile_one(spark, reply(3, None, "v7", ["v7"], {"rank": 1}, item(None), item(42)))
    assert [r.restaurant.id for r in row.recommendations] == ["42"]
    assert row.warnings == []


def test_rank_values(spark):
    ranks = [2, 2.7, "2", " 2 ", "+2", "2.5", "x", "", None, True, 1e3, {}, [], "1_0", 10**25, "9" * 30]

    def python_rank(rank):
        try:
            return int(rank) if rank is not None else 9999
        except (ValueError, TypeError):
            return 9999

    texts = [reply(item("42", rank=rank)) for rank in ranks] + [reply(item("42"))]
    rows = parse_replies(replies(spark, texts)).orderBy("pref_id").collect()
    assert [r["items"][0]["rank"] for r in rows] == [min(python_rank(r), 2**63 - 1) for r in ranks] + [9999]


def test_rank_below_one_spoils_the_reply(spark):
    low = [reply(item("v7", rank=1), item("v9", rank=rank)) for rank in [0, -5, False, 0.9, "-1", "0"]]
    texts = [
        *low,
        '{"recommendations":[{"id":"v7","rank":1e999}]}',
        reply(item("ghost", rank=0), item("v9", rank=1)),
    ]
    got = [r.reply_error for r in reconcile_replies(replies(spark, texts)).orderBy("pref_id").collect()]
    assert got == ["rank"] * 7 + [None]


def test_ties_missing_ranks_and_duplicates(spark):
    row = reconcile_one(spark, reply(
        item("v9"), item("v7"), item("42", rank=1), item("v7", explanation=5), item("v7", explanation="x"),
    ))
    assert [(r.rank, r.restaurant.id, r.explanation) for r in row.recommendations] == [
        (1, "42", "Recommended based on your preferences."),
        (2, "v7", "Recommended based on your preferences."),
        (3, "v7", "Recommended based on your preferences."),
        (4, "v7", "x"),
        (5, "v9", "Recommended based on your preferences."),
    ]


def test_prompts(spark):
    venues = [*CARDS[:2], ("r3", 'Quote "Café"\n', "HSR", "Bangalore", "italian", None, 0, "medium"), ("r4", "Nil", "HSR", "Bangalore", "italian", 1.0, None, "medium")]
    prefs = [
        (1, "Bangalore", "medium", "Italian", 4.0, "quiet place"),
        (2, "Bangalore", "medium", "Italian", 0.0, " "),
        (3, "Atlantis", "medium", "Italian", 0.0, None),
    ]
    matched = match_preferences(samples.catalog(spark, venues), samples.preferences(spark, prefs))
    rows = {r.pref_id: r for r in build_prompts(matched, top_k=3).collect()}
    assert set(rows) == {1, 2}
    first, second = json.loads(rows[1].prompt), json.loads(rows[2].prompt)
    assert first == {
        "preferences": {"location": "Bangalore", "budget": "medium", "cuisine": "Italian", "min_rating": 4.0, "additional_preferences": "quiet place"},
        "candidates": [
            {"id": "v7", "name": "Blue Kiln", "cuisine": "italian", "rating": 4.4, "cost_for_two": 1250, "location": "Jayanagar"},
            {"id": "v9", "name": "Green Stair", "cuisine": "italian", "rating": 4.2, "cost_for_two": 980, "location": "Ulsoor"},
        ],
        "request_top_k": 2,
    }
    assert "additional_preferences" not in second["preferences"]
    assert second["request_top_k"] == 3
    tail = [(c["name"], c["rating"], c["cost_for_two"]) for c in second["candidates"][2:]]
    assert tail == [("Nil", 1.0, "N/A"), ('Quote "Café"\n', "N/A", 0)]
    assert "holds 2 entries" in rows[1].system and "holds 3 entries" in rows[2].system


def run_batch(spark, answer):
    """Three preferences (one empty) through the whole job; ``answer`` is the ranker's row for each prompt."""
    prefs = samples.preferences(spark, [
        (1, "Bangalore", "medium", "Italian", 4.0, "nice"),
        (2, "Bangalore", "medium", "Italian", 5.0, None),
        (3, "", "medium", "Italian", 5.0, None),
    ])
    index = build_match_index(samples.catalog(spark, CARDS))

    def ranker(asked):
        rows = [(r.pref_id, *answer) for r in asked.collect()]
        assert [r[0] for r in rows] == [1]
        return spark.createDataFrame(rows, schemas.RESPONSES)

    return {r.pref_id: r for r in recommend_batch(index, prefs, ranker).collect()}


def test_success_and_empty(spark):
    text = reply(item("v7", rank=1, explanation="Fine"), item("v9", rank=2), summary="Top picks.")
    rows = run_batch(spark, (text, None, None, 1234.56))
    assert set(rows) == {1, 2}
    good, empty = rows[1], rows[2]
    assert (good.status, good.summary, good.message, good.warnings) == ("success", "Top picks.", None, [])
    assert [r.restaurant.id for r in good.recommendations] == ["v7", "v9"]
    meta = good.metadata
    assert (meta.candidates_considered, meta.after_budget, meta.returned, meta.top_n) == (3, 2, 2, 30)
    assert (meta.llm_called, meta.llm_latency_ms, meta.error_type) == (True, 1234.6, None)
    assert meta.filters_applied.asDict() == {
        "location": "Bangalore", "budget": "medium", "min_rating": 4.0, "cuisine": "italian", "additional_preferences": "nice",
    }
    assert (empty.status, empty.recommendations, empty.metadata.llm_called) == ("empty", [], False)
    assert empty.message == "No restaurants found. Try a different location or lower your minimum rating."
    assert empty.metadata.candidates_considered == 3


@pytest.fixture(scope="module")
def three_matches(spark):
    """One preference that all three cards match."""
    return match_one(samples.catalog(spark, CARDS), "Bangalore", "medium", "any").cache()


def test_errors(spark, three_matches):
    broken = "We couldn't generate recommendations right now. Please try again."
    unavailable = "Recommendations temporarily unavailable. Please try again."
    odd = "Something went wrong. Please try again."
    cases = [
        (("{ malformed", None, None), broken, True, "LLMParseError", None),
        ((reply(item("ghost")), None, None), broken, True, "LLMParseError", None),
        ((None, "LLMTimeoutError", "timed out"), unavailable, True, "LLMTimeoutError", None),
        ((None, "LLMRateLimitError", None), "Service is busy. Please try again in a moment.", True, "LLMRateLimitError", None),
        ((None, "LLMAPIError", None), unavailable, True, "LLMAPIError", None),
        ((None, "LLMConfigurationError", "no key"), "no key", False, "LLMConfigurationError", None),
        ((None, "OddError", "boom"), odd, False, "Exception", "boom"),
        ((reply(item("v7", rank=0)), None, None), odd, False, "Exception", None),
    ]
    numbers = spark.range(len(cases)).withColumnRenamed("id", "pref_id")
    matched = three_matches.drop("pref_id").crossJoin(numbers)
    answers = [(i, *case[0], 1.0) for i, case in enumerate(cases)]
    rows = {r.pref_id: r for r in envelopes(matched, spark.createDataFrame(answers, schemas.RESPONSES)).collect()}
    for i, (_, message, called, kind, own) in enumerate(cases):
        row = rows[i]
        assert (row.status, row.message, row.recommendations, row.summary) == ("error", message, [], None)
        assert (row.metadata.llm_called, row.metadata.error_type, row.metadata.error) == (called, kind, own)
        assert (row.metadata.candidates_considered, row.metadata.llm_latency_ms) == (None, None)


def test_partial(spark, three_matches):
    text = reply(item("v7"), item("x"))
    row = envelopes(three_matches, spark.createDataFrame([(0, text, None, None, None)], schemas.RESPONSES)).first()
    assert (row.status, len(row.recommendations), len(row.warnings)) == ("partial", 1, 1)


def test_missing_reply_is_an_error(spark, three_matches):
    row = envelopes(three_matches, spark.createDataFrame([], schemas.RESPONSES)).first()
    assert (row.status, row.metadata.error_type) == ("error", "Exception")


def test_pandas_ranker(spark):
    """A scorer of the user's own, run by Spark on batches of prompts."""
    def rank(batches):
        for batch in batches:
            texts = [json.dumps({"recommendations": [{"id": c["id"], "rank": i + 1} for i, c in enumerate(reversed(json.loads(p)["candidates"]))]}) for p in batch["prompt"]]
            yield pd.DataFrame({"pref_id": batch["pref_id"], "raw_response": texts, "error_type": None, "error_message": None, "latency_ms": 1.0})

    prefs = samples.preferences(spark, [(i, "Bangalore", "medium", "any", 4.0, None) for i in range(20)])
    index = build_match_index(samples.catalog(spark, CARDS))
    rows = recommend_batch(index, prefs, lambda asked: asked.mapInPandas(rank, schemas.RESPONSES)).collect()
    assert len(rows) == 20
    assert {tuple(r.restaurant.id for r in row.recommendations) for row in rows} == {("v9", "v7")}


def test_cards_and_badges(spark, three_matches):
    text = reply(item("42", rank=1), item("v7", rank=2))
    done = envelopes(three_matches, spark.createDataFrame([(0, text, None, None, None)], schemas.RESPONSES))
    cards = {r["rank"]: r for r in result_cards(done).collect()}
    assert (cards[1].rating, cards[1].cost, cards[1].place) == ("—", "Price not available", "Ulsoor, Bangalore")
    assert (cards[2].rating, cards[2].cost, cards[2].name) == ("4.4", "₹1250", "Blue Kiln")
    assert result_badges(done).first().badge == "Selected 2 restaurants from 3 matches!"


def test_preview_lines(spark):
    rows = {r.id: r.line for r in preview_lines(samples.catalog(spark, CARDS)).collect()}
    assert rows["v7"] == "Blue Kiln | italian | ★4.4 | ₹1250 | medium"
    assert rows["42"] == "Forty Two | italian | ★N/A | N/A | medium"


def test_recommend_one(spark):
    text = reply(item("v7", rank=1), summary="One.")
    ranker = stored_ranker(spark.createDataFrame([(0, text, None, None, 5.0)], schemas.RESPONSES))
    catalog = samples.catalog(spark, CARDS)
    row = recommend_one(catalog, ranker, location="Bangalore", budget="medium", cuisine="any").first()
    assert (row.status, row.summary, row.metadata.after_budget) == ("success", "One.", 3)
    row = recommend_one(catalog, ranker, location="Pune", budget="medium", cuisine="any").first()
    assert (row.status, row.metadata.llm_called) == ("empty", False)
