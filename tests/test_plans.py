"""What the plans must and must not contain."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tests import samples
from venuematch.operators.batch import build_match_index, match_batch, match_lookup
from venuematch.operators.display import result_badges, result_cards
from venuematch.operators.envelope import envelopes
from venuematch.operators.preferences import check_preferences, valid_preferences
from venuematch.operators.replies import reconcile_replies
from venuematch.operators.single import top_candidates
from venuematch.plans.catalog import build_catalog
from venuematch.sources import snapshot


def plan(frame) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


PYTHON_NODES = ("EvalPython", "InPandas", "InArrow")


def exchanges(text: str) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", text, re.MULTILINE))


@pytest.fixture(scope="module")
def index(spark):
    return build_match_index(samples.catalog(spark, samples.random_catalog(3, 200)))


@pytest.fixture(scope="module")
def prefs(spark):
    rows = samples.preferences(spark, samples.random_preferences(3, 40))
    return valid_preferences(check_preferences(rows))


@pytest.fixture(scope="module")
def matched(index, prefs):
    return match_batch(index, prefs)


def test_catalog_takes_one_shuffle_after_partial_aggregation(spark):
    text = plan(build_catalog(samples.listings(spark, [{"name": "A"}])))
    assert exchanges(text) == 1
    assert "partial_max_by" in text
    assert not any(node in text for node in PYTHON_NODES)


def test_single_preference_reads_one_band_and_takes_top_n(spark, tmp_path):
    snapshot.write_snapshot(samples.catalog(spark, samples.VENUES), str(tmp_path))
    text = plan(top_candidates(snapshot.read_snapshot(spark, str(tmp_path)), "Pune", "low", "thai", 3.0))
    assert "TakeOrderedAndProject" in text and exchanges(text) == 0
    assert re.search(r"PartitionFilters: .*budget_band#\d+ = low", text)
    assert re.search(r"PushedFilters: .*EqualTo\(city_lc,pune\),StringContains\(location_lc,pune\)", text)
    assert "GreaterThanOrEqual(rating,3.0)" in text


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_batch_never_pairs_everything(spark, index, prefs, limit):
    requests = prefs.select("target", "needle", "budget", "min_rating").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        lookup, joined = plan(match_lookup(index, requests, 5)), plan(match_batch(index, prefs, 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in (lookup, joined):
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
        assert not any(node in text for node in PYTHON_NODES)
    assert lookup.count("WindowGroupLimit") >= 4
    # Catalog data is joined with the asked keys before anything ranks, and no list holds more than the first n.
    assert lookup.count("collect_list") <= 2 * lookup.count("ObjectHashAggregate")
    assert exchanges(lookup) < 24


def test_a_hot_request_is_split(spark, index, tmp_path):
    """Half of all preferences ask for the same; with size limits scaled down, AQE cuts their partition."""
    hot = F.col("id") % 2 == 0
    rows = spark.range(0, 60_000, 1, 16).select(
        F.col("id").alias("pref_id"),
        F.when(hot, "Bangalore").otherwise(F.concat(F.lit("Place "), F.col("id") % 500)).alias("location"),
        F.lit("low").alias("budget"),
        F.lit("any").alias("cuisine"),
        F.lit(0.0).alias("min_rating"),
        F.sha2(F.col("id").cast("string"), 256).alias("additional_preferences"),
    )
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        answered = match_batch(index, valid_preferences(check_preferences(rows)), 5)
        answered.write.parquet(str(tmp_path / "out"))
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        final_plan = runs.apply(runs.size() - 1).physicalPlanDescription()
    finally:
        for key in options:
            spark.conf.unset(key)
    assert "SortMergeJoin(skew=true)" in final_plan
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60_000


def test_replies_are_reconciled_without_a_shuffle(spark, matched):
    replies = matched.selectExpr("pref_id", "candidates", "cast(null as string) raw_response")
    assert exchanges(plan(reconcile_replies(replies))) == exchanges(plan(replies))


def test_filters_do_not_repeat_the_reconciliation(spark, matched):
    """A filter on the status, or one made from an explode, reads finished columns."""
    replies = spark.createDataFrame([(1, "{}", None, None, 1.0)], "pref_id BIGINT, raw_response STRING, error_type STRING, error_message STRING, latency_ms DOUBLE")
    answers = envelopes(matched, replies)
    for asked in (answers.where(F.col("status") == "error"), result_cards(answers), result_badges(answers)):
        optimized = asked._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("sort_array(") <= 1 and optimized.count("try_parse_json(") + optimized.count("tryparsejson(") <= 1
        assert optimized.count("arrays_zip(") <= 1
