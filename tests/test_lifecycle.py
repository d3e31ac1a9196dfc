"""What the library leaves in the shared folder, and that its work follows what is asked."""

from __future__ import annotations

import io
import logging
import pathlib
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tests import samples
from venuematch.config import DEFAULTS
from venuematch.functions.numbers import round_exact
from venuematch.operators.batch import (
    asked_keys,
    build_match_index,
    candidate_rows,
    match_batch,
    resolve_areas,
    resolve_texts,
)
from venuematch.operators.preferences import check_preferences, valid_preferences
from venuematch.operators.replies import reconcile_replies
from venuematch.operators.single import top_candidates
from venuematch.plans.catalog import data_summary, open_catalog
from venuematch.plans.recommend import resumable_ranker
from venuematch.sources import exports, snapshot
from venuematch.sources.listings import read_listings
from venuematch.storage import materialize, scratch_folder, shared_dir


def left_over(spark):
    return {p.name for p in pathlib.Path(shared_dir(spark)).iterdir()}


def test_nothing_but_the_requested_output_is_left(spark, tmp_path):
    before = left_over(spark)
    catalog = samples.catalog(spark, samples.random_catalog(1, 300))
    prefs = valid_preferences(check_preferences(samples.preferences(spark, samples.random_preferences(2, 40))))
    with scratch_folder(spark), build_match_index(catalog) as index:
        candidate_rows(match_batch(index, prefs)).write.parquet(str(tmp_path / "out"))
        assert left_over(spark) - before
    assert left_over(spark) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_folder_goes_after_an_error_too(spark):
    before = left_over(spark)
    with pytest.raises(ZeroDivisionError), scratch_folder(spark):
        materialize(spark.range(3))
        raise ZeroDivisionError
    assert left_over(spark) == before


def test_one_request_reads_its_own_keys_only(spark):
    index = build_match_index(samples.catalog(spark, samples.random_catalog(3, 2000)))

    def keys(target, needle):
        pairs = spark.createDataFrame([(target, needle)], "target string, needle string")
        targets, needles = pairs.select("target"), pairs.select("needle")
        texts = resolve_texts(index, targets, needles)
        return asked_keys(index, pairs, resolve_areas(index, targets, texts), texts).collect()

    assert keys("mumbai", "sushi") == []
    named = keys("mumbai", "tex")
    assert named and {(k.cuisine_lc, k.any_cuisine) for k in named} == {("tex-mex", False)}
    assert all(k.area_city == "mumbai" if k.whole_city else "mumbai" in k.area_location for k in named)
    assert all(k.any_cuisine for k in keys("delhi", ""))


def test_many_distinct_ratings_need_no_array(spark):
    rows = [(str(i), f"V{i}", "Old Town", "Pune", "thai", i / 4000, 800, "medium") for i in range(8000)]
    catalog = samples.catalog(spark, rows)
    prefs = valid_preferences(check_preferences(samples.preferences(spark, [(1, "Pune", "medium", "thai", 1.0, None), (2, "Pune", "low", "any", 0.0, None)])))
    got = {r.pref_id: r for r in match_batch(build_match_index(catalog), prefs).collect()}
    assert (got[1].after_cuisine, got[1].after_rating, got[1].after_budget, got[1].returned) == (8000, 4000, 4000, 30)
    assert (got[2].after_location, got[2].after_budget) == (8000, 0)
    assert [c.id for c in got[1].candidates] == [r.id for r in top_candidates(catalog, "Pune", "medium", "thai", 1.0).collect()]


def test_first_rows_of_a_seed_follow_the_file(spark, tmp_path):
    rows = [(name, name, "X", "Pune", "thai", 4.0, 800, "medium") for name in ("zeta", "beta", "alpha", "omega")]
    columns = ["id", "name", "location", "city", "cuisine", "rating", "cost_for_two", "budget_band"]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "seed"))
    seed = snapshot.read_clean_parquet(spark, str(tmp_path / "seed"))
    assert [r.id for r in exports.json_sample(seed, 3).collect()] == ["zeta", "beta", "alpha"]
    odd = [("x", "x", "X", "Pune", "thai", 4.0, 800, "cheap")]
    spark.createDataFrame(rows + odd, columns).write.parquet(str(tmp_path / "odd"))
    assert snapshot.read_clean_parquet(spark, str(tmp_path / "odd")) is None
    assert snapshot.read_clean_parquet(spark, str(tmp_path / "none")) is None


def test_positions_never_move_listings(spark, tmp_path):
    spark.range(0, 1000, 1, 5).select(F.col("id").cast("string").alias("name")).write.parquet(str(tmp_path / "raw"))
    frame = read_listings(spark, str(tmp_path / "raw"))
    text = io.StringIO()
    with redirect_stdout(text):
        frame.explain("formatted")
    assert "BroadcastHashJoin" in text.getvalue() and "hashpartitioning" not in text.getvalue()
    assert sorted(r.row_index for r in frame.collect()) == list(range(1000))


def test_large_latencies_are_rounded_exactly(spark):
    values = [20000000.05, 20000000.15, 16777216.25, 2.0**52 + 0.5, 1e15 + 0.125, 2.0**60, 0.25, 0.35, 9.95, 99999999.95]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_exact(F.col("x"), 1).alias("y"), round_exact(F.col("x"), 2).alias("z"))
    for r in rows.collect():
        assert (r.y, r.z) == (round(r.x, 1), round(r.x, 2)), r.x


def test_ranks_beyond_64_bits_keep_their_order(spark):
    cards = [(i, i, "X", "Pune", "thai", 4.0, 800, "medium") for i in "abcde"]
    text = (
        '{"recommendations": [{"id": "a", "rank": 1e21}, {"id": "b", "rank": 1e20}, {"id": "c", "rank": "100000000000000000001"},'
        ' {"id": "d", "rank": 9223372036854775807}, {"id": "e", "rank": 3}]}'
    )
    catalog = samples.catalog(spark, cards)
    listed = catalog.agg(F.collect_list(F.struct(*catalog.columns[:8])).alias("candidates"))
    got = reconcile_replies(listed.select(F.lit(1).alias("pref_id"), F.lit(text).alias("raw_response"), "candidates")).first()
    assert [r.restaurant.id for r in got.recommendations] == ["e", "d", "b", "c", "a"]


def test_a_failing_refresh_is_logged(spark, tmp_path, caplog):
    catalog = samples.catalog(spark, samples.VENUES)
    snapshot.write_snapshot(catalog, str(tmp_path / "store"))
    (tmp_path / "exports").write_text("a file where a folder should be")
    with caplog.at_level(logging.WARNING):
        opened = open_catalog(spark, lambda: None, str(tmp_path / "store"), export_root=str(tmp_path / "exports"))
    assert opened.count() == 6 and "could not refresh" in caplog.text


def test_missing_snapshot_and_odd_caps_are_named(spark, tmp_path, caplog):
    with pytest.raises(FileNotFoundError, match="no catalog snapshot"):
        exports.export_snapshot(spark, str(tmp_path / "nothing"), str(tmp_path / "out"))
    with caplog.at_level(logging.WARNING):
        assert DEFAULTS.effective_top_n(0) == 30 and DEFAULTS.effective_top_n(None) == 30
    assert caplog.text.count("is not positive") == 1


def test_summary_names_cities_and_first_rows(spark):
    row = data_summary(samples.catalog(spark, samples.VENUES), spark.range(1), "bengaluru", 2).first()
    assert (row.total, row.n_cities, row.cities, row.in_city, row.sample_names) == (6, 2, ["Bangalore", "Delhi"], 4, ["Salt Harbour", "Old Clay Oven"])


REPLIES = "pref_id long, raw_response string, error_type string, error_message string, latency_ms double"


def test_a_ranker_that_fails_is_asked_for_the_rest_only(spark, tmp_path):
    rows = [(i, "be kind", f"prompt {i % 20}") for i in range(40)] + [(50, "be", " kindprompt 1"), (51, "", "odd")]
    prompts, asked = spark.createDataFrame(rows, "pref_id long, system string, prompt string"), []

    def ranker(open_prompts, dies_after=None):
        found = open_prompts.collect()
        asked.append([(r.system, r.prompt) for r in found])
        if dies_after is not None and len(asked) > dies_after:
            raise ConnectionError
        return spark.createDataFrame([(r.pref_id, f"re {r.prompt}", "Timeout" if r.prompt == "odd" else None, None, 1.5) for r in found], REPLIES)

    store = str(tmp_path / "replies")
    with pytest.raises(ConnectionError):
        resumable_ranker(lambda p: ranker(p, 2), store, batches=4)(prompts).collect()
    kept = {x for batch in asked[:2] for x in batch if x[1] != "odd"}
    asked.clear()
    got = resumable_ranker(ranker, store, batches=4)(prompts).collect()
    again = [x for batch in asked for x in batch]
    assert len(again) == len(set(again)) and not kept & set(again) and kept | set(again) == {(s, p) for _, s, p in rows}
    assert sorted((r.pref_id, r.raw_response) for r in got) == sorted((i, f"re {p}") for i, _, p in rows)
    assert set(got[0].asDict()) == {"pref_id", "raw_response", "error_type", "error_message", "latency_ms"}
    asked.clear()
    assert len(resumable_ranker(ranker, store)(prompts).collect()) == len(rows) and asked == [[("", "odd")]]
    assert resumable_ranker(ranker, str(tmp_path / "none"))(prompts.limit(0)).count() == 0


def test_stored_rows_are_cut_into_files(spark):
    stored = materialize(spark.range(10).coalesce(1), "cut", 4)
    assert len(stored.inputFiles()) == 3 and stored.count() == 10
