from __future__ import annotations

import pytest

from tests import samples
from venuematch.operators.batch import COUNTS, build_match_index, candidate_rows, match_batch
from venuematch.operators.diagnose import empty_reasons, root_causes
from venuematch.operators.preferences import check_preferences, rejected_preferences, valid_preferences
from venuematch.operators.single import funnel_counts, match_one, top_candidates
from venuematch.operators.substring_join import gram_frequencies, gram_index, substring_matches


def ids(frame):
    return [r.id for r in frame.collect()]


@pytest.fixture(scope="module")
def venues(spark):
    return samples.catalog(spark, samples.VENUES).cache()


def valid(spark, rows):
    return valid_preferences(check_preferences(samples.preferences(spark, rows)))


def test_single_preference(venues):
    assert ids(top_candidates(venues, "Bangalore", "medium", "italian")) == ["1", "5"]
    assert ids(top_candidates(venues, "Bangalore", "medium", "italian", 4.0)) == ["1"]
    assert ids(top_candidates(venues, "Bangalore", "medium", "any")) == ["1", "4", "5"]
    assert ids(top_candidates(venues, " new delhi", "high", "*")) == ["3"]
    assert ids(top_candidates(venues, "indira", "medium", "n, piz")) == ["1"]
    assert ids(top_candidates(venues, "Bangalore", "low", "indian")) == ["2"]
    assert ids(top_candidates(venues, "Bangalore", "high", "italian")) == []
    assert ids(top_candidates(venues, "Bangalore", "medium", ".*")) == []


def test_single_counts(venues):
    row = funnel_counts(venues, "Bangalore", "medium", "italian", 4.0, top_n=1).first()
    assert tuple(row) == (6, 5, 3, 2, 1, 1)


def test_cap_and_order(spark):
    many = [(str(i), f"R{i}", "X", "Bangalore", "italian", 3.0 + i * 0.01, 800, "medium") for i in range(50)]
    tied = [("b", "Bravo", "A", "Pune", "italian", 4.0, 800, "medium"), ("a", "alpha", "B", "Pune", "italian", 4.0, 800, "medium")]
    catalog = samples.catalog(spark, many + tied)
    ratings = [r.rating for r in top_candidates(catalog, "Bangalore", "medium", "italian", top_n=10).collect()]
    assert len(ratings) == 10 and ratings == sorted(ratings, reverse=True)
    assert len(ids(top_candidates(catalog, "Bangalore", "medium", "italian", top_n=0))) == 30
    assert ids(top_candidates(catalog, "Pune", "medium", "italian")) == ["a", "b"]


def test_validation(spark):
    rows = [
        (1, " Pune ", "low", " Thai ", None, "   "),
        (2, "  ", "low", "thai", 1.0, None),
        (3, "Pune", "LOW", "thai", 1.0, None),
        (4, "Pune", "low", None, 5.5, None),
        (5, None, None, "", -0.1, None),
        (6, "Pune", "high", "x", float("nan"), None),
        (7, "Pune", "high", "ALL", 5.0, " quiet "),
    ]
    checked = check_preferences(samples.preferences(spark, rows))
    good = {r.pref_id: r for r in valid_preferences(checked).collect()}
    bad = {r.pref_id: r.errors for r in rejected_preferences(checked).collect()}
    assert set(good) == {1, 7}
    assert (good[1].location, good[1].cuisine, good[1].min_rating, good[1].additional_preferences) == ("Pune", "Thai", 0.0, None)
    assert (good[7].needle, good[7].additional_preferences) == ("", "quiet")
    assert bad == {
        2: ["location_blank"],
        3: ["budget_invalid"],
        4: ["cuisine_blank", "min_rating_out_of_range"],
        5: ["location_blank", "budget_invalid", "cuisine_blank", "min_rating_out_of_range"],
        6: ["min_rating_out_of_range"],
    }


def test_text_ratings_are_read(spark):
    rows = [(1, "Pune", "low", "thai", "4.5"), (2, "Pune", "low", "thai", "lots")]
    frame = spark.createDataFrame(rows, "pref_id BIGINT, location STRING, budget STRING, cuisine STRING, min_rating STRING")
    checked = {r.pref_id: r for r in check_preferences(frame).collect()}
    assert (checked[1].min_rating, checked[1].errors) == (4.5, [])
    assert checked[2].errors == ["min_rating_out_of_range"]


def test_substring_join_equals_brute_force(spark):
    texts = ["abcabc", "bca", "a", "ab", "", "zzé!x", "é", "north indian, chinese", "indian", "aaaa", "a.c"]
    needles = ["a", "ab", "abc", "cab", "é!x", "é", "indian", "n, c", "aaa", "zzzz", "bcabcabca", "a.c", "", "."]
    frame = spark.createDataFrame([("k", t) for t in texts] + [("other", "indian abc")], "kind STRING, text STRING")
    asked = spark.createDataFrame([("k", n) for n in needles], "kind STRING, needle STRING")
    got = {(r.text, r.needle) for r in substring_matches(gram_index(frame), gram_frequencies(gram_index(frame)), asked).collect()}
    assert got == {(t, n) for t in texts for n in needles if n and n in t}


@pytest.fixture(params=["10MB", "-1"])
def broadcast_limit(spark, request):
    """Small sides broadcast, and every join shuffled as it would be on large inputs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed, top_n", [(1, 3), (2, 30)])
def test_batch_equals_brute_force(spark, broadcast_limit, seed, top_n):
    rows = samples.random_catalog(seed, 400)
    prefs = samples.random_preferences(seed, 150)
    catalog = samples.catalog(spark, rows).repartition(5)
    matched = match_batch(build_match_index(catalog, top_n), valid(spark, prefs), top_n).collect()
    assert len(matched) == len(prefs)
    found = {r.pref_id: r for r in matched}
    for pref in prefs:
        counts, want = samples.brute_force(rows, pref, top_n)
        row = found[pref[0]]
        assert tuple(row[c] for c in COUNTS) == (*counts, len(want)), pref
        assert [card.id for card in row.candidates] == want, pref
        assert counts == tuple(sorted(counts, reverse=True))


def test_batch_of_one_equals_single(spark, venues):
    matched = match_batch(build_match_index(venues), valid(spark, [(9, "Bengaluru", "medium", "Italian", 0.0, None)]))
    assert [r.id for r in candidate_rows(matched).orderBy("position").collect()] == ids(
        top_candidates(venues, "Bengaluru", "medium", "Italian")
    )


def test_one_row_has_the_batch_shape(spark, venues):
    pref = (0, "Bengaluru", "medium", "any", 3.0, " calm ")
    batch = match_batch(build_match_index(venues), valid(spark, [pref]))
    one = match_one(venues, *pref[1:])
    assert one.columns == batch.columns
    assert one.first().asDict(True) == batch.first().asDict(True)
    assert match_one(venues, "Bengaluru", "dear", "any").isEmpty()
    nothing = match_one(venues, "Bengaluru", "high", "thai").first()
    assert (nothing.candidates, nothing.returned, nothing.after_location) == ([], 0, 5)


def test_index_depth_is_checked(spark, venues):
    with pytest.raises(ValueError):
        match_batch(build_match_index(venues, 5), valid(spark, []), 6)


def test_empty_catalog(spark, venues):
    matched = match_batch(build_match_index(venues.limit(0)), valid(spark, [(1, "Pune", "low", "any", 0.0, None)]))
    assert empty_reasons(matched).first().message == "Restaurant data is not loaded."
    cause = root_causes(matched).first()
    assert (cause.cause, cause.title, len(cause.suggestions)) == ("other", "No Restaurants Found", 3)


def test_empty_results_are_explained(spark, venues):
    prefs = [
        (1, "atlantis", "low", "any", 0.0, None),
        (2, "Delhi", "low", "italian", 0.0, None),
        (3, "Bangalore", "medium", "pizza", 4.9, None),
        (4, "Bangalore", "high", "italian", 4.5, None),
        (5, "Bangalore", "low", "indian", 4.0, None),
        (6, "Bangalore", "low", "any", 5.0, None),
    ]
    matched = match_batch(build_match_index(venues), valid(spark, prefs))
    reasons = {r.pref_id: r.message for r in empty_reasons(matched).collect()}
    assert reasons == {
        1: "No restaurants found in 'Atlantis'. This dataset is primarily Bangalore-based.",
        2: "No restaurants found. Try a different location or lower your minimum rating.",
        3: "No restaurants found. Try a different location or lower your minimum rating.",
        4: "No restaurants in your budget range. Try a different budget level.",
        6: "No restaurants found. Try a different location or lower your minimum rating.",
    }
    causes = {r.pref_id: (r.cause, r.stage_before) for r in root_causes(matched).collect()}
    assert causes == {1: ("location", 6), 2: ("cuisine", 2), 3: ("rating", 1), 4: ("budget", 1), 6: ("rating", 5)}
    advice = {r.pref_id: r.suggestions for r in root_causes(matched).collect()}
    assert advice[2][0] == 'Set Cuisine Type to "Any" to see all 2 restaurants in Delhi.'
    assert advice[6][1].endswith("higher-rated options.")
    assert "different price bracket" in advice[4][0]
    why = {r.pref_id: r.explanation for r in root_causes(matched).collect()}
    assert why[2].startswith("We found 2 restaurants in Delhi, but none of them serve italian cuisine.")
    assert why[3] == "We found 1 pizza restaurant in Bangalore, but none have a rating of 4.9 or above."
    assert why[4].endswith('1 italian restaurant in Bangalore rated 4.5+, but none fall in the "above ₹1500" budget range.')
