from __future__ import annotations

import logging

import pytest
from pyspark.sql import functions as F

from tests import samples
from venuematch.config import CATALOG_COLUMNS
from venuematch.operators import facets
from venuematch.operators.dedupe import catalog_counters, dedupe_listings, quality_counters
from venuematch.operators.normalize import normalize_listings
from venuematch.plans.catalog import build_catalog, data_summary, preview, store_catalog
from venuematch.sources.listings import ListingsError

COST = "approx_cost(for two people)"


def listing(name, rate="4.0/5", address="Jayanagar, Bengaluru", location="Jayanagar", cuisines="Cafe", cost="300"):
    return {"name": name, "address": address, "location": location, "cuisines": cuisines, "rate": rate, COST: cost}


def test_one_listing(spark):
    raw = samples.listings(spark, [listing("Test Cafe", "4.2/5", "Banashankari, Bangalore", "Banashankari", "Italian, Pizza", "800")])
    row = build_catalog(raw).first()
    assert (row.name, row.city, row.location, row.cuisine) == ("Test Cafe", "Bangalore", "Banashankari", "italian, pizza")
    assert (row.rating, row.cost_for_two, row.budget_band) == (4.2, 800, "medium")


def test_missing_columns_and_fallbacks(spark):
    raw = spark.createDataFrame([(0, " X ", " ")], "row_index BIGINT, name STRING, location STRING")
    row = build_catalog(raw).first()
    assert (row.name, row.city, row.location, row.cuisine) == ("X", "Bangalore", "Bangalore", "unknown")
    assert (row.rating, row.cost_for_two, row.budget_band) == (None, None, "unknown")


def test_best_rated_duplicate_wins(spark):
    raw = samples.listings(spark, [listing("Jalsa", "4.0/5", cost="600"), listing("JALSA", "4.5/5", cost="700"), listing("jalsa", "NEW")])
    rows = build_catalog(raw).collect()
    assert [(r.name, r.rating, r.cost_for_two, r.position) for r in rows] == [("JALSA", 4.5, 700, 0)]


def test_tie_keeps_the_earliest(spark):
    raw = samples.listings(spark, [listing("A", "NEW", cost="100"), listing("A", "0/5", cost="200"), listing("A", "-", cost="300")])
    assert build_catalog(raw).first().cost_for_two == 100


def test_same_name_elsewhere_is_another_venue(spark):
    raw = samples.listings(spark, [listing("A"), listing("A", location="HSR"), listing("A", address="Pune")])
    assert build_catalog(raw).count() == 3


def test_counters(spark):
    raw = samples.listings(spark, [listing("A"), listing("a"), listing(" "), listing(None, address="x"), listing("B", address="nowhere")])
    counters = quality_counters(raw).first().asDict()
    assert counters == {
        "input_rows": 5, "rows_normalized": 3, "dropped_missing_name": 2, "collapsed_duplicates": 1,
        "defaulted_city": 1, "output_rows": 2, "success_rate": 0.6,
    }
    assert catalog_counters(build_catalog(raw), raw).first().asDict() == counters
    assert quality_counters(raw.limit(0)).first().asDict()["success_rate"] == 0.0


def test_result_does_not_depend_on_partitions(spark):
    rows = [listing(f"V{i % 37}", f"{i % 6}.{i % 10}/5", cost=str(i % 2000)) for i in range(600)]
    raw = samples.listings(spark, rows)
    results = {
        tuple(sorted(map(tuple, build_catalog(raw.repartition(n)).collect()), key=str)) for n in (1, 3, 16)
    }
    assert len(results) == 1
    assert len(next(iter(results))) == 37


def test_dedupe_is_idempotent(spark):
    raw = samples.listings(spark, [listing(f"V{i % 5}", f"{i % 6}/5") for i in range(40)])
    once = dedupe_listings(normalize_listings(raw))
    again = dedupe_listings(once.withColumnRenamed("position", "row_index").withColumn("city_defaulted", F.lit(False)))
    assert sorted(map(tuple, once.select(*CATALOG_COLUMNS).collect())) == sorted(
        map(tuple, again.select(*CATALOG_COLUMNS).collect())
    )


def test_store_checks(spark, caplog):
    with pytest.raises(ListingsError):
        store_catalog(samples.listings(spark, []))
    with pytest.raises(ListingsError):
        store_catalog(samples.listings(spark, [listing(" ")]))
    with caplog.at_level(logging.WARNING):
        assert store_catalog(samples.listings(spark, [listing("A"), listing("")])).count() == 1
    assert "50.0%" in caplog.text


def test_facets(spark):
    catalog = samples.catalog(spark, [
        ("1", "A", "HSR", "Bangalore", "north indian, tex-mex", 4.0, 1, "low"),
        ("2", "B", "BTM", "bangalore", "thai,, Tex-Mex", 4.0, 1, "low"),
        ("3", "C", "CP", "Delhi", "thai", 4.0, 1, "low"),
        ("4", "D", "", "Bangalore", "thai", 4.0, 1, "low"),
    ])
    assert [r.city for r in facets.city_list(catalog).collect()] == ["Bangalore", "Delhi", "bangalore"]
    locations = facets.location_facet(catalog)
    assert [r.location for r in locations.collect()] == ["BTM", "HSR"]
    assert [r.cuisine for r in facets.cuisine_facet(catalog).collect()] == ["Any", "", "North Indian", "Tex-Mex", "Thai"]
    assert facets.default_facet(locations).first().location == "BTM"
    known = spark.createDataFrame([("HSR",), ("Indiranagar",), ("Zed",)], "location STRING")
    assert facets.default_facet(known).first().location == "Indiranagar"
    assert sorted(r.id for r in facets.by_city(catalog, " bengaluru").collect()) == ["1", "2", "4"]
    asked = spark.createDataFrame([("NEW DELHI",), ("delhi",), ("Pune",)], "city STRING")
    assert [r.id for r in facets.lookup_cities(catalog, asked).collect()] == ["3"]


def test_preview_and_summary(spark):
    raw = samples.listings(spark, [listing("C"), listing("A"), listing("B", address="Pune"), listing("c", "5/5")])
    catalog = build_catalog(raw)
    assert [r.name for r in preview(catalog, 2).collect()] == ["c", "A"]
    summary = data_summary(catalog, quality_counters(raw), "Bangalore").first()
    assert (summary.total, summary.cities, summary.in_city) == (3, ["Bangalore", "Pune"], 2)
    assert summary.sample_names == ["c", "A"]
