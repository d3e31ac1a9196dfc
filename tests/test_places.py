from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.samples import listings
from venuematch.operators import places
from venuematch.operators.normalize import annotate_listings

SCHEMA = "name string, place string, position long"


def expected(address, dictionary):
    """The first name, longest first and then by position, that the lower-cased address contains."""
    for name, place, _ in sorted((d for d in dictionary if d[0]), key=lambda d: (-len(d[0]), d[2])):
        if address and name.lower() in address.lower():
            return place
    return None


def found(spark, addresses, dictionary):
    rows = spark.createDataFrame(list(enumerate(addresses)), "id long, `a.b` string")
    got = places.with_place(rows, F.col("`a.b`"), spark.createDataFrame(dictionary, SCHEMA))
    assert got.columns == ["id", "a.b", "place"]
    return [r["place"] for r in got.orderBy("id").collect()]


def test_places_agree_with_trying_every_name(spark):
    rng = random.Random(6)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
    # Few letters, so that names lie in one another, and beginnings that hundreds of names share, up to the longest key.
    names = [word("abÄ", 7) for _ in range(60)] + [f"Saint {'very ' * k}{word('xyz', 6)}" for k in (0, 1, 4, 8) for _ in range(120)]
    dictionary = [(n, f"p{i}", i) for i, n in enumerate(names)] + [("", "empty", -1), (None, "none", -2)]
    addresses = [word("abÄc ,", 30) for _ in range(150)] + [f"{word('abc', 4)}{rng.choice(names)}{word('xyz', 4)}".upper() for _ in range(150)]
    addresses += [None, "", " ", addresses[0], addresses[200]]
    assert found(spark, addresses, dictionary) == [expected(a, dictionary) for a in addresses]


def test_no_key_leads_to_more_names_than_allowed(spark):
    dictionary = [(f"supplier#{i:09d}", str(i), i) for i in range(500)] + [("pune", "x", 1), ("punegaon", "y", 2)]
    keyed = places.keyed_names(spark.createDataFrame(dictionary, SCHEMA))
    assert keyed.count() == len(dictionary)
    # A whole name may be the beginning of others as well.
    assert keyed.groupBy("key").count().agg(F.max("count")).first()[0] <= places.CROWD + 1
    assert keyed.where(~F.startswith("needle", "key")).count() == 0


def test_ties_repeats_and_empty_tables(spark):
    twice = [("Goa", "late", 5), ("goa", "early", 2), ("GOA", "early", 2), ("oa!", "other", 9)]
    assert found(spark, ["in goa!", "goA", "go"], twice) == ["early", "early", None]
    assert found(spark, ["in goa"], []) == [None]
    rows = spark.createDataFrame([], "id long, `a.b` string")
    assert places.with_place(rows, F.col("`a.b`"), spark.createDataFrame(twice, SCHEMA)).count() == 0
    # A column of the result's name is replaced.
    taken = spark.createDataFrame([("goa", "old")], "text string, place string")
    got = places.with_place(taken, F.col("text"), spark.createDataFrame(twice, SCHEMA))
    assert got.columns == ["text", "place"] and got.collect()[0]["place"] == "early"


def test_listings_take_their_city_from_a_dictionary(spark):
    raw = listings(spark, [{"name": "A", "address": "12 Rue X, LYON 3"}, {"name": "B", "address": "nowhere"}, {"name": "C", "address": None}])
    dictionary = spark.createDataFrame([("Lyon", "Lyon", 1), ("Lyon 3", "Lyon east", 2)], SCHEMA)
    got = annotate_listings(raw, places=dictionary).orderBy("row_index").collect()
    assert [(r["city"], r["city_defaulted"]) for r in got] == [("Lyon east", False), ("Bangalore", True), ("Bangalore", True)]
