"""A table of preferences against a catalog of any size.

No preference is ever paired with a catalog row. The four filters only look at a row's place, cuisine, band
and rating, and candidate order starts with the rating, so two summaries of the catalog are enough:

``cells``  how many rows share (area, cuisine, band, rating) - for the funnel counts;
``heads``  the first N rows in candidate order per (area, cuisine, band) - for the candidate lists.

Both are stored at four levels: the area is one place or a whole city, the cuisine is one text or any. A top-N over a
union of groups is the top-N over the groups' own top-N, and a minimum rating cuts a prefix of an ordered list, so
each level follows from the one below, never keeping more than N rows per group.

A batch first settles which areas and cuisines its requests ask for. Only these keys of the summaries are read, joined
with the requests, and then counted and ranked: the work follows what is asked, not the catalog.

``build_match_index`` and ``match_batch`` run jobs when called. The index and the small tables that several branches
share are written to the shared folder: every branch then reads them instead of planning and running them again, and
Spark knows their size when it decides between a broadcast and a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from venuematch.config import BUDGETS, CATALOG_COLUMNS, DEFAULTS, Settings
from venuematch.operators import predicates
from venuematch.operators.substring_join import gram_frequencies, gram_index, substring_matches
from venuematch.storage import materialize, remove, scratch_path, stored_under

PLACE = ["city_lc", "location_lc"]
AREA = ["whole_city", "area_city", "area_location"]
KEY = [*AREA, "any_cuisine", "cuisine_lc"]
REQUEST = ["target", "needle", "budget"]
COUNTS = [
    "candidates_considered",
    "after_location",
    "after_cuisine",
    "after_rating",
    "after_budget",
    "returned",
]
SALTS = 16

# Rows of a file of stored matches or replies. A match holds up to N cards, which repeat and so take little room on disk.
FILE_ROWS = 2_000


@dataclass(frozen=True)
class MatchIndex:
    """Stored summaries of a catalog. ``depth`` is the largest top-N they can answer.

    ``close`` removes them; a ``with`` block does so at its end.
    """

    cells: DataFrame
    heads: DataFrame
    places: DataFrame
    grams: DataFrame
    frequencies: DataFrame
    depth: int
    folder: str

    def close(self) -> None:
        remove(self.cells.sparkSession, self.folder)

    def __enter__(self) -> MatchIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def first_n(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows 1..n of each group in candidate order.

    Done twice: over parts of each group, cut by a hash of the id, and then over the parts' own first rows. Catalyst
    limits every part to n rows on the map side. A group that holds most of the rows is so spread over many tasks,
    and its last step sees n rows of each part.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for by in ([*keys, "salt"], keys):
        window = Window.partitionBy(*by).orderBy(*predicates.candidate_order())
        salted = salted.withColumn("position", F.row_number().over(window)).where(F.col("position") <= n)
    return salted.drop("salt")


def _levels(rows: DataFrame, whole_city: bool, any_cuisine: bool) -> DataFrame:
    """Rows under the key of one place or its whole city, and of one cuisine or any."""
    kept = [c for c in rows.columns if c not in [*PLACE, "cuisine_lc"]]
    return rows.select(
        F.lit(whole_city).alias("whole_city"),
        F.col("city_lc").alias("area_city"),
        (F.lit("") if whole_city else F.col("location_lc")).alias("area_location"),
        F.lit(any_cuisine).alias("any_cuisine"),
        (F.lit("") if any_cuisine else F.col("cuisine_lc")).alias("cuisine_lc"),
        *kept,
    )


def _all_levels(rows: DataFrame) -> DataFrame:
    out = _levels(rows, False, False)
    for whole_city, any_cuisine in ((False, True), (True, False), (True, True)):
        out = out.unionByName(_levels(rows, whole_city, any_cuisine))
    return out


def catalog_cells(catalog: DataFrame) -> DataFrame:
    """Rows per place, cuisine, band and rating."""
    rows = catalog.withColumn("cuisine_lc", F.lower("cuisine"))
    return rows.groupBy(*PLACE, "cuisine_lc", "budget_band", "rating").agg(F.count("*").alias("n"))


def catalog_heads(catalog: DataFrame, n: int) -> DataFrame:
    """Rows of an unknown band never match, so they have no head."""
    rows = catalog.withColumn("cuisine_lc", F.lower("cuisine")).where(F.col("budget_band").isin(BUDGETS))
    return first_n(rows, [*PLACE, "cuisine_lc", "budget_band"], n).select(
        *PLACE, "cuisine_lc", "budget_band", "name_lc", "id", "rating", F.struct(*CATALOG_COLUMNS).alias("card")
    )


def build_match_index(catalog: DataFrame, depth: int | None = None, settings: Settings = DEFAULTS) -> MatchIndex:
    """Summarise the catalog once; any number of preference batches can then be answered from it."""
    n = settings.effective_top_n(depth)
    folder = scratch_path(catalog.sparkSession, "match-index")
    with stored_under(folder):
        lowest = materialize(catalog_cells(catalog), "lowest-cells")
        cells = _all_levels(lowest).groupBy(*KEY, "budget_band", "rating").agg(F.sum("n").alias("n"))
        heads = materialize(catalog_heads(catalog, n), "lowest-heads")
        places = materialize(lowest.select(*PLACE).distinct(), "places")
        names = places.select(_kind("place"), F.col("location_lc").alias("text")).distinct()
        cuisines = lowest.select(_kind("cuisine"), F.col("cuisine_lc").alias("text")).distinct()
        grams = materialize(gram_index(names.unionByName(cuisines)), "grams")
        return MatchIndex(
            cells=materialize(cells, "cells"),
            heads=materialize(first_n(_all_levels(heads), [*KEY, "budget_band"], n).drop("position"), "heads"),
            places=places,
            grams=grams,
            frequencies=materialize(gram_frequencies(grams), "frequencies"),
            depth=n,
            folder=folder,
        )


def _kind(name: str) -> Column:
    return F.lit(name).alias("kind")


def resolve_texts(index: MatchIndex, targets: DataFrame, needles: DataFrame) -> DataFrame:
    """Location texts that contain a target and cuisine texts that contain a needle, in one join."""
    sought = targets.select(_kind("place"), F.col("target").alias("needle")).unionByName(
        needles.select(_kind("cuisine"), "needle")
    )
    return substring_matches(index.grams, index.frequencies, sought)


def resolve_areas(index: MatchIndex, targets: DataFrame, texts: DataFrame) -> DataFrame:
    """Areas each target stands for: the city of that name as a whole, and single places elsewhere whose
    location text contains the target. The two never overlap, so no row is counted twice."""
    cities = targets.select(
        "target", F.lit(True).alias("whole_city"), F.col("target").alias("area_city"), F.lit("").alias("area_location")
    )
    named = texts.where(F.col("kind") == "place").select(
        F.col("text").alias("location_lc"), F.col("needle").alias("target")
    )
    elsewhere = index.places.join(named, "location_lc").where(F.col("city_lc") != F.col("target"))
    return cities.unionByName(
        elsewhere.select(
            "target", F.lit(False).alias("whole_city"), F.col("city_lc").alias("area_city"), F.col("location_lc").alias("area_location")
        )
    )


def asked_keys(index: MatchIndex, pairs: DataFrame, areas: DataFrame, texts: DataFrame) -> DataFrame:
    """Keys of the summaries that each (target, needle) asks for.

    "Any" cuisine is a level of its own. A named one stands for the texts that contain it, of which only those that
    occur in the area are keys.
    """
    asked = pairs.join(areas, "target")
    everything = asked.where(F.col("needle") == "").select(
        "target", "needle", *AREA, F.lit(True).alias("any_cuisine"), F.lit("").alias("cuisine_lc")
    )
    cuisines = texts.where(F.col("kind") == "cuisine").select(F.col("text").alias("cuisine_lc"), "needle")
    present = (
        index.cells.where(~F.col("any_cuisine"))
        .join(cuisines.select("cuisine_lc").distinct(), "cuisine_lc", "left_semi")
        .join(asked.select(*AREA).distinct(), AREA, "left_semi")
        .select(*AREA, "cuisine_lc")
        .distinct()
    )
    named = asked.where(F.col("needle") != "").join(cuisines, "needle").join(present, [*AREA, "cuisine_lc"])
    return everything.unionByName(named.select("target", "needle", *AREA, F.lit(False).alias("any_cuisine"), "cuisine_lc"))


def location_counts(index: MatchIndex, areas: DataFrame) -> DataFrame:
    """Rows at each target."""
    counted = index.cells.where("any_cuisine").join(areas, AREA)
    return counted.groupBy("target").agg(F.sum("n").alias("after_location"))


def _rated(floor: Column) -> Column:
    return (floor <= 0.0) | F.coalesce(F.col("rating") >= floor, F.lit(False))


def funnel_sums(index: MatchIndex, keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows left after each later filter for every (target, needle, budget, min_rating)."""
    buckets = (
        index.cells.join(keys, KEY).groupBy("target", "needle", "budget_band", "rating").agg(F.sum("n").alias("n"))
    )
    rated = _rated(F.col("min_rating"))
    in_band = F.col("budget_band") == F.col("budget")

    def total(kept: Column, name: str) -> Column:
        return F.sum(F.when(kept, F.col("n")).otherwise(0)).alias(name)

    return buckets.join(requests, ["target", "needle"]).groupBy(*REQUEST, "min_rating").agg(
        F.sum("n").alias("after_cuisine"), total(rated, "after_rating"), total(rated & in_band, "after_budget")
    )


def ranked_heads(index: MatchIndex, keys: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """The first n rows per (target, needle, budget), as an ordered array of at most n cards."""
    asked = requests.select("target", "needle", F.col("budget").alias("budget_band")).distinct()
    wanted = keys.join(asked, ["target", "needle"])
    merged = first_n(index.heads.join(wanted, [*KEY, "budget_band"]), ["target", "needle", "budget_band"], n)
    listed = F.sort_array(F.collect_list(F.struct("position", "card")))
    return merged.groupBy("target", "needle", F.col("budget_band").alias("budget")).agg(
        F.transform(listed, lambda item: item["card"]).alias("ranked")
    )


def match_lookup(index: MatchIndex, requests: DataFrame, n: int) -> DataFrame:
    """One row per distinct (target, needle, budget, min_rating): its counts and its ordered candidates."""
    pairs = requests.select("target", "needle").distinct()
    targets = pairs.select("target").distinct()
    texts = materialize(resolve_texts(index, targets, pairs.select("needle").distinct()), "texts")
    areas = materialize(resolve_areas(index, targets, texts), "areas")
    keys = materialize(asked_keys(index, pairs, areas, texts), "keys")
    return (
        requests.join(location_counts(index, areas), "target", "left")
        .join(funnel_sums(index, keys, requests), [*REQUEST, "min_rating"], "left")
        .join(ranked_heads(index, keys, requests, n), REQUEST, "left")
    )


def match_batch(
    index: MatchIndex, prefs: DataFrame, top_n: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Validated preferences plus their funnel counts and an ordered ``candidates`` array.

    Preferences are reduced to distinct requests on the map side, and joined with the answers of their
    requests. The answers are a stored table with one row per request: small ones are broadcast, and
    otherwise both join sides are plain shuffles, which AQE splits when a large share of the preferences
    makes the same request.
    """
    n = settings.effective_top_n(top_n)
    if n > index.depth:
        raise ValueError(f"the match index answers up to {index.depth} candidates, not {n}")
    keys = [*REQUEST, "min_rating"]
    requests = materialize(prefs.select(*keys).distinct(), "requests")
    lookup = materialize(match_lookup(index, requests, n), "answers")
    considered = index.cells.where("whole_city and any_cuisine").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    # A file of preferences is small and would be one task, which writes N cards for each of them.
    joined = prefs.repartition(*prefs.columns).join(lookup, keys, "left")
    floor = F.col("min_rating")
    kept = F.when(floor <= 0.0, F.col("ranked")).otherwise(
        F.filter("ranked", lambda card: F.coalesce(card["rating"] >= floor, F.lit(False)))
    )
    card_type = index.heads.schema["card"].dataType.simpleString()
    return joined.select(
        *prefs.columns,
        considered.alias("candidates_considered"),
        *[F.coalesce(count, F.lit(0).cast("bigint")).alias(count) for count in COUNTS[1:-1]],
        F.coalesce(kept, F.array().cast(f"array<{card_type}>")).alias("candidates"),
    ).select(
        *prefs.columns,
        *COUNTS[:-1],
        F.size("candidates").cast("bigint").alias("returned"),
        F.lit(n).alias("top_n"),
        "candidates",
    )


def candidate_rows(matched: DataFrame) -> DataFrame:
    """One row per preference and candidate, numbered from 1."""
    exploded = matched.select("pref_id", F.posexplode("candidates").alias("at", "card"))
    return exploded.select("pref_id", (F.col("at") + 1).alias("position"), "card.*")
