"""One preference against the catalog: literals in the filter, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from venuematch import schemas
from venuematch.config import ANY_CUISINE_TOKENS, CATALOG_COLUMNS, DEFAULTS, Settings
from venuematch.functions import parsing
from venuematch.operators import predicates
from venuematch.operators.preferences import check_preferences, valid_preferences

STAGES = ["after_location", "after_cuisine", "after_rating", "after_budget"]


def stage_predicates(location: str, budget: str, cuisine: str, min_rating: float) -> list[Column]:
    """Location, cuisine, rating and budget tests, in funnel order."""
    target = F.lit(parsing.location_target(location))
    needle = cuisine.strip().lower()
    return [
        predicates.location_match(target),
        F.lit(True) if needle in ANY_CUISINE_TOKENS else predicates.cuisine_match(F.lit(needle)),
        predicates.rating_match(F.lit(float(min_rating))),
        predicates.budget_match(F.lit(budget)),
    ]


def top_candidates(
    catalog: DataFrame,
    location: str,
    budget: str,
    cuisine: str,
    min_rating: float = 0.0,
    top_n: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The first N matches in candidate order; the sort and limit become one top-N operator."""
    by_location, by_cuisine, by_rating, by_budget = stage_predicates(location, budget, cuisine, min_rating)
    matches = catalog.where(by_location & by_cuisine & by_rating & by_budget)
    ordered = matches.orderBy(*predicates.candidate_order()).limit(settings.effective_top_n(top_n))
    return ordered.select(*CATALOG_COLUMNS)


def funnel_counts(
    catalog: DataFrame,
    location: str,
    budget: str,
    cuisine: str,
    min_rating: float = 0.0,
    top_n: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Survivors after each stage in one pass over five columns."""
    limit = settings.effective_top_n(top_n)
    counts = []
    survives = F.lit(True)
    stages = stage_predicates(location, budget, cuisine, min_rating)
    for name, predicate in zip(STAGES, stages, strict=True):
        survives = survives & predicate
        counts.append(F.count_if(survives).alias(name))
    totals = catalog.agg(F.count("*").alias("candidates_considered"), *counts)
    return totals.withColumn("returned", F.least("after_budget", F.lit(limit).cast("bigint")))


def match_one(
    catalog: DataFrame,
    location: str,
    budget: str,
    cuisine: str,
    min_rating: float = 0.0,
    additional_preferences: str | None = None,
    top_n: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The row a batch match gives for this preference, with ``pref_id`` 0, without building an index.

    No row when the preference breaks a rule. Runs when called: one job reads the catalog once, counts on the way, and
    brings at most N candidates to the driver.
    """
    spark = catalog.sparkSession
    given = [(0, location, budget, cuisine, min_rating, additional_preferences)]
    prefs = valid_preferences(check_preferences(spark.createDataFrame(given, schemas.PREFERENCES)))
    limit = settings.effective_top_n(top_n)
    schema = T.StructType([
        *prefs.schema.fields,
        *[T.StructField(name, T.LongType()) for name in ["candidates_considered", *STAGES, "returned"]],
        T.StructField("top_n", T.IntegerType(), False),
        T.StructField("candidates", T.ArrayType(catalog.select(*CATALOG_COLUMNS).schema)),
    ])
    valid = prefs.first()
    if valid is None:
        return spark.createDataFrame([], schema)
    survives = F.lit(True)
    counts = [F.count(F.lit(1)).alias("candidates_considered")]
    for name, predicate in zip(STAGES, stage_predicates(location, budget, cuisine, min_rating), strict=True):
        survives = survives & predicate
        counts.append(F.count_if(survives).alias(name))
    seen = Observation()
    best = (
        catalog.observe(seen, *counts)
        .where(survives)
        .orderBy(*predicates.candidate_order())
        .limit(limit)
        .select(*CATALOG_COLUMNS)
        .collect()
    )
    found = [seen.get[name] for name in ["candidates_considered", *STAGES]]
    return spark.createDataFrame([(*valid, *found, len(best), limit, best)], schema)
