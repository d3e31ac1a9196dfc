"""One row per venue, and the counters that say how the raw rows got there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from venuematch.config import CATALOG_COLUMNS, DEFAULTS, Settings
from venuematch.functions.text import blank_to_null
from venuematch.operators.normalize import MATCH_KEYS, annotate_listings, map_raw_columns, with_match_keys

QUALITY_COLUMNS = [
    "input_rows",
    "rows_normalized",
    "dropped_missing_name",
    "collapsed_duplicates",
    "defaulted_city",
    "output_rows",
    "success_rate",
]


def dedupe_listings(clean: DataFrame) -> DataFrame:
    """Keep the best rated row per (name, city, location); on a tie the earliest row.

    ``max_by`` is aggregated on the map side, so a key that owns a third of all rows still sends only one
    row per map task through the single shuffle. ``position`` is the first appearance of the venue, which
    is its place in catalog order even when a later duplicate replaces the row; ``n_rows`` and
    ``n_defaulted`` let the counters be read off the result. With ``best_index``, where the kept row
    stands, two results for different listings can be merged.
    """
    return merge_venues(
        clean.select(
            *CATALOG_COLUMNS,
            *MATCH_KEYS,
            F.col("row_index").alias("position"),
            F.lit(1).cast("bigint").alias("n_rows"),
            F.col("city_defaulted").cast("bigint").alias("n_defaulted"),
            F.col("row_index").alias("best_index"),
        )
    )


def merge_venues(parts: DataFrame) -> DataFrame:
    """One row per venue from results of :func:`dedupe_listings` for different listings, in any order."""
    best = F.max_by(
        F.struct(*CATALOG_COLUMNS, "best_index"),
        F.struct(F.coalesce("rating", F.lit(0.0)), -F.col("best_index")),
    )
    return (
        parts.groupBy(*MATCH_KEYS)
        .agg(
            best.alias("best"),
            F.min("position").alias("position"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_defaulted").alias("n_defaulted"),
        )
        .select(*[f"best.{c}" for c in CATALOG_COLUMNS], *MATCH_KEYS, "position", "n_rows", "n_defaulted", "best.best_index")
    )


def _report(totals: DataFrame) -> DataFrame:
    """The counter row from its five independent numbers."""
    return totals.select(
        "*",
        (F.col("rows_normalized") + F.col("dropped_missing_name")).alias("input_rows"),
        (F.col("rows_normalized") - F.col("output_rows")).alias("collapsed_duplicates"),
    ).select(
        "*",
        F.when(F.col("input_rows") > 0, F.col("rows_normalized") / F.col("input_rows"))
        .otherwise(0.0)
        .alias("success_rate"),
    ).select(*QUALITY_COLUMNS)


def _sum(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def quality_counters(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of counters straight from the listings. Unnamed rows share one null key; only keys and
    counts are shuffled."""
    named = F.col("name").isNotNull()
    per_venue = (
        with_match_keys(annotate_listings(raw, settings))
        .groupBy(named.alias("named"), *[F.when(named, F.col(key)).alias(key) for key in MATCH_KEYS])
        .agg(F.count("*").alias("n"), F.count_if("city_defaulted").alias("n_defaulted"))
    )
    venue = F.col("named")
    return _report(
        per_venue.agg(
            _sum(F.when(venue, F.col("n"))).alias("rows_normalized"),
            _sum(F.when(~venue, F.col("n"))).alias("dropped_missing_name"),
            _sum(F.when(venue, F.col("n_defaulted"))).alias("defaulted_city"),
            F.count_if(venue).alias("output_rows"),
        )
    )


def catalog_counters(catalog: DataFrame, raw: DataFrame) -> DataFrame:
    """The same row from a stored catalog: of the listings only the name column is read again."""
    unnamed = map_raw_columns(raw).where(blank_to_null(F.col("name")).isNull())
    return _report(
        catalog.agg(
            _sum(F.col("n_rows")).alias("rows_normalized"),
            unnamed.agg(F.count("*")).scalar().alias("dropped_missing_name"),
            _sum(F.col("n_defaulted")).alias("defaulted_city"),
            F.count("*").alias("output_rows"),
        )
    )


def counters_after(stats: DataFrame, added: DataFrame, raw: DataFrame, n_fresh: int) -> DataFrame:
    """The stored counter row brought up to date with ``added``, the venues of the listings ``raw``, of which
    ``n_fresh`` were not stored before. Reads the added listings only."""
    unnamed = map_raw_columns(raw).where(blank_to_null(F.col("name")).isNull())
    sums = added.agg(_sum(F.col("n_rows")).alias("rows"), _sum(F.col("n_defaulted")).alias("defaulted"))
    return _report(
        stats.select(
            (F.col("rows_normalized") + sums.select("rows").scalar()).alias("rows_normalized"),
            (F.col("dropped_missing_name") + unnamed.agg(F.count("*")).scalar()).alias("dropped_missing_name"),
            (F.col("defaulted_city") + sums.select("defaulted").scalar()).alias("defaulted_city"),
            (F.col("output_rows") + F.lit(n_fresh)).alias("output_rows"),
        )
    )
