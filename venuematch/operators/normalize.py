"""Raw listings to clean rows, one listing in and at most one out, with no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from venuematch.config import CATALOG_COLUMNS, DEFAULT_CITY, DEFAULTS, RAW_COLUMNS, Settings
from venuematch.functions import parsing
from venuematch.functions.text import blank_to_null
from venuematch.operators.places import with_place

MATCH_KEYS = ["name_lc", "city_lc", "location_lc"]
CLEAN_COLUMNS = ["row_index", *CATALOG_COLUMNS, *MATCH_KEYS, "city_defaulted"]


def map_raw_columns(raw: DataFrame) -> DataFrame:
    """The six used source columns under canonical names; a missing one is null, the rest are pruned."""
    present = set(raw.columns)
    mapped = [
        (F.col(f"`{source}`") if source in present else F.lit(None)).cast("string").alias(target)
        for target, source in RAW_COLUMNS.items()
    ]
    return raw.select("row_index", *mapped)


def annotate_listings(raw: DataFrame, settings: Settings = DEFAULTS, places: DataFrame | None = None) -> DataFrame:
    """Every row normalised, unnamed ones included (``name`` is null there), plus ``city_defaulted``.

    Cities are the known ones, or those of a dictionary ``places(name, place, position)``.

    Written as a chain of projections so that each parser runs once although its result is used often.
    """
    stripped = map_raw_columns(raw).select(
        "row_index",
        blank_to_null(F.col("name")).alias("name"),
        blank_to_null(F.col("location")).alias("area"),
        F.lower("address").alias("address_lc"),
        parsing.normalize_cuisine(F.col("cuisines")).alias("cuisine"),
        "rate",
        "cost",
    )
    parsed = parsing.with_cost(parsing.with_rating(stripped, F.col("rate")), F.col("cost"))
    if places is None:
        located = parsed.withColumn("found_city", parsing.extract_city(F.col("address_lc")))
    else:
        located = with_place(parsed, F.col("address_lc"), places, "found_city")
    settled = located.withColumns({
        "city": F.coalesce("found_city", F.lit(DEFAULT_CITY)),
        "city_defaulted": F.col("found_city").isNull(),
    })
    return settled.select(
        "row_index",
        "name",
        F.coalesce("area", "city").alias("location"),
        "city",
        "city_defaulted",
        "cuisine",
        "rating",
        "cost_for_two",
        parsing.budget_band(F.col("cost_for_two"), settings).alias("budget_band"),
    )


def with_match_keys(rows: DataFrame) -> DataFrame:
    """Add the lower-cased columns that filters and joins compare."""
    return rows.withColumns(
        {
            "name_lc": F.lower("name"),
            "city_lc": F.lower("city"),
            "location_lc": F.lower("location"),
        }
    )


def normalize_listings(raw: DataFrame, settings: Settings = DEFAULTS, places: DataFrame | None = None) -> DataFrame:
    """Named rows only, with their stable id and match keys."""
    named = annotate_listings(raw, settings, places).where(F.col("name").isNotNull())
    identified = named.withColumn(
        "id", parsing.stable_id(F.col("name"), F.col("city"), F.col("location"), F.col("row_index"))
    )
    return with_match_keys(identified).select(*CLEAN_COLUMNS)
