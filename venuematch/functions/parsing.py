"""Parsers for the messy text columns of a listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from venuematch.config import (
    ANY_CUISINE_TOKENS,
    DEFAULTS,
    KNOWN_CITIES,
    LOCATION_ALIASES,
    MAX_COST,
    MAX_FREE_TEXT,
    UNKNOWN,
    Settings,
)
from venuematch.functions.numbers import round_exact
from venuematch.functions.text import blank_to_null, strip, title_case


def number_text(rate: Column) -> Column:
    """First unsigned number in the text, empty when there is none, as in NEW or -."""
    return F.regexp_extract(rate.cast("string"), r"([0-9]+(?:\.[0-9]+)?)", 1)


def digits_only(cost: Column) -> Column:
    return F.regexp_replace(cost.cast("string"), "[^0-9]", "")


def rating_on_five(number: Column) -> Column:
    """0..5 as it is, 5..10 halved, anything higher dropped."""
    return F.when(number <= 5.0, number).when(number <= 10.0, number / 2.0)


def with_rating(rows: DataFrame, rate: Column, name: str = "rating") -> DataFrame:
    """Add the parsed rating. The steps are separate projections so that each runs once per row: as one
    expression the pattern would be matched again for every mention of its result."""
    steps = [
        number_text(rate),
        F.col(name).try_cast("double"),
        rating_on_five(F.col(name)),
        round_exact(F.col(name), 2),
    ]
    return reduce(lambda frame, step: frame.withColumn(name, step), steps, rows)


def with_cost(rows: DataFrame, cost: Column, name: str = "cost_for_two") -> DataFrame:
    """Add the cost: all digits of the text as one number, null when none or above the ceiling."""
    steps = [
        digits_only(cost),
        F.col(name).try_cast("bigint"),
        F.when(F.col(name) <= MAX_COST, F.col(name).cast("int")),
    ]
    return reduce(lambda frame, step: frame.withColumn(name, step), steps, rows)


def budget_band(cost: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(cost.isNull() | (cost <= 0), UNKNOWN)
        .when(cost <= settings.budget_low_max, "low")
        .when(cost <= settings.budget_medium_max, "medium")
        .otherwise("high")
    )


def alias_lookup(key: Column) -> Column:
    """Canonical city of a lower-cased place name, or null."""
    pairs = [F.lit(text) for pair in LOCATION_ALIASES.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def location_target(location: str) -> str:
    """What a single requested place is compared with: its lower-cased canonical name, as a literal."""
    stripped = location.strip()
    return LOCATION_ALIASES.get(stripped.lower(), stripped.title()).lower()


def normalize_location(location: Column) -> Column:
    stripped = strip(location)
    return F.coalesce(alias_lookup(F.lower(stripped)), title_case(stripped))


def extract_city(address_lc: Column) -> Column:
    """Canonical name of the first known city inside the lower-cased address: longer names first, then
    list order."""
    ranked = sorted(KNOWN_CITIES, key=len, reverse=True)
    hits = [
        F.when(F.contains(address_lc, F.lit(city.lower())), LOCATION_ALIASES.get(city.lower(), city))
        for city in ranked
    ]
    return F.coalesce(*hits)


def normalize_cuisine(cuisines: Column) -> Column:
    return F.coalesce(F.lower(blank_to_null(cuisines.cast("string"))), F.lit(UNKNOWN))


def stable_id(name: Column, city: Column, location: Column, row_index: Column) -> Column:
    key = F.concat_ws("|", name, city, location, row_index.cast("string"))
    return F.substring(F.sha2(key, 256), 1, 16)


def is_any_cuisine(cuisine: Column) -> Column:
    return F.lower(strip(cuisine)).isin(ANY_CUISINE_TOKENS)


def free_text(text: Column) -> Column:
    """Stripped, blank becomes null, cut to the length the ranker accepts."""
    return F.substring(blank_to_null(text.cast("string")), 1, MAX_FREE_TEXT)
