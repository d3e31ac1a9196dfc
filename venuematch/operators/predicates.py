"""The four match predicates, for literals and joined columns alike.

Catalog side columns are ``city_lc``, ``location_lc``, ``cuisine``, ``rating`` and ``budget_band``. A null
value gives null, which a filter and ``count_if`` both treat as no match; left plain like this, comparisons
with literals reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from venuematch.config import UNKNOWN


def location_match(target: Column) -> Column:
    return (F.col("city_lc") == target) | F.contains("location_lc", target)


def cuisine_match(needle: Column) -> Column:
    """Literal substring of the whole cuisine text; the empty needle of "any" matches everything."""
    return F.contains(F.lower("cuisine"), needle)


def rating_match(min_rating: Column) -> Column:
    """A floor of zero or less keeps unrated rows, any other floor drops them."""
    return (min_rating <= 0.0) | (F.col("rating") >= min_rating)


def budget_match(budget: Column) -> Column:
    """An unknown band never matches."""
    return (F.col("budget_band") != UNKNOWN) & (F.col("budget_band") == budget)


def candidate_order() -> list[Column]:
    """Best rating first, unrated last, then name and id by code point."""
    return [F.coalesce("rating", F.lit(-1.0)).desc(), F.col("name_lc").asc(), F.col("id").asc()]
