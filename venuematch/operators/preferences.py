"""Validation and normalisation of a table of preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from venuematch.config import BUDGETS
from venuematch.functions import parsing
from venuematch.functions.text import blank_to_null

PREFERENCE_COLUMNS = ["pref_id", "location", "budget", "cuisine", "min_rating", "additional_preferences"]
DERIVED_COLUMNS = ["normalized_location", "target", "needle"]


def _broken(rule, code: str):
    return F.when(F.coalesce(rule, F.lit(True)), F.lit(code))


def check_preferences(prefs: DataFrame) -> DataFrame:
    """Clean every preference and list the rules it breaks in ``errors``.

    ``target`` is the lower-cased canonical place, ``needle`` the cuisine text to look for; any-cuisine
    tokens become the empty needle, which every cuisine contains.
    """
    absent = F.lit(None).cast("string")
    free_text = F.col("additional_preferences") if "additional_preferences" in prefs.columns else absent
    rating_is_text = dict(prefs.dtypes).get("min_rating") == "string"
    given = F.col("min_rating") if "min_rating" in prefs.columns else F.lit(None).cast("double")
    unreadable = given.isNotNull() & given.try_cast("double").isNull() if rating_is_text else F.lit(False)
    cleaned = prefs.select(
        "pref_id",
        blank_to_null(F.col("location")).alias("location"),
        "budget",
        blank_to_null(F.col("cuisine")).alias("cuisine"),
        F.coalesce(given.try_cast("double"), F.lit(0.0)).alias("min_rating"),
        parsing.free_text(free_text).alias("additional_preferences"),
        unreadable.alias("unreadable"),
    )
    rating = F.col("min_rating")
    errors = F.array_compact(
        F.array(
            _broken(F.col("location").isNull(), "location_blank"),
            _broken(~F.col("budget").isin(BUDGETS), "budget_invalid"),
            _broken(F.col("cuisine").isNull(), "cuisine_blank"),
            _broken(F.col("unreadable") | (rating < 0.0) | (rating > 5.0), "min_rating_out_of_range"),
        )
    )
    located = cleaned.select(
        *PREFERENCE_COLUMNS,
        parsing.normalize_location(F.col("location")).alias("normalized_location"),
        errors.alias("errors"),
    )
    needle = F.when(parsing.is_any_cuisine(F.col("cuisine")), "").otherwise(F.lower("cuisine"))
    return located.select(
        *PREFERENCE_COLUMNS,
        "normalized_location",
        F.lower("normalized_location").alias("target"),
        needle.alias("needle"),
        "errors",
    )


def valid_preferences(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def rejected_preferences(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0).select("pref_id", "errors")
