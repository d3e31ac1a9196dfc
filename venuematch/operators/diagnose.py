"""Why a preference came back empty, from its funnel counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from venuematch.config import (
    BUDGET_LABELS,
    CAUSE_EXPLANATIONS,
    CAUSE_SUGGESTIONS,
    CAUSE_TITLES,
    MSG_EMPTY_BUDGET,
    MSG_EMPTY_DEFAULT,
    MSG_EMPTY_LOCATION,
    MSG_NOT_LOADED,
)
from venuematch.functions.numbers import round_exact


def empty_message() -> Column:
    """Message of an empty result; null when there are candidates."""
    return (
        F.when(F.col("candidates_considered") == 0, MSG_NOT_LOADED)
        .when(F.col("returned") > 0, F.lit(None).cast("string"))
        .when(F.col("after_location") == 0, F.format_string(MSG_EMPTY_LOCATION, "normalized_location"))
        .when((F.col("after_cuisine") == 0) | (F.col("after_rating") == 0), MSG_EMPTY_DEFAULT)
        .when(F.col("after_budget") == 0, MSG_EMPTY_BUDGET)
        .otherwise(MSG_EMPTY_DEFAULT)
    )


def filters_applied() -> Column:
    """The filters as they were understood; free text is null when there is none."""
    return F.struct(
        F.col("normalized_location").alias("location"),
        "budget",
        "min_rating",
        F.when(F.col("needle") == "", "any").otherwise(F.col("needle")).alias("cuisine"),
        "additional_preferences",
    )


def empty_reasons(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("returned") == 0).select("pref_id", empty_message().alias("message"))


def _one_digit(floor: Column) -> Column:
    """A rating floor with one digit; the one tie that rounding to even would lower goes up."""
    tie = floor - F.floor(floor) == 0.25
    return F.format_string("%.1f", F.when(tie, F.floor(floor) + 0.3).otherwise(round_exact(floor, 1)))


def root_causes(matched: DataFrame) -> DataFrame:
    """The first filter that left nothing, how many rows it started from, why, and what to try instead.

    Only empty results have a row. ``other`` stands for an empty catalog, where no filter is to blame.
    """
    any_cuisine = F.col("needle") == ""
    shown = F.when(any_cuisine, "any").otherwise(F.col("needle"))
    kind = F.when(any_cuisine, "").otherwise(F.concat(F.col("needle"), F.lit(" ")))
    place = F.col("normalized_location")
    bracket = F.when(F.col("budget") == "low", "higher").otherwise("different")

    floor = _one_digit(F.col("min_rating"))
    label = F.coalesce(*[F.when(F.col("budget") == band, text) for band, text in BUDGET_LABELS.items()])

    def found(stage: str, *middle: Column) -> list[Column]:
        """The number of rows, the words before the noun, its plural ending and the place."""
        return [F.col(stage), *middle, F.when(F.col(stage) == 1, "").otherwise("s"), place]

    # Rows before the filter, values of the title, of the explanation, of each suggestion.
    stages = {
        "location": (F.col("candidates_considered"), [place], [place], [[], []]),
        "cuisine": (
            F.col("after_location"),
            [shown, place],
            [*found("after_location"), shown],
            [[F.col("after_location"), place], [shown]],
        ),
        "rating": (F.col("after_cuisine"), [], [*found("after_cuisine", kind), floor], [[], [kind]]),
        "budget": (F.col("after_rating"), [], [*found("after_rating", kind), floor, label], [[bracket], []]),
    }

    def record(
        cause: str, before: Column, title: list[Column], reason: list[Column], advice: list[list[Column]]
    ) -> Column:
        return F.struct(
            F.lit(cause).alias("cause"),
            before.alias("stage_before"),
            F.format_string(CAUSE_TITLES[cause], *title).alias("title"),
            F.format_string(CAUSE_EXPLANATIONS[cause], *reason).alias("explanation"),
            F.array(*[
                F.format_string(template, *values)
                for template, values in zip(CAUSE_SUGGESTIONS[cause], advice, strict=True)
            ]).alias("suggestions"),
        )

    loaded = F.col("candidates_considered") > 0
    diagnosis = F.coalesce(
        *[F.when(loaded & (F.col(f"after_{cause}") == 0), record(cause, *parts)) for cause, parts in stages.items()],
        record("other", F.col("candidates_considered"), [], [], [[], [], []]),
    )
    return (
        matched.where(F.col("returned") == 0)
        .select("pref_id", diagnosis.alias("diagnosis"))
        .select("pref_id", "diagnosis.*")
    )
