"""The answer record: status, message, recommendations, warnings and typed metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from venuematch.config import ERROR_ENVELOPES
from venuematch.functions.numbers import round_exact
from venuematch.operators.diagnose import empty_message, filters_applied
from venuematch.operators.replies import reconcile_replies

ENVELOPE_COLUMNS = ["pref_id", "status", "summary", "recommendations", "message", "warnings", "metadata"]


def _by_error(error: Column, part: int, default: Column) -> Column:
    known = {name: entry[part] for name, entry in ERROR_ENVELOPES.items() if entry[part] is not None}
    return F.coalesce(*[F.when(error == name, value) for name, value in known.items()], default)


def error_class(error: Column) -> Column:
    """Error types outside the known ones are treated as unexpected."""
    return F.when(error.isNull() | error.isin(list(ERROR_ENVELOPES)), error).otherwise("Exception")


def error_message(error: Column, own_text: Column) -> Column:
    return _by_error(error, 0, own_text)


def error_was_called(error: Column) -> Column:
    return _by_error(error, 1, F.lit(False))


def metadata_struct(error: Column, was_called: Column, latency: Column) -> Column:
    """Funnel counts and call facts; an error keeps only the call facts and its type."""
    failed = error.isNotNull()

    def unless_failed(name: str, value: Column) -> Column:
        return F.when(~failed, value).alias(name)

    loaded = F.col("candidates_considered") > 0
    stages = ["after_location", "after_cuisine", "after_rating", "after_budget", "returned", "top_n"]
    return F.struct(
        unless_failed("candidates_considered", F.col("candidates_considered")),
        *[unless_failed(stage, F.when(loaded, F.col(stage))) for stage in stages],
        unless_failed("filters_applied", filters_applied()),
        was_called.alias("llm_called"),
        latency.alias("llm_latency_ms"),
        error.alias("error_type"),
        F.when(error == "Exception", F.col("error_message")).alias("error"),
    )


def envelopes(matched: DataFrame, responses: DataFrame) -> DataFrame:
    """One envelope per matched preference.

    ``responses`` is the ranker's table ``(pref_id, raw_response, error_type, error_message, latency_ms)``,
    one row per asked preference. It is joined once on ``pref_id``; all else happens within the row. Replies are small
    beside the cards of a match, so they are hashed and the matches stream by, instead of both being sorted.
    """
    joined = matched.join(responses.hint("shuffle_hash"), "pref_id", "left")
    empty = F.size("candidates") == 0
    answered = reconcile_replies(joined)
    error = error_class(
        F.when(empty, F.lit(None).cast("string"))
        .when(F.col("error_type").isNotNull(), F.col("error_type"))
        .when(F.col("raw_response").isNull(), "Exception")
        .when(F.col("reply_error") == "parse", "LLMParseError")
        .when(F.col("reply_error") == "rank", "Exception")
    )
    judged = answered.withColumns({"error": error, "is_empty": empty})
    failed = F.col("error").isNotNull()
    silent = failed | F.col("is_empty")
    own_text = F.coalesce("error_message", F.lit(""))
    no_text = F.array().cast("array<string>")
    recommendations = judged.schema["recommendations"].dataType.simpleString()
    return judged.select(
        "pref_id",
        F.when(failed, "error")
        .when(F.col("is_empty"), "empty")
        .when(F.size("warnings") > 0, "partial")
        .otherwise("success")
        .alias("status"),
        F.when(~silent, F.col("summary")).alias("summary"),
        F.when(~silent, F.col("recommendations"))
        .otherwise(F.array().cast(recommendations))
        .alias("recommendations"),
        F.when(failed, error_message(F.col("error"), own_text))
        .when(F.col("is_empty"), empty_message())
        .alias("message"),
        F.when(~silent, F.col("warnings")).otherwise(no_text).alias("warnings"),
        metadata_struct(
            F.col("error"),
            F.when(failed, error_was_called(F.col("error"))).otherwise(~F.col("is_empty")),
            F.when(~silent, round_exact(F.col("latency_ms"), 1)),
        ).alias("metadata"),
    )
