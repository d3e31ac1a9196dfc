"""Display fields of candidates and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def result_badges(enveloped: DataFrame) -> DataFrame:
    """How many venues were picked out of how many matches, for answers that have any."""
    picked = F.size("recommendations")
    matches = F.coalesce(
        F.nullif(F.col("metadata.after_budget"), F.lit(0).cast("bigint")), picked.cast("bigint")
    )
    return enveloped.where(F.col("status").isin("success", "partial")).select(
        "pref_id",
        F.format_string("Selected %d restaurants from %d matches!", picked, matches).alias("badge"),
    )


def result_cards(enveloped: DataFrame) -> DataFrame:
    """Display fields, one row per recommendation."""
    rows = enveloped.select("pref_id", F.explode("recommendations").alias("rec")).select(
        "pref_id", "rec.rank", "rec.explanation", "rec.restaurant.*"
    )
    cost = F.col("cost_for_two")
    return rows.select(
        "pref_id",
        "rank",
        "name",
        F.when(F.col("rating").isNull(), "—").otherwise(F.format_string("%.1f", "rating")).alias("rating"),
        F.when(cost.isNull() | (cost == 0), "Price not available")
        .otherwise(F.format_string("₹%d", cost))
        .alias("cost"),
        "cuisine",
        F.concat_ws(", ", "location", "city").alias("place"),
        "explanation",
    )


def preview_lines(rows: DataFrame) -> DataFrame:
    """Catalog rows with one line of text each."""
    cost = F.col("cost_for_two")
    rating = F.coalesce(F.col("rating").cast("string"), F.lit("N/A"))
    price = F.when(cost.isNull() | (cost == 0), "N/A").otherwise(F.format_string("₹%d", cost))
    line = F.format_string("%s | %s | ★%s | %s | %s", "name", "cuisine", rating, price, "budget_band")
    return rows.select("id", line.alias("line"))
