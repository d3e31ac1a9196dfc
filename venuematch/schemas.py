"""DDL of the tables that cross module borders."""

from __future__ import annotations

RAW = (
    "name STRING, address STRING, location STRING, cuisines STRING, rate STRING, "
    "`approx_cost(for two people)` STRING"
)

CATALOG = (
    "id STRING, name STRING, location STRING, city STRING, cuisine STRING, "
    "rating DOUBLE, cost_for_two INT, budget_band STRING"
)

PREFERENCES = (
    "pref_id BIGINT, location STRING, budget STRING, cuisine STRING, min_rating DOUBLE, "
    "additional_preferences STRING"
)

# What a ranker hook takes and gives back.
PROMPTS = "pref_id BIGINT, system STRING, prompt STRING"
RESPONSES = (
    "pref_id BIGINT, raw_response STRING, error_type STRING, error_message STRING, latency_ms DOUBLE"
)
