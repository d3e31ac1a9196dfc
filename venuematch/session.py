"""Session options this package is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE sizes the shuffles, splits skewed join sides and turns a side that proves small into a broadcast.
# The variant option keeps the last of two equal JSON keys, as common JSON readers do.
OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in OPTIONS.items():
        builder = builder.config(key, value)
    return builder
