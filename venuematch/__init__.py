"""Spark-native preference matching: clean listings, match preference tables, reconcile replies."""

from venuematch.config import Settings

__all__ = ["Settings"]
