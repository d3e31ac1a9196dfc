"""Value lists for choosing a preference, and lookups by city."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from venuematch.config import DEFAULT_CITY, DEFAULT_FACET
from venuematch.functions import parsing
from venuematch.functions.text import strip, title_case
from venuematch.storage import materialize


def city_list(catalog: DataFrame) -> DataFrame:
    return catalog.select("city").distinct().orderBy("city")


def location_facet(catalog: DataFrame) -> DataFrame:
    """Distinct areas of the default city."""
    in_city = (F.col("city_lc") == DEFAULT_CITY.lower()) & (F.col("location") != "")
    return catalog.where(in_city).select("location").distinct().orderBy("location")


def cuisine_facet(catalog: DataFrame) -> DataFrame:
    """Single cuisines in title case with ``Any`` in front.

    Distinct lists come first: splitting and casing then touch the dictionary of lists, not the rows.
    """
    lists = catalog.where(F.col("cuisine") != "").select("cuisine").distinct()
    tokens = lists.select(F.explode(F.split("cuisine", ",")).alias("token"))
    names = tokens.select(strip(F.col("token")).alias("token")).distinct()
    values = names.select(title_case(F.col("token")).alias("cuisine"), F.lit(False).alias("is_any"))
    first = catalog.sparkSession.range(1).select(F.lit("Any").alias("cuisine"), F.lit(True).alias("is_any"))
    listed = values.distinct().unionByName(first)
    return listed.orderBy(F.col("is_any").desc(), "cuisine").select("cuisine", "is_any")


def default_facet(locations: DataFrame) -> DataFrame:
    """The preselected area: the well-known one when it is listed, else the first."""
    preferred = F.max(F.when(F.col("location") == DEFAULT_FACET, F.col("location")))
    return locations.agg(F.coalesce(preferred, F.min("location")).alias("location"))


def by_city(catalog: DataFrame, city: str) -> DataFrame:
    """Rows of one city; aliases and letter case of the request do not matter."""
    return catalog.where(F.col("city_lc") == parsing.location_target(city))


def lookup_cities(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Equi-join form of :func:`by_city` for a table of requested ``city`` values.

    Runs jobs when called. Requests are reduced to distinct targets and these to cities that the catalog has, which are
    stored. However many requests there are, the few cities left decide whether Spark broadcasts them; otherwise both
    join sides are plain shuffles and AQE splits a city that holds most of the rows.
    """
    asked = F.lower(parsing.normalize_location(F.col("city"))).alias("city_lc")
    known = catalog.select("city_lc").distinct()
    targets = materialize(known.join(requests.select(asked).distinct(), "city_lc", "left_semi"), "cities")
    return catalog.join(targets, "city_lc", "left_semi")
