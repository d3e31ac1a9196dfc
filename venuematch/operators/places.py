"""The place that an address names, from a dictionary of any size.

An address names the longest of the dictionary's names that it contains, without regard to case; of equally long ones the
one with the lower position. Each name is sought by one key, the shortest of its beginnings that few names share (or the
whole name), so an address meets a name only where it has that key at some place, and no key leads to more than ``CROWD``
names. Names and addresses are two sides of one equi-join; neither is collected or assumed to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from venuematch.operators.substring_join import substrings
from venuematch.storage import materialize

# Lengths of the beginnings tried as keys, and how many names may share one.
KEY_LENGTHS = (4, 8, 16, 32)
CROWD = 64


def keyed_names(places: DataFrame) -> DataFrame:
    """``(needle, key, choice)``: each different lower-cased name once; the least ``choice`` is the one to take."""
    choice = F.struct((-F.length("name")).alias("shortness"), "position", "place")
    needles = places.where(F.length("name") > 0).groupBy(F.lower("name").alias("needle")).agg(F.min(choice).alias("choice"))
    beginnings = needles.select("needle", F.explode(F.array(*map(F.lit, KEY_LENGTHS))).alias("size")).where(
        F.length("needle") > F.col("size")
    ).withColumn("key", F.left("needle", F.col("size")))
    few = beginnings.groupBy("key").agg(F.count("*").alias("sharing")).where(F.col("sharing") <= CROWD).select("key")
    shortest = beginnings.join(few, "key").groupBy("needle").agg(F.min_by("key", "size").alias("key"))
    return needles.join(shortest, "needle", "left").select("needle", F.coalesce("key", "needle").alias("key"), "choice")


def places_in(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``(text, place)`` for every different ``text`` that contains a name of ``places(name, place, position)``.

    Texts are lower-cased. Null and empty texts and names match nothing. Names that differ by case only, or come twice, count
    as the first of them. Runs two jobs on the dictionary when called: one stores its keys, one reads how long they are.
    """
    names = materialize(keyed_names(places), "places")
    lengths = sorted(r[0] for r in names.select(F.length("key")).distinct().collect())
    different = texts.select("text").where(F.length("text") > 0).distinct()
    # Rows that travel to the names are two numbers; the text is fetched for those that meet one.
    held = [F.transform(substrings(F.col("text"), F.lit(n)), lambda s: F.xxhash64(s)) for n in lengths]
    known = [F.coalesce(keys, F.array().cast("array<bigint>")) for keys in held] or [F.array().cast("array<bigint>")]
    probes = different.select(F.xxhash64("text").alias("text_id"), F.explode(F.array_distinct(F.concat(*known))).alias("key_id"))
    met = probes.join(names.withColumn("key_id", F.xxhash64("key")), "key_id").select("text_id", "needle", "choice")
    found = different.withColumn("text_id", F.xxhash64("text")).join(met, "text_id").where(F.contains("text", "needle"))
    return found.groupBy("text").agg(F.min("choice").alias("choice")).select("text", "choice.place")


def with_place(rows: DataFrame, address: Column, places: DataFrame, name: str = "place") -> DataFrame:
    """``rows`` with the place that their address names, or null; an address that many rows share is read once.

    Rows without an address join nothing and are dealt out by their other columns.
    """
    columns = rows.columns
    hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    packed = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"),
        F.lower(address).alias("text"),
        F.when(address.isNull(), F.xxhash64(*hashed) if hashed else F.lit(1)).otherwise(F.lit(0)).cast("long").alias("spread"),
    )
    # One key of both, or Spark would deal the rows out by the text alone, as the places already are.
    keyed = packed.select("row", F.struct("text", "spread").alias("key"))
    found = places_in(packed, places).select(F.struct("text", F.lit(0).cast("long").alias("spread")).alias("key"), "place")
    placed = keyed.join(found, "key", "left")
    return placed.select(*(F.col("row").getField(c).alias(c) for c in columns if c != name), F.col("place").alias(name))
