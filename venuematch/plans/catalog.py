"""Building the catalog and choosing where it comes from."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from venuematch.config import DEFAULTS, SUCCESS_RATE_FLOOR, Settings
from venuematch.operators.dedupe import catalog_counters, counters_after, dedupe_listings, merge_venues
from venuematch.operators.facets import by_city, city_list
from venuematch.operators.normalize import MATCH_KEYS, normalize_listings
from venuematch.sources import exports, snapshot
from venuematch.sources.listings import ListingsError, read_with_retries, require_rows
from venuematch.storage import scratch_path

logger = logging.getLogger(__name__)


def build_catalog(raw: DataFrame, settings: Settings = DEFAULTS, places: DataFrame | None = None) -> DataFrame:
    """Raw listings to one row per venue: one narrow stage, one shuffle.

    With a dictionary of ``places`` the different addresses are joined with it before.
    """
    return dedupe_listings(normalize_listings(raw, settings, places))


def store_catalog(
    raw: DataFrame, root: str | None = None, settings: Settings = DEFAULTS, batch: tuple[str, int] | None = None
) -> DataFrame:
    """Build, check and snapshot the catalog; returns the stored table.

    No listings, or none with a name, is an error; a low share of normalised rows is only logged. An error leaves the
    catalog that was stored before as it was.
    """
    spark = raw.sparkSession
    require_rows(raw, "the source has no rows")
    root = root or scratch_path(spark, "catalog")

    def counted(stored: DataFrame) -> DataFrame:
        if stored.isEmpty():
            raise ListingsError("no listing is left after normalisation")
        return catalog_counters(stored, raw)

    snapshot.replace_snapshot(build_catalog(raw, settings), counted, root, batch=batch)
    rate = snapshot.read_snapshot_stats(spark, root).first()["success_rate"]
    if rate < SUCCESS_RATE_FLOOR:
        logger.warning("only %.1f%% of the listings could be normalised", rate * 100)
    return snapshot.read_snapshot(spark, root)


def add_listings(
    raw: DataFrame,
    root: str,
    settings: Settings = DEFAULTS,
    continued: bool = False,
    batch: tuple[str, int] | None = None,
) -> DataFrame:
    """Bring further listings into the stored catalog and its counters; returns the stored table.

    The result is that of one build from all listings, in whatever parts and order they come. ``continued`` counts the
    positions on from the listings that are stored; otherwise they are those of the listings among all. ``batch`` is the
    name of a stream and the number of its batch: one that is stored already changes nothing. Only files that hold a
    venue of these listings are written again. Without a stored catalog the listings are the first.
    """
    spark = raw.sparkSession
    if batch is not None and batch[1] <= snapshot.merged_batch(spark, root, batch[0]):
        return snapshot.read_snapshot(spark, root)
    stored = snapshot.read_snapshot(spark, root)
    if stored is None:
        return store_catalog(raw, root, settings, batch)
    stats = snapshot.read_snapshot_stats(spark, root)
    if stats is None or "best_index" not in stored.columns:
        raise ListingsError("the stored catalog has no counters or an earlier layout; build it again")
    if continued:
        raw = raw.withColumn("row_index", F.col("row_index") + F.lit(stats.first()["input_rows"]))
    snapshot.merge_snapshot(
        build_catalog(raw, settings),
        MATCH_KEYS,
        merge_venues,
        lambda before, added, n_fresh: counters_after(before, added, raw, n_fresh),
        root,
        batch=batch,
    )
    return snapshot.read_snapshot(spark, root)


def open_catalog(
    spark: SparkSession,
    read_raw: Callable[[], DataFrame],
    root: str,
    seed: str | None = None,
    export_root: str | None = None,
    force_reload: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Snapshot, else seed file, else the raw source; ``force_reload`` goes straight to the raw source, which is tried
    again when it fails to be read."""
    if not force_reload:
        stored = snapshot.read_snapshot(spark, root)
        if stored is not None:
            if export_root:
                exports.refresh_exports(stored, export_root, snapshot.snapshot_time(spark, root))
            return stored
        seeded = snapshot.read_clean_parquet(spark, seed) if seed else None
        if seeded is not None:
            return seeded
    stored = store_catalog(read_with_retries(read_raw), root, settings)
    if export_root:
        exports.refresh_exports(stored, export_root, snapshot.snapshot_time(spark, root))
    return stored


def preview(catalog: DataFrame, n: int) -> DataFrame:
    """The first rows in catalog order."""
    return exports.json_sample(catalog, n)


def data_summary(catalog: DataFrame, stats: DataFrame, city: str, sample: int = 5) -> DataFrame:
    """One row: totals, cities, counters, rows in the given city and its first few rows.

    ``cities`` names all of them.
    """
    local = by_city(catalog, city)
    shown = preview(local, sample).agg(F.collect_list("name").alias("sample_names"))
    cities = city_list(catalog)
    named = cities.agg(F.array_sort(F.collect_list("city")).alias("cities"))
    in_city = local.agg(F.count("*").alias("in_city"))
    return stats.select(
        "*",
        catalog.agg(F.count("*")).scalar().alias("total"),
        cities.agg(F.count("*")).scalar().alias("n_cities"),
        named.scalar().alias("cities"),
        in_city.scalar().alias("in_city"),
        shown.scalar().alias("sample_names"),
    )
