"""Exports of the catalog for people and other tools."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from venuematch import schemas
from venuematch.config import CATALOG_COLUMNS
from venuematch.sources.snapshot import read_snapshot
from venuematch.storage import UNREADABLE, modified_at

logger = logging.getLogger(__name__)


def write_csv(catalog: DataFrame, path: str) -> str:
    """All rows with a header, columns in fixed order."""
    catalog.select(*CATALOG_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(catalog: DataFrame, path: str) -> str:
    catalog.select(*CATALOG_COLUMNS).write.mode("overwrite").parquet(path)
    return path


def json_sample(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """The first rows in the order of the source, or all of them."""
    if limit is None:
        return catalog.select(*CATALOG_COLUMNS)
    return catalog.orderBy("position").limit(limit).select(*CATALOG_COLUMNS)


def write_json(catalog: DataFrame, path: str, limit: int | None = None) -> str:
    """JSON lines, null fields written out."""
    sample = json_sample(catalog, limit)
    sample.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def export_preview(catalog: DataFrame, root: str, json_rows: int = 100) -> dict[str, str]:
    """Full CSV, full Parquet and a JSON sample. Pass a stored catalog: each writer scans it once."""
    return {
        "csv": write_csv(catalog, f"{root}/csv"),
        "parquet": write_parquet(catalog, f"{root}/parquet"),
        "json": write_json(catalog, f"{root}/json", json_rows),
    }


def export_snapshot(spark: SparkSession, snapshot_root: str, root: str, json_rows: int = 100) -> dict[str, str]:
    """:func:`export_preview` of a stored snapshot, which must be there."""
    stored = read_snapshot(spark, snapshot_root)
    if stored is None:
        raise FileNotFoundError(f"no catalog snapshot under {snapshot_root}")
    return export_preview(stored, root, json_rows)


def refresh_exports(catalog: DataFrame, root: str, snapshot_time: int) -> list[str]:
    """Rewrite the full exports that are missing or older than the snapshot; returns the names of those written.

    A catalog is usable without its exports, so one that can't be written is only logged.
    """
    writers = {"csv": write_csv, "parquet": write_parquet}
    written = []
    for name, writer in writers.items():
        try:
            time = modified_at(catalog.sparkSession, f"{root}/{name}")
            if time is None or time < snapshot_time:
                writer(catalog, f"{root}/{name}")
                written.append(name)
        except UNREADABLE as error:
            logger.warning("could not refresh the %s export under %s: %s", name, root, type(error).__name__)
    return written


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).option("header", True).csv(path)


def read_json_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).json(path)
