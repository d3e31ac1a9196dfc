"""Listings that keep coming: the stateless normalisation of the batch job, and a catalog that is kept up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from venuematch import schemas
from venuematch.config import DEFAULTS, Settings
from venuematch.operators.normalize import normalize_listings
from venuematch.plans.catalog import add_listings


def read_listing_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """New files of listings that carry their ``row_index``."""
    return spark.readStream.schema(f"row_index BIGINT, {schemas.RAW}").format(fmt).load(path)


def write_clean_stream(
    raw: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Append clean rows for everything that is there, then stop."""
    clean = normalize_listings(raw, settings)
    return (
        clean.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def merge_listing_stream(
    raw: DataFrame, root: str, checkpoint: str, name: str = "listings", settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Bring everything that is there into the stored catalog, then stop. A batch that is run again after a failure is
    not counted twice, because the stored catalog names the last batch in it."""

    def merge(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            add_listings(rows, root, settings, batch=(name, number))

    return (
        raw.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
