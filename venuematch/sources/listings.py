"""Raw listings with the position every row has in its source."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from venuematch import schemas
from venuematch.storage import materialize

logger = logging.getLogger(__name__)

# A file's entry in the table of offsets is a hash of its path and a number, about 40 bytes in memory. Up to this many,
# 20 MB, are broadcast; a source of more files is joined with them the way that Spark chooses.
BROADCAST_FILES = 500_000


class ListingsError(Exception):
    """The listings cannot be used."""


def read_listings(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    position_column: str | None = None,
    schema: str = schemas.RAW,
    **options: str,
) -> DataFrame:
    """Listings plus ``row_index``, their 0-based position over all files in path order.

    Parquet knows each row's place in its file. CSV and JSON lines with the columns of ``schema`` either carry the
    position in a column, or are numbered by the splits they are read in, see :func:`with_text_positions`.
    """
    if fmt == "parquet":
        frame = spark.read.options(**options).parquet(*([path] if isinstance(path, str) else path))
        if position_column is None:
            return with_positions(frame)
    elif position_column is None:
        return _by_name(with_text_positions(_text_rows(spark, path, fmt, schema, options)), schema)
    else:
        placed = f"`{position_column}` BIGINT, {schema}"
        frame = spark.read.options(**options).schema(placed).format(fmt).load(path)
    kept = [f"`{c}`" for c in frame.columns if c != position_column]
    return frame.select(F.col(f"`{position_column}`").cast("bigint").alias("row_index"), *kept)


def with_positions(frame: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Place in the file plus the number of rows in all files before it, as ``row_index``, with the named columns.

    The row counts come from a scan without columns and are stored, so that their number is known before
    they are broadcast. Up to :data:`BROADCAST_FILES` files, listings are not moved for their position. The running sum
    goes over one row per file. Files are told apart by a hash of their path, checked to be unique.
    """
    columns = [f"`{c}`" for c in names or frame.columns]
    path = F.col("_metadata.file_path").alias("file_path")
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    counted = frame.groupBy(path).agg(F.count("*").alias("n"))
    skipped = counted.select(
        F.xxhash64("file_path").alias("file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped")
    )
    offsets = materialize(skipped, "offsets")
    files, hashes = offsets.agg(F.count("*"), F.count_distinct("file")).first()
    if hashes < files:
        raise ListingsError("two file paths have the same hash; rename one of the files")
    placed = frame.select(F.xxhash64(path).alias("file"), F.col("_metadata.row_index").alias("in_file"), *columns)
    return placed.join(F.broadcast(offsets) if files <= BROADCAST_FILES else offsets, "file").select(
        (F.col("in_file") + F.col("skipped")).alias("row_index"), *columns
    )


def _text_rows(spark: SparkSession, path: str | list[str], fmt: str, schema: str, options: dict[str, str]) -> DataFrame:
    """JSON lines by the names of ``schema``; CSV with a header by its own names, and else in the order of ``schema``."""
    reader = spark.read.options(**options).format(fmt)
    headed = fmt == "csv" and str(options.get("header", "false")).lower() == "true"
    return (reader if headed else reader.schema(schema)).load(path)


def _by_name(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in its types, null where a source has none, and all others as they are."""
    wanted = {field.name: field.dataType for field in StructType.fromDDL(schema)}
    there = [F.col(f"`{c}`").try_cast(wanted[c]).alias(c) if c in wanted else F.col(f"`{c}`") for c in rows.columns]
    return rows.select(*there, *(F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in rows.columns))


def with_text_positions(frame: DataFrame) -> DataFrame:
    """``row_index`` for rows of text files: place in the split plus the rows of all splits before it.

    A task reads a split from its start to its end, but which splits it reads, and in which order, is up to the
    scheduler. So the rows are stored once with their split, (path, start), and their number in the task; the least
    number of a split and its count of rows come from the stored table, and the running sum goes over one row per
    split. Lines must not be broken by quoted line ends (``multiLine`` files are not split, and are numbered as well). A
    column ``row_index`` of the source gives way.
    """
    columns = [f"`{c}`" for c in frame.columns if c != "row_index"]
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    # The nested row keeps the columns apart from these names.
    numbered = frame.select(*split, F.monotonically_increasing_id().alias("number"), F.struct(*columns).alias("row"))
    stored = materialize(numbered, "text-rows")
    splits = stored.groupBy("file", "start").agg(F.min("number").alias("least"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "start", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    return stored.join(materialize(offsets, "offsets"), ["file", "start"]).select(
        (F.col("number") - F.col("least") + F.col("skipped")).alias("row_index"), "row.*"
    )


def require_rows(frame: DataFrame, message: str) -> DataFrame:
    """The same frame, or an error when it is empty; looks at one row only."""
    if frame.isEmpty():
        raise ListingsError(message)
    return frame


def read_with_retries(
    read: Callable[[], DataFrame], attempts: int = 3, wait: Callable[[float], object] = time.sleep
) -> DataFrame:
    """What ``read`` gives, once a job has found a row in it.

    A source that can't be listed or read is tried again after 2, 4, ... seconds, and after the last attempt it is an
    error. One that has no rows, or that ``read`` itself refuses, is an error at once.
    """
    if attempts < 1:
        raise ValueError("attempts must be positive")
    for attempt in range(1, attempts + 1):
        try:
            return require_rows(read(), "the source has no rows")
        except ListingsError:
            raise
        except Exception as error:  # any kind of source may fail for a while in its own way
            logger.warning("attempt %d of %d to read the source failed: %s", attempt, attempts, type(error).__name__)
            if attempt == attempts:
                raise ListingsError(f"the source could not be read in {attempts} attempts") from error
        wait(2.0**attempt)
