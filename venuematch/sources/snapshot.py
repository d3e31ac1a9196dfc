"""The stored catalog: a versioned snapshot, and Parquet files of clean rows made elsewhere."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from venuematch.config import BUDGETS, CATALOG_COLUMNS, SNAPSHOT_VERSION, UNKNOWN
from venuematch.operators.normalize import with_match_keys
from venuematch.sources.listings import with_positions
from venuematch.storage import UNREADABLE, child_names, materialize, modified_at, remove, scratch_folder, touch

logger = logging.getLogger(__name__)

# Builds that stay readable after they are replaced, the newest included.
KEPT_BUILDS = 2

# Earlier builds that a merged one may take files from; with more it is written as a whole.
MAX_LAYERS = 8

_FILE = "_stored_file"


def _home(root: str, version: int) -> str:
    return f"{root}/version={version}"


def _commits(spark: SparkSession, root: str, version: int) -> list[tuple[int, str]]:
    """(number, build) of the committed builds, the newest last."""
    found = [name.split("-", 1) for name in child_names(spark, f"{_home(root, version)}/commits")]
    return sorted((int(number), build) for number, build in found if number.isdigit())


def _current(spark: SparkSession, root: str, version: int) -> str | None:
    """The folder of the newest committed build."""
    commits = _commits(spark, root, version)
    return f"{_home(root, version)}/builds/{commits[-1][1]}" if commits else None


def _commit(spark: SparkSession, root: str, version: int, build: str) -> None:
    """Make a finished build the one that readers see, by one empty file with the next number and the build's name.

    The file is never changed, so a reader sees the build before or this one. The last :data:`KEPT_BUILDS` stay for
    readers that have opened them, and so do builds that they take files from; older ones are removed. One job writes at
    a time.
    """
    home = _home(root, version)
    earlier = _commits(spark, root, version)
    number = earlier[-1][0] + 1 if earlier else 1
    touch(spark, f"{home}/commits/{number:019d}-{build}")
    kept = {name for _, name in _commits(spark, root, version)[-KEPT_BUILDS:]}
    needed = kept.union(*[child_names(spark, f"{home}/builds/{name}/uses") for name in kept])
    for gone, name in earlier:
        if name not in needed:
            remove(spark, f"{home}/builds/{name}")
            remove(spark, f"{home}/commits/{gone:019d}-{name}")


def _write_catalog(catalog: DataFrame, path: str) -> None:
    """One folder per budget band, because every full match asks for one band. Range partitioning keeps each
    city in neighbouring files, so that file statistics skip the others; the id among its keys lets a place
    that holds most of the rows spread over many files.
    """
    keys = ["budget_band", "city_lc", "location_lc", "id"]
    catalog.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("budget_band").parquet(path)


def replace_snapshot(
    catalog: DataFrame,
    stats_of: Callable[[DataFrame], DataFrame],
    root: str,
    version: int = SNAPSHOT_VERSION,
    batch: tuple[str, int] | None = None,
) -> str:
    """Store the catalog and its counters in a folder of their own below ``root/version=N``, then show both at once.

    ``stats_of`` makes the counters from the stored catalog. A failure before the end changes nothing for readers: they
    keep the last finished build, and never see a catalog with other counters. ``batch`` is the name of a stream and the
    number of its batch, for :func:`merged_batch`. Returns the build's folder.
    """
    spark = catalog.sparkSession
    build = uuid.uuid4().hex
    path = f"{_home(root, version)}/builds/{build}"
    try:
        _write_catalog(catalog, f"{path}/catalog")
        # An empty catalog has no files to learn the columns from.
        stats_of(spark.read.schema(catalog.schema).parquet(f"{path}/catalog")).write.parquet(f"{path}/stats")
        _note_batches(spark, path, dict([batch]) if batch else {})
    except BaseException:
        remove(spark, path)
        raise
    _commit(spark, root, version, build)
    return path


def _note_batches(spark: SparkSession, path: str, batches: dict[str, int]) -> None:
    for stream, number in batches.items():
        touch(spark, f"{path}/batches/{stream}-{number}")


def _batches(spark: SparkSession, path: str) -> dict[str, int]:
    found = [name.rsplit("-", 1) for name in child_names(spark, f"{path}/batches")]
    return {stream: int(number) for stream, number in found}


def merged_batch(spark: SparkSession, root: str, stream: str, version: int = SNAPSHOT_VERSION) -> int:
    """The last batch of a stream that the stored catalog holds, or -1. It is shown together with its rows."""
    current = _current(spark, root, version)
    return _batches(spark, current).get(stream, -1) if current else -1


def _place(file: str) -> tuple[str, str]:
    """(build, file below its catalog folder) of a data file's address."""
    build, rest = re.search(r"/builds/([^/]+)/catalog/(.+)$", file).groups()
    return build, rest


def _read_files(spark: SparkSession, home: str, places: Iterable[tuple[str, str]]) -> list[DataFrame]:
    """One frame for each build that the files belong to."""
    by_build: dict[str, list[str]] = {}
    for build, file in sorted(places):
        by_build.setdefault(build, []).append(f"{home}/builds/{build}/catalog/{file}")
    return [
        spark.read.option("basePath", f"{home}/builds/{build}/catalog").parquet(*files) for build, files in by_build.items()
    ]


def _layers(spark: SparkSession, home: str, path: str) -> list[DataFrame]:
    """The stored rows of a build: those of its own files, and of the files that it takes from earlier builds."""
    if not child_names(spark, f"{path}/uses"):
        return [spark.read.parquet(f"{path}/catalog")]
    taken = _read_files(spark, home, [tuple(row) for row in spark.read.parquet(f"{path}/taken").collect()])
    # A merge without named rows leaves no file to learn the columns from.
    return [*taken, spark.read.schema(taken[0].schema).parquet(f"{path}/catalog")]


def merge_snapshot(
    added: DataFrame,
    keys: list[str],
    merge: Callable[[DataFrame], DataFrame],
    stats_of: Callable[[DataFrame, DataFrame, int], DataFrame],
    root: str,
    version: int = SNAPSHOT_VERSION,
    batch: tuple[str, int] | None = None,
) -> str:
    """Merge rows into the stored catalog and write again only the files that hold one of their keys.

    ``added`` has the columns of the catalog and one row per key; ``merge`` makes one row per key of such rows;
    ``stats_of`` gets the stored counters, ``added`` and how many of its keys are new. The other files stay where they
    are: the new build names them, one row per file, as any reader lists them. The stored rows are never shuffled as a
    whole; their keys are joined with those of ``added``. Readers and failures are as in :func:`replace_snapshot`, and
    after :data:`MAX_LAYERS` earlier builds all files are written again.
    """
    spark = added.sparkSession
    home = _home(root, version)
    current = _current(spark, root, version)
    build = uuid.uuid4().hex
    path = f"{home}/builds/{build}"
    layers = _layers(spark, home, current)
    columns = added.columns
    live = {_place(file) for layer in layers for file in layer.inputFiles()}
    with scratch_folder(spark, "merge"):
        try:
            added = materialize(added, "added")
            asked = added.select(*keys)
            placed = [layer.select(*columns, F.col("_metadata.file_path").alias(_FILE)) for layer in layers]
            hits = materialize(reduce(DataFrame.unionByName, placed).join(asked, keys, "left_semi"), "hits")
            touched = {_place(row[0]) for row in hits.select(_FILE).distinct().collect()}
            if len({name for name, _ in live - touched}) > MAX_LAYERS:
                touched = live
            beside = [frame.select(*columns).join(asked, keys, "left_anti") for frame in _read_files(spark, home, touched)]
            merged = merge(hits.select(*columns).unionByName(added)).select(*columns)
            _write_catalog(reduce(DataFrame.unionByName, [merged, *beside]), f"{path}/catalog")
            stats = stats_of(spark.read.parquet(f"{current}/stats"), added, added.count() - hits.count())
            stats.write.parquet(f"{path}/stats")
            taken = sorted(live - touched)
            if taken:
                spark.createDataFrame(taken, "build STRING, file STRING").coalesce(1).write.parquet(f"{path}/taken")
            for name in {name for name, _ in taken}:
                touch(spark, f"{path}/uses/{name}")
            _note_batches(spark, path, _batches(spark, current) | (dict([batch]) if batch else {}))
        except BaseException:
            remove(spark, path)
            raise
    _commit(spark, root, version, build)
    return path


def write_snapshot(catalog: DataFrame, root: str, version: int = SNAPSHOT_VERSION) -> str:
    """Store the catalog without counters and show it; returns the path of the catalog."""
    build = uuid.uuid4().hex
    path = f"{_home(root, version)}/builds/{build}/catalog"
    _write_catalog(catalog, path)
    _commit(catalog.sparkSession, root, version, build)
    return path


def write_snapshot_stats(stats: DataFrame, root: str, version: int = SNAPSHOT_VERSION) -> str:
    """Counters of the newest build, in place of those it has; without a build they are one of their own."""
    spark = stats.sparkSession
    current = _current(spark, root, version)
    build = uuid.uuid4().hex
    path = f"{current or f'{_home(root, version)}/builds/{build}'}/stats"
    stats.write.mode("overwrite").parquet(path)
    if current is None:
        _commit(spark, root, version, build)
    return path


def snapshot_time(spark: SparkSession, root: str, version: int = SNAPSHOT_VERSION) -> int | None:
    current = _current(spark, root, version)
    return current and modified_at(spark, f"{current}/catalog")


def read_snapshot(spark: SparkSession, root: str, version: int = SNAPSHOT_VERSION) -> DataFrame | None:
    """The catalog of this version; null when it is absent, unfinished, unreadable or another version."""
    current = _current(spark, root, version)
    if current is None or modified_at(spark, f"{current}/catalog") is None:
        return None
    try:
        stored = reduce(DataFrame.unionByName, _layers(spark, _home(root, version), current))
        keys = [c for c in stored.columns if c not in CATALOG_COLUMNS]
        return stored.select(*CATALOG_COLUMNS, *keys)
    except UNREADABLE as error:
        logger.warning("unreadable snapshot under %s: %s", root, type(error).__name__)
        return None


def read_snapshot_stats(spark: SparkSession, root: str, version: int = SNAPSHOT_VERSION) -> DataFrame | None:
    current = _current(spark, root, version)
    path = f"{current}/stats"
    return None if current is None or modified_at(spark, path) is None else spark.read.parquet(path)


def _text(name: str) -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.when(F.lower(text) == "nan", "").otherwise(text)


def _text_or_unknown(name: str) -> Column:
    return F.coalesce(F.nullif(_text(name), F.lit("")), F.lit(UNKNOWN))


def _number(name: str) -> Column:
    number = F.col(name).try_cast("double")
    return F.when(~F.isnan(number), number)


def repair_clean_rows(rows: DataFrame) -> DataFrame:
    """Undo what other tools do to nulls: NaN numbers, "nan" texts, blank cuisine or band."""
    absent = [name for name in CATALOG_COLUMNS if name not in rows.columns]
    complete = rows.withColumns({name: F.lit(None).cast("string") for name in absent}) if absent else rows
    repaired = complete.select(
        *[_text(name).alias(name) for name in ["id", "name", "location", "city"]],
        _text_or_unknown("cuisine").alias("cuisine"),
        _number("rating").alias("rating"),
        _number("cost_for_two").try_cast("int").alias("cost_for_two"),
        _text_or_unknown("budget_band").alias("budget_band"),
        *[c for c in ["position"] if c in rows.columns],
    )
    return with_match_keys(repaired)


def read_clean_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """Clean rows from a seed file, with their place in it as ``position``.

    Null when the file is missing, unreadable, empty, or has a budget band that does not exist: such a file was not
    made from a catalog, and the caller has other sources.
    """
    try:
        stored = spark.read.parquet(path)
        known = [c for c in CATALOG_COLUMNS if c in stored.columns]
        rows = with_positions(stored, known).withColumnRenamed("row_index", "position")
        repaired = repair_clean_rows(rows)
        if rows.isEmpty():
            logger.warning("the seed under %s has no rows", path)
            return None
        odd = repaired.where(~F.col("budget_band").isin([*BUDGETS, UNKNOWN])).select("budget_band").first()
    except UNREADABLE as error:
        logger.warning("no readable seed under %s: %s", path, type(error).__name__)
        return None
    if odd is not None:
        logger.warning("the seed under %s has the budget band %r", path, odd["budget_band"])
        return None
    return repaired
