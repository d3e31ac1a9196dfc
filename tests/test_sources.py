from __future__ import annotations

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from tests import samples
from tests.test_catalog import listing
from venuematch import schemas
from venuematch.config import CATALOG_COLUMNS
from venuematch.operators.normalize import normalize_listings
from venuematch.plans.catalog import build_catalog, open_catalog
from venuematch.sources import exports, listings as listing_source, snapshot
from venuematch.sources.listings import ListingsError, read_listings, read_with_retries
from venuematch.storage import modified_at
from venuematch.streaming.listings import read_listing_stream, write_clean_stream


def rows_of(frame):
    return sorted(map(tuple, frame.select(*CATALOG_COLUMNS).collect()), key=str)


def test_positions_run_over_all_files(spark, tmp_path):
    for part, size in enumerate([3, 1, 4]):
        start = [0, 3, 4][part]
        names = [(f"V{start + i}",) for i in range(size)]
        spark.createDataFrame(names, "name STRING").coalesce(1).write.parquet(str(tmp_path / f"part={part}"))
    paths = [str(tmp_path / f"part={part}") for part in range(3)]
    rows = read_listings(spark, paths).collect()
    assert sorted((r.row_index, r.name) for r in rows) == [(i, f"V{i}") for i in range(8)]


def test_text_formats_carry_their_position(spark, tmp_path):
    target = tmp_path / "raw.csv"
    target.write_text('at,name,address,location,cuisines,rate,approx_cost(for two people)\n5,"A, B",x,,Cafe,4/5,"1,200"\n', encoding="utf-8")
    row = read_listings(spark, str(target), "csv", position_column="at", header="true").first()
    assert (row.row_index, row.name, row["approx_cost(for two people)"]) == (5, "A, B", "1,200")
    (tmp_path / "raw.json").write_text(json.dumps({"at": 7, "name": "A", "rate": "4/5"}), encoding="utf-8")
    row = read_listings(spark, str(tmp_path / "raw.json"), "json", position_column="at").first()
    assert (row.row_index, row.name, row.address) == (7, "A", None)
    # Without a position column rows are numbered, and columns found by their names.
    row = read_listings(spark, str(target), "csv", header="true").first()
    assert (row.row_index, row.name, row["approx_cost(for two people)"], row.at) == (0, "A, B", "1,200", "5")
    (tmp_path / "few.csv").write_text("rate,name\n4/5,A\n", encoding="utf-8")
    row = read_listings(spark, str(tmp_path / "few.csv"), "csv", header="true").first()
    assert (row.row_index, row.name, row.rate, row.address) == (0, "A", "4/5", None)


def test_exports_round_trip(spark, tmp_path):
    venues = [*samples.VENUES, ("7", 'Quote "x", é', "", "Pune", "thai", None, 0, "unknown")]
    catalog = samples.catalog(spark, venues)
    paths = exports.export_preview(catalog, str(tmp_path), json_rows=3)
    assert rows_of(spark.read.parquet(paths["parquet"])) == rows_of(catalog)
    csv = exports.read_csv_export(spark, paths["csv"]).fillna("", subset=["location"])
    assert rows_of(csv) == rows_of(catalog)
    header = next(pathlib.Path(paths["csv"]).glob("part-*.csv")).read_text(encoding="utf-8").splitlines()[0]
    assert header.split(",") == CATALOG_COLUMNS
    text = "".join(p.read_text(encoding="utf-8") for p in pathlib.Path(paths["json"]).glob("part-*.json"))
    assert [json.loads(line)["id"] for line in text.splitlines()] == ["1", "2", "3"]
    exports.write_json(catalog, str(tmp_path / "all"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "all").glob("part-*.json"))
    assert '"rating":null' in text and "é" in text and len(text.splitlines()) == 7


def test_snapshot_versions(spark, tmp_path):
    catalog = samples.catalog(spark, samples.VENUES)
    root = str(tmp_path / "store")
    assert snapshot.read_snapshot(spark, root) is None
    snapshot.write_snapshot(catalog, root)
    assert snapshot.read_snapshot_stats(spark, root) is None
    snapshot.write_snapshot_stats(spark.range(1), root)
    assert rows_of(snapshot.read_snapshot(spark, root)) == rows_of(catalog)
    assert snapshot.read_snapshot(spark, root, version=2) is None
    assert snapshot.read_snapshot_stats(spark, root).count() == 1
    assert snapshot.read_snapshot_stats(spark, root, version=2) is None
    for part in (tmp_path / "store").rglob("*.parquet"):
        part.write_bytes(b"broken")
    for crc in (tmp_path / "store").rglob("*.crc"):
        crc.write_bytes(b"")
    assert snapshot.read_snapshot(spark, root) is None


def test_repair(spark, tmp_path):
    nan = float("nan")
    rows = [("1", "A", "nan", None, "NaN", nan, nan, ""), ("2", "B", "x", "y", "thai", 4.0, 800.0, "low")]
    path = str(tmp_path / "seed")
    spark.createDataFrame(rows, "id STRING, name STRING, location STRING, city STRING, cuisine STRING, rating DOUBLE, cost_for_two DOUBLE, budget_band STRING").write.parquet(path)
    assert rows_of(snapshot.read_clean_parquet(spark, path)) == [
        ("1", "A", "", "", "unknown", None, None, "unknown"), ("2", "B", "x", "y", "thai", 4.0, 800, "low"),
    ]
    assert snapshot.read_clean_parquet(spark, str(tmp_path / "none")) is None
    spark.createDataFrame([], schemas.CATALOG).write.parquet(str(tmp_path / "empty"))
    assert snapshot.read_clean_parquet(spark, str(tmp_path / "empty")) is None


def test_source_chain(spark, tmp_path):
    root, seed, out = (str(tmp_path / name) for name in ["store", "seed", "out"])
    calls = []

    def read_raw():
        calls.append(1)
        return samples.listings(spark, [listing("Raw")])

    def names(**options):
        return [r.name for r in open_catalog(spark, read_raw, root, seed=seed, export_root=out, **options).collect()]

    samples.catalog(spark, samples.VENUES[:1]).write.parquet(seed)
    assert names() == ["Salt Harbour"] and not calls
    assert names(force_reload=True) == ["Raw"] and len(calls) == 1
    assert names() == ["Raw"] and len(calls) == 1
    assert exports.read_csv_export(spark, f"{out}/csv").first().name == "Raw"


def test_only_stale_exports_are_rewritten(spark, tmp_path):
    catalog = samples.catalog(spark, samples.VENUES)
    root = str(tmp_path)
    assert exports.refresh_exports(catalog, root, 0) == ["csv", "parquet"]
    assert exports.refresh_exports(catalog, root, 0) == []
    later = modified_at(spark, f"{root}/csv") + 60_000
    assert exports.refresh_exports(catalog, root, later) == ["csv", "parquet"]


def test_stream_equals_batch(spark, tmp_path):
    raw = samples.listings(spark, [listing(f"V{i}", f"{i % 5}/5") for i in range(20)] + [listing("")])
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    raw.write.parquet(source)
    query = write_clean_stream(read_listing_stream(spark, source), target, str(tmp_path / "log"))
    query.awaitTermination(120)
    streamed = spark.read.parquet(target)
    assert rows_of(streamed) == rows_of(normalize_listings(raw))
    assert streamed.where(F.col("name") == "").isEmpty()
    assert build_catalog(raw).count() == 20


def test_a_failed_rebuild_leaves_the_stored_build(spark, tmp_path):
    root, catalog = str(tmp_path / "store"), samples.catalog(spark, samples.VENUES)
    counted = lambda stored: stored.agg(F.count("*").alias("n"))
    few = catalog.where("id <= '3'")
    snapshot.replace_snapshot(few, counted, root)
    opened = snapshot.read_snapshot(spark, root)

    def killed(stored):
        # The new catalog is written, its counters are not; readers still see the old build as a whole.
        assert rows_of(stored.select(*opened.columns)) == rows_of(catalog.select(*opened.columns))
        assert rows_of(snapshot.read_snapshot(spark, root)) == rows_of(few)
        assert snapshot.read_snapshot_stats(spark, root).first()["n"] == few.count()
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        snapshot.replace_snapshot(catalog, killed, root)
    assert rows_of(snapshot.read_snapshot(spark, root)) == rows_of(few)
    assert len(list((tmp_path / "store").glob("version=*/builds/*"))) == 1
    # A rebuild may read the build that it replaces, and a reader that opened it goes on.
    snapshot.replace_snapshot(snapshot.read_snapshot(spark, root).unionByName(catalog.where("id > '3'").select(*opened.columns)), counted, root)
    assert rows_of(opened) == rows_of(few)
    assert rows_of(snapshot.read_snapshot(spark, root)) == rows_of(catalog)
    assert snapshot.read_snapshot_stats(spark, root).first()["n"] == catalog.count()
    snapshot.replace_snapshot(few, counted, root)
    assert len(list((tmp_path / "store").glob("version=*/builds/*"))) == snapshot.KEPT_BUILDS
    assert rows_of(snapshot.read_snapshot(spark, root)) == rows_of(few)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_rows_of_text_files_are_numbered_in_their_order(spark, tmp_path, fmt):
    sizes = {"b": 700, "a": 1, "c": 0, "d": 2500, "e": 1}
    n = 0
    for name in sorted(sizes):
        numbers = range(n, n := n + sizes[name])
        lines = [json.dumps({"name": f"v{i}", "rate": str(i), "row_index": "own"}) if fmt == "json" else f'v{i},{i},"own, x"' for i in numbers]
        head = ["name,rate,row_index"] if fmt == "csv" else []
        (tmp_path / f"{name}.{fmt}").write_text("".join(f"{line}\n" for line in head + lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        frame = spark.read.option("header", "true").schema("name STRING, rate STRING").format(fmt).load(str(tmp_path))
        assert frame.rdd.getNumPartitions() > 20
        got = read_listings(spark, str(tmp_path), fmt, schema="name STRING, rate STRING", header="true").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["row_index"], r["name"], r["rate"]) for r in got) == [(i, f"v{i}", str(i)) for i in range(n)]


def test_a_source_is_tried_again_only_when_it_fails(spark, tmp_path):
    good, waits, asked = samples.listings(spark, [listing("A")]), [], []

    def failing(times, then):
        asked.clear(), waits.clear()

        def read():
            asked.append(1)
            if len(asked) <= times:
                # Read by the probe only: the folder is there when the frame is made, its file isn't a Parquet file.
                (tmp_path / "broken").mkdir(exist_ok=True)
                (tmp_path / "broken" / "part.parquet").write_text("no table")
                return spark.read.schema(schemas.RAW).parquet(str(tmp_path / "broken")).withColumn("row_index", F.lit(0))
            return then

        return read

    assert read_with_retries(failing(2, good), wait=waits.append).count() == 1
    assert (len(asked), waits) == (3, [2.0, 4.0])
    with pytest.raises(ListingsError, match="3 attempts"):
        read_with_retries(failing(5, good), wait=waits.append)
    assert (len(asked), waits) == (3, [2.0, 4.0])
    with pytest.raises(ListingsError, match="no rows"):
        read_with_retries(failing(0, good.limit(0)), wait=waits.append)
    assert (len(asked), waits) == (1, [])
    with pytest.raises(ListingsError):
        read_with_retries(lambda: spark.read.parquet(str(tmp_path / "absent")), attempts=2, wait=waits.append)
    assert waits == [2.0]


def test_positions_without_a_broadcast_are_the_same(spark, tmp_path, monkeypatch):
    for part in range(4):
        spark.range(part * 5, part * 5 + 5, numPartitions=1).write.parquet(str(tmp_path / f"part={part}"))
    monkeypatch.setattr(listing_source, "BROADCAST_FILES", 3)
    rows = read_listings(spark, [str(tmp_path / f"part={part}") for part in range(4)]).collect()
    assert sorted((r.row_index, r.id) for r in rows) == [(i, i) for i in range(20)]
