"""Further listings brought into a stored catalog, against one build from all of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests import samples
from tests.test_catalog import listing
from venuematch.operators.dedupe import quality_counters
from venuematch.plans import catalog as plan
from venuematch.sources import snapshot
from venuematch.streaming.listings import merge_listing_stream, read_listing_stream


def listings(spark, seed, n):
    """A third of the rows are one venue, many have equal ratings, some have no name."""
    pick = random.Random(seed)
    return samples.listings(spark, [
        listing(
            "Hot" if pick.random() < 0.34 else pick.choice(["", f"V{pick.randrange(60)}", f" v{pick.randrange(60)} "]),
            pick.choice(["4.1/5", "3.0/5", "NEW", None, "8/10"]),
            address=pick.choice(["x, Mumbai", "y, New Delhi", "z"]),
            cost=str(pick.choice([300, 900, 2000])),
        )
        for _ in range(n)
    ])


def state(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def counters(spark, root):
    return snapshot.read_snapshot_stats(spark, root).first().asDict()


def files(spark, root):
    return set(snapshot.read_snapshot(spark, root).inputFiles())


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_in_any_order_give_one_build(spark, tmp_path, seed):
    raw, root = listings(spark, seed, 400).cache(), str(tmp_path / "store")
    parts = [raw.where(f"row_index * 7 % 400 between {i} and {i + 99}") for i in (300, 0, 200, 100)]
    for part in [*parts, raw.limit(0)]:
        merged = plan.add_listings(part, root)
    assert state(merged) == state(plan.build_catalog(raw))
    assert counters(spark, root) == quality_counters(raw).first().asDict()


def test_positions_count_on(spark, tmp_path):
    raw, root = listings(spark, 3, 200).cache(), str(tmp_path / "store")
    plan.add_listings(raw.where("row_index < 120"), root, continued=True)
    later = raw.where("row_index >= 120").withColumn("row_index", F.col("row_index") - 120)
    assert state(plan.add_listings(later, root, continued=True)) == state(plan.build_catalog(raw))


def test_only_touched_files_are_written_again(spark, tmp_path):
    root = str(tmp_path / "store")
    raw = samples.listings(spark, [listing(f"V{i}", "4/5", address="x, Mumbai" if i % 2 else "y, Pune", cost=str(100 + i)) for i in range(600)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan.store_catalog(raw, root)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = files(spark, root)
    again = raw.where("row_index = 5").withColumns({"row_index": F.lit(600).cast("bigint"), "rate": F.lit("4.9/5")})
    fresh = samples.listings(spark, [listing("New", "3/5")]).withColumn("row_index", F.lit(601).cast("bigint"))
    merged = plan.add_listings(again.unionByName(fresh), root)
    assert state(merged) == state(plan.build_catalog(raw.unionByName(again).unionByName(fresh)))
    assert len(before) > 3 and len(before - files(spark, root)) == 1
    assert counters(spark, root)["output_rows"] == 601 and counters(spark, root)["collapsed_duplicates"] == 1


def test_many_merges_are_written_as_a_whole_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "MAX_LAYERS", 2)
    raw, root = listings(spark, 4, 160).cache(), str(tmp_path / "store")
    for i in range(8):
        opened = plan.add_listings(raw.where(f"row_index % 8 = {i}"), root)
        folders = len(list((tmp_path / "store").glob("version=*/builds/*")))
        # The kept builds, and at most the two that each of them takes files from.
        assert folders <= 3 * snapshot.KEPT_BUILDS
    assert state(opened) == state(plan.build_catalog(raw))
    assert counters(spark, root) == quality_counters(raw).first().asDict()


def test_a_failed_merge_changes_nothing(spark, tmp_path, monkeypatch):
    raw, root = listings(spark, 5, 100).cache(), str(tmp_path / "store")
    opened = plan.add_listings(raw.where("row_index < 60"), root, batch=("s", 0))
    before, counted = state(opened), counters(spark, root)

    def killed(*_):
        assert state(snapshot.read_snapshot(spark, root)) == before
        raise KeyboardInterrupt

    monkeypatch.setattr(plan, "counters_after", killed)
    with pytest.raises(KeyboardInterrupt):
        plan.add_listings(raw.where("row_index >= 60"), root, batch=("s", 1))
    monkeypatch.undo()
    assert state(snapshot.read_snapshot(spark, root)) == before and counters(spark, root) == counted
    assert snapshot.merged_batch(spark, root, "s") == 0
    for _ in range(2):
        merged = plan.add_listings(raw.where("row_index >= 60"), root, batch=("s", 1))
        assert state(merged) == state(plan.build_catalog(raw))
    assert counters(spark, root) == quality_counters(raw).first().asDict()
    # A reader that opened the catalog before the merge goes on.
    assert state(opened) == before


def test_a_stream_keeps_the_catalog_up(spark, tmp_path):
    raw, root, source = listings(spark, 6, 150).cache(), str(tmp_path / "store"), str(tmp_path / "in")
    for i in range(3):
        raw.where(f"row_index % 3 = {i}").coalesce(1).write.mode("append").parquet(source)
        query = merge_listing_stream(read_listing_stream(spark, source), root, str(tmp_path / "log"))
        query.awaitTermination()
        assert query.exception() is None
    assert state(snapshot.read_snapshot(spark, root)) == state(plan.build_catalog(raw))
    assert snapshot.merged_batch(spark, root, "listings") == 2
