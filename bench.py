"""Headline timings: one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import inputs, queries
from venuematch.operators.batch import build_match_index, candidate_rows
from venuematch.operators.dedupe import quality_counters
from venuematch.operators.single import funnel_counts, match_one, top_candidates
from venuematch.plans.catalog import build_catalog, store_catalog
from venuematch.plans.recommend import recommend_one, stored_ranker
from venuematch.session import tuned

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def best_of(times: int, action: Callable[[], object]) -> float:
    seconds = []
    for _ in range(times):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    builder = (
        tuned(SparkSession.builder.master(f"local[{CPUS}]"))
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    raw = inputs.listings(spark, SF_DIR)
    catalog = queries.catalog(spark, SF_DIR)
    queries.index(spark, SF_DIR)
    one = queries.ONE_PREFERENCE
    timings = {
        "clean_listings": best_of(3, lambda: run(queries.clean_listings(spark, SF_DIR))),
        "dedupe_catalog": best_of(3, lambda: run(build_catalog(raw))),
        "quality_counters": best_of(3, lambda: run(quality_counters(raw))),
        "store_catalog": best_of(2, lambda: store_catalog(raw)),
        "build_match_index": best_of(2, lambda: build_match_index(catalog)),
        "top_candidates": best_of(5, lambda: top_candidates(catalog, **one).collect()),
        "funnel_one": best_of(5, lambda: funnel_counts(catalog, **one).collect()),
        "match_one": best_of(3, lambda: match_one(catalog, **one).collect()),
        "facet_locations": best_of(3, lambda: run(queries.facets.location_facet(catalog))),
        "facet_cuisines": best_of(3, lambda: run(queries.facets.cuisine_facet(catalog))),
        "batch_match_topn": best_of(3, lambda: run(candidate_rows(queries.match(spark, SF_DIR)))),
    }
    matched = queries.matched(spark, SF_DIR)
    responses = queries.responses(spark, SF_DIR)
    # The single preference has pref_id 0; any stored reply serves for its timing.
    first_reply = responses.limit(1).withColumn("pref_id", F.lit(0).cast("bigint"))
    timings |= {
        "build_prompts": best_of(3, lambda: run(queries.prompts.build_prompts(matched))),
        "parse_responses": best_of(3, lambda: run(queries.replies.parse_replies(responses))),
        "envelopes": best_of(3, lambda: run(queries.enveloped(spark, SF_DIR))),
        "recommend_batch": best_of(2, lambda: run(queries.recommend_batch(spark, SF_DIR))),
        "recommend_one": best_of(3, lambda: recommend_one(catalog, stored_ranker(first_reply), **one).collect()),
    }
    rows = {
        "raw_listings": raw.count(),
        "catalog": catalog.count(),
        "preferences": matched.count(),
        "replies": responses.count(),
    }
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows": rows,
        "preferences_per_second": round(rows["preferences"] / timings["batch_match_topn"], 1),
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
