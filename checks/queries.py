"""One query per operator over the driver's tables, each on all of their rows.

Shared inputs (stored catalog, match index, matches, replies, envelopes) are built once per session and
folder, the way a job would reuse its stored tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from checks import inputs
from venuematch.config import CATALOG_COLUMNS
from venuematch.functions import parsing
from venuematch.functions.numbers import round_exact
from venuematch.functions.once import settled
from venuematch.functions.text import strip, title_case
from venuematch.operators import diagnose, display, envelope, facets, predicates, preferences, prompts, replies
from venuematch.operators.batch import COUNTS, FILE_ROWS, MatchIndex, build_match_index, candidate_rows, match_batch
from venuematch.operators.dedupe import catalog_counters, quality_counters
from venuematch.operators.normalize import annotate_listings, map_raw_columns, normalize_listings
from venuematch.operators.places import with_place
from venuematch.operators.single import funnel_counts, match_one, top_candidates
from venuematch.plans import catalog as catalog_plan, recommend
from venuematch.sources import exports, listings as listing_source, snapshot
from venuematch.storage import materialize, modified_at, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

ONE_PREFERENCE = {"location": "Bengaluru", "budget": "medium", "cuisine": "Indian", "min_rating": 3.5}

_stored: dict[tuple[str, str, str], object] = {}


def _shared(name: str, spark: SparkSession, sf_dir: str, build: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived listings, joined once for all that is built from them, in files that many tasks read."""
    return _shared("listings", spark, sf_dir, lambda: materialize(inputs.listings(spark, sf_dir), "listings", 50_000))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("catalog", spark, sf_dir, lambda: catalog_plan.store_catalog(listings(spark, sf_dir)))


def index(spark: SparkSession, sf_dir: str) -> MatchIndex:
    return _shared("index", spark, sf_dir, lambda: build_match_index(catalog(spark, sf_dir)))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.check_preferences(inputs.preferences(spark, sf_dir))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.valid_preferences(checked(spark, sf_dir))


def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_batch(index(spark, sf_dir), valid(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared("matched", spark, sf_dir, lambda: materialize(match(spark, sf_dir), "matched", FILE_ROWS))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return materialize(inputs.responses(candidate_rows(matched(spark, sf_dir))), "replies", FILE_ROWS)

    return _shared("responses", spark, sf_dir, build)


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = matched(spark, sf_dir).join(responses(spark, sf_dir).hint("shuffle_hash"), "pref_id")
    return replies.reconcile_replies(joined)


def enveloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.envelopes(matched(spark, sf_dir), responses(spark, sf_dir))


def _cards(frame: DataFrame) -> DataFrame:
    return frame.select(*CATALOG_COLUMNS)


# scans and sinks


def scan_positions(spark, sf_dir):
    return listing_source.read_listings(spark, f"{sf_dir}/orders.parquet").select("row_index", "o_orderkey")


def text_positions(spark, sf_dir):
    """CSV and JSON copies of a table, in many files, numbered again without a position column."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    ordered = orders.repartitionByRange(12, "o_orderkey").sortWithinPartitions("o_orderkey")
    found = []
    for fmt in ("csv", "json"):
        path = scratch_path(spark, fmt)
        ordered.write.format(fmt).option("header", "true").save(path)
        rows = listing_source.read_listings(spark, path, fmt, schema="o_orderkey BIGINT, o_orderstatus STRING", header="true")
        found.append(rows.select(F.lit(fmt).alias("format"), "row_index", "o_orderkey"))
    return found[0].union(found[1])


def replaced_snapshot(spark, sf_dir):
    """A stored catalog, a rebuild that fails after its catalog is written, and a rebuild that replaces it."""
    root = scratch_path(spark, "replaced")
    store = catalog(spark, sf_dir)
    counted = lambda stored: stored.agg(F.count("*").alias("n_stored"))

    def failing(stored):
        raise InterruptedError

    snapshot.replace_snapshot(store.where("id < '8'"), counted, root)
    try:
        snapshot.replace_snapshot(store.where("id >= '8'"), failing, root)
    except InterruptedError:
        before = snapshot.read_snapshot(spark, root)
        snapshot.replace_snapshot(before.unionByName(store.where("id >= '8'")), counted, root)
    stats = snapshot.read_snapshot_stats(spark, root).first()["n_stored"]
    return _cards(snapshot.read_snapshot(spark, root)).withColumn("n_stored", F.lit(stats))


def merged_root(spark: SparkSession, sf_dir: str) -> str:
    """A catalog of the listings with odd positions, to which the others are added in two parts."""

    def build() -> str:
        root = scratch_path(spark, "merged")
        rows = listings(spark, sf_dir)
        catalog_plan.store_catalog(rows.where("row_index % 2 = 1"), root)
        for part in ("row_index % 4 = 2", "row_index % 4 = 0"):
            catalog_plan.add_listings(rows.where(part), root)
        return root

    return _shared("merged", spark, sf_dir, build)


def csv_export(spark, sf_dir):
    path = exports.write_csv(catalog(spark, sf_dir), scratch_path(spark, "csv"))
    return exports.read_csv_export(spark, path)


def parquet_export(spark, sf_dir):
    return spark.read.parquet(exports.write_parquet(catalog(spark, sf_dir), scratch_path(spark, "parquet")))


def json_sample(spark, sf_dir):
    path = exports.write_json(catalog(spark, sf_dir), scratch_path(spark, "json"), limit=100)
    return exports.read_json_export(spark, path)


def export_preview(spark, sf_dir):
    paths = exports.export_preview(catalog(spark, sf_dir), scratch_path(spark, "preview"))
    readers = {"csv": exports.read_csv_export, "json": exports.read_json_export}
    counts = [
        readers.get(name, lambda s, p: s.read.parquet(p))(spark, path)
        .agg(F.count("*").alias("n"))
        .select(F.lit(name).alias("format"), "n")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def snapshot_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "snapshot")
    snapshot.write_snapshot(catalog_plan.build_catalog(inputs.listings(spark, sf_dir)), root)
    return _cards(snapshot.read_snapshot(spark, root))


def snapshot_stats(spark, sf_dir):
    root = scratch_path(spark, "snapshot")
    counters = catalog_counters(catalog(spark, sf_dir), inputs.listings(spark, sf_dir))
    snapshot.write_snapshot_stats(counters, root)
    return snapshot.read_snapshot_stats(spark, root)


def seed_repair(spark, sf_dir):
    """Damage the nulls the way other tools do, store, and read back through the repair."""
    damaged = _cards(catalog(spark, sf_dir)).withColumns({
        "rating": F.coalesce("rating", F.lit(float("nan"))),
        "cost_for_two": F.coalesce(F.col("cost_for_two").cast("double"), F.lit(float("nan"))),
        "cuisine": F.when(F.col("cuisine") == "unknown", "NaN").otherwise(F.col("cuisine")),
        "budget_band": F.when(F.col("budget_band") == "unknown", "").otherwise(F.col("budget_band")),
    })
    path = scratch_path(spark, "seed")
    damaged.write.parquet(path)
    return _cards(snapshot.read_clean_parquet(spark, path))


def source_fallback(spark, sf_dir):
    """No snapshot and no seed, so the raw source is read; the second call finds the snapshot."""
    root = scratch_path(spark, "fallback")
    for _ in range(2):
        opened = catalog_plan.open_catalog(
            spark, lambda: inputs.listings(spark, sf_dir), root, seed=f"{root}/no-seed"
        )
    return _cards(opened)


def stale_exports(spark, sf_dir):
    root = scratch_path(spark, "exports")
    store = catalog(spark, sf_dir)
    exports.refresh_exports(store, root, snapshot_time=0)
    exports.refresh_exports(store, root, snapshot_time=modified_at(spark, f"{root}/csv") + 1)
    return exports.read_csv_export(spark, f"{root}/csv")


# scalar projections


def strip_text(spark, sf_dir):
    raw = map_raw_columns(inputs.listings(spark, sf_dir))
    return raw.select("row_index", *[strip(F.col(c)).alias(c) for c in ["name", "address", "location"]])


def _annotated(*columns: str) -> Query:
    return lambda spark, sf_dir: annotate_listings(inputs.listings(spark, sf_dir)).select("row_index", *columns)


def _raw(**columns) -> Query:
    def query(spark, sf_dir):
        raw = map_raw_columns(inputs.listings(spark, sf_dir))
        return raw.select("row_index", *[make().alias(name) for name, make in columns.items()])

    return query


def parse_rating(spark, sf_dir):
    raw = map_raw_columns(inputs.listings(spark, sf_dir))
    return parsing.with_rating(raw, F.col("rate")).select("row_index", "rating")


def parse_cost(spark, sf_dir):
    raw = map_raw_columns(inputs.listings(spark, sf_dir))
    return parsing.with_cost(raw, F.col("cost")).select("row_index", "cost_for_two")


def find_places(spark, sf_dir):
    rows, places = inputs.addresses_and_places(spark, sf_dir)
    return with_place(rows, F.col("address"), places)


def alias_location(spark, sf_dir):
    location = parsing.normalize_location(F.col("location"))
    return inputs.preferences(spark, sf_dir).select("pref_id", location.alias("normalized_location"))


def title_case_query(spark, sf_dir):
    text = F.concat("p_name", F.lit("-"), F.lower("p_type"), F.lit("'s "), "p_brand")
    return inputs.table(spark, sf_dir, "part").select("p_partkey", title_case(text).alias("titled"))


def clean_listings(spark, sf_dir):
    return normalize_listings(inputs.listings(spark, sf_dir)).select("row_index", *CATALOG_COLUMNS)


def any_cuisine(spark, sf_dir):
    prefs = inputs.preferences(spark, sf_dir)
    return prefs.select("pref_id", parsing.is_any_cuisine(F.col("cuisine")).alias("is_any"))


def round_exact_query(spark, sf_dir):
    prices = inputs.table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 8).alias("price"))
    return prices.select(
        "price",
        round_exact(F.col("price"), 2).alias("two_digits"),
        round_exact(F.col("price"), 1).alias("one_digit"),
    )


# predicates and catalog aggregates


def _filtered(predicate, *columns: str) -> Query:
    return lambda spark, sf_dir: catalog(spark, sf_dir).where(predicate()).select("id", *columns)


def preview_rows(spark, sf_dir):
    return catalog_plan.preview(facets.by_city(catalog(spark, sf_dir), "Bombay"), 5)


def data_summary(spark, sf_dir):
    stats = quality_counters(inputs.listings(spark, sf_dir))
    summary = catalog_plan.data_summary(catalog(spark, sf_dir), stats, "Mumbai")
    return summary.withColumns({name: F.array_join(name, ",") for name in ["cities", "sample_names"]})


def match_one_query(spark, sf_dir):
    row = match_one(catalog(spark, sf_dir), **ONE_PREFERENCE)
    ids = F.array_join(F.transform("candidates", lambda card: card["id"]), ",")
    return row.select("normalized_location", *COUNTS, "top_n", ids.alias("ids"))


def top_candidates_query(spark, sf_dir):
    best = top_candidates(catalog(spark, sf_dir), **ONE_PREFERENCE)
    # The list is already cut to the top-N; numbering it is a window over those few rows.
    order = Window.orderBy(F.coalesce("rating", F.lit(-1.0)).desc(), F.lower("name"), "id")
    return best.select(F.row_number().over(order).alias("position"), "*")


# preference tables


def _joined_errors(frame: DataFrame) -> DataFrame:
    return frame.withColumn("errors", F.array_join("errors", ","))


def validate_preferences(spark, sf_dir):
    columns = [*preferences.PREFERENCE_COLUMNS, "normalized_location", "errors"]
    return _joined_errors(checked(spark, sf_dir)).select(*columns)


def funnel_counts_batch(spark, sf_dir):
    return match(spark, sf_dir).select("pref_id", *COUNTS)


def candidate_lists(spark, sf_dir):
    ids = F.array_join(F.transform("candidates", lambda card: card["id"]), ",")
    return matched(spark, sf_dir).select("pref_id", ids.alias("ids"))


def root_cause(spark, sf_dir):
    causes = diagnose.root_causes(matched(spark, sf_dir))
    return causes.withColumn("suggestions", F.array_join("suggestions", "|"))


def filters_applied(spark, sf_dir):
    applied = valid(spark, sf_dir).select("pref_id", diagnose.filters_applied().alias("f"))
    return applied.select("pref_id", "f.*")


# prompts


def prompt_payload(spark, sf_dir):
    """The payload read back from its JSON text."""
    payload = F.try_parse_json("prompt").alias("payload")
    read = prompts.build_prompts(matched(spark, sf_dir)).select("pref_id", payload)

    def field(path: str, kind: str):
        return F.try_variant_get("payload", f"$.{path}", kind)

    opened = read.select(
        "pref_id",
        *[
            field(f"preferences.{name}", kind).alias(name)
            for name, kind in [
                ("location", "string"),
                ("budget", "string"),
                ("cuisine", "string"),
                ("min_rating", "double"),
                ("additional_preferences", "string"),
            ]
        ],
        field("candidates", "array<struct<id:string,name:string,cuisine:string,rating:string,cost_for_two:string,location:string>>").alias("cards"),
        field("request_top_k", "int").alias("request_top_k"),
    )
    # JSON numbers may lose a trailing ".0" on the way; a rating is compared as a double's text.
    rating_text = F.transform(
        "cards", lambda c: F.coalesce(c["rating"].try_cast("double").cast("string"), c["rating"])
    )
    return opened.select(
        "pref_id",
        "location",
        "budget",
        "cuisine",
        "min_rating",
        "additional_preferences",
        F.size("cards").cast("bigint").alias("n_candidates"),
        F.array_join(F.transform("cards", lambda c: c["id"]), ",").alias("ids"),
        F.array_join(rating_text, ",").alias("ratings"),
        *[
            F.array_join(F.col(f"cards.{name}"), "|").alias(f"card_{name}")
            for name in ["name", "cuisine", "cost_for_two", "location"]
        ],
        "request_top_k",
    )


def prompt_text(spark, sf_dir):
    read = prompts.build_prompts(matched(spark, sf_dir))
    return read.select("pref_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def effective_top_k(spark, sf_dir):
    asked = prompts.effective_top_k(F.size("candidates"), 5)
    return matched(spark, sf_dir).where(F.col("returned") > 0).select("pref_id", asked.alias("top_k"))


# replies and envelopes


def strip_fences(spark, sf_dir):
    return responses(spark, sf_dir).select("pref_id", replies.strip_fences(F.col("raw_response")).alias("body"))


def parse_responses(spark, sf_dir):
    return replies.parse_replies(responses(spark, sf_dir)).select("pref_id", "parse_error", "summary")


def reply_items(spark, sf_dir):
    parsed = settled(replies.parse_replies(responses(spark, sf_dir)), "items")
    return parsed.select("pref_id", F.explode("items").alias("item")).select("pref_id", "item.*").drop("beyond")


def unknown_ids(spark, sf_dir):
    """The warnings of each reply, numbered."""
    warned = reconciled(spark, sf_dir).select("pref_id", F.posexplode("warnings").alias("at", "warning"))
    return warned.select("pref_id", (F.col("at") + 1).alias("position"), "warning")


def rerank(spark, sf_dir):
    rows = reconciled(spark, sf_dir).select("pref_id", F.explode("recommendations").alias("rec"))
    return rows.select(
        "pref_id",
        "rec.rank",
        *[f"rec.restaurant.{c}" for c in ["id", "name", "rating", "cost_for_two"]],
        "rec.explanation",
    )


def reconcile(spark, sf_dir):
    return reconciled(spark, sf_dir).select(
        "pref_id",
        F.greatest(F.size("recommendations"), F.lit(0)).cast("bigint").alias("n_recommendations"),
        F.coalesce(F.array_join("warnings", "|"), F.lit("")).alias("warnings"),
        "reply_error",
    )


def resumed_replies(spark, sf_dir):
    """Two runs of a ranker that remembers; ``asked`` is the number of prompts that reached it in the run of a row.

    The first run has the even preferences, and the second all; a prompt says whose it is, so all differ.
    """
    store, asked = scratch_path(spark, "remembered"), []
    replies = materialize(responses(spark, sf_dir), "replies")
    prompts_ = replies.select("pref_id", F.lit("").alias("system"), F.concat(F.lit("for "), "pref_id").alias("prompt"))

    def counting(open_prompts):
        seen = materialize(open_prompts, "seen")
        asked[-1] += seen.count()
        return recommend.stored_ranker(replies)(seen)

    ranker = recommend.resumable_ranker(counting, store, batches=3)
    for part in (prompts_.where("pref_id % 2 = 0"), prompts_):
        asked.append(0)
        answered = ranker(part)
    run = F.when(F.col("pref_id") % 2 == 0, 0).otherwise(1)
    numbers = F.when(run == 0, asked[0]).otherwise(asked[1]).cast("bigint")
    return answered.where("error_type is null").select("pref_id", "raw_response", numbers.alias("asked"))


def recommend_batch(spark, sf_dir):
    """The whole job, with a ranker that looks stored replies up."""
    stored = responses(spark, sf_dir)
    answers = recommend.recommend_batch(
        index(spark, sf_dir),
        inputs.preferences(spark, sf_dir),
        recommend.stored_ranker(stored),
    )
    return answers.select(
        "pref_id",
        "status",
        "message",
        "summary",
        F.size("recommendations").cast("bigint").alias("n_recommendations"),
        F.array_join("warnings", "|").alias("warnings"),
    )


def error_envelope(spark, sf_dir):
    failed = enveloped(spark, sf_dir).where(F.col("status") == "error")
    return failed.select("pref_id", "metadata.error_type", "message", "metadata.error", "metadata.llm_called")


def result_metadata(spark, sf_dir):
    fine = enveloped(spark, sf_dir).where(F.col("status") != "error")
    return fine.select("pref_id", *[f"metadata.{c}" for c in [*COUNTS, "top_n", "llm_called", "llm_latency_ms"]])


QUERIES: dict[str, Query] = {
    "scan_positions": scan_positions,
    "text_positions": text_positions,
    "replaced_snapshot": replaced_snapshot,
    "merged_catalog": lambda spark, sf_dir: snapshot.read_snapshot(spark, merged_root(spark, sf_dir)).select(
        *CATALOG_COLUMNS, "position"
    ),
    "merged_counters": lambda spark, sf_dir: snapshot.read_snapshot_stats(spark, merged_root(spark, sf_dir)),
    "csv_export": csv_export,
    "parquet_export": parquet_export,
    "json_sample": json_sample,
    "export_preview": export_preview,
    "snapshot": snapshot_roundtrip,
    "snapshot_stats": snapshot_stats,
    "seed_repair": seed_repair,
    "source_fallback": source_fallback,
    "stale_exports": stale_exports,
    "strip_text": strip_text,
    "parse_rating": parse_rating,
    "parse_cost": parse_cost,
    "extract_city": _raw(city=lambda: parsing.extract_city(F.lower("address"))),
    "find_places": find_places,
    "alias_location": alias_location,
    "budget_band": _annotated("budget_band"),
    "normalize_cuisine": _raw(cuisine=lambda: parsing.normalize_cuisine(F.col("cuisines"))),
    "default_place": _annotated("city", "location", "city_defaulted"),
    "stable_id": lambda spark, sf_dir: clean_listings(spark, sf_dir).select("row_index", "id"),
    "title_case": title_case_query,
    "clean_listings": clean_listings,
    "any_cuisine": any_cuisine,
    "free_text": lambda spark, sf_dir: checked(spark, sf_dir).select("pref_id", "additional_preferences"),
    "round_exact": round_exact_query,
    "filter_location": _filtered(lambda: predicates.location_match(F.lit("nation_1")), "city", "location"),
    "filter_cuisine": _filtered(lambda: predicates.cuisine_match(F.lit("e, tex")), "cuisine"),
    "filter_min_rating": _filtered(lambda: predicates.rating_match(F.lit(3.5)), "rating"),
    "filter_no_rating_floor": _filtered(lambda: predicates.rating_match(F.lit(0.0)), "rating"),
    "filter_budget": _filtered(lambda: predicates.budget_match(F.lit("medium")), "budget_band"),
    "city_lookup": lambda spark, sf_dir: _cards(facets.by_city(catalog(spark, sf_dir), " GURUGRAM ")),
    "city_lookup_batch": lambda spark, sf_dir: _cards(
        facets.lookup_cities(
            catalog(spark, sf_dir), inputs.preferences(spark, sf_dir).select(F.col("location").alias("city"))
        )
    ),
    "dedupe_catalog": lambda spark, sf_dir: _cards(catalog_plan.build_catalog(inputs.listings(spark, sf_dir))),
    "quality_counters": lambda spark, sf_dir: quality_counters(inputs.listings(spark, sf_dir)),
    "facet_locations": lambda spark, sf_dir: facets.location_facet(catalog(spark, sf_dir)),
    "facet_cuisines": lambda spark, sf_dir: facets.cuisine_facet(catalog(spark, sf_dir)),
    "facet_cities": lambda spark, sf_dir: facets.city_list(catalog(spark, sf_dir)),
    "default_facet": lambda spark, sf_dir: facets.default_facet(facets.location_facet(catalog(spark, sf_dir))),
    "catalog_count": lambda spark, sf_dir: catalog(spark, sf_dir).agg(F.count("*").alias("n")),
    "preview_rows": preview_rows,
    "preview_lines": lambda spark, sf_dir: display.preview_lines(catalog(spark, sf_dir)),
    "data_summary": data_summary,
    "top_candidates": top_candidates_query,
    "match_one": match_one_query,
    "funnel_one": lambda spark, sf_dir: funnel_counts(catalog(spark, sf_dir), **ONE_PREFERENCE),
    "validate_preferences": validate_preferences,
    "rejected_preferences": lambda spark, sf_dir: _joined_errors(
        preferences.rejected_preferences(checked(spark, sf_dir))
    ),
    "batch_match_topn": lambda spark, sf_dir: candidate_rows(match(spark, sf_dir)),
    "funnel_counts": funnel_counts_batch,
    "candidate_lists": candidate_lists,
    "empty_reason": lambda spark, sf_dir: diagnose.empty_reasons(matched(spark, sf_dir)),
    "root_cause": root_cause,
    "filters_applied": filters_applied,
    "prompt_payload": prompt_payload,
    "prompt_text": prompt_text,
    "effective_top_k": effective_top_k,
    "system_text": lambda spark, sf_dir: prompts.build_prompts(matched(spark, sf_dir)).select("pref_id", "system"),
    "strip_fences": strip_fences,
    "parse_responses": parse_responses,
    "reply_items": reply_items,
    "unknown_ids": unknown_ids,
    "rerank": rerank,
    "reconcile": reconcile,
    "resumed_replies": resumed_replies,
    "recommend_batch": recommend_batch,
    "error_envelope": error_envelope,
    "result_metadata": result_metadata,
    "result_badge": lambda spark, sf_dir: display.result_badges(enveloped(spark, sf_dir)),
    "result_cards": lambda spark, sf_dir: display.result_cards(enveloped(spark, sf_dir)),
}
