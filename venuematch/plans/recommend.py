"""Preferences in, answer envelopes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from venuematch.config import DEFAULTS, Settings
from venuematch.operators.batch import FILE_ROWS, MatchIndex, build_match_index, match_batch
from venuematch.operators.envelope import envelopes
from venuematch.operators.preferences import check_preferences, valid_preferences
from venuematch.operators.prompts import build_prompts
from venuematch.operators.single import match_one
from venuematch.storage import child_names, materialize

Ranker = Callable[[DataFrame], DataFrame]


def stored_ranker(replies: DataFrame) -> Ranker:
    """A ranker that looks replies up in a table, for reruns and tests."""
    return lambda prompts: prompts.select("pref_id").join(replies, "pref_id")


def resumable_ranker(ranker: Ranker, store: str, batches: int = 8) -> Ranker:
    """A ranker that asks for a prompt once, whatever fails in between.

    ``store`` is a folder of replies by the hash of (system, prompt). What it has is not asked again; of equal prompts
    one is asked. The open ones go to ``ranker`` in batches by their hash, and each batch's replies are committed to
    the store before the next, so a job that dies loses one batch at most. A reply with an ``error_type`` is returned but
    not stored, and its prompt is asked again by the next run.
    """

    def ask(prompts: DataFrame) -> DataFrame:
        spark = prompts.sparkSession
        keyed = prompts.withColumn("prompt_key", _prompt_key())
        # One preference stands for all with its prompt; its id is what the ranker sees.
        different = keyed.groupBy("prompt_key").agg(F.min(F.struct("pref_id", "system", "prompt")).alias("asked"))
        different = materialize(different.select("prompt_key", "asked.*"), "prompts")
        failed = None
        for batch in range(batches):
            part = different.where(F.pmod(F.xxhash64("prompt_key"), F.lit(batches)) == batch)
            known = stored_replies(spark, store)
            still_open = part if known is None else part.join(known.select("prompt_key"), "prompt_key", "left_anti")
            still_open = materialize(still_open, "open-prompts")
            if still_open.isEmpty():
                continue
            replies = ranker(still_open.select("pref_id", "system", "prompt"))
            replies = materialize(still_open.select("prompt_key", "pref_id").join(replies, "pref_id").drop("pref_id"), "asked")
            replies.where("error_type is null").write.mode("append").parquet(store)
            wrong = replies.where("error_type is not null")
            failed = wrong if failed is None else failed.unionByName(wrong)
        known = stored_replies(spark, store)
        found = known if failed is None else failed if known is None else known.unionByName(failed)
        if found is None:
            return ranker(prompts.limit(0))
        return keyed.select("pref_id", "prompt_key").join(found, "prompt_key").drop("prompt_key")

    return ask


def _prompt_key() -> Column:
    """The lengths in front keep (a, bc) and (ab, c) apart."""
    return F.sha2(F.concat_ws(":", F.length("system"), F.length("prompt"), "system", "prompt"), 256)


def stored_replies(spark: SparkSession, store: str) -> DataFrame | None:
    """Replies by ``prompt_key``, one each; null before the first batch. Two jobs that ran at once may have asked twice."""
    if not any(name.endswith(".parquet") for name in child_names(spark, store)):
        return None
    return spark.read.parquet(store).dropDuplicates(["prompt_key"])


def match_preferences(
    catalog: DataFrame, prefs: DataFrame, top_n: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Validate a preference table and match it; rows that break a rule are left out."""
    valid = valid_preferences(check_preferences(prefs))
    return match_batch(build_match_index(catalog, top_n, settings), valid, top_n, settings)


def answer_matches(
    matched: DataFrame, ranker: Ranker, top_k: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """One envelope per row of a match.

    ``ranker`` maps ``(pref_id, system, prompt)`` to ``(pref_id, raw_response, error_type, error_message,
    latency_ms)``: a join with stored replies, or ``mapInPandas`` around a model. Matches and replies are
    written to the shared folder, so a lost executor never repeats a paid call. Preferences without
    candidates do not reach the ranker.
    """
    stored = materialize(matched, "matched", FILE_ROWS)
    replies = materialize(ranker(build_prompts(stored, top_k, settings)), "replies", FILE_ROWS)
    return envelopes(stored, replies)


def recommend_batch(
    index: MatchIndex,
    prefs: DataFrame,
    ranker: Ranker,
    top_n: int | None = None,
    top_k: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One envelope per valid preference of a table."""
    valid = valid_preferences(check_preferences(prefs))
    return answer_matches(match_batch(index, valid, top_n, settings), ranker, top_k, settings)


def recommend_one(
    catalog: DataFrame, ranker: Ranker, top_k: int | None = None, settings: Settings = DEFAULTS, **preference
) -> DataFrame:
    """The envelope of a single preference; ``preference`` holds the arguments of ``match_one``.

    The match is one row on the driver, so only the ranker's reply is stored.
    """
    matched = match_one(catalog, settings=settings, **preference)
    return envelopes(matched, materialize(ranker(build_prompts(matched, top_k, settings)), "replies"))
