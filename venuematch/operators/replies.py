"""Ranked JSON replies: tolerant parsing and reconciliation with the candidates.

A reply and its candidates sit in one row, so looking ids up, dropping unknown ones, sorting and
renumbering are array expressions inside that row: no shuffle, and no group larger than one reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from venuematch.config import MISSING_RANK, MSG_DEFAULT_EXPLANATION, MSG_UNKNOWN_ID
from venuematch.functions.once import bound, settled
from venuematch.functions.python_text import MARKERS, NO_NUMBER, float_text, readable_json, value_text
from venuematch.functions.text import blank_to_null, strip

BIGGEST_RANK = 2**63 - 1


def strip_fences(reply: Column) -> Column:
    """The reply without a surrounding Markdown code fence."""
    opened = F.regexp_replace(strip(reply), r"(?U)^```[a-zA-Z]*\s*", "")
    return strip(F.regexp_replace(opened, r"(?U)\s*```$", ""))


def parse_strict(text: Column) -> Column:
    """VARIANT of a JSON text, null unless the whole text is one JSON value.

    The JSON parser stops after the first complete value and would accept ``{...} anything``. The text is
    therefore parsed as first element of an array whose second element is the text's own hash, which only
    survives when the first element ends where the text ends.
    """
    seal = F.xxhash64(text)
    sealed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), seal.cast("string"), F.lit("]")))
    intact = F.try_variant_get(sealed, "$[1]", "bigint") == seal
    return F.when(intact, F.try_variant_get(sealed, "$[0]", "variant"))


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text_or_null(value: Column) -> Column:
    """Stripped text of a JSON string; null for blanks and for every other type."""
    return F.when(_type(value) == "STRING", blank_to_null(value.try_cast("string")))


def _id_text(value: Column, json_text: Column) -> Column:
    """``str()`` of a JSON value, stripped; of a list or an object it is read off its text, in the order written there.
    A missing or null id is null."""
    text = value.try_cast("string")
    kind = _type(value)
    # Most ids are texts or whole numbers, which need nothing further.
    return F.when(kind.isin("STRING", "BIGINT"), strip(text)).otherwise(_odd_id_text(value, json_text, text, kind))


def _odd_id_text(value: Column, json_text: Column, text: Column, kind: Column) -> Column:
    return strip(
        F.when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.rlike("^(ARRAY|OBJECT)"), value_text(json_text))
        .when(kind == "DOUBLE", float_text(value.try_cast("double")))
        .when(kind.rlike(r"^DECIMAL\((1?[0-9]),0\)$"), F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def _rank_number(value: Column) -> Column:
    """``int()`` of a JSON value, or the number that sorts last when there is none.

    Numbers lose their fraction. A text counts when it is an integer literal. Numbers beyond 64 bits keep
    their sign and stand at that end, where :func:`_rank_beyond` orders them; an infinite one becomes zero, which is
    not a valid rank.
    """
    kind = _type(value)
    double = value.try_cast("double")
    number = (
        F.when((F.abs(double) == float("inf")) | _field(value, NO_NUMBER).try_cast("string").isin("inf", "-inf"), 0)
        .when(double >= float(BIGGEST_RANK), BIGGEST_RANK)
        .when(double <= -float(BIGGEST_RANK), -BIGGEST_RANK)
        .otherwise(value.try_cast("bigint"))
    )
    literal = strip(value.try_cast("string"))
    digits = F.regexp_replace(literal, "_", "")
    integer = F.when(
        literal.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"),
        F.coalesce(
            digits.try_cast("bigint"),
            F.when(literal.startswith("-"), -BIGGEST_RANK).otherwise(BIGGEST_RANK),
        ),
    )
    return F.coalesce(F.when(kind == "STRING", integer).otherwise(number), F.lit(MISSING_RANK).cast("bigint"))


def _rank_beyond(value: Column) -> Column:
    """Length and digits of a rank too large for 64 bits, so that these sort among themselves; null for all others.

    Negative ones need no order, since a rank below one is an error.
    """
    double = value.try_cast("double")
    number = F.coalesce(value.try_cast("decimal(38,0)").cast("string"), F.regexp_replace(F.format_number(double, 0), ",", ""))
    literal = F.regexp_replace(strip(value.try_cast("string")), r"^\+|_", "")
    large = F.when(_type(value) == "STRING", F.when(literal.rlike(r"^[0-9]+$"), literal)).otherwise(
        F.when((double >= float(BIGGEST_RANK)) & (double < float("inf")), number)
    )
    digits = F.regexp_replace(large, r"^0+(?=[0-9])", "")
    beyond = (F.length(digits) > 19) | ((F.length(digits) == 19) & (digits > str(BIGGEST_RANK)))
    return F.when(beyond, F.struct(F.length(digits).alias("length"), digits.alias("digits")))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$['{name}']", "variant")


def parse_replies(replies: DataFrame) -> DataFrame:
    """Adds ``parse_error``, ``summary`` and ``items`` to rows with a ``raw_response``.

    ``parse_error`` is ``not_json``, ``not_object``, ``no_list`` or null. Items without an id, among them
    everything that is not an object, are skipped; ``item_position`` still counts them.
    """
    body = settled(replies.withColumn("body", readable_json(strip_fences(F.col("raw_response")))), "body")
    document = settled(body.withColumn("document", parse_strict(F.col("body"))), "document")
    opened = document.select(
        *replies.columns,
        F.from_json("body", "recommendations ARRAY<STRING>")["recommendations"].alias("item_texts"),
        F.col("document").isNull().alias("is_broken"),
        (F.try_variant_get("document", "$", "map<string,variant>").isNotNull() & ~F.col("body").isin(MARKERS)).alias("is_object"),
        _field(F.col("document"), "summary").alias("summary_value"),
        F.try_variant_get("document", "$.recommendations", "array<variant>").alias("listed"),
    )
    opened = settled(opened, *[c for c in opened.columns if c not in replies.columns])
    # One array, so that the texts are read once and not for each item.
    items = F.transform(
        F.arrays_zip(F.col("listed").alias("item"), F.col("item_texts").alias("text")),
        lambda entry, at: F.struct(
            at.cast("int").alias("item_position"),
            bound(
                _field(entry["item"], "id"), lambda value: _id_text(value, F.from_json(entry["text"], "id STRING")["id"])
            ).alias("id"),
            bound(_field(entry["item"], "rank"), _rank_number).alias("rank"),
            bound(_field(entry["item"], "rank"), _rank_beyond).alias("beyond"),
            F.coalesce(bound(_field(entry["item"], "explanation"), _text_or_null), F.lit(MSG_DEFAULT_EXPLANATION)).alias(
                "explanation"
            ),
        ),
    )
    return opened.select(
        *replies.columns,
        F.when(F.col("is_broken"), "not_json")
        .when(~F.col("is_object"), "not_object")
        .when(F.col("listed").isNull(), "no_list")
        .alias("parse_error"),
        _text_or_null(F.col("summary_value")).alias("summary"),
        F.when(F.col("listed").isNotNull(), F.filter(items, lambda item: item["id"].isNotNull())).alias("items"),
    )


def reconcile_replies(replies: DataFrame) -> DataFrame:
    """Resolves parsed items against the row's own ``candidates``.

    Facts come from the candidate, never from the reply. Adds ``recommendations`` (ranks 1..n by reply
    rank, then id, then position), ``warnings`` for unknown ids in reply order, and ``reply_error``: null,
    ``parse`` (unreadable, or nothing valid in it) or ``rank`` (a valid item ranked below one).
    """
    parsed = settled(parse_replies(replies), "items")
    resolved = parsed.withColumn(
        "resolved",
        F.transform(
            "items",
            lambda item: F.struct(
                item.alias("item"),
                F.try_element_at(
                    F.filter("candidates", lambda card: card["id"] == item["id"]), F.lit(-1)
                ).alias("card"),
            ),
        ),
    )
    resolved = settled(resolved, "resolved")
    unknown = F.filter("resolved", lambda entry: entry["card"].isNull())
    known = F.filter("resolved", lambda entry: entry["card"].isNotNull())
    sortable = F.transform(
        known,
        lambda entry: F.struct(
            entry["item"]["rank"].alias("rank"),
            entry["item"]["beyond"].alias("beyond"),
            entry["item"]["id"].alias("id"),
            entry["item"]["item_position"].alias("item_position"),
            entry["item"]["explanation"].alias("explanation"),
            entry["card"].alias("card"),
        ),
    )
    ordered = resolved.select(
        *[c for c in parsed.columns if c != "items"],
        F.sort_array(sortable).alias("ordered"),
        F.transform(unknown, lambda entry: F.format_string(MSG_UNKNOWN_ID, entry["item"]["id"])).alias(
            "warnings"
        ),
    )
    renumbered = F.transform(
        "ordered",
        lambda entry, at: F.struct(
            (at + 1).cast("int").alias("rank"),
            entry["card"].alias("restaurant"),
            entry["explanation"].alias("explanation"),
        ),
    )
    ordered = settled(ordered, "ordered", "warnings")
    answered = ordered.select(
        *[c for c in ordered.columns if c != "ordered"],
        renumbered.alias("recommendations"),
        F.when(F.col("parse_error").isNotNull(), "parse")
        .when(F.size("ordered") < 1, "parse")
        .when(F.try_element_at("ordered", F.lit(1))["rank"] < 1, "rank")
        .alias("reply_error"),
    )
    return settled(answered, "recommendations", "reply_error")
