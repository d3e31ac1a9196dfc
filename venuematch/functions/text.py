"""Python's string semantics as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from venuematch.config import WHITESPACE


def strip(c: Column) -> Column:
    """``str.strip()``: unlike ``trim`` this removes every Unicode blank, in one linear pass."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def title_case(c: Column) -> Column:
    """``str.title()``: a capital after anything that is not a cased letter, lower case elsewhere.

    ``initcap`` knows blanks only, which is enough for plain words; other texts are cut into runs first.
    """
    runs = F.regexp_extract_all(
        c,
        F.lit(r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]+|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+"),
        F.lit(0),
    )
    by_run = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(c.rlike("^[A-Za-z ]*$"), F.initcap(c)).otherwise(by_run)
