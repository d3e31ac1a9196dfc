"""Whole rows as one column, so that a user's column names can't meet those of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(frame: DataFrame) -> DataFrame:
    """(row): all columns of each row."""
    return frame.select(F.struct(*map(quoted, frame.columns)).alias("row"))


def unpacked(frame: DataFrame) -> DataFrame:
    """The columns of ``row``, whatever other columns there are."""
    return frame.select("row.*")
