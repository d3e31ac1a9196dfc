"""Values that are computed once, however often they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row or array element, also inside a lambda, where Spark shares no
    common part of an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(rows: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns as finished values.

    Filters above, also those that Spark derives from an ``explode``, are otherwise moved below the projections that
    compute these columns, and then hold each of them once for every mention. They do not pass a generator.
    """
    passed = F.inline(F.array(F.struct(*names)))
    return rows.select(*[c for c in rows.columns if c not in names], passed).select(*rows.columns)
