"""Rounding that agrees with Python's ``round`` on every double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_exact(x: Column, digits: int) -> Column:
    """Round a non-negative double to one or two digits, the way Python does.

    ``round`` and ``bround`` round the shortest decimal text of a double (2.675 -> 2.68); Python rounds
    its exact binary value (2.675 is stored slightly lower -> 2.67). The whole part is split off first, which is
    exact. Splitting the fraction into a part with 20 bits and a remainder makes both products below exact, so the
    comparison with the midpoint between the two neighbours is exact as well. A true tie goes to the even neighbour.
    The two parts are put together as a decimal, whose double is the nearest one. From 2**53 on there is no fraction.
    """
    scale = 10**digits
    whole = F.floor(x)
    fraction = x - whole.cast("double")
    below = F.floor(fraction * F.lit(float(scale))).cast("double")
    head = F.floor(fraction * F.lit(2.0**20)).cast("double") / F.lit(2.0**20)
    tail = (fraction - head) * F.lit(2.0 * scale)
    midpoint = below * 2.0 + 1.0 - head * F.lit(2.0 * scale)
    # Whether the neighbour below is even depends on the whole part too; times ten it is always even.
    step = F.when(tail > midpoint, 1.0).when(tail < midpoint, 0.0).otherwise(below % 2.0)
    digits_part = ((below + step) / F.lit(float(scale))).cast(f"decimal(5,{digits})")
    return F.when(x < 2.0**53, (whole.cast("decimal(20,0)") + digits_part).cast("double")).otherwise(x)
