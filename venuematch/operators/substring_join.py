"""Which dictionary texts contain which needles, as an equi-join on n-grams.

A text that contains a needle also contains every n-gram of it. Each needle is therefore looked up by one of
its own grams, the one that the fewest texts share, and the hits are verified with a literal test. No pair
is formed between a needle and a text that does not share that gram. ``kind`` keeps several dictionaries
apart so that one join serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3


def substrings(text: Column, size: Column) -> Column:
    """Distinct substrings of the given length; none when the text is shorter."""
    last = F.length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, size)))


def gram_index(texts: DataFrame) -> DataFrame:
    """``(kind, text, gram)`` for all grams of up to three characters; shorter ones serve short needles."""
    sizes = F.explode(F.sequence(F.lit(1), F.lit(GRAM))).alias("size")
    sized = texts.select("kind", "text", sizes)
    return sized.select("kind", "text", F.explode(substrings(F.col("text"), F.col("size"))).alias("gram"))


def gram_frequencies(grams: DataFrame) -> DataFrame:
    """``(kind, gram, frequency)``: how many texts hold a gram."""
    return grams.groupBy("kind", "gram").agg(F.count("*").alias("frequency"))


def substring_matches(grams: DataFrame, frequencies: DataFrame, needles: DataFrame) -> DataFrame:
    """All ``(kind, text, needle)`` where the text contains the non-empty needle of the same kind."""
    size = F.least(F.length("needle"), F.lit(GRAM))
    sought = needles.where(F.length("needle") > 0).select(
        "kind", "needle", F.explode(substrings(F.col("needle"), size)).alias("gram")
    )
    rarest = (
        sought.join(frequencies, ["kind", "gram"])
        .groupBy("kind", "needle")
        .agg(F.min_by("gram", F.struct("frequency", "gram")).alias("gram"))
    )
    hits = grams.join(rarest, ["kind", "gram"])
    return hits.where(F.contains("text", "needle")).select("kind", "text", "needle")
