"""Mixing sources to target weights by Pareto order sampling, with Spark functions only.

A source with target t and size s takes every document floor(t / s) times for certain; what is left of the target over
s is the mean chance of one more copy. A document's own chance is above it the longer its text is, and below it the
shorter, by as much as all chances stay between 0 and 1, and so that chances times sizes add up to what is left.
Documents are ranked by their random odds divided by the odds of their chance, and the lowest ranks are taken until
the rest is filled. The ranks of a source are cut into slices, so the place of the cut needs running sums over slice
totals and inside one slice only, however large the source. Equal rows share a rank and are counted together; where
the cut falls among them, as many of them are taken as are wanted. A document is then compared with its source's cut,
without moving its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from venuematch.llm.rows import packed, unpacked
from venuematch.llm.words import WORD_PATTERN
from venuematch.storage import materialize

WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3
SEED = 7
SLICES = 4096
# A document of so many words has half of the highest score.
HALF_SCORE_WORDS = 200
SCORES = 1024
_RANDOM_BITS = 52
_ROW_BITS = 33


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) for ``sizes(source, size)``.

    Sources ordered by code point, null last, have the weights in turn and share the size of all documents. A
    target stops at ``most`` times its source's size, and the excess goes to the others by weight. With the
    sources in the order in which they reach their limit, the first one that its share doesn't fill settles the
    share of a unit of weight for all that follow. The windows run over one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    limited = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    shared = limited.select(
        "*",
        F.row_number().over(order).alias("rank"),
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
    ).withColumn("unit", (F.col("total") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("unit") * F.col("weight") <= F.col("limit"), F.struct("rank", "unit"))
    settled = shared.withColumn("first", F.min(fits).over(whole))
    filled = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    target = F.when(filled, F.col("limit")).otherwise(F.col("first.unit") * F.col("weight"))
    return settled.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, *others: str) -> DataFrame:
    """(others, source, doc_id, text_hash, size, score, row): what a draw needs of each row; ``row`` tells equal ones apart."""
    text = F.col("text").cast("string")
    size = word_count(text)
    return docs.select(
        *others,
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        size.alias("size"),
        F.floor(size * SCORES / (size + HALF_SCORE_WORDS)).cast("long").alias("score"),
        F.monotonically_increasing_id().alias("row"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _drawn(sizes: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """Each document with its source's share, the rank of one more copy, and the slice of that rank."""
    joined = sizes.join(shares.withColumnRenamed("source", "_source"), _same("source", "_source")).drop("_source")
    random = F.xxhash64(F.col("doc_id"), F.col("text_hash"), F.lit(seed)).bitwiseAND((1 << _RANDOM_BITS) - 1)
    u = (random + 0.5) / float(1 << _RANDOM_BITS)
    own = F.col("chance") + F.least("chance", 1 - F.col("chance")) * (F.col("score") - F.col("mean_score")) / SCORES
    odds = (u / (1 - u)) / (F.col("own") / (1 - F.col("own")))
    rank = F.when(F.col("size") == 0, None).when(F.col("own") >= 1, 0.0).when(F.col("own") > 0, odds)
    ranked = joined.withColumn("own", own).withColumn("rank", rank)
    return ranked.withColumn("slice", F.floor(SLICES * (1 - 1 / (1 + F.col("rank")))).cast("int")).drop("own")


_PLACE = ("rank", "doc_id", "text_hash")


def _cuts(drawn: DataFrame) -> DataFrame:
    """(source, cut, last_row): ranks before ``cut`` are taken, and of the rows at it those up to ``last_row``."""
    upto = lambda order, *by: Window.partitionBy("source", *by).orderBy(*order)
    drawn = drawn.filter("rank is not null")
    totals = drawn.groupBy("source", "rest", "slice").agg(F.sum("size").alias("held"))
    crossed = totals.withColumn("upto", F.sum("held").over(upto(["slice"]))).filter("upto > rest")
    slices = crossed.groupBy("source").agg(F.min(F.struct("slice", (F.col("upto") - F.col("held")).alias("before"))).alias("at"))
    slices = slices.select(F.col("source").alias("_source"), F.col("at.slice").alias("_slice"), F.col("at.before").alias("before"))
    inside = drawn.join(slices, _same("source", "_source") & (F.col("slice") == F.col("_slice")))
    # Equal rows are one, so many of them don't meet in one task.
    equal = inside.groupBy("source", "rest", "before", *_PLACE, "size").agg(F.count("*").alias("rows"))
    held = F.col("size") * F.col("rows")
    begun = F.col("before") + F.sum(held).over(upto(_PLACE)) - held
    crossing = equal.withColumn("begun", begun).filter((F.col("begun") <= F.col("rest")) & (F.col("begun") + held > F.col("rest")))
    # A document counts if at least half of it is wanted.
    wanted = F.floor((F.col("rest") - F.col("begun")) / F.col("size") + 0.5).cast("long")
    cuts = crossing.select(F.col("source").alias("_source"), F.struct(*_PLACE).alias("cut"), wanted.alias("wanted"))
    # The rows at the cut by the parts that they were read in, then those of the one part where the last wanted one is.
    at_cut = drawn.join(cuts, _same("source", "_source") & F.struct(*_PLACE).eqNullSafe(F.col("cut")))
    at_cut = at_cut.select("source", "wanted", "row", F.shiftright("row", _ROW_BITS).alias("part"))
    parts = at_cut.groupBy("source", "wanted", "part").agg(F.count("*").alias("rows"))
    passed = parts.withColumn("earlier", F.sum("rows").over(upto(["part"])) - F.col("rows")).filter(
        (F.col("earlier") < F.col("wanted")) & (F.col("earlier") + F.col("rows") >= F.col("wanted"))
    )
    passed = passed.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "earlier")
    last = (
        at_cut.join(passed, _same("source", "_source") & (F.col("part") == F.col("_part")))
        .withColumn("place", F.col("earlier") + F.row_number().over(upto(["row"], "part")))
        .filter("place = wanted")
        .select(F.col("source").alias("_last"), F.col("row").alias("last_row"))
    )
    return cuts.join(last, _same("_source", "_last"), "left").select(F.col("_source").alias("source"), "cut", "last_row")


def _plan(sizes: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> DataFrame:
    certain = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)).cast("long")
    scores = sizes.groupBy("source").agg(F.sum(F.col("score") * F.col("size")).alias("scored"))
    shares = (
        source_targets(sizes, weights, most)
        .withColumn("certain", F.when(F.col("source_size") > 0, certain).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
        .withColumn("chance", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)))
        .join(scores.withColumnRenamed("source", "_source"), _same("source", "_source"))
        .withColumn("mean_score", F.coalesce(F.col("scored") / F.nullif("source_size", F.lit(0)), F.lit(0.0)))
        .drop("_source", "scored")
    )
    shares = materialize(shares, "shares")
    cuts = _cuts(_drawn(sizes, shares, seed)).withColumnRenamed("source", "_source")
    return materialize(shares.join(cuts, _same("source", "_source"), "left").drop("_source"), "mix")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """One row per source of ``docs(doc_id, text, source)``: its size, target, certain copies and cut.

    Stores the sizes of the documents and the result in the shared folder.
    """
    return _plan(materialize(_sized(docs), "sizes"), weights, most, seed)


def with_copies(sized: DataFrame, plan: DataFrame, most: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """Rows as ``_sized`` gives them with the plan of their source and ``copies``, how often each is taken.

    The plan has a row per source, so Spark may broadcast it where that is small; otherwise it splits hot sources.
    """
    drawn = _drawn(sized, plan, seed)
    place = F.struct(*_PLACE)
    taken = F.col("cut").isNull() | (place < F.col("cut")) | ((place == F.col("cut")) & (F.col("row") <= F.col("last_row")))
    extra = F.col("rank").isNotNull() & F.coalesce(taken, F.lit(False)) & (F.col("certain") < most)
    return drawn.withColumn("copies", F.when(F.col("size") > 0, F.col("certain")).otherwise(F.lit(0)) + extra.cast("long"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs(doc_id, text, source)``.

    ``copies`` says how often the mix takes the document whole, and ``taken = copies * size``. What a source takes
    differs from its target by half of the document at the cut at most. The random number of a document comes from its
    doc_id, its text and the seed, so reruns agree; a null doc_id is an id like any other, and other texts under one
    doc_id are documents of their own. Of rows equal in both, any of the wanted number are taken. Documents without
    words, or of a source without words, take nothing. A null source is a source of its own. Other columns are not read.
    Runs jobs when called; texts are read once.
    """
    sizes = materialize(_sized(docs), "sizes")
    return with_copies(sizes, _plan(sizes, weights, most, seed), most, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ...)`` with all of their columns, each as often as the mix takes it.

    See ``mixed``. Texts are read twice and not shuffled unless the table of sources is too large for Spark to broadcast.
    Equal rows at a cut are told apart by where they are read, so ``docs`` should be a stored table.
    """
    plan = mix_plan(docs.select("doc_id", "text", "source"), weights, most, seed)
    rows = packed(docs).select(F.col("row").alias("whole"), "row.doc_id", "row.text", "row.source")
    taken = with_copies(_sized(rows, "whole"), plan, most, seed).filter("copies > 0")
    repeated = taken.select(F.col("whole").alias("row"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return unpacked(repeated)
