"""A quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

The score of a text is a sum of table entries, one per feature and one per chosen pair of features. Each cycle adds to
every table in turn a tree of a few leaves, fitted to what the model still gets wrong, at a small rate. The tables are
all that is left of the trees, so scoring is looking up bins and adding.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuematch.llm.shipping import workers_ready
from venuematch.llm.words import WORD_PATTERN

SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
CYCLES = 150
PAIR_CYCLES = 50
RATE = 0.15
LEAVES = 3
SHRINK = 5.0

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclaims", "stops", "commas", "distinct",
    "top_word", "repeated_pairs", "lines", "repeated_lines", "long_words", "short_words", "other_letters",
)
_WORD = re.compile(WORD_PATTERN)


def features(text: str | None) -> list[float]:
    """The inputs of a score, all from the text; shares of its words, characters or lines."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(data, minlength=256)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(len(words))), float(lengths.mean()) if len(words) else 0.0, kinds[65:91].sum() / chars,
        kinds[48:58].sum() / chars, sum(kinds[ord(c)] for c in "#*$%&|<>@^~_=+\\") / n, kinds[33] / n, kinds[46] / n, kinds[44] / n,
        len(counts) / n, max(counts.values(), default=0) / n, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        len(lines) / n, 1 - len(set(lines)) / len(lines), float((lengths > 14).mean()) if len(words) else 0.0,
        float((lengths < 4).mean()) if len(words) else 0.0, kinds[128:].sum() / chars,
    ]


@dataclass(frozen=True)
class AdditiveModel:
    """``base`` plus a table entry for each feature and each pair of features, as log-odds."""

    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for f, edges in enumerate(self.edges):
            total += self.tables[f, np.searchsorted(edges, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for pair in self.pairs for f in pair}
        for p, (a, b) in enumerate(self.pairs):
            total += self.pair_tables[p, coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree that splits one feature where it helps most, leaf by leaf."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for span in spans:
            a, b = span
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if not len(left_g):
                continue
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            at = int(gains.argmax())
            if gains[at] > best[0]:
                best = (gains[at], span, a + at + 1)
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut in each of two features."""
    sums = [x.cumsum(0).cumsum(1) for x in (g, h)]
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = []
            for s in sums:
                a, b, c, d = s[i - 1, j - 1], s[i - 1, -1], s[-1, j - 1], s[-1, -1]
                parts.append(np.array([a, b - a, c - a, d - b - c + a]))
            gain = _gain(*parts).sum()
            if gain > best:
                best, values = gain, parts[0] / (parts[1] + SHRINK)
                out = np.zeros_like(g)
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = values
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit the tables in cycles over the features, then over the pairs that explain most of what is left.

    Without rows, or with one label only, the tables are empty and every text has the share of label 1, smoothed.
    """
    n, width = len(x), len(FEATURES)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, f], BINS) if n else np.zeros(0) for f in range(width)]
    pair_edges = [_edges(x[:, f], PAIR_BINS) if n else np.zeros(0) for f in range(width)]
    tables = np.zeros((width, BINS))
    if n == 0 or y.min() == y.max():
        return AdditiveModel(base, edges, tables, pair_edges, [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    at = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]
    coarse = [np.searchsorted(pair_edges[f], x[:, f], side="right") for f in range(width)]
    total = np.full(n, base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for f in range(width):
            g, h = left()
            step = RATE * _tree(np.bincount(at[f], g, BINS), np.bincount(at[f], h, BINS), LEAVES)
            tables[f] += step
            total += step[at[f]]

    def summed(pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        cell = coarse[pair[0]] * PAIR_BINS + coarse[pair[1]]
        return tuple(np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in left())

    candidates = [(a, b) for a in range(width) for b in range(a + 1, width)]
    pairs = sorted(candidates, key=lambda pair: -_pair_tree(*summed(pair))[0])[:PAIRS]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_CYCLES):
        for p, pair in enumerate(pairs):
            step = RATE * _pair_tree(*summed(pair))[1]
            pair_tables[p] += step
            total += step[coarse[pair[0]], coarse[pair[1]]]
    return AdditiveModel(base, edges, tables, pair_edges, pairs, pair_tables)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from; a null doc_id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(t) for t in batch])

    return run(text)


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """A model of ``labels(doc_id, quality)`` on the texts of ``docs(doc_id, text)``, fitted on the driver.

    Learns from ``sample_rows`` labelled documents at most, those with the least hash of their doc_id, none of them
    held out. Labels other than 0 and 1, and labels that contradict each other for one doc_id, are left out; of
    repeated rows of a document one is used.
    """
    workers_ready(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("other")).filter("y = other")
    # At most sample_rows rows of two numbers, which is what bounds the broadcast.
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "y"))
    found = (
        docs.select("doc_id", F.col("text").cast("string"))
        .join(sample, "doc_id")
        .select("doc_id", "y", _feature_column(F.col("text")).alias("x"))
        .groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("row"))
        .orderBy("doc_id").limit(sample_rows).select("row.*").collect()
    )
    x = np.array([r["x"] for r in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in found], float))


def quality_score(text: Column, model: AdditiveModel) -> Column:
    """Score of each text, 0 to 1; a null text is an empty one."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.scores(np.array([features(t) for t in batch], float).reshape(-1, len(FEATURES))))

    return run(text.cast("string"))


def classified(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``; other columns are not read.

    Scores depend on the text alone. A null or empty text is scored like any other. With no usable label all scores are
    one half and all texts are predicted good. Trains when called; scoring is one narrow pass.
    """
    model = trained(docs, labels, sample_rows)
    scored = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_only(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows predicted bad, with all of their columns."""
    model = trained(docs, labels, sample_rows)
    return docs.filter(quality_score(F.col("text"), model) >= 0.5)
