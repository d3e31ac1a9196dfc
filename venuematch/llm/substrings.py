"""Substring dedup: repeated word sequences found in suffix trees that are partitioned by prefix.

A suffix starts at each word of a document. A repeat of ``length`` words is a node of the suffixes' tree at that
depth or deeper with two or more suffixes below it. Prefixes of growing length split the suffixes:

* a short prefix, taken at the places where its hash is least among neighbours, so that every window of
  ``length`` words holds such a place at the same offset wherever it occurs. A short prefix that occurs once
  leads to a leaf, and no repeat runs through it: most suffixes end here without being stored;
* around each repeated short prefix the neighbouring windows that hold it make up a context. Equal contexts are one
  node of the tree: its first occurrence stays, and all windows of the others are repeats;
* only where one prefix leads to several contexts can these share windows of ``length`` words. Then the first
  occurrence of each context is extended to its single windows. Each of them is a node at depth ``length``, and the
  tree is not needed below it. Adjacent repeats of a document make up the maximal one.

Nodes are keyed by the prefix's hash and a hash of the rest, 128 bits together. A node's suffixes are never
gathered: its first one is a partial aggregate, and the others come from a join that Spark splits where a node is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuematch.llm.shipping import workers_ready
from venuematch.llm.words import mix, range_hashes, window_hashes, word_hashes
from venuematch.storage import materialize

LENGTH = 20
PREFIX = 8
# A document is a doc_id with a text: different texts without a doc_id, or with the same one, are different documents.
KEY = ["doc_id", "text_hash"]
# Stands for a null doc_id and, like it, comes before all others.
NO_ID = -(1 << 63)


def _least_places(prefixes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` prefixes the place of the least hash, the last of equal ones."""
    # Places are found by doubling runs, each keeping the place of its least hash.
    n = len(prefixes) - span + 1
    at, size = np.arange(len(prefixes)), 1
    while size < span:
        step = min(size, span - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(prefixes[a] < prefixes[b], a, b)
        size += step
    return at[:n]


def sampled_prefixes(hashes: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all short prefixes, and for each window the place of its sampled one."""
    if len(hashes) < length:
        return hashes[:0], np.zeros(0, np.int64)
    prefixes = window_hashes(hashes, (prefix,))[prefix]
    return prefixes, _least_places(prefixes, length - prefix + 1)


def _contexts_of(text: str | None, length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Word hashes, then for each run of windows with one sampled place: its prefix, first window, end and place."""
    hashes = word_hashes((text or "").encode())
    prefixes, places = sampled_prefixes(hashes, length, prefix)
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    ends = np.append(starts[1:], len(places))
    return hashes, prefixes[places[starts]], starts, ends, places[starts]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scanned(docs: DataFrame, length: int, prefix: int) -> DataFrame:
    """(KEY, n_words, kept_sha256, prefixes): each document if nothing is removed, and its sampled prefixes.

    A prefix that a document has at several places is given twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sampled = [], [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                words = data.split()
                prefixes, places = sampled_prefixes(word_hashes(data), length, prefix)
                counts.append(len(words))
                digests.append(_digest(words))
                found, times = np.unique(prefixes[np.unique(places)], return_counts=True)
                sampled.append(np.repeat(found, np.minimum(times, 2)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sampled])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *sampled])
            yield pa.record_batch(
                [*map(batch.column, KEY), pa.array(counts, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(offsets, values)],
                [*KEY, "n_words", "kept_sha256", "prefixes"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_words long, kept_sha256 string, prefixes array<long>")


def _occurrences(candidates: DataFrame, length: int, prefix: int) -> DataFrame:
    """(prefix, rest, KEY, start, n): contexts around the repeated prefixes of a document, with n windows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[np.zeros(0, np.int64)] for _ in range(6)]
            for doc_id, text_hash, text, repeated in zip(*map(batch.column, (*KEY, "text", "repeated"))):
                hashes, prefixes, starts, ends, places = _contexts_of(text.as_py(), length, prefix)
                kept = np.isin(prefixes, repeated.values.to_numpy(zero_copy_only=False).view(np.uint64))
                prefixes, starts, ends, places = (x[kept] for x in (prefixes, starts, ends, places))
                shape = ((ends - starts) * length + (places - starts)).astype(np.uint64)
                rest = mix(range_hashes(hashes, starts, ends + length - 1) + shape)
                key = (np.full(len(starts), k.as_py()) for k in (doc_id, text_hash))
                found = (prefixes.view(np.int64), rest.view(np.int64), *key, starts, ends - starts)
                for column, values in zip(columns, found):
                    column.append(values)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], ["prefix", "rest", *KEY, "start", "n"])

    return candidates.select(*KEY, "text", "repeated").mapInArrow(run, "prefix long, rest long, doc_id long, text_hash long, start long, n long")


def _windows(candidates: DataFrame, length: int, prefix: int) -> DataFrame:
    """(prefix, rest, KEY, start): the single windows of the contexts that begin at ``wanted`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[np.zeros(0, np.int64)] for _ in range(5)]
            for doc_id, text_hash, text, wanted in zip(*map(batch.column, (*KEY, "text", "wanted"))):
                hashes, prefixes, starts, ends, places = _contexts_of(text.as_py(), length, prefix)
                kept = np.isin(starts, wanted.values.to_numpy(zero_copy_only=False))
                sizes = (ends - starts)[kept]
                first = np.repeat(starts[kept], sizes)
                at = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                offset = (np.repeat(places[kept], sizes) - at).astype(np.uint64)
                rest = mix(range_hashes(hashes, at, at + length) + offset)
                key = (np.full(len(at), k.as_py()) for k in (doc_id, text_hash))
                found = (np.repeat(prefixes[kept], sizes).view(np.int64), rest.view(np.int64), *key, at)
                for column, values in zip(columns, found):
                    column.append(values)
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in columns], ["prefix", "rest", *KEY, "start"])

    return candidates.select(*KEY, "text", "wanted").mapInArrow(run, "prefix long, rest long, doc_id long, text_hash long, start long")


def _cut(candidates: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of documents with the ``spans`` (start, n) of windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id"), batch.column("text"), batch.column("spans")):
                words = (text.as_py() or "").encode().split()
                at, n = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + n + length - 1, -1)
                left = [w for w, covered in zip(words, np.cumsum(change).tolist()) if not covered]
                rows.append((doc_id.as_py(), len(words), len(words) - len(left), _digest(left), b" ".join(left).decode()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return candidates.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def repeats_removed(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), one row per row of ``docs(doc_id, text)``.

    A word goes if a window of ``length`` words that covers it has the same words as one that starts earlier: in a
    smaller doc_id, or in the same document before it. ``kept`` holds the words left, joined by one space, for
    documents that lose words; it is null for others, whose words all stay. Texts of fewer than ``length`` words
    keep theirs, and null texts have none. A null doc_id comes before all others. Different texts
    with one doc_id are different documents, in the order of their hashes; a repeated row is cut like the first and returned
    again. Other columns are not read. Runs jobs when called; sampled prefixes, the texts with
    repeated ones and the nodes are stored in the shared folder.
    """
    if not 0 < prefix < length:
        raise ValueError("a prefix is shorter than a window")
    workers_ready(docs.sparkSession)
    text = F.col("text").cast("string")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )
    scanned = materialize(_scanned(texts, length, prefix), "prefixes")
    sampled = scanned.select(*KEY, F.explode("prefixes").alias("prefix"))
    shared = sampled.groupBy("prefix").count().filter("count > 1").select("prefix")
    repeated = sampled.join(shared, "prefix").groupBy(*KEY).agg(F.collect_set("prefix").alias("repeated"))
    candidates = materialize(texts.join(repeated, KEY), "candidates")

    node, place = ["prefix", "rest"], F.struct(*KEY, "start")
    occurrences = materialize(_occurrences(candidates, length, prefix), "occurrences")
    contexts = materialize(
        occurrences.groupBy(*node).agg(F.min(place).alias("first"), F.count("*").alias("times")), "contexts"
    )
    again = occurrences.join(contexts.filter("times > 1"), node).filter(place != F.col("first"))
    split = contexts.groupBy("prefix").count().filter("count > 1").select("prefix")
    wanted = contexts.join(split, "prefix", "left_semi").groupBy(*(F.col(f"first.{k}").alias(k) for k in KEY)).agg(
        F.collect_set("first.start").alias("wanted")
    )
    windows = materialize(_windows(candidates.join(wanted, KEY), length, prefix), "windows")
    nodes = windows.groupBy(*node).agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
    later = windows.join(nodes, node).filter(place != F.col("first"))
    found = again.select(*KEY, "start", "n").union(later.select(*KEY, "start", F.lit(1).cast("long")))
    spans = materialize(found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")
    cut = _cut(candidates.select(*KEY, "text").join(spans, KEY).drop("text_hash"), length)
    whole = scanned.join(spans.select(*KEY), KEY, "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept")
    )
    return whole.union(cut).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
