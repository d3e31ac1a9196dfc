"""SimHash near-duplicates: fingerprints linked at a small bit distance by a generalised pigeonhole search.

The 64 bits are dealt into partitions, correlated bits together. Thresholds t_i with sum(t_i) = k - m + 1 are
complete: two fingerprints at distance k or less are within t_i in some partition i (-1 skips a partition).
Dynamic programming picks the thresholds, and the number of partitions, with the least estimated work. A probe
enumerates the partition values within t_i, meets equal values in an equi-join, and is verified on all bits.

A bucket with more members than its pairs are worth is closed another exact way: two fingerprints are within k
bits exactly if both lie within k/2 bits of a common value, so each of them is sent to those values. The members
of a value are all linked, and their number is bounded by the values around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from venuematch.llm.components import connected_components
from venuematch.llm.rows import packed, unpacked
from venuematch.llm.shipping import workers_ready
from venuematch.storage import materialize

BITS = 64
SHINGLE = 3
SEED = 42
MAX_BITS = 2
BLOCK = 8

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Entry v has bit j of v in its byte j, so that up to 255 entries add up without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
_POPCOUNT = np.array([v.bit_count() for v in range(256)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' hashes, bit by bit, unsigned; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words)) - 1
    spans = zip(starts[: len(words) - width].tolist(), ends[width:].tolist())
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 255 * 256):
        spread = _SPREAD[hashes[part : part + 255 * 256].view(np.uint8).reshape(-1, 8)]
        counts += np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0).view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of ``docs(doc_id, text)``; fp holds the 64 bits as a signed long."""
    workers_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], dtype=np.uint64)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))]
            yield pa.record_batch(columns, ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return texts.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _gathered(prints: DataFrame, count, size: int) -> np.ndarray:
    """Sum over all fingerprints of ``count(array) -> vector``: one vector a partition, one row an entry at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(size)
    for at, n in prints.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out


def _as_bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pair_counts(values: np.ndarray) -> np.ndarray:
    """How often two bits are set together, for all pairs of bits."""
    total = np.zeros((BITS, BITS))
    for part in range(0, len(values), 1 << 16):
        bits = _as_bits(values[part : part + (1 << 16)]).astype(np.float32)
        total += bits.T @ bits
    return total.ravel().astype(np.int64)


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    share = np.diag(together) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs(together / n - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, groups = list(range(BITS)), []
    for i in range(parts):
        group = [max(left, key=lambda b: (close[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < BITS // parts + (i < BITS % parts):
            group.append(max(left, key=lambda b: (close[b, group].mean(), -b)))
            left.remove(group[-1])
        groups.append(group)
    return groups


def _blocks(group: list[int]) -> list[list[int]]:
    return [group[i : i + BLOCK] for i in range(0, len(group), BLOCK)]


def _block_counts(blocks: list[list[int]]):
    """Counter of the values that each block of bits takes."""

    def count(values: np.ndarray) -> np.ndarray:
        bits = _as_bits(values)
        return np.concatenate([
            np.bincount(bits[:, b].astype(np.int64) @ (1 << np.arange(len(b))), minlength=256) for b in blocks
        ])

    return count


def _within(histograms: list[np.ndarray], n: int, most: int) -> list[float]:
    """Estimated ordered pairs within 0..most bits in a partition, its blocks taken as independent."""
    spread = np.ones(1)
    apart = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)]
    for h in histograms:
        share = h / n
        near = np.array([share @ ((apart == d) @ share) for d in range(BLOCK + 1)])
        spread = np.convolve(spread, near)
    return list(np.cumsum(spread)[: most + 1] * n * n)


def allocated(work: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least work of thresholds -1..most with the given sum; ``work[i][t + 1]`` is that of t in partition i."""
    best = {0: (0.0, [])}
    for costs in work:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in enumerate(costs, start=-1):
                if used + t not in step or cost + more < step[used + t][0]:
                    step[used + t] = (cost + more, [*chosen, t])
        best = step
    return best[total]


def search_plan(prints: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to be searched, planned on counts over all fingerprints."""
    n = prints.count()
    if n < 2:
        return []
    together = _gathered(prints, _pair_counts, BITS * BITS).reshape(BITS, BITS)
    options = [grouped_bits(together, n, parts) for parts in range(1 + max_bits // 2, max_bits + 3)]
    blocks = [_blocks(group) for groups in options for group in groups]
    histograms = iter(_gathered(prints, _block_counts(sum(blocks, [])), 256 * sum(map(len, blocks))).reshape(-1, 256))
    plans = []
    for groups in options:
        work = []
        for group in groups:
            near = _within([next(histograms) for _ in _blocks(group)], n, max_bits)
            probes = np.cumsum([comb(len(group), d) for d in range(max_bits + 1)])
            work.append([0.0, *(n * (1.0 + probes[t]) + near[t] for t in range(max_bits + 1))])
        cost, chosen = allocated(work, max_bits - len(groups) + 1)
        plans.append((cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for d in range(most + 1) for c in combinations(bits, d)]


def _flipped(value: Column, flips: list[int]) -> Column:
    return F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: value.bitwiseXOR(f)))


def _signatures(prints: DataFrame, plan: list[tuple[list[int], int]], probing: bool) -> DataFrame:
    frames = [
        prints.select(
            F.lit(i).alias("part"),
            _flipped(F.col("fp").bitwiseAND(_signed(sum(1 << b for b in bits))), _flips(bits, most if probing else 0)).alias("value"),
            "fp",
        )
        for i, (bits, most) in enumerate(plan)
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def _close(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _common_values(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links among all ``prints(fp)`` by their common values; at an odd distance one bit is left out first."""
    half = max_bits // 2
    if max_bits % 2:
        one = F.explode(F.array(*(F.lit(_signed(1 << b)) for b in range(BITS))))
        sent = prints.select("fp", one.alias("out")).withColumn("value", F.col("fp").bitwiseAND(F.bitwise_not("out")))
    else:
        sent = prints.withColumn("out", F.lit(0)).withColumn("value", F.col("fp"))
    around = sent.select("fp", "out", _flipped(F.col("value"), _flips(list(range(BITS)), half)).alias("value"))
    groups = around.groupBy("out", "value").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return groups.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), not always all pairs but enough to connect all, of distinct ``prints(fp)`` within ``max_bits``."""
    plan = search_plan(prints, max_bits)
    if not plan:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    # Above this size a bucket's pairs outnumber the common values of its members.
    worth = 2 * sum(comb(BITS, d) for d in range(max_bits // 2 + 1)) * (BITS if max_bits % 2 else 1)
    keys = ["part", "value"]
    members, probes = (_signatures(prints, plan, probing) for probing in (False, True))
    crowded = materialize(members.groupBy(*keys).count().filter(F.col("count") > worth).select(*keys), "crowded")
    pairs = (
        probes.join(crowded, keys, "left_anti").select(*keys, F.col("fp").alias("a"))
        .join(members.join(crowded, keys, "left_anti").select(*keys, F.col("fp").alias("b")), keys)
        .filter((F.col("a") < F.col("b")) & _close(F.col("a"), F.col("b"), max_bits))
        .select("a", "b")
    )
    gathered = probes.join(crowded, keys, "left_semi").select("fp").distinct()
    return pairs.union(_common_values(gathered, max_bits))


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, least, first): the root of each fingerprint's group, its smallest doc_id and its first document.

    The first document is that of the smallest doc_id, a null one last, and of the smallest text hash among those.
    """
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_hash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(first).alias("first"))
    classes = materialize(classes, "classes")
    roots = connected_components(near_links(classes.select("fp"), max_bits))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least", "first"
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs(doc_id, text)``; other columns are not read.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits. Equal
    fingerprints are searched once. A null or wordless text has fingerprint zero and is linked like any other.
    Repeated rows are returned as often as they come. A null doc_id counts only where its group has no other.
    Runs jobs when called; fingerprints and links are stored in the shared folder.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(prints, max_bits)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = materialize(rooted.join(least, "root").select("fp", "component_id"), "groups")
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group, once, and all of its columns.

    A document is a doc_id with a text, so that a null or repeated doc_id never stands for another document.
    """
    prints = materialize(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    kept = _rooted(prints, max_bits).groupBy("root").agg(F.min("first").alias("first"))
    kept = materialize(kept.select("first.doc_id", "first.text_hash"), "kept")
    rows = packed(docs).select(
        "row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("text_hash")
    )
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["text_hash"] == kept["text_hash"])
    return unpacked(rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]))
