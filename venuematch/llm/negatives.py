"""Hard negatives by a secondary sort.

Every pair of an anchor with a row that may count is a key: anchor, score from the highest, whether it is a negative,
id. ``repartitionAndSortWithinPartitions`` deals the keys out by anchor and sorts them, so one pass over a partition
meets an anchor's rows in order: a positive opens a window of scores, a negative goes to the open windows, and a window
closes when it is full or the scores fall below it. Nothing of an anchor is held but its open windows.

An anchor meets all rows, so keys are thinned out before they are sent, which changes no result. Rows and anchors
are packed into blocks of bounded size, and each two blocks are one unit of work. A unit sends an anchor's first
positives in its block only. Once these are settled, by the same sort, a unit sends the first negatives of each of the
anchor's windows in its block only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuematch.llm.shipping import workers_ready
from venuematch.storage import materialize

POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
ANCHORS = 100
# Rows of a block, and numbers of all their vectors at most; a block of anchors may hold half as many.
BLOCK_ROWS = 16_384
BLOCK_NUMBERS = 1 << 21

# Big-endian, so that keys sort as bytes; signed numbers are shifted to unsigned ones.
KEY = np.dtype([
    ("anchor", ">u8"), ("anchor_tie", ">u8"), ("below", ">u8"), ("negative", "u1"), ("no_id", "u1"), ("id", ">u8"), ("tie", ">u8"),
])
_ANCHOR_BYTES = 16
_TOP = np.uint64(1 << 63)

_BLOCK_DDL = "rows long, ids binary, no_ids binary, ties binary, labels binary, vectors binary, widths long, floors binary"


def _shifted(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64) ^ _TOP


def _key_columns(keys: np.ndarray) -> pa.Array:
    packed = pa.Array.from_buffers(pa.binary(KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return packed.cast(pa.binary())


class Block:
    """Rows in the order of label, id and tie; ``floors`` has the scores of an anchor's positives, the rest filled up."""

    def __init__(self, row: dict):
        self.ids, self.ties, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "ties", "labels"))
        self.no_ids = np.frombuffer(row["no_ids"], np.uint8)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(row["rows"], row["widths"])
        self.greatest = int(np.abs(self.vectors).max(initial=0))
        self.floors = np.frombuffer(row["floors"], np.int64)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())


def _packed(table: pa.Table) -> dict:
    """One block of rows of the same width, read back by ``Block``."""
    ids = table.column("vec_id")
    no_ids = ids.is_null().to_numpy()
    ids, ties, labels = (table.column(c).fill_null(0).to_numpy() for c in ("vec_id", "tie", "label"))
    vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    order = np.lexsort((ties, ids, no_ids, labels))
    out = {"rows": len(ids), "ids": ids, "no_ids": no_ids.astype(np.uint8), "ties": ties, "labels": labels}
    out = {c: x[order].tobytes() if c != "rows" else x for c, x in out.items()}
    out |= {"vectors": vectors[order].tobytes(), "widths": vectors.shape[1], "floors": b""}
    if "floors" in table.column_names:
        out["floors"] = table.column("floors").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order].tobytes()
    return out


def _blocks(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """Rows dealt by a hash into blocks of about ``size`` rows, and the number of parts the hash has."""
    n = rows.count()
    parts = max(1, -(-n // size))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{name: key[0].as_py(), **_packed(table)}], _block_schema(name))

    dealt = rows.withColumn(name, F.pmod("tie", F.lit(parts))).withColumn("width", F.size("vector"))
    return dealt.groupBy(name, "width").applyInArrow(pack, f"{name} long, {_BLOCK_DDL}"), parts


def _block_schema(name: str) -> pa.Schema:
    kinds = {"rows": pa.int64(), "widths": pa.int64()}
    fields = [part.split()[0] for part in _BLOCK_DDL.split(", ")]
    return pa.schema([(name, pa.int64()), *((f, kinds.get(f, pa.binary())) for f in fields)])


def _scores(rows: Block, anchors: Block, at: slice) -> np.ndarray:
    """Exact inner products of some anchors with all rows."""
    most = rows.greatest * anchors.greatest * max(1, rows.vectors.shape[1])
    # 100 times a score is compared below.
    if most * 100 >= 1 << 63:
        raise OverflowError("the scores of these vectors don't fit 64 bits")
    kind = np.float64 if most < 1 << 53 else np.int64
    return (anchors.vectors[at].astype(kind) @ rows.vectors.astype(kind).T).astype(np.int64)


def _first(scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the n highest scores in their order, of equal ones the earliest."""
    places = np.arange(len(scores))
    if len(scores) > n:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    return places[np.argsort(-scores[places], kind="stable")][:n]


def _low(positive: int, low_percent: int) -> int:
    """The least score of a positive's window."""
    return -(-low_percent * positive // 100)


def _unit_keys(rows: Block, anchors: Block, choose: Callable) -> np.ndarray:
    """Keys of the rows that ``choose(scores, block, anchor's place)`` takes for each anchor."""
    found = [np.zeros(0, KEY)]
    by_id = np.lexsort((rows.ties, rows.ids, rows.no_ids))
    for at in range(0, len(anchors.ids), 64):
        block = _scores(rows, anchors, slice(at, at + 64))
        for i, scores in enumerate(block, at):
            for negative, places in choose(scores, rows, by_id, anchors, i):
                keys = np.zeros(len(places), KEY)
                keys["anchor"], keys["anchor_tie"] = _shifted(anchors.ids[i : i + 1]), _shifted(anchors.ties[i : i + 1])
                keys["below"] = ~_shifted(scores[places])
                keys["negative"], keys["no_id"] = negative, rows.no_ids[places]
                keys["id"], keys["tie"] = _shifted(rows.ids[places]), _shifted(rows.ties[places])
                found.append(keys)
    # Concatenating turns numbers to the machine's byte order.
    return np.concatenate(found).astype(KEY)


def _positives(n: int) -> Callable:
    def choose(scores: np.ndarray, rows: Block, by_id: np.ndarray, anchors: Block, i: int):
        same = rows.of_label(int(anchors.labels[i]))
        others = np.flatnonzero((rows.ids[same] != anchors.ids[i]) | (rows.ties[same] != anchors.ties[i])) + same.start
        yield 0, others[_first(scores[others], n)]

    return choose


def _negatives(positives: int, n: int, low_percent: int) -> Callable:
    def choose(scores: np.ndarray, rows: Block, by_id: np.ndarray, anchors: Block, i: int):
        same = rows.of_label(int(anchors.labels[i]))
        ordered = by_id[(by_id < same.start) | (by_id >= same.stop)]
        ordered_scores = scores[ordered]
        taken = [np.zeros(0, np.int64)]
        for positive in set(anchors.floors[i * positives : (i + 1) * positives].tolist()):
            inside = np.flatnonzero((ordered_scores <= positive) & (ordered_scores >= _low(positive, low_percent)))
            taken.append(ordered[inside[_first(ordered_scores[inside], n)]])
        yield 1, np.unique(np.concatenate(taken))

    return choose


def _keys(row_blocks: tuple[DataFrame, int], anchor_blocks: tuple[DataFrame, int], choose: Callable) -> DataFrame:
    """(key) of all units. Each block is copied to the parts of the other side, so a unit has a key of its own."""
    rows, row_parts = row_blocks
    anchors, anchor_parts = anchor_blocks
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    names = [part.split()[0] for part in _BLOCK_DDL.split(", ")]
    left = rows.select(F.struct(*names).alias("row_block"), "widths", "part", copies(anchor_parts).alias("anchor_part"))
    right = anchors.select(F.struct(*names).alias("anchor_block"), "widths", "anchor_part", copies(row_parts).alias("part"))
    units = left.join(right, ["part", "anchor_part", "widths"]).select("row_block", "anchor_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                keys = _unit_keys(Block(unit["row_block"]), Block(unit["anchor_block"]), choose)
                for at in range(0, len(keys), 10_000):
                    yield pa.record_batch([_key_columns(keys[at : at + 10_000])], ["key"])

    return units.mapInArrow(run, "key binary")


def _sorted_by_anchor(keys: DataFrame) -> RDD:
    """Keys dealt out by anchor, sorted in their partitions."""
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = keys.rdd.map(lambda row: (bytes(row[0]), None))
    # The anchor's tie is a hash.
    return pairs.repartitionAndSortWithinPartitions(partitions, lambda key: int.from_bytes(key[8:_ANCHOR_BYTES], "big")).keys()


def _read(key: bytes) -> tuple[int, int, int, bool, int | None]:
    """anchor, its tie, score, whether it is a negative, id."""
    unsigned = lambda at: int.from_bytes(key[at : at + 8], "big")
    signed = lambda at: unsigned(at) - (1 << 63)
    return signed(0), signed(8), (1 << 63) - 1 - unsigned(16), bool(key[24]), None if key[25] else signed(26)


def _first_positives(keys: Iterator[bytes], n: int) -> Iterator[tuple]:
    """(anchor, tie, score, key) of the first n keys of each anchor."""
    current, left = b"", 0
    for key in keys:
        if key[:_ANCHOR_BYTES] != current:
            current, left = key[:_ANCHOR_BYTES], n
        if left:
            left -= 1
            anchor, tie, score, _, _ = _read(key)
            yield anchor, tie, score, bytearray(key)


def _windows(keys: Iterator[bytes], negatives: int, low_percent: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive's score, negative's score) of sorted keys."""
    current, windows = b"", []
    for key in keys:
        if key[:_ANCHOR_BYTES] != current:
            current, windows = key[:_ANCHOR_BYTES], []
        anchor, _, score, negative, id_ = _read(key)
        if not negative:
            windows.append([id_, score, 0])
            continue
        # Scores only fall, so a window that is passed or full is closed for good.
        windows = [w for w in windows if w[2] < negatives and low_percent * w[1] <= 100 * score]
        for window in windows:
            window[2] += 1
            yield anchor, window[0], window[2], id_, window[1], score


def hard_negatives(
    rows: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows(vec_id, label, vector)``.

    ``vector`` is an array of integers and ``label`` an integer. A row's score is its inner product with the anchor,
    exact in 64 bits (an OverflowError where 100 times the product may not fit). Anchors are the rows whose vec_id is
    divisible by ``every``; an anchor's positives are its first ``positives`` other rows of its label, by falling
    score, ties by smaller vec_id. For each of them the first ``negatives`` rows of other labels are returned whose
    score is at most the positive's and ``low_percent`` of it at least.

    Rows with a null label, vector or component take no part. A null vec_id is no anchor, and comes after others of
    its score. Rows that are equal in vec_id, label and vector count once; other rows of one vec_id are rows of their
    own, in an order settled by a hash. Vectors of different lengths have no score. Rows of empty vectors have scores of 0.
    No anchors give no rows. Other columns are not read.

    Runs jobs when called. Stores the rows, their blocks and the positives in the shared folder; a block is bounded by
    ``BLOCK_ROWS`` rows and ``BLOCK_NUMBERS`` numbers, whatever the labels are.
    """
    if every < 1 or positives < 1 or negatives < 1 or not 0 <= low_percent <= 100:
        raise ValueError("every, positives and negatives are at least 1, and low_percent is at most 100")
    spark = rows.sparkSession
    workers_ready(spark)
    chosen = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>").alias("vector"))
    chosen = chosen.filter("label is not null and vector is not null and not exists(vector, x -> x is null)")
    stored = materialize(chosen.distinct().withColumn("tie", F.xxhash64("vec_id", "label", "vector")), "vectors")
    anchors = stored.filter(F.col("vec_id") % every == 0)
    widest = stored.agg(F.max(F.size("vector"))).first()[0]
    size = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, widest or 1)))

    blocks, parts = _blocks(stored, "part", size)
    row_blocks = materialize(blocks, "row-blocks"), parts
    keys = _keys(row_blocks, _blocks(anchors, "anchor_part", max(1, size // 2)), _positives(positives))
    found = _sorted_by_anchor(keys).mapPartitions(lambda keys: _first_positives(keys, positives))
    settled = materialize(_frame(spark, found, "anchor long, anchor_tie long, score long, key binary"), "positives")

    # The last floor is repeated, so that all anchors have as many.
    floors = settled.groupBy("anchor", "anchor_tie").agg(F.sort_array(F.collect_list("score"), False).alias("floors"))
    filled = F.concat("floors", F.array_repeat(F.element_at("floors", -1), positives - F.size("floors")))
    floors = floors.select(F.col("anchor").alias("vec_id"), F.col("anchor_tie").alias("tie"), filled.alias("floors"))
    with_floors = materialize(anchors.join(floors, ["vec_id", "tie"]), "anchors")
    keys = _keys(row_blocks, _blocks(with_floors, "anchor_part", max(1, size // 2)), _negatives(positives, negatives, low_percent))
    mined = _sorted_by_anchor(keys.union(settled.select("key"))).mapPartitions(lambda keys: _windows(keys, negatives, low_percent))
    return _frame(
        spark, mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


def _frame(spark: SparkSession, found: RDD, ddl: str) -> DataFrame:
    return spark.createDataFrame(found, ddl, verifySchema=False)


def floored(embedding, scale: int = 256):
    """floor(scale * x) of each component taken as a double; null where one is null or not finite."""
    x = F.transform(embedding.cast("array<double>"), lambda v: F.when(F.abs(v) < float("inf"), F.floor(v * float(scale))))
    return F.when(~F.exists(x, lambda v: v.isNull()), x)
