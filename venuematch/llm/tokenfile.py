"""Token ids in files: a concatenated id array per block, with document boundaries in Elias-Fano code.

A block is one row of a Parquet file: the ids of consecutive documents as 16- or 32-bit integers, and two monotone
sequences in Elias-Fano code, the documents' ends in the id array and their doc_ids. An Elias-Fano sequence keeps
the low bits of each value packed and the high bits in unary, about 2 + log2(range / count) bits a value. Its i-th
value is found by a select on the unary bits, from samples of every 64th one.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuematch.llm.shipping import workers_ready
from venuematch.llm.tables import Recent

END_ID = 0
BLOCK_IDS = 1 << 20
SAMPLE = 64
CACHE = 400_000

_BLOCK_COLUMNS = {
    "part": pa.int32(), "block": pa.int64(), "n_docs": pa.int64(), "n_nulls": pa.int64(), "n_ids": pa.int64(), "id_bytes": pa.int32(),
    "ids": pa.binary(), "least": pa.int64(),
    **{f"{name}_{field}": kind for name in ("ends", "docs") for field, kind in (
        ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()))},
}
BLOCK_SCHEMA = pa.schema(list(_BLOCK_COLUMNS.items()))
BLOCK_DDL = ", ".join(
    f"{name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'})[kind]}" for name, kind in _BLOCK_COLUMNS.items()
)


@dataclass(frozen=True)
class EliasFano:
    """A sequence of integers from 0 that never falls."""

    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        marks = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(marks[-1]) + 1 if n else 0, np.uint8)
        unary[marks] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        return cls(low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(),
                   np.packbits(unary, bitorder="little").tobytes(), marks[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value."""
        high, at = np.frombuffer(self.high, np.uint8), int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        wanted = i % SAMPLE
        byte = at // 8
        ahead = int(high[byte]) >> (at % 8) << (at % 8)
        while wanted >= ahead.bit_count():
            wanted -= ahead.bit_count()
            byte += 1
            ahead = int(high[byte])
        for _ in range(wanted):
            ahead &= ahead - 1
        mark = 8 * byte + (ahead & -ahead).bit_length() - 1
        first = i * self.low_bits
        last = first + self.low_bits
        packed = int.from_bytes(self.low[first // 8 : (last + 7) // 8], "little") >> (first % 8)
        return (mark - i) << self.low_bits | (packed & ((1 << self.low_bits) - 1))

    def decode(self, n: int) -> np.ndarray:
        """All n values."""
        marks = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=n * self.low_bits)
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        low = (low.reshape(n, self.low_bits) * weights).sum(axis=1, dtype=np.uint64)
        return (marks - np.arange(n)).astype(np.uint64) << np.uint64(self.low_bits) | low


# The byte-level pre-tokenizer's pattern and its characters for bytes.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SHOWN_SPACE = chr(_BYTE_CHARS[32])


class Parts(Recent):
    """Ids of a pre-tokenizer's parts."""

    def __init__(self, encoder: Encoder, keep: int):
        super().__init__(keep)
        self.tokenize, self.code = encoder.tokenizer.model.tokenize, encoder.code

    def found(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            shown = part.replace(" ", _SHOWN_SPACE)
        else:
            shown = part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()


class Pieces(Recent):
    """Ids of what stands between two spaces, the space in front included."""

    def __init__(self, encoder: Encoder, keep: int):
        super().__init__(keep)
        self.encoder, self.parts = encoder, Parts(encoder, keep)

    def found(self, piece: str) -> bytes:
        text = " " + piece
        if piece.isalpha() and not self.encoder.added_words:
            return self.parts.found(text)
        if self.encoder.added and self.encoder.added.search(text):
            return self.encoder.whole([text])[0]
        head, *rest = BYTE_LEVEL.findall(text)
        # A word with punctuation has the word's own ids first.
        first = self[head[1:]] if head[:1] == " " and head[1:].isalpha() else self.parts[head]
        return first + b"".join(map(self.parts.__getitem__, rest))


class Encoder:
    """Token ids of texts, as the tokenizer gives them, with each different word encoded once while it is kept.

    A byte-level pre-tokenizer never joins text across a space that follows a character other than white space, so a
    text is cut there, and each piece is encoded with the space in front of it. With any other kind of tokenizer whole
    texts are encoded.
    """

    _ODD = re.compile(r"\s ")
    _CUT = re.compile(r"(?<=\S) ")

    def __init__(self, path: str, keep: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        added = [t["content"] for t in made["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.added_words = any(a.strip().isalpha() for a in added)
        self.cuts = (
            before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
            and made["normalizer"] is None and made["truncation"] is None
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in made["added_tokens"])
        )
        self.pieces = Pieces(self, keep)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers, without special tokens."""
        if not self.cuts:
            return self.whole(texts)
        cut = [self._CUT.split(t) if t[:1] == " " or self._ODD.search(t) else t.split(" ") for t in texts]
        ids = self.pieces.__getitem__
        return [head + b"".join(map(ids, rest[1:])) for head, rest in zip(self.whole([c[0] for c in cut]), cut)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _block(part: int, block: int, doc_ids: list, ids: list[bytes], width: int) -> dict:
    """One row of the file; nulls come first and hold no doc_id."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum([len(x) // width for x in ids]))
    docs = EliasFano.encode(known.view(np.uint64) - np.uint64(least % (1 << 64)))
    return {
        "part": part, "block": block, "n_docs": len(ids), "n_nulls": len(ids) - len(known), "n_ids": sum(map(len, ids)) // width,
        "id_bytes": width, "ids": b"".join(ids), "least": least,
        **{f"{name}_{field}": getattr(x, field) for name, x in (("ends", ends), ("docs", docs)) for field in ("low_bits", "low", "high", "samples")},
    }


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of every row of ``docs(doc_id, text)`` under ``path``, in ascending doc_id order.

    Each document is followed by ``end_id``. A null text is empty, a null doc_id comes first, repeated rows stay.
    Rows are dealt out by ranges of doc_id and of a hash of the text, so equal doc_ids do not meet in one task; among
    equal doc_ids the order is that of the hash. ``tokenizer`` is a file of the tokenizers library that every executor can
    read. Spark commits the files, so a lost task is written again. Other columns are not read.
    """
    workers_ready(docs.sparkSession)
    order = ["doc_id", "tie"]
    sorted_docs = (
        docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = encode.kind.itemsize
        end = np.array([end_id], encode.kind).tobytes()
        part, block, held, doc_ids, ids = 0, 0, 0, [], []
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc_id, found in zip(rows.column("doc_id").to_pylist(), encode.encode(rows.column("text").to_pylist())):
                    doc_ids.append(doc_id)
                    ids.append(found + end)
                    held += len(found) // width + 1
                    if held >= BLOCK_IDS:
                        yield pa.RecordBatch.from_pylist([_block(part, block, doc_ids, ids, width)], BLOCK_SCHEMA)
                        block, held, doc_ids, ids = block + 1, 0, [], []
        if ids:
            yield pa.RecordBatch.from_pylist([_block(part, block, doc_ids, ids, width)], BLOCK_SCHEMA)

    sorted_docs.mapInArrow(run, BLOCK_DDL).write.parquet(path)


def _sequence(row: dict, name: str) -> EliasFano:
    return EliasFano(*(row[f"{name}_{f}"] for f in ("low_bits", "low", "high", "samples")))


def _boundaries(row: dict) -> tuple[np.ndarray, list]:
    """Ends and doc_ids of a block's documents; each end is found by a select."""
    ends, docs = _sequence(row, "ends"), _sequence(row, "docs")
    known = docs.decode(row["n_docs"] - row["n_nulls"]) + np.uint64(row["least"] % (1 << 64))
    selected = np.fromiter(map(ends.select, range(row["n_docs"])), np.int64, row["n_docs"])
    return selected, [None] * row["n_nulls"] + known.view(np.int64).tolist()


def document_ids(row: dict, i: int) -> np.ndarray:
    """The ids of the i-th document of a block, by two selects."""
    ends = _sequence(row, "ends")
    first = ends.select(i - 1) if i else 0
    return np.frombuffer(row["ids"], f"<u{row['id_bytes']}", ends.select(i) - first, first * row["id_bytes"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; ``start`` counts the ids of all before it.

    The starts of blocks come from a running sum over one row per block, first within a part and then over parts.
    """
    workers_ready(spark)
    blocks = spark.read.parquet(path)
    earlier = Window.unboundedPreceding, -1
    sizes = blocks.select("part", "block", "n_ids")
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(*earlier)), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("held"))
    before = parts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    starts = inside.join(before, "part").select("part", "block", (F.col("inside") + F.col("before")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, doc_ids = _boundaries(row)
                begins = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [pa.array([row["part"]] * len(ends), pa.int32()), pa.array([row["block"]] * len(ends), pa.int64()),
                     pa.array(doc_ids, pa.int64()), pa.array(begins), pa.array(ends - begins), pa.array(crcs, pa.int64())],
                    ["part", "block", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    found = blocks.mapInArrow(run, "part int, block long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )
