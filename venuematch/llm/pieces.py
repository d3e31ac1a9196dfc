"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A merge-type (BPE) model joins the best-scored adjacent pair, the leftmost of equal ones, until no pair is a piece. A
sequence of pieces is what the merges of its whole text give if and only if each two neighbours are what the merges of
their own text give. So no merges of long texts are run: an Aho-Corasick automaton finds the longest piece at each
place, a piece is taken if it is compatible with the one before it (the merges of the two, run once for each different
pair and kept), else the next shorter piece that begins it is tried. Where none fits, the place is marked in a bitfield
as one from which the rest can't be reached, and the piece before it is taken back.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuematch.llm.shipping import workers_ready
from venuematch.llm.tables import Recent

SPACE = "▁"
KEEP = 400_000
# A segment of more characters is encoded anew each time, so that kept ones are small.
KEPT_CHARS = 64
_BPE = 2
# More than the codes of all parts.
_CODES = 1 << 24
_NORMAL, _BYTE, _USER, _UNUSED = 1, 6, 4, 5


class Segments(Recent):
    """Ids of segments as little-endian 32-bit integers; those met lately are kept.

    No merge reaches over two characters that meet in no piece, so a segment is cut there.
    """

    def __init__(self, encoder: Encoder, keep: int):
        super().__init__(keep)
        self.encoder = encoder

    def found(self, segment: str) -> bytes:
        meet = self.encoder.meet
        cuts = [i for i, two in enumerate(zip(segment, segment[1:]), 1) if two not in meet]
        if not cuts:
            return self.encoder.ids_of(self.encoder.backtracked(segment))
        return b"".join(self[segment[a:b]] for a, b in zip([0, *cuts], [*cuts, len(segment)]))

    def worth_keeping(self, segment: str) -> bool:
        return len(segment) <= KEPT_CHARS


class Compatible(Recent):
    """Whether the merges of two parts put together give these two again; without a first one, the other.

    A key holds both codes.
    """

    def __init__(self, encoder: Encoder, keep: int):
        super().__init__(keep)
        self.encoder = encoder

    def found(self, key: int) -> bool:
        pair = [self.encoder.part(code) for code in divmod(key, _CODES)]
        return self.encoder.merged("".join(pair)) == [x for x in pair if x]


class Encoder:
    """Ids of texts by a merge-type model with byte pieces, as its library gives them.

    Models of another type, without byte pieces, or with user-defined or unused pieces are refused with a ValueError.
    A part of a text has a code: the id of its piece, or for a character that is none its code point above all ids.
    """

    def __init__(self, path: str, keep: int = KEEP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != _BPE or _BYTE not in kinds or kinds & {_USER, _UNUSED}:
            raise ValueError("a merge-type model with byte pieces, and without user-defined and unused ones, is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [p.piece if p.type == _NORMAL else "" for p in model.pieces]
        self.size = len(self.pieces)
        self.start = self.size + 0x110000
        self.scores = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.ids = {piece: i for i, piece in enumerate(self.pieces) if piece}
        self.meet = {two for piece in self.ids for two in zip(piece, piece[1:])}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.lengths = list(map(len, self.pieces))
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.shorter = [self._longest_start(piece) for piece in self.pieces]
        self.compatible = Compatible(self, keep)
        self.segments = Segments(self, keep)
        self.cut = self._cut_pattern()

    def _longest_start(self, piece: str) -> int:
        """The code of the longest piece that begins a piece and is shorter, or else of its first character; -1 for none."""
        if len(piece) < 2:
            return -1
        return next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), self.size + ord(piece[0]))

    def part(self, code: int) -> str:
        return self.pieces[code] if code < self.size else "" if code == self.start else chr(code - self.size)

    def _cut_pattern(self) -> re.Pattern | None:
        """Segments between which no merge is possible: a space sign after another character, and signs of no piece."""
        if any(SPACE in piece.lstrip(SPACE) for piece in self.scores):
            return None
        used = set(chain.from_iterable(self.scores))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in used)
        single = f"[{alone}]|{SPACE}+(?=[{alone}])|" if alone else ""
        return re.compile(f"{single}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """The pieces and single characters that the merges of a short text end with."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def backtracked(self, text: str) -> list[int]:
        """The codes of a text's parts, by longest matches that are taken back where they don't fit."""
        n, size, lengths = len(text), self.size, self.lengths
        longest = [-1] * (n + 1)
        # Matches come in the order of their ends, so the longest of a start comes last.
        for end, i in self.automaton.iter(text):
            longest[end + 1 - lengths[i]] = i
        compatible, shorter = self.compatible, self.shorter
        path: list[int] = []
        failed: bytearray | None = None
        at, before, code = 0, self.start * _CODES, longest[0]
        while at < n:
            if code < 0:
                code = size + ord(text[at])
            end = at + (lengths[code] if code < size else 1)
            if compatible[before + code] and not (failed and failed[end >> 3] >> (end & 7) & 1):
                path.append(code)
                at, before, code = end, code * _CODES, longest[end]
                continue
            code = shorter[code] if code < size else -1
            while code < 0:
                # No part fits here. The merges of the whole text are one path, so the start never fails.
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                code = path.pop()
                at -= lengths[code] if code < size else 1
                before = (path[-1] if path else self.start) * _CODES
                code = shorter[code] if code < size else -1
        return path

    def ids_of(self, codes: list[int]) -> bytes:
        """Their ids; a character that is no piece becomes the pieces of its bytes."""
        if max(codes) >= self.size:
            codes = [i for c in codes for i in ([c] if c < self.size else [self.bytes[b] for b in chr(c - self.size).encode()])]
        return array("i", codes).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, normalised by the library's own rules."""
        normal = self.library.normalize(text) if text else ""
        if not normal:
            return np.zeros(0, "<i4")
        parts = self.cut.findall(normal) if self.cut else [normal]
        return np.frombuffer(b"".join(map(self.segments.__getitem__, parts)), "<i4")

    def decode(self, ids: np.ndarray | None) -> str:
        return self.library.decode(ids.tolist()) if ids is not None and len(ids) else ""


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a model file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ids_column(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *found]))


def _mapped(frame: DataFrame, model: str, rows) -> DataFrame:
    """(doc_id, ids, text) of ``rows(encoder, slice of a batch)``, taken over a few rows at a time."""
    workers_ready(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_model = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts = rows(with_model, part)
                yield pa.record_batch(
                    [part.column("doc_id"), _ids_column(ids), pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
                )

    return frame.mapInArrow(run, "doc_id long, ids array<int>, text string")


def _encoded(docs: DataFrame, model: str, back: bool) -> DataFrame:
    def rows(with_model: Encoder, part: pa.RecordBatch) -> tuple[list[np.ndarray], list[str | None]]:
        ids = [with_model.encode(x.as_py()) for x in part.column("text")]
        return ids, [with_model.decode(x) if back else None for x in ids]

    return _mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), model, rows)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs(doc_id, text)``, without begin and end ids; other columns are not read.

    ``model`` is a sentencepiece file that every executor can read. Null and empty texts have no ids; a null doc_id is
    returned as it is, and repeated rows each give a row. One narrow pass without a shuffle; work and memory grow in
    proportion to the text, also for one without spaces.
    """
    return _encoded(docs, model, False).select("doc_id", "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) for every row of ``encoded(doc_id, ids)``, by the library; null and empty ids give an empty text."""

    def rows(with_model: Encoder, part: pa.RecordBatch) -> tuple[list[np.ndarray], list[str]]:
        ids = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in part.column("ids")]
        return [np.zeros(0, np.int32)] * len(ids), [with_model.decode(x) for x in ids]

    chosen = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>").alias("ids"))
    return _mapped(chosen, model, rows).select("doc_id", "text")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text): ``encode`` and, in the same pass, ``decode`` of these ids."""
    return _encoded(docs, model, True)
