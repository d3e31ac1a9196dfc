"""Quality rules on repetition: how many characters lie in duplicated n-grams and lines of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from venuematch.llm.shipping import workers_ready
from venuematch.llm.words import WORD_PATTERN, mix, window_hashes

LENGTHS = (5, 6, 7, 8, 9, 10)
# Most characters, as a share of all word characters, in n-grams that came before; longer ones weigh more.
MOST_REPEATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MOST_LINE_CHARS = 0.20
MOST_SYMBOLS = 0.10
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MOST_REPEAT_WORDS = 20
BASE_LENGTH = 5

_WORD = re.compile(WORD_PATTERN)
_SPACE = " \t\n\r\x0b\x0c"


def _covered(windows: np.ndarray, length: int, n_words: int) -> np.ndarray:
    """Which words lie in one of the marked windows."""
    change = np.zeros(n_words + 1, np.int32)
    starts = np.flatnonzero(windows)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def measured(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, then repeated characters by length)."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = np.fromiter(map(len, words), np.int64, n)
    codes: dict[str, int] = {}
    numbered = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, n)
    hashes = mix(numbered + np.uint64(1))
    n_repeat, repeated = 0, [0] * len(LENGTHS)
    for i, length in enumerate(LENGTHS):
        windows = window_hashes(hashes, (length,))[length]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        # Without a repeat of this length there is none of a greater one.
        if not same.any():
            break
        again = np.zeros(len(windows), bool)
        again[order[1:][same]] = True
        if length == BASE_LENGTH:
            found = again.copy()
            found[order[:-1][same]] = True
            n_repeat = int(_covered(found, length, n).sum())
        repeated[i] = int(chars[_covered(again, length, n)].sum())
    seen: set[str] = set()
    n_dup = dup_chars = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            if line in seen:
                n_dup += 1
                dup_chars += sum(map(len, _WORD.findall(line)))
            seen.add(line)
    return n, int(chars.sum()), sum(map(text.count, SYMBOLS)), n_dup, n_repeat, dup_chars, *repeated


def judged(m: tuple) -> tuple[bool, bool]:
    """(base_failed, kept) of a measured text."""
    n_words, word_chars, n_symbols, _, n_repeat_words, dup_line_chars, *repeated = m
    base_failed = n_words < MIN_WORDS or 100 * n_repeat_words > MOST_REPEAT_WORDS * n_words
    if base_failed:
        return True, False
    bad = (
        any(r > MOST_REPEATED[length] * word_chars for length, r in zip(LENGTHS, repeated))
        or dup_line_chars > MOST_LINE_CHARS * word_chars
        or n_symbols > MOST_SYMBOLS * n_words
    )
    return False, not bad


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, shares and verdict for every row of ``docs(doc_id, text)``; other columns are not read.

    Base counts: n_words, word_chars, n_symbols, n_dup_lines (lines with a word that equal an earlier line) and
    n_repeat_words (words in 5-word windows found twice or more, the first included). ``base_failed`` says fewer than
    10 words or more than a fifth of them repeated. ``repeated_share`` holds, for n-grams of 5 to 10 words, the share
    of word characters in n-grams that came before. A text is kept if the base holds and no share of repeated
    characters, lines or symbols is above its limit. Null and empty texts have no words and fail. Rows are judged
    one by one, so repeated rows agree. One narrow pass, without a shuffle.
    """
    workers_ready(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(x.as_py()) for x in batch.column("text")]
            verdicts = [judged(m) for m in rows]
            shares = [[r / m[1] if m[1] else 0.0 for r in m[6:]] for m in rows]
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array([m[i] for m in rows], pa.int64()) for i in range(5)),
                 pa.array([m[5] / m[1] if m[1] else 0.0 for m in rows], pa.float64()), pa.array(shares, pa.list_(pa.float64())),
                 pa.array([v[0] for v in verdicts], pa.bool_()), pa.array([v[1] for v in verdicts], pa.bool_())],
                ["doc_id", *names, "dup_line_share", "repeated_share", "base_failed", "kept"],
            )

    ddl = "doc_id long, " + ", ".join(f"{n} long" for n in names) + (
        ", dup_line_share double, repeated_share array<double>, base_failed boolean, kept boolean"
    )
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl)
