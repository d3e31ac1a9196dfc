"""Token counts of a unigram tokenizer without its tokens: a count-only Viterbi search.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word by their ends. Dynamic programming carries the
best score and the number of pieces up to each character. Ties go to the match that starts first, and a single
character without a piece of its own is unknown, at the least score minus 10, as the tokenizers library has it; a run of
unknown characters is one token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from venuematch.llm.shipping import workers_ready

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEEP = 600_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the pieces of a sentencepiece file that stand for text, scored by rank as in Zipf's law.

    The public files hold ranks of merges instead of probabilities; control, unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), -math.log(rank + 2.0)) for rank, i in enumerate(ids)]


class Counter(dict):
    """Token counts of words, each kept once it is found, in a table of bounded size."""

    def __init__(self, vocabulary: list[tuple[str, float]], keep: int = KEEP):
        super().__init__()
        self.keep = keep
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.matches = self.automaton.iter if len(self.automaton) else lambda word: ()

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        n = self[word] = self.search(word)
        return n

    def search(self, word: str) -> int:
        """Number of tokens of one word, its leading space sign included."""
        n = len(word)
        # Best score up to each character, the tokens it takes, and whether the last one is unknown.
        score, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best, tokens, single, at = -math.inf, 0, False, 0
        for end, (length, own) in [*self.matches(word), (n, (0, 0.0))]:
            while at < end:
                last = not single and score[at] + self.unknown > best
                if last:
                    best, tokens = score[at] + self.unknown, count[at] + (not odd[at])
                at += 1
                score[at], count[at], odd[at] = best, tokens, last
                best, single = -math.inf, False
            if end == n:
                break
            total = score[end + 1 - length] + own
            if length == 1:
                single = True
            # Matches of one end come with the longest first, so an equal score doesn't replace it.
            if total > best:
                best, tokens = total, count[end + 1 - length] + 1
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text cut before each space, the spaces standing in front of the words."""
        if not text:
            return 0
        words = text.replace(" ", SPACE).split(SPACE)
        head = [] if text[0] in (" ", SPACE) else [SPACE + words[0]]
        return sum(map(self.__getitem__, head)) + sum(self[SPACE + w] for w in words[1:])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this process for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(unigram_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs(doc_id, text)``; other columns are not read.

    ``vocabulary`` is a sentencepiece file that every executor can read. A text is taken with a space in front, unless
    it starts with one (or with its sign), and is cut before each space, so a count is that of the whole text. Null and empty texts have no
    tokens. One narrow pass, without a shuffle; rows are counted one by one, so repeated rows agree.
    """
    workers_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in batches:
            found = [counts.count(x.as_py()) for x in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long")
