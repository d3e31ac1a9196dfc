"""Phrase collocations counted in suffix trees that are partitioned by word prefixes.

A suffix starts at each word of a piece of text and is cut at the longest phrase. All suffixes with one first word are
below one node of their language's tree, so they are dealt out by that prefix; where more suffixes than a part of the
memory budget share it, the prefix grows by a word, and again, each time counted by a scan of the texts. A hash spreads
the prefixes over groups of at most the budget. Equal suffixes of a scanned share of the texts become one leaf with a
count before they are sent. Each group's subtrees are built by themselves: sorted leaves, whose nodes at depth d are
the runs with d equal words, and a phrase's count is the total of the leaves below its node.

Words are named by 64-bit hashes of language and word. The table of all words shows if two share one; then all is done
anew with another seed, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from venuematch.llm.shipping import workers_ready
from venuematch.llm.words import mix, span_hashes
from venuematch.storage import materialize

LONGEST = 3
MIN_COUNT = 10
BEST = 2000
COVERED_PERCENT = 50
# Suffixes of a group's subtrees, and the share of it from which a prefix grows.
BUDGET = 2_000_000
HEAVY_SHARE = 8
NO_LANG = "und"

_CHUNK_BYTES = 1 << 20
_HELD_WORDS = 1_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANK, _END = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\v\f\r")] = _END
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Share:
    """The words of some texts in order: names, how many words of the piece follow each, and where each is.

    Suffixes of several words need names only; the texts and places are kept where words are read.
    """

    def __init__(self, seed: int, longest: int):
        self.seed, self.longest = seed, longest
        self.clear()

    def clear(self) -> None:
        self.names, self.follow, self.spans, self.data, self.langs, self.size = [], [], [], [], [], 0

    def add(self, texts: list[bytes], langs: list[str]) -> None:
        data = (b"\n".join(texts) + b"\n").translate(_LOWER)
        kinds = _KIND[np.frombuffer(data, np.uint8)]
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = kinds == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        # The data ends with a separator, so each word has its end.
        starts, ends = edges[0::2], edges[1::2]
        piece = np.cumsum(kinds == _END)[starts]
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        hashed = {lang: xxhash.xxh64_intdigest(lang, self.seed) for lang in set(langs)}
        lang = np.array([hashed[x] for x in langs], np.uint64)[doc]
        names = mix(span_hashes(data, starts, ends) * _STEP + lang)
        # 0 stands for no word.
        names[names == 0] = 1
        follow = np.zeros(len(names), np.uint8)
        for k in range(1, self.longest):
            follow[: max(0, len(names) - k)] += piece[k:] == piece[: max(0, len(names) - k)]
        self.names.append(names)
        self.follow.append(follow)
        if self.longest == 1:
            self.spans.append((starts, ends, doc))
            self.data.append(data)
            self.langs.append(langs)
        self.size += len(names)

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(leaves, counts) of shares of at most so many words that the places of three names fit one integer.

        A leaf is a row of names, 0 for none; leaves come in the order of places in the sorted names.
        """
        names = np.concatenate([np.zeros(0, np.uint64), *self.names])
        follow = np.concatenate([np.zeros(0, np.uint8), *self.follow])
        bits = 63 // self.longest
        most = min(_HELD_WORDS, (1 << bits) - self.longest - 1)
        for at in range(0, len(names), most):
            known, place = np.unique(names[at : at + most + self.longest - 1], return_inverse=True)
            known, place = np.concatenate([np.zeros(1, np.uint64), known]), place.astype(np.uint64) + np.uint64(1)
            n = min(most, len(names) - at)
            packed = place[:n].copy()
            for k in range(1, self.longest):
                later = np.zeros(n, np.uint64)
                there = place[k : k + n]
                later[: len(there)] = there
                packed = packed << np.uint64(bits) | np.where(follow[at : at + n] >= k, later, np.uint64(0))
            packed.sort()
            first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
            counts = np.diff(np.append(first, n))
            packed = packed[first]
            low = np.uint64((1 << bits) - 1)
            del place, first
            leaves = np.empty((self.longest, len(packed)), np.uint64)
            for row, k in zip(leaves, reversed(range(self.longest))):
                row[:] = known[(packed >> np.uint64(bits * k) & low).astype(np.int64)]
            yield leaves, counts


def _shares(batches: Iterator[pa.RecordBatch], seed: int, longest: int) -> Iterator[Share]:
    """The texts of a task in shares of bounded size, each to be used before the next; one long text is a share."""
    share, texts, langs, size = Share(seed, longest), [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            data = (text.as_py() or "").encode()
            texts.append(data)
            langs.append(lang.as_py())
            size += len(data)
            if size >= _CHUNK_BYTES:
                share.add(texts, langs)
                texts, langs, size = [], [], 0
                if share.size >= _HELD_WORDS:
                    yield share
                    share.clear()
    if texts:
        share.add(texts, langs)
    if share.size:
        yield share


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(k, lang, word, n): every word of a language with its name and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in _shares(batches, seed, 1):
            names, first, counts = np.unique(np.concatenate(share.names), return_index=True, return_counts=True)
            chunk = np.searchsorted(np.cumsum([len(x) for x in share.names]), first, "right")
            before = np.concatenate([[0], np.cumsum([len(x) for x in share.names])])[chunk]
            words, langs = [], []
            for c, i in zip(chunk.tolist(), (first - before).tolist()):
                starts, ends, doc = share.spans[c]
                words.append(share.data[c][starts[i] : ends[i]])
                langs.append(share.langs[c][doc[i]])
            for at in range(0, len(names), 50_000):
                upto = slice(at, at + 50_000)
                yield pa.record_batch(
                    [pa.array(names[upto].view(np.int64)), pa.array(langs[upto], pa.string()),
                     pa.array(words[upto], pa.binary()).cast(pa.string()), pa.array(counts[upto])],
                    ["k", "lang", "word", "n"],
                )

    found = texts.mapInArrow(run, "k long, lang string, word string, n long")
    return found.groupBy("k", "lang", "word").agg(F.sum("n").alias("n"))


def _held(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among a few sorted ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _next_route(route: np.ndarray, names: np.ndarray) -> np.ndarray:
    return mix(route * _STEP + names)


def _routes(leaves: np.ndarray, heavy: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes of each leaf's prefixes of one word, two, ..., and the depth of the first that isn't heavy."""
    routes, depth = [leaves[0]], np.ones(leaves.shape[1], np.int64)
    for level, names in enumerate(leaves[1:]):
        if level < len(heavy):
            depth[(depth == level + 1) & _held(routes[-1], heavy[level])] += 1
        routes.append(_next_route(routes[-1], names))
    return routes, depth


def _may_be_heavy(leaves: np.ndarray, heavy: list[np.ndarray]) -> np.ndarray:
    """Whether a prefix one word longer than the last heavy level may be heavy: so are both its shorter parts.

    No word at its end counts as one that is.
    """
    depth = len(heavy) + 1
    _, own = _routes(leaves[:depth], heavy)
    later = _held(leaves[1], heavy[0])
    route = leaves[1]
    for level in range(1, depth - 1):
        route = _next_route(route, leaves[level + 1])
        later &= _held(route, heavy[level])
    return (own == depth) & (later | (leaves[depth - 1] == 0))


def _prefix_counts(texts: DataFrame, seed: int, longest: int, heavy: list[np.ndarray]) -> DataFrame:
    """(route, names, n) of the prefixes one word longer than those of the last heavy level that may be heavy, too."""
    depth = len(heavy) + 1
    ddl = ", ".join(f"k{i + 1} long" for i in range(depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in _shares(batches, seed, longest):
            for leaves, counts in share.suffixes():
                kept = _may_be_heavy(leaves, heavy)
                leaves, counts = leaves[:depth, kept], counts[kept]
                # Leaves are in order, so equal prefixes stand together.
                first = np.flatnonzero(np.concatenate([[True], (leaves[:, 1:] != leaves[:, :-1]).any(axis=0)])[: len(counts)])
                totals = np.add.reduceat(counts, first) if len(first) else counts
                routes, _ = _routes(leaves[:, first], heavy)
                yield pa.record_batch(
                    [pa.array(x.view(np.int64)) for x in (routes[-1], *leaves[:, first])] + [pa.array(totals)],
                    ["route", *(f"k{i + 1}" for i in range(depth)), "n"],
                )

    found = texts.mapInArrow(run, f"route long, {ddl}, n long")
    names = [f"k{i + 1}" for i in range(depth)]
    return found.groupBy("route", *names).agg(F.sum("n").alias("n"))


def _group(route, groups: int):
    """The group of a prefix: the upper half of its hash, scaled."""
    return F.shiftright(F.shiftrightunsigned(route, 32) * groups, 32).cast("int")


def _partitioned(texts: DataFrame, words: DataFrame, seed: int, longest: int, budget: int) -> tuple[list[np.ndarray], list[DataFrame], int]:
    """The heavy prefixes by length, the counts of those that may be heavy from two words on, and the number of groups.

    A prefix of more suffixes than its share of the budget is heavy. These are collected; there are at most
    ``HEAVY_SHARE / budget`` of them for each word of the texts and length. All other prefixes are light, and the hash
    gives groups of half the budget on average; the number of groups is doubled while those of single words pass it.
    """
    limit = budget // HEAVY_SHARE
    heavy, counted = [], []
    level = words.select(F.col("k").alias("route"), "n")
    loads = level.filter(F.col("n") <= limit)
    while len(heavy) < longest - 1:
        found = [r["route"] for r in level.filter(F.col("n") > limit).select("route").collect()]
        if not found:
            break
        heavy.append(np.unique(np.array(found, np.int64).view(np.uint64)))
        if len(heavy) < longest - 1:
            level = materialize(_prefix_counts(texts, seed, longest, heavy), "prefixes")
            counted.append(level)
    total = words.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-2 * total // budget))
    while (loads.groupBy(_group(F.col("route"), groups)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > budget:
        groups *= 2
    return heavy, counted, groups


def _blobs(column: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One binary value for each run of 64-bit values between edges."""
    offsets = pa.py_buffer((edges * 8).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(column))])


def _leaves(texts: DataFrame, seed: int, longest: int, heavy: list[np.ndarray], groups: int) -> DataFrame:
    """(group, k1, k2, ..., n): the leaves of a share of the texts that belong to one group, in packed columns."""
    columns = [*(f"k{i + 1}" for i in range(longest)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in _shares(batches, seed, longest):
            for leaves, counts in share.suffixes():
                routes, depth = _routes(leaves, heavy)
                route = np.choose(depth - 1, routes)
                group = (route >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
                order = np.argsort(group, kind="stable")
                group = group[order]
                edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
                packed = [_blobs(x[order], edges) for x in (*leaves, counts.astype(np.int64))]
                out = pa.record_batch([pa.array(group[edges[:-1]].astype(np.int32)), *packed], ["group", *columns])
                # A few rows at a time, so that no batch is large.
                for at in range(0, out.num_rows, 16):
                    yield out.slice(at, 16)

    return texts.mapInArrow(run, f"group int, {', '.join(f'{c} binary' for c in columns)}")


def _tree_nodes(leaves: DataFrame, longest: int, heavy: list[np.ndarray], min_count: int) -> DataFrame:
    """(names, n): the nodes from depth 2 on of each group's subtrees, with at least ``min_count`` suffixes below them."""
    columns = [f"k{i + 1}" for i in range(longest)]

    def build(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda name: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), np.uint64)
        leaves, counts = np.stack([read(c) for c in columns]), read("n").astype(np.int64)
        order = np.lexsort(leaves[::-1])
        leaves, counts = leaves[:, order], counts[order]
        routes, own = _routes(leaves, heavy)
        new = np.ones(len(counts), bool)
        new[1:] = leaves[0][1:] != leaves[0][:-1]
        sizes, values, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for depth in range(2, longest + 1):
            new[1:] |= leaves[depth - 1][1:] != leaves[depth - 1][:-1]
            first = np.flatnonzero(new)
            below = np.add.reduceat(counts, first)
            # The suffixes below a prefix that has grown are in several groups; it is counted by itself.
            kept = (below >= min_count) & (leaves[depth - 1][first] != 0) & (own[first] <= depth)
            sizes.append(np.full(kept.sum(), depth))
            values.append(leaves[:depth, first[kept]].T.ravel())
            totals.append(below[kept])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        names = pa.ListArray.from_arrays(offsets, np.concatenate(values).view(np.int64))
        return pa.table([names, pa.array(np.concatenate(totals))], ["names", "n"])

    return leaves.groupBy("group").applyInArrow(build, "names array<long>, n long")


def phrase_counts(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, budget: int = BUDGET
) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): words(k, lang, word, n) of all texts, and phrases(names, n) of 2 to ``longest`` words that
    occur ``min_count`` times or more within pieces, the words named by their k. Both are stored.

    Runs jobs when called: a scan for the words, one for each length of heavy prefixes, and one for the leaves.
    """
    if longest < 2 or min_count < 1 or budget < HEAVY_SHARE:
        raise ValueError("phrases have two words or more, a count of 1 or more, and a budget of more than a few suffixes")
    workers_ready(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")
    ).filter("text is not null")
    seed = 0
    while True:
        words = materialize(_word_counts(texts, seed), "words")
        if words.groupBy("k").count().filter("count > 1").isEmpty():
            break
        seed += 1
    heavy, counted, groups = _partitioned(texts, words, seed, longest, budget)
    found = _tree_nodes(_leaves(texts, seed, longest, heavy, groups), longest, heavy, min_count)
    for level, prefixes in enumerate(counted, 2):
        if len(heavy) >= level:
            grown = texts.sparkSession.createDataFrame([(int(x),) for x in heavy[level - 1].view(np.int64)], "route long")
            names = F.array(*(f"k{i + 1}" for i in range(level)))
            there = prefixes.join(grown, "route").filter((F.col(f"k{level}") != 0) & (F.col("n") >= min_count))
            found = found.union(there.select(names.alias("names"), "n"))
    return words, materialize(found, "phrases")


def _parts(names, shortest: int, longest):
    """All runs of names of the given lengths as arrays."""
    starts = lambda n: F.sequence(F.lit(1), F.size(names) - n + 1)
    runs = lambda n: F.transform(starts(n), lambda i: F.slice(names, i, n))
    return F.flatten(F.transform(F.sequence(F.lit(shortest), longest), runs))


def collocations(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, best: int = BEST,
    covered_percent: int = COVERED_PERCENT, budget: int = BUDGET,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language of ``docs(lang, text)``.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs.
    A candidate has 2 to ``longest`` words and occurs ``a >= min_count`` times. Cut in two, with l and r occurrences of
    the parts, it has floor(1000000 * a * a / (l * r)); the lowest score counts, of equal ones the earliest cut. It is
    dropped if a longer candidate that holds it occurs in ``covered_percent`` of its places or more. Order: score and a
    from the highest, then the phrase in byte order, so there are no ties. n is the number of the language's words.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they are there. Empty
    tables give no rows. Numbers of up to 15 digits are counted exactly, beyond that the query fails. Other columns
    are not read. Runs jobs when called, see ``phrase_counts``.
    """
    words, phrases = phrase_counts(docs, longest, min_count, budget)
    single = words.filter(F.col("n") >= min_count).select(F.array("k").alias("names"), "n")
    counts = phrases.union(single)
    cuts = phrases.select("names", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("names") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", F.slice("names", F.lit(1), F.col("cut"))).withColumn(
        "right", F.slice("names", F.col("cut") + 1, F.size("names"))
    )
    cuts = cuts.join(counts.select(F.col("names").alias("left"), F.col("n").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("names").alias("right"), F.col("n").alias("r")), "right")
    exact = lambda c: f"cast({c} as decimal(15,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})")
    scored = cuts.groupBy("names", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("lowest"))
    inner = phrases.filter(F.size("names") > 2).select(
        F.explode(_parts(F.col("names"), 2, F.size("names") - 1)).alias("names"), F.col("n").alias("longer")
    )
    inner = inner.groupBy("names").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, "names", "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * covered_percent, F.lit(True)))
    kept = kept.select("names", "a", "lowest.*")
    spelled = kept.select("names", F.posexplode("names").alias("at", "k")).join(words.select("k", "lang", "word"), "k")
    spelled = spelled.groupBy("names", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    found = kept.join(spelled, "names").join(sizes, "lang").withColumn("phrase", F.array_join(F.col("words.word"), " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select(
        "lang", F.col("rank").cast("long"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score"))
    )
