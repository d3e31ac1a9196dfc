from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.samples import WORD, frame, prose, texts
from venuematch.llm import repetition, simhash, substrings
from venuematch.llm.components import connected_components
from venuematch.llm.words import window_hashes, word_hashes


def plain_fingerprint(text, shingle=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints, max_bits):
    """Smallest doc_id reachable from each row over fingerprints within the distance."""
    found = [None] * len(prints)
    for i in range(len(prints)):
        if found[i] is None:
            reached, todo = {i}, [i]
            while todo:
                at = todo.pop()
                new = {j for j in range(len(prints)) if (prints[j][1] ^ prints[at][1]).bit_count() <= max_bits} - reached
                reached |= new
                todo += new
            least = min((prints[j][0] for j in reached if prints[j][0] is not None), default=None)
            for j in reached:
                found[j] = least
    return found


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
def test_near_duplicates_agree_with_brute_force(spark, max_bits):
    rows = texts()
    got = simhash.near_duplicates(frame(spark), max_bits=max_bits).collect()
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = [(d, f"{fp:016x}", c) for (d, fp), c in zip(prints, plain_components(prints, max_bits))]
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_crowded_fingerprints_are_linked_as_by_brute_force(spark, max_bits):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    values = {centre}
    for _ in range(500):
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)))
    signed = [simhash._signed(v) for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), max_bits)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    unsigned = [(s, v) for s, v in zip(signed, values)]
    want = dict(zip(signed, plain_components(unsigned, max_bits)))
    assert {v: roots.get(v, v) for v in signed} == want


def test_thresholds_are_the_cheapest_with_their_sum():
    work = [[0, 5, 9, 40], [0, 3, 30, 70], [0, 4, 8, 9]]
    best = min(
        (sum(w[t + 1] for w, t in zip(work, (a, b, c))), [a, b, c])
        for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0
    )
    assert simhash.allocated(work, 0)[0] == best[0]


def test_no_documents_and_one_of_each(spark):
    empty = frame(spark).limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(frame(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == frame(spark).columns and len(ids) == len(set(ids))
    assert 200 in ids and not {201, 202, 203, 204, 205} & set(ids)


def test_null_and_repeated_ids_stand_for_no_other_document(spark):
    rng = random.Random(4)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    kept = simhash.one_of_each(frame(spark, [(None, a), (None, a), (None, b), (None, c), (7, c), (7, d), (2, e), (7, e)])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(None, a), (None, b), (7, c), (7, d), (2, e)])


def test_columns_of_any_name_are_kept(spark):
    rng = random.Random(3)
    names = ["_hash", "_kept", "_kept_hash", "_hit", "_hit_hash", "_row", "row", "text_hash", "hit", "a.b", "copies", "slice", "ta`rget"]
    docs = frame(spark, [(i, prose(rng, 40)) for i in range(12)] + [(20, "one two three")] * 2)
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    from venuematch.llm import decontam, mixing

    item = spark.createDataFrame([(1, docs.filter("doc_id = 5").first()["text"])], "item_id long, text string")
    for stage in (simhash.one_of_each, lambda d: decontam.without_benchmark(d, item), mixing.mix):
        got = stage(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[name] == name for r in rows for name in names)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def plain_repeats(rows, length):
    order = sorted({(d is not None, d or 0): t for d, t in rows}.items())
    seen, out = set(), {}
    for key, text in order:
        words = WORD.findall(text or "")
        covered = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                covered[i : i + length] = [True] * length
            seen.add(window)
        kept = [w for w, c in zip(words, covered) if not c]
        out[key] = (len(words), sum(covered), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return Counter((d, *out[d is not None, d or 0]) for d, _ in rows)


@pytest.mark.parametrize(("length", "prefix"), [(20, 8), (10, 4), (8, 4)])
def test_repeated_passages_agree_with_brute_force(spark, length, prefix):
    got = substrings.repeats_removed(frame(spark), length, prefix)
    assert Counter(map(tuple, got.drop("kept").collect())) == plain_repeats(texts(), length)
    changed = got.filter("n_removed > 0").withColumn("again", F.sha2(F.col("kept").cast("binary"), 256))
    assert changed.filter("again <> kept_sha256").count() == 0
    assert substrings.repeats_removed(frame(spark).limit(0)).count() == 0


def test_texts_without_an_id_are_different_documents(spark):
    rng = random.Random(6)
    passage = prose(rng, 40)
    rows = [(None, passage), (None, f"{prose(rng, 90)} {passage} {prose(rng, 9)}"), (None, passage), (4, f"{prose(rng, 30)} {passage}"), (4, prose(rng, 50))]
    got = substrings.repeats_removed(frame(spark, rows)).collect()
    lost = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got)
    # One of the two texts without an id has the passage first; its repeated row is cut alike.
    first, second = [(None, 40, 0), (None, 40, 0), (None, 139, 40)], [(None, 40, 40), (None, 40, 40), (None, 139, 0)]
    assert lost in [Counter([*x, (4, 70, 40), (4, 50, 0)]) for x in (first, second)]


def test_window_hashes_depend_on_the_words_only():
    a, b = word_hashes("xx aa bb cc aa bb cc".encode()), word_hashes("aa\tbb\ncc".encode())
    for n in (1, 2, 3):
        assert window_hashes(a, (n,))[n][1] == window_hashes(a, (n,))[n][4] == window_hashes(b, (n,))[n][0]
    assert len(window_hashes(b, (4,))[4]) == 0 and len(word_hashes(b"")) == 0


def plain_rules(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    again = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return n, sum(map(len, words)), symbols, again, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rules_agree_with_brute_force(spark):
    rows = [*texts(), (700, "a b c\nd e\na b c\n \n \n" * 3), (701, "#*$ %&| <>" * 9), (702, "a b c d e f a b c d e " + " ".join(map(str, range(60))))]
    got = repetition.quality_rules(frame(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((d, *plain_rules(t)) for d, t in rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[0] is not None and not kept[600] and not kept[701] and kept[502]
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert repetition.quality_rules(frame(spark).limit(0)).count() == 0


def test_repeated_share_counts_what_came_before():
    words = [f"w{i}" for i in range(12)]
    measured = repetition.measured(" ".join(words + words[:8] + ["end"]))
    assert measured[4] == 16 and list(measured[6:]) == [16, 16, 16, 16, 0, 0]
