from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.samples import frame, prose, texts
from venuematch.llm import collocations

PIECE, WORD = re.compile(r"[.,;:!?\x0a-\x0d]"), re.compile(r"[^\x20\x09]+")


def plain_collocations(rows, longest=3, min_count=10, best=2000, covered=50):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    counts, sizes, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in PIECE.split(lower):
            words = WORD.findall(piece)
            sizes[lang] += len(words)
            counts[lang].update(tuple(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        covering = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covering[p[i : i + n]] = max(covering[p[i : i + n]], a)
        kept = []
        for p, a in candidates.items():
            score, cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * covering[p] < covered * a:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def sample(seed=3):
    rng = random.Random(seed)
    words = [prose(rng, 1) for _ in range(25)]
    rows = []
    for i in range(90):
        said = [rng.choice(words[: 1 + rng.randrange(25)]) for _ in range(rng.randrange(1, 80))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ", ", ". ", "\n", "!? "]) for w in said)
        rows.append((rng.choice(["en", "de", None, "und"]), text.title() if i % 5 == 0 else text))
    phrase = "Ünï cödé phrase"
    rows += [("en", f"{phrase}. {phrase}; x {phrase}")] * 6 + [("en", None), ("de", ""), (None, " \n.,"), ("en", "the " * 400)]
    return rows


def as_docs(spark, rows):
    made = spark.createDataFrame([(i, lang, text, 1, 2, "s") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, k long, n long, word string")
    return made.repartition(5)


@pytest.mark.parametrize(("longest", "min_count", "best", "budget"), [(3, 10, 2000, 2_000_000), (3, 2, 40, 400), (2, 3, 500, 300), (4, 2, 2000, 160)])
def test_collocations_agree_with_brute_force(spark, longest, min_count, best, budget):
    rows = sample()
    got = collocations.collocations(as_docs(spark, rows), longest, min_count, best, 50, budget).collect()
    want = plain_collocations(rows, longest, min_count, best)
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_usual_samples_and_empty_tables(spark):
    got = collocations.collocations(frame(spark), min_count=3).collect()
    assert sorted(map(tuple, got)) == plain_collocations([("en", t) for _, t in texts()], min_count=3)
    assert collocations.collocations(frame(spark).limit(0)).count() == 0


def test_prefixes_grow_until_groups_fit(spark, monkeypatch):
    rows = [("en", "the cat sat on the mat the cat ran " * 30), ("en", "the cat sat " * 200)]
    seen = []
    whole = collocations._partitioned

    def noted(*args):
        seen.append(whole(*args))
        return seen[-1]

    monkeypatch.setattr(collocations, "_partitioned", noted)
    monkeypatch.setattr(collocations, "_HELD_WORDS", 50)
    got = collocations.collocations(as_docs(spark, rows), 3, 2, 100, 50, 400).collect()
    (heavy, counted, groups), = seen
    assert len(heavy) == 2 and len(heavy[0]) >= 3 and len(heavy[1]) >= 2 and len(counted) == 1 and groups > 3
    assert sorted(map(tuple, got)) == plain_collocations(rows, 3, 2, 100)


def test_words_that_share_a_name_are_named_anew(spark, monkeypatch):
    real, seeds = collocations._word_counts, []

    def clashing(texts, seed):
        seeds.append(seed)
        words = real(texts, seed)
        return words if seed else words.withColumn("k", F.col("k") % 5)

    monkeypatch.setattr(collocations, "_word_counts", clashing)
    rows = sample()
    got = collocations.collocations(as_docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows) and seeds == [0, 1]


def test_shares_know_what_follows_each_word():
    share = collocations.Share(0, 3)
    share.add([b"A b, c\nd e", b"", b"f  g\th"], ["en", "en", "de"])
    assert len(set(share.names[0].tolist())) == 8 and share.follow[0].tolist() == [1, 0, 0, 1, 0, 2, 1, 0]


def test_suffixes_hold_names_only():
    share = collocations.Share(0, 3)
    share.add([b"a b c", b"d"], ["en", "en"])
    assert share.size == 4 and not share.data and not share.spans
    assert sum(int(counts.sum()) for _, counts in share.suffixes()) == 4
