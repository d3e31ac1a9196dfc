from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from venuematch.llm import negatives

SCHEMA = "vec_id long, label int, vector array<long>, tie string, part int, key string"


def plain_negatives(rows, every=100, positives=5, wanted=5, low=80):
    """Rows (vec_id, label, vector) without repeated ones and without nulls."""
    out = Counter()
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0] is None, r[0] or 0, i, r) for i, r in enumerate(rows) if len(r[2]) == len(a[2])]
        scored = [(-s, r) for s, _, _, _, r in sorted(scored, key=lambda x: x[:4]) if r is not a]
        for ps, p in [x for x in scored if x[1][1] == a[1]][:positives]:
            inside = [x for x in scored if x[1][1] != a[1] and low * ps <= 100 * x[0] <= 100 * ps][:wanted]
            out.update((a[0], p[0], rank, n[0], ps, ns) for rank, (ns, n) in enumerate(inside, 1))
    return out


def sample(n, width, top, seed=2, labels=4):
    rng = random.Random(seed)
    return [(3 * i, rng.randrange(labels), [rng.randint(-top // 3, top) for _ in range(width)]) for i in range(n)]


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "k") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("rows", "every", "positives", "wanted", "low", "block"), [
    (sample(400, 8, 300), 20, 5, 5, 80, 16_384),
    # Few different scores: many ties, inside blocks and between them.
    (sample(500, 2, 2), 10, 5, 5, 80, 37),
    (sample(300, 4, 3, labels=2), 9, 3, 7, 50, 16),
    (sample(120, 1, 1, labels=60), 6, 5, 5, 100, 8),
])
def test_hard_negatives_agree_with_brute_force(spark, monkeypatch, rows, every, positives, wanted, low, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    got = negatives.hard_negatives(as_frame(spark, rows), every, positives, wanted, low).collect()
    want = plain_negatives(rows, every, positives, wanted, low)
    assert Counter(map(tuple, got)) == want and want


def test_odd_rows(spark):
    rows = sample(60, 3, 9)
    rows += [(None, 1, [2, 3, 4]), (None, 2, [2, 3, 5]), (900, 1, [1, 1]), (1200, 2, [1, 2]), (1203, 1, [1, 1]), (1500, 1, []), (1501, 2, [])]
    odd = [(2000, None, [1, 2, 3]), (2100, 1, None), (2200, 1, [1, None, 2]), rows[0], rows[0], rows[5]]
    got = negatives.hard_negatives(as_frame(spark, rows + odd), every=50).collect()
    assert Counter(map(tuple, got)) == plain_negatives(rows, every=50)
    # Rows of one vec_id with other labels or vectors are rows of their own; both are anchors here.
    two = [(0, 1, [5]), (1, 1, [5]), (0, 2, [5]), (2, 2, [4])]
    got = negatives.hard_negatives(as_frame(spark, two), every=3).collect()
    assert Counter(map(tuple, got)) == plain_negatives(two, every=3)


def test_no_rows_no_anchors_and_overflow(spark):
    empty = as_frame(spark, sample(4, 2, 3)).limit(0)
    assert negatives.hard_negatives(empty).count() == 0
    assert negatives.hard_negatives(as_frame(spark, [(1, 1, [2]), (2, 2, [2])])).count() == 0
    # Large components go through integers, larger ones are refused.
    big = [(0, 1, [3_000_000_000 // 16, 7]), (1, 1, [200_000_001, 3]), (2, 2, [190_000_001, 9])]
    assert Counter(map(tuple, negatives.hard_negatives(as_frame(spark, big)).collect())) == plain_negatives(big)
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(as_frame(spark, [(0, 1, [1 << 40]), (1, 1, [1 << 40])])).count()


def test_components_are_floored_as_doubles(spark):
    rows = [([0.1, -0.1, 0.00390625],), ([None, 1.0],), ([float("nan")],), ([float("inf"), 1.0],), (None,), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "e array<float>").select(negatives.floored(F.col("e"))).collect()]
    assert got == [[25, -26, 1], None, None, None, None, []]
