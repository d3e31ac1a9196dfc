from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.samples import WORD, frame, prose, texts
from venuematch.llm import mixing, tokenfile
from venuematch.llm.queries import BYTE_BPE
from venuematch.storage import scratch_path


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = {}
    while True:
        open_ = [s for s in order if s not in full]
        rest, unit = sum(sizes.values()) - sum(full.values()), sum(weight[s] for s in open_)
        shares = {s: rest * weight[s] / unit for s in open_} if unit else {}
        over = {s for s in open_ if shares[s] > most * sizes[s] + 1e-9}
        if not over:
            return full | shares
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 500, "c": 3, None: 40}, {"x": 7}, {"a": 0, "b": 9}, {f"s{i}": 1 + 37 * i % 91 for i in range(25)}, {"Z": 5, "a": 5, "é": 5},
])
def test_targets_agree_with_sharing_in_rounds(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(plain_targets(sizes))


def test_a_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 200)), ["a", "b", "c", None][min(3, i % 9 // 2)]) for i in range(900)]
    docs = spark.createDataFrame([*rows, (901, None, "b"), (902, "", "empty"), (None, "a b", "b")], "doc_id long, text string, source string")
    docs = docs.withColumn("target", F.lit("own"))
    got = mixing.mixed(docs).collect()
    assert len(got) == 903
    taken, targets, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in targets)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {(r["doc_id"], r["source"]): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()} == {k: n for k, n in copies.items() if n}


def plain_copies(spark, docs):
    """Copies of each (doc_id, text, source), by ranking all documents of a source at once."""
    sizes = mixing._sized(docs, "text").cache()
    plan = mixing.mix_plan(docs).cache()
    drawn = mixing._drawn(sizes, plan.drop("cut", "last_row"), mixing.SEED).collect()
    found = Counter()
    for source in {r["source"] for r in drawn}:
        own = [r for r in drawn if r["source"] == source]
        ranked = [r for r in own if r["rank"] is not None]
        ranked.sort(key=lambda r: (r["rank"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_hash"] is not None, r["text_hash"] or 0, r["row"]))
        before, extra = 0, set()
        for r in ranked:
            if before + r["size"] / 2 > own[0]["rest"]:
                break
            extra.add(r["row"])
            before += r["size"]
        for r in own:
            found[r["doc_id"], r["text"], source, (r["certain"] if r["size"] else 0) + (r["row"] in extra)] += 1
    return found


def test_the_lowest_ranks_are_taken(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 90)), rng.choice(["a", "a", "b", "c", None])) for i in range(500)]
    rows += [(None, prose(rng, 12), "a") for _ in range(60)] + [(7, "same words in here", "b")] * 150 + [(None, None, "c"), (3, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3)
    want = plain_copies(spark, docs)
    got = mixing.mix(docs).groupBy("doc_id", "text", "source").count().collect()
    total = Counter()
    for (doc_id, text, source, copies), n in want.items():
        total[doc_id, text, source] += copies * n
    assert {(r["doc_id"], r["text"], r["source"]): r["count"] for r in got} == {k: n for k, n in total.items() if n}
    assert Counter(r["copies"] for r in mixing.mixed(docs).collect()) == Counter(c for *_, c in want.elements())


@pytest.mark.parametrize("ids", [[None], [1, 2], [4]])
def test_equal_and_missing_ids_come_near_their_targets(spark, ids):
    rng = random.Random(5)
    different = [(ids[i % len(ids)], prose(rng, 10), "abc"[i % 3]) for i in range(120)]
    equal = [(ids[0], "ten words that are the same in all rows here", "abc"[i % 3]) for i in range(120)]
    for rows in (different, equal):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        taken, targets = Counter(), {}
        for r in mixing.mixed(docs).collect():
            taken[r["source"]] += r["taken"]
            targets[r["source"]] = r["target"]
        assert all(abs(taken[s] - targets[s]) <= 5 for s in targets) and len(set(targets.values())) == 3
        again = Counter(r["source"] for r in mixing.mix(docs).collect())
        assert {s: 10 * n for s, n in again.items()} == dict(taken)


def test_longer_documents_have_better_odds(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 400 if i % 2 else 40), "a" if i % 5 else "b") for i in range(1500)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    mean = lambda size: np.mean([r["copies"] for r in got if r["size"] == size and r["source"] == "a"])
    assert mean(400) > mean(40) + 0.05


def test_word_counts_and_empty_mix(spark):
    got = {r["doc_id"]: r["size"] for r in mixing.mixed(frame(spark)).collect()}
    assert got == {d: len(WORD.findall(t or "")) for d, t in texts()}
    assert mixing.mixed(frame(spark).limit(0)).count() == 0 and mixing.mix(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5, 5, 2**40], [2**63], list(range(1000)), [i * i for i in range(300)], []])
def test_elias_fano_round_trip(values):
    values = np.array(values, np.uint64)
    code = tokenfile.EliasFano.encode(values)
    assert code.decode(len(values)).tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 10_000))
    code = tokenfile.EliasFano.encode(values)
    assert len(code.low) + len(code.high) < 10_000 * (2 + np.log2(values[-1] / 10_000) + 1) / 8


def test_encoder_agrees_with_the_library():
    encoder = tokenfile.Encoder(BYTE_BPE, keep=40)
    given = [t or "" for _, t in texts()]
    given += ["", " ", "  ", "a  b", " lead", "trail ", "x\n y", "tab\t z", "it's  they'll", "é  b", "a <|endoftext|> b<|endoftext|>c", "\x1c a", "a\x85 b", "日本 語 12,!!  "]
    want = [x.ids for x in encoder.tokenizer.encode_batch(given, add_special_tokens=False)]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(given)] == want


def test_token_files_round_trip(spark, monkeypatch):
    path = scratch_path(spark, "token-test")
    rows = [*texts(), (-5, "negative id"), (-(1 << 62), "far"), (1 << 62, "away")]
    tokenfile.write_token_files(frame(spark, rows), path, BYTE_BPE)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.read_token_files(spark, path).collect()), key=lambda r: r[0])
    encoder = tokenfile.Encoder(BYTE_BPE)
    ids = {t: np.frombuffer(encoder.encode([t or ""])[0], encoder.kind).astype("<u4").tolist() + [0] for _, t in rows}
    want = defaultdict(list)
    for d, t in rows:
        want[d].append((len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())))
    assert [r[1] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start = 0
    for at, doc_id, n, crc in got:
        assert at == start and (n, crc) in want[doc_id]
        start += n
    block = spark.read.parquet(path).first().asDict()
    ends, doc_ids = tokenfile._boundaries(block)
    assert tokenfile.document_ids(block, len(ends) - 1).tolist() in [ids[t] for d, t in rows if d == doc_ids[-1]]
    empty = scratch_path(spark, "token-test")
    tokenfile.write_token_files(frame(spark).limit(0), empty, BYTE_BPE)
    assert tokenfile.read_token_files(spark, empty).count() == 0


def test_pipeline_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage-test")
        stage(spark, at, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == columns, name
        if "mixing" not in name:
            assert 0 < after.count() < at.count() and after.join(at, "doc_id", "left_anti").count() == 0, name
        at = after
    result = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in result.collect()) == sorted(r["doc_id"] for r in at.select("doc_id").collect())
