from __future__ import annotations

import random
from collections import Counter

import pytest
import sentencepiece
from public_tokenizers import path

from tests.llm.samples import frame, texts
from venuematch.llm import pieces
from venuematch.llm.tables import Recent

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(8)
    signs = "ab ▁th\neïn日0.,1'  \r\t\x00"
    found = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 50))) for _ in range(4000)]
    found += ["", " ", "  a", "▁▁ x", "x" * 3000, "ab" * 2000, " " * 200, "</s><s><unk><0x41>", "🙂🙂", "é́" * 20, "日本語のテキスト" * 300]
    return found


def test_ids_are_those_of_the_library(library):
    encoder = pieces.Encoder(MODEL, keep=500)
    known = [p for p in encoder.pieces if p]
    rng = random.Random(9)
    joined = ["".join(rng.choices(known, k=rng.randrange(1, 6))) for _ in range(4000)]
    for text in odd_texts() + joined:
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert encoder.decode(ids) == library.decode(library.encode(text))
    # A table of few entries has been turned over many times.
    assert len(encoder.segments) <= 500 and len(encoder.segments.older) <= 500


def test_backtracking_gives_what_all_merges_give():
    encoder = pieces.Encoder(MODEL)
    rng = random.Random(10)
    for _ in range(2000):
        text = "".join(rng.choice("▁etaonéñ日") for _ in range(rng.randrange(1, 25)))
        assert [encoder.part(c) for c in encoder.backtracked(text)] == encoder.merged(text)


def test_longest_pieces_are_not_always_compatible():
    encoder = pieces.Encoder(MODEL)
    tries = Counter()
    whole = pieces.Compatible.found

    class Counted(pieces.Compatible):
        def found(self, key):
            tries["all"] += 1
            value = whole(self, key)
            tries["no"] += not value
            return value

    encoder.compatible = Counted(encoder, 10_000)
    for text in odd_texts():
        encoder.encode(text)
    assert tries["no"] > 100


def test_round_trip_rows(spark, library):
    rows = texts()
    got = pieces.round_trip(frame(spark), MODEL).collect()
    want = Counter((d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == want
    encoded = pieces.encode(frame(spark), MODEL)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((d, i) for d, i, _ in want.elements())
    back = pieces.decode(encoded, MODEL).collect()
    assert Counter(map(tuple, back)) == Counter((d, t) for d, _, t in want.elements())
    nothing = spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>")
    assert sorted(map(str, pieces.decode(nothing, MODEL).collect())) == ["Row(doc_id=1, text='')", "Row(doc_id=None, text='')"]
    assert pieces.round_trip(frame(spark).limit(0), MODEL).count() == 0


def test_models_of_other_types_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    other = tmp_path / "unigram.model"
    other.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Encoder(str(other))


def test_recent_results_come_back_from_the_older_generation():
    class Squares(Recent):
        asked = 0

        def found(self, key):
            self.asked += 1
            return key * key

    table = Squares(10)
    for key in [*range(10), *range(5), *range(10, 15), *range(5)]:
        assert table[key] == key * key
    assert table.asked == 15 and len(table) <= 10 and len(table.older) <= 10
