"""Small inputs with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, n long"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(2 + rng.randrange(vocabulary) % 7)) for _ in range(words))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): prose, exact and near copies, shared passages, and odd texts."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    found: list[tuple[int | None, str | None]] = [(3 * i, prose(rng, rng.randrange(1, 120))) for i in range(30)]
    base = prose(rng, 90)
    found += [(200 + i, base) for i in range(6)]
    found += [(300 + i, base.replace(base.split()[5 * i + 3], "changed", 1)) for i in range(6)]
    found += [(400 + i, f"{prose(rng, 20)} {passage} {prose(rng, 15)}") for i in range(4)]
    found += [(500, f"{passage}\n{passage}"), (501, "x " * 70), (502, prose(rng, 5000))]
    found += [(600, None), (601, ""), (602, " \n\t "), (603, "one"), (604, "one two"), (605, "Ünï cödé  　 ✓ [INST]"), (None, base)]
    return found + found[:2]


def frame(spark, rows=None):
    """The rows with further columns, some with names that operators use themselves."""
    rows = texts() if rows is None else rows
    full = [(d, t, "en", f"s{(d or 0) % 3}" if d != 600 else None, None, 1, 2, 3) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)
