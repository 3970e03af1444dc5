from __future__ import annotations

import random

import pytest

WORDS = ["the", "of", "river", "stone", "cloud", "walks", "under", "light", "seven", "paper", "wind", "Green", "late,", "été", "house.", "über"]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randint(0, 60)))
        if i % 9 == 8:
            out[-1] += ".\n" if i % 27 == 26 else "."
    return " ".join(out)


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves)."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 140)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    near = base[5].split(" ")
    near[3] = "changed"
    rows += [(50, base[5], None, "s0"), (51, base[5].replace(" ", "  "), "en", None), (52, " ".join(near) if len(near) > 60 else base[5], "en", "s1")]
    long = prose(rng, 20_000)
    rows += [(60, long, "en", "s2"), (61, long + " end", "en", "s2"), (62, "x" * 30_000, "en", "s1")]
    rows += [(70, None, None, None), (71, "", "en", "s0"), (72, " \t\r\n", "en", "s0"), (73, "one", "en", "s0"), (74, "one", "en", "s0")]
    rows += [(80, base[7], "en", "s0"), (80, base[7], "en", "s0"), (80, "another text of eighty", "en", "s0")]
    rows += [(None, base[8], "en", "s1"), (None, None, None, None), (None, base[8], "en", "s1")]
    return [(i, t, lang, s, len(t or ""), 1.5, "k", -3) for i, t, lang, s in rows]


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, key string, row int, item string, size string, block string, "
    "h string, words string, position string, taken string, id string, kept string, t string, rule string, host string, ids string, held_out string"
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 14) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
