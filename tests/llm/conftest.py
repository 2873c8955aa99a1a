"""Awkward documents that every operator must take: nulls, blanks, very long texts, copies, clashing columns."""

import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
NEAR = [f"tok{i}" for i in range(200)]


def awkward_rows():
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    base = prose(120)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base + " tail", "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (6, " \n\t ", "fr", "b"),
        (7, "one two", "fr", None),
        (8, "one two", "fr", "c"),
        (9, LONG, "de", "c"),
        (10, "x" * 100_000, None, "c"),
        (11, "<|endoftext|> <s> </s> ▁ é日本 😀 \x00", "en", "d"),
        (None, prose(80), "en", "d"),
        (12, "$$$ ### " * 60 + prose(60), "en", "a"),
    ]
    rows += [(100 + i, " ".join(NEAR[:150] + [f"own{i}x{j}" for j in range(8)]), "en", "hot") for i in range(30)]
    rows += [(200 + i, prose(90), "en", "hot") for i in range(30)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _rank int, score string, kept string, _bucket string, row string, n string"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), "x", 0, "x", "x", "x", "x", "x") for i, t, lang, s in awkward_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
