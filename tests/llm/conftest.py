from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

CLASHING = (
    "id row key size taken target source_size number block print root labels score found spans words n_words pack held "
    "kind rank copies first held_out predicted component_id at __row __at __found"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(("Ba", "re", "to", "lin", "mo")) + rng.choice(("da", "ri", "né", "SU")) * rng.randint(1, 2) for _ in range(n))


def texts() -> list[str | None]:
    """Empty, NULL, blank, copied, nearly copied, very long and ordinary texts."""
    long_word, long_run = "a" * 120_000, " " * 90_000
    copy = prose(1, 80)
    return [
        None,
        "",
        "  \t\n ",
        copy,
        copy,
        copy + " end",
        long_word,
        f"x{long_run}y",
        prose(2, 9_000),
        "one",
        "One two",
        *(prose(10 + i, 5 + 7 * i) for i in range(12)),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with NULLs in every column, repeated rows and ids, and columns named as the operators' own."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, "no id here at all", None, None, None), (None, None, None, None, None), (3, "same id", "de", "s1", 7)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
