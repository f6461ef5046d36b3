"""Rows that every operator and stage must bear."""

from __future__ import annotations

import random

import pytest

#: Names that operators use for columns of their own or of their results.
CLASHING = ("d", "e", "row", "node", "doc", "body", "marks", "marked", "begins", "stops", "lost", "lost_first", "lost_size", "leaking", "leaks", "stays", "pii", "class", "row_id", "size")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, " + ", ".join(f"{c} string" for c in CLASHING)


def words(seed: int, n: int, size: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) + rnd.choice(["", "", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null in every column, empty and very long texts, ties, repeated rows and names that operators use themselves."""
    long = words(1, 30000)
    texts = [None, "", " \n\t ", "x", long, long, words(2, 120), words(2, 120), words(3, 80) + "\n" + words(3, 80), "né ÀÉ 日本 👍 " * 40, "a\x00b\x1cc d", "word " * 300]
    own = tuple(None if k % 4 == 3 else f"own {k}" for k in range(len(CLASHING)))
    rows = [(k, t, None if k % 3 else "en", None if k % 2 else "s", None if t is None else len(t), "s", "k", *own) for k, t in enumerate(texts)]
    rows += [rows[6], (None, words(4, 60), None, None, None, None, None, *(None for _ in CLASHING))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
