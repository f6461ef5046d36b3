"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from tessera.llm import spellings
from tessera.llm.common import Workspace
from tessera.llm.queries import op13_spelling_groups

SF = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    """Exactly one letter inserted, deleted or replaced, by the common ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def grouped(words: dict[str, int], times: int = 5) -> list[tuple]:
    form, rows = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
        rows[w] = n, len(close)
    out = []
    for w, (n, n_near) in rows.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near, form[w] and words[form[w]]))
    return sorted(out)


def vocabulary(docs) -> dict[str, int]:
    counts: Counter = Counter()
    lower = {k: k + 32 for k in range(65, 91)}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_op13_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = grouped(vocabulary(docs))
    assert rows_of(op13_spelling_groups(spark, SF)) == want
    assert sum(r[1] is not None for r in want) > 3


def made_up(seed: int, n: int, letters: str = "abé", prefix: str = "") -> dict[str, int]:
    rnd = random.Random(seed)
    return {prefix + "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))): rnd.choice([1, 5, 25, 100, 700, 4000]) for _ in range(n)}


def test_dense_words_in_many_rounds(spark):
    """Words of few letters, short and long ones, below a long common prefix too, with hardly any word left to a task."""
    words = made_up(1, 350) | made_up(2, 120, "ab", "abbaabbaabbaab") | {"z": 7, "z" * 300: 3, "z" * 301: 90, "y" + "z" * 299: 4}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = grouped(words)
    for most in (3, 2000):
        assert rows_of(spellings.group_spellings(spark, table, most=most)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # chains of forms


def test_tries_of_one_task():
    for seed in range(60):
        words = sorted(w + spellings.END for w in made_up(seed, 40, "ab" if seed % 2 else "abcd"))
        got = {tuple(sorted((a[:-1], b[:-1]))) for a, b in spellings.near_below(words, 0)}
        plain = [w[:-1] for w in words]
        assert got == {(a, b) for a in plain for b in plain if a < b and near(a, b)}


def test_pairs_are_those_of_words_at_distance_one(spark):
    words = spark.createDataFrame([("abcdef", 1), ("abcdeg", 2), ("abcdefg", 3), ("bcdef", 4), ("xbcdef", 5)], "word string, n long")
    got = spellings.near_pairs(Workspace(spark, "t"), words).select("word", "near").distinct().collect()
    assert {frozenset(r) for r in got} == {frozenset(p) for p in (("abcdef", "abcdeg"), ("abcdef", "abcdefg"), ("abcdef", "bcdef"), ("abcdef", "xbcdef"), ("bcdef", "xbcdef"), ("abcdeg", "abcdefg"))}


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    counted = spellings.count_words(odd)
    assert sorted(map(tuple, counted.collect())) == sorted(vocabulary(rows).items())
    assert rows_of(spellings.group_spellings(spark, counted)) == grouped(vocabulary(rows))
    assert rows_of(spellings.group_spellings(spark, spellings.count_words(none))) == []
    strange = spark.createDataFrame([(None, 3, "a"), ("", 4, "a"), ("anword", 2, "a"), ("anword", 3, "b"), ("aword", 25, None)], "word string, n long, form string")
    assert rows_of(spellings.group_spellings(spark, strange)) == [("anword", "aword", "aword", 5, 1, 25), ("aword", None, "aword", 25, 1, None)]
