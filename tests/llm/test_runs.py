"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tessera.llm import runs
from tessera.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def search(x, least_length, least_exponent):
    """All runs by the definition: stretches of equality at each distance, of which the smallest counts."""
    found, (codes, x) = {}, np.unique(np.array(x), return_inverse=True) if len(x) else (None, np.zeros(0, int))
    for period in range(1, len(x) // least_exponent + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], x[:-period] == x[period:], [0]]).astype(int)))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = end - start + period
            if length >= max(least_length, least_exponent * period) and not any(s <= start and start + length <= s + n and period % p == 0 for s, n, p in found):
                found[start, length, period] = None
    return sorted(found)


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = search(words, 24, 3)
    lost = {k for s, length, q in found for k in range(s + q, s + length)}
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = s, length, q
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in lost)
    milli = None if best is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *(best or (None, None, None)), milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_next_smaller_and_runs_of_random_words():
    rnd = random.Random(5)
    for _ in range(1500):
        top = rnd.randint(1, 3)
        x = [rnd.randint(0, top) for _ in range(rnd.randint(0, 30))]
        if rnd.random() < 0.5:
            root = [rnd.randint(0, top) for _ in range(rnd.randint(1, 6))]
            x[len(x) // 2 : len(x) // 2] = (root * 9)[: rnd.randint(0, 40)]
        smaller, shared = runs.next_smaller(x)
        for i in range(len(x)):
            j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            m = 0
            while j + m < len(x) and x[i + m] == x[j + m]:
                m += 1
            assert (smaller[i], shared[i]) == (j, m)
        for least in ((2, 2), (24, 3)):
            assert runs.runs(x, *least) == search(x, *least)


@pytest.mark.parametrize("kind", ["ones", "fibonacci", "period", "nested"])
def test_time_is_linear(kind):
    def made(n):
        if kind == "fibonacci":
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            return b[:n]
        return {"ones": [1], "period": list(range(n // 50)), "nested": [0] * 50 + [1]}[kind] * n

    took = []
    for n in (20_000, 160_000):
        x = made(n)[:n]
        began = time.process_time()
        runs.runs(x)
        took.append(time.process_time() - began)
    assert took[1] < 8 * 3 * took[0] + 0.5


def test_stretches_hold_all_runs():
    rnd = random.Random(6)
    for _ in range(150):
        docs = []
        for _ in range(3):
            x = [rnd.randint(0, 40) for _ in range(rnd.randint(0, 80))]
            for _ in range(rnd.randint(0, 2)):
                root = [rnd.randint(0, 40) for _ in range(rnd.randint(1, 30))]
                x += (root * 30)[: rnd.randint(20, 120)] + [rnd.randint(0, 40) for _ in range(rnd.randint(0, 9))]
            docs.append(x)
        sizes = [len(x) for x in docs]
        codes, doc = np.array(sum(docs, []), int), np.repeat(np.arange(3), sizes)
        first = np.cumsum(sizes) - sizes
        got = [[] for _ in docs]
        for start, end in runs.stretches(codes, doc, first, 24, 3):
            k = int(doc[start])
            got[k] += [(start + s - int(first[k]), n, p) for s, n, p in runs.runs(codes[start:end].tolist())]
        assert [sorted(x) for x in got] == [search(x, 24, 3) for x in docs]


def test_op12_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(expected(*r) for r in docs)
    assert sorted(tuple(r) for r in op12_periodic_runs(spark, SF).collect()) == want
    assert any(r[1] for r in want)


def test_odd_rows(spark, odd, none):
    out = runs.find_runs(odd, pattern=True)
    assert out.columns == [*odd.columns, "runs", "collapsed"]
    got = out.collect()
    assert len(got) == odd.count()
    assert sorted((r.doc_id is None, r.doc_id, [tuple(x) for x in r.runs]) for r in got) == sorted((r.doc_id is None, r.doc_id, search_of(r)) for r in odd.select("doc_id", "text").collect())
    assert all(r.collapsed == "" for r in got if r.text is None)
    assert {r.collapsed for r in got if r.text == "word " * 300} == {"word"}
    assert runs.find_runs(none).count() == 0
    again = runs.find_runs(spark.createDataFrame([(1, "a b " * 30, "x")], "doc_id long, text string, runs string")).collect()[0]
    assert [tuple(x) for x in again.runs] == [(0, 60, 2)] and again.collapsed == "a b"


def search_of(row):
    words, made = re.findall("[^\x20\x09-\x0d]+", row.text or ""), None
    if row.doc_id is not None:
        made = runs.made_periodic(row.doc_id, len(words))
    if made:
        a, p = made
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return search(words, 24, 3) if len(words) < 5000 else [tuple(x) for x in runs.runs([sorted(set(words)).index(w) for w in words])] if made else []
