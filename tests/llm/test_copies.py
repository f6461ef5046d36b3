"""Operators 2, 8 and 10 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, jaccard_join, queries, sentence_spans, substrings, suffixes
from tests.llm.conftest import words

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(texts, n, percent):
    sets = {k: shingles(t, n) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def edited(text, rate, rnd):
    return " ".join("".join(rnd.choice("qrstuv") for _ in range(5)) if rnd.random() < rate else w for w in text.split())


def corpus(rnd):
    base = [words(k, rnd.randint(20, 90)) for k in range(12)]
    common = words(99, 60)
    texts = [None, "", " ", "one", "One", "one two three", "one two three four"]
    for k in range(170):
        b = rnd.choice(base)
        texts.append([b, edited(b, 0.005, rnd), edited(b, 0.02, rnd), edited(b, 0.05, rnd), words(1000 + k, 50) + " " + common, common + " " + words(2000 + k, 9), b + " " + words(3000 + k, rnd.randint(1, 8))][k % 7])
    return dict(enumerate(texts))


@pytest.mark.parametrize(("n", "percent", "rounds", "most"), [(4, 85, 2, 6), (5, 80, 0, 1), (3, 60, 1, 3), (2, 100, 2, 4)])
def test_components(spark, n, percent, rounds, most):
    texts = corpus(random.Random(n))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = jaccard_join.jaccard_components(spark, df, n, percent, most, rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(texts, n, percent)
    assert len(got) == len(texts)


def test_jaccard_odd_rows(spark, odd, none):
    got = jaccard_join.jaccard_components(spark, odd, 5, 80).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert by[5] == 4 and by[7] == 6 and by[0] == 0 and by[1] == 1 and None not in by
    assert jaccard_join.jaccard_components(spark, none).count() == 0


def test_op2(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_jaccard_join(spark, SF).collect()}
    assert got == classes(docs, 4, 85)


def test_suffix_arrays():
    rnd = np.random.default_rng(4)
    cases = [rnd.integers(1, k + 2, rnd.integers(1, 70)) for k in range(1, 5) for _ in range(60)]
    cases += [np.frombuffer(s, np.uint8) for s in (b"mississippi" * 9, b"a" * 200, b"abab" * 40, b"\x01")]
    for case in cases:
        t = np.concatenate([case, [0]]).astype(np.uint16)
        flat = t.tolist()
        order = sorted(range(len(flat)), key=lambda i: flat[i:])
        sa = suffixes.suffix_array(t)
        assert sa.tolist() == order
        phi, lcp = suffixes.permuted_lcp(t, sa)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while flat[a + k] == flat[b + k]:
                k += 1
            assert (phi[b], lcp[b]) == (a, k)


def covered(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def cut(spark, texts, length, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = substrings.dedup_substrings(spark, df, length, **options).collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("options", [{}, {"most_stretches": 1}, {"shard_bytes": 300, "long_stretch": 90}, {"most_stretches": 1, "long_stretch": 90}])
def test_substrings(spark, options):
    rnd = random.Random(3)
    passages = ["".join(rnd.choice("abcdefé ") for _ in range(rnd.randint(60, 160))) for _ in range(6)]
    texts = [None, "", "x" * 30, "a" * 300, "ab" * 200, "é" * 100, "b\x00" * 90]
    for _ in range(50):
        t = ""
        for _ in range(rnd.randint(1, 4)):
            t += "".join(rnd.choice("abcdefghé ") for _ in range(rnd.randint(0, 120)))
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                t += p[rnd.randint(0, 30) : len(p) - rnd.randint(0, 30)]
        texts.append(t)
    texts += [texts[10], texts[11], texts[11]]
    assert cut(spark, texts, 50, **options) == covered(texts, 50)


def test_rolling_hashes_of_two_bases():
    raw = np.random.default_rng(3).integers(97, 101, 4000).astype(np.uint8).tobytes()
    first, second = substrings.Rolling()(raw, 40), substrings.Rolling(substrings.SECOND_BASE)(raw, 40)
    strings = [raw[k : k + 40] for k in range(len(raw) - 39)]
    for h in (first, second):
        assert len(set(h.tolist())) == len(set(strings))
    assert not set(first.tolist()) & set(second.tolist())


def test_substrings_of_clashing_hashes(spark, monkeypatch):
    """Texts whose first hash is equal are told apart by the second."""
    monkeypatch.setattr(substrings, "text_hash", lambda text: F.pmod(F.length(text), F.lit(3)).cast("long"))
    rnd = random.Random(5)
    own = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(60, 90))) for _ in range(12)]
    texts = [*own, own[3], own[4] + own[5][:55], "", None, own[6][:49]]
    assert cut(spark, texts, 50) == covered(texts, 50)


def test_substrings_that_powers_cannot_tell_apart(spark):
    """Two texts whose difference is a product of x^n - 1, which any odd base sends to a multiple of 2^62 or more."""
    product = np.array([1])
    for n in (1, 2, 4, 8, 16, 32, 64, 128, 3, 6, 12, 24, 48):
        product = np.convolve(product, np.array([-1, *[0] * (n - 1), 1]))
    one, other = (bytes(int(80 + 4 * x) for x in np.maximum(sign * product, 0)).decode() for sign in (1, -1))
    filler = " E" * 5000
    for base in (substrings.BASE, substrings.SECOND_BASE):
        a, b = (substrings.Rolling(base)((filler[-51:] + x).encode(), 400) for x in (one, other))
        assert a.tolist() == b.tolist() and one != other
    docs = spark.createDataFrame([(1, filler + one), (2, filler + other)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, bytes(r.kept).decode()) for r in substrings.dedup_substrings(spark, docs).collect()}
    assert got == {1: (10000, one), 2: (10000, other)}


def test_substrings_odd_rows(spark, odd, none):
    rows = substrings.dedup_substrings(spark, odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.n_bytes): r for r in rows}
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (4, 5, 6, 7))
    assert by[0, 0].n_spans == 0 and set(rows[0].asDict()) == {*odd.columns, "n_bytes", "n_removed", "n_spans"}
    assert {(r.d, r.row, r.stops) for r in rows if r.doc_id is not None} == {("own 0", "own 2", "own 9")}
    assert all(r.text == bytes(r.kept).decode("utf-8", "ignore") for r in rows)
    assert substrings.dedup_substrings(spark, none).count() == 0


def test_op8(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op8_substrings(spark, SF).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == covered([d.text for d in docs], 400)


def test_sentences_join_to_the_text():
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b ", ". ", "! ", "\n", " ", "?", "...", "\t", "é. "]) for _ in range(rnd.randint(0, 60)))
        assert "".join(sentence_spans.sentences(text)) == text
    assert sentence_spans.sentences("One two. Three 3.5 four!\nFive") == ["One two. ", "Three 3.5 four!\n", "Five"]


def spans_by_hand(texts, run, many):
    """The sentences each text loses: runs compared as tuples of their sentences, in the order of the ids."""
    seen, lost = set(), {}
    for k in sorted(texts):
        parts = re.findall(r"[^.!?\n]*(?:[.!?]+(?=[^\s.!?])[^.!?\n]*)*(?:[.!?]+(?=\s|$)|(?=\n)|$)\s*", texts[k] or "")
        parts = [p for p in parts if p]
        real = [i for i, p in enumerate(parts) if re.search(r"\w", p)]
        own = [" ".join(parts[j].lower().split()) for j in real]
        gone = set()
        for i in range(len(real)):
            for m in range(i + 1, min(i + run, len(real)) + 1):
                if m - i < run and len(" ".join(own[i:m]).split(" ")) < many:
                    continue
                if tuple(own[i:m]) in seen:
                    gone |= set(range(real[i], real[m - 1] + 1))
                seen.add(tuple(own[i:m]))
        lost[k] = (parts, gone)
    return {k: (len(gone), "".join(p for j, p in enumerate(parts) if j not in gone)) for k, (parts, gone) in lost.items()}


def test_spans(spark):
    rnd = random.Random(8)
    pool = [words(k, rnd.randint(2, 9)).replace(".", "") + ". " for k in range(25)]
    texts = {k: "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) + rnd.choice(["", "...\n", "\n"]) for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = sentence_spans.dedup_spans(spark, df, 3, 12).collect()
    assert {r.doc_id: (r.n_removed, r.text) for r in got} == spans_by_hand(texts, 3, 12)
    assert all(r.text == texts[r.doc_id] for r in got if not r.n_removed)


def test_spans_of_short_sentences(spark):
    """A passage of 60 words in sentences of three has spans, and so have one of single words and three short sentences."""
    three = "".join(f"We saw thing{k}. " for k in range(20))
    single = "".join(f"word{k}!! " for k in range(40))
    texts = {1: "Begin here now. " + three + "End.", 2: "Other start is. " + three + "Last one.", 3: single, 4: "Quite another beginning. " + single, 5: "We saw thing3. We saw thing4. We saw thing5.", 6: "He ran off. She sat down. They all left.", 7: "Alone at first. He ran off. She sat down. They all left."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in sentence_spans.dedup_spans(spark, df).collect()}
    assert {k: r.n_removed for k, r in got.items()} == {1: 0, 2: 20, 3: 0, 4: 40, 5: 3, 6: 0, 7: 3}
    assert got[2].text == "Other start is. Last one." and got[4].text == "Quite another beginning. "


def test_a_run_over_many_partitions(spark):
    """One passage in most rows spans several range partitions: only its first place stays."""
    passage = "Every one of these rows has the same three sentences. They are long enough to count as a run. No more is in them than that. "
    texts = {k: (passage if k % 4 else "") + f"Row number {k} ends with words of its own here. " for k in range(400)}
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sentence_spans.dedup_spans(spark, df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.doc_id: r.n_removed for r in got} == {k: n for k, (n, _) in spans_by_hand(texts, 3, 24).items()} and len(got) == 401


def test_rows_without_a_doc_id_lose_their_own(spark):
    same, other = words(1, 20).replace(".", ",") + ". ", words(2, 30).replace(".", ",") + "."
    rows = [(None, same * 3 + "End of the first one here."), (None, other + " Last."), (7, same * 3 + "Something else follows."), (7, "Alone and unlike the rest."), (8, "x")]
    got = {(r.doc_id, r.text) for r in sentence_spans.dedup_spans(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 99).collect()}
    assert got == {(None, rows[0][1]), (None, rows[1][1]), (7, "Something else follows."), (7, rows[3][1]), (8, "x")}


def test_spans_odd_rows(spark, odd, none):
    rows = sentence_spans.dedup_spans(spark, odd).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.text for r in rows}[0] is None
    by = {r.doc_id: r for r in rows}
    assert by[4].n_removed == 0 and by[5].n_removed > 0.8 * by[5].n_sentences
    assert by[None].lang is None and by[1].n_sentences == 0 and set(odd.columns) < set(rows[0].asDict()) and by[5].lost_first == "own 11" or by[5].lost == "own 10"
    assert sentence_spans.dedup_spans(spark, none).count() == 0


def test_op10(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_removed, r.text or "") for r in queries.op10_sentence_spans(spark, SF).collect()}
    assert got == spans_by_hand(docs, 3, 24)


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_shingles_of_columns(n):
    """Shingles found on the bytes of whole columns: as many as word by word, equal for equal words only."""
    rnd = random.Random(n)
    texts = [None, "", " ", "a", "A b", "x" * 64 + " " + "x" * 65 + " b " + "x" * 65 + "y c d e", "X" * 65 + "\x0b" + "q \x1c", *("".join(rnd.choice("aAbé日\x00 \n\t") for _ in range(rnd.randint(0, 90))) for _ in range(400))]
    got = list(jaccard_join.shingle_sets(pa.array(["before", *texts]).slice(1), n))
    want = [shingles(t, n) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    hashes = {}
    for text, own in zip(texts, got, strict=True):
        for other in shingles(text, n):
            hashes.setdefault(other, None)
    assert len(np.unique(np.concatenate(got))) == len(hashes)
    by_set = {}
    for own, other in zip(got, want, strict=True):
        assert by_set.setdefault(other, own.tolist()) == own.tolist()


def test_rooted_edges_need_no_round(spark):
    """Edges that lead to roots are components as they are; others are contracted, and the last round is not repeated."""
    ws, written = common.Workspace(spark, "test"), []
    write = ws.write
    ws.write = lambda df, name, *a: written.append(name) or write(df, name, *a)
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    got = common.components(ws, frame([(1, 2), (3, 1), (5, 4), (4, 5), (7, 7)]), "stars").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)] and written == ["stars_e0"]
    got = common.components(ws, frame([(k, k + 1) for k in range(1, 12)] + [(20, 21), (22, 21)]), "chains").collect()
    assert sorted(map(tuple, got)) == [(k, 1) for k in range(1, 13)] + [(20, 20), (21, 20), (22, 20)]
    assert common.components(ws, frame([]), "none").collect() == []


@pytest.mark.parametrize("length", [40, 41, 400])
def test_stretches_with_partners(spark, length):
    """Stretches whose halves beside the anchor occur once leave, and no removed byte with them."""
    rnd = random.Random(length)
    rand = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    parts = [rand(k) for k in (length // 2, length - 1, length, length + 1, 2 * length)]
    texts = [rand(rnd.randint(0, length)) + rnd.choice(parts) + rnd.choice(["", rand(rnd.randint(0, 2 * length))]) for _ in range(60)] + [parts[3], "ab" * length, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    where = Counter()
    for t in texts:
        raw = (t or "").encode()
        where.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    want = {}
    for d, t in enumerate(texts):
        raw, gone = (t or "").encode(), set()
        for k in range(len(raw) - length + 1):
            if where[raw[k : k + length]] > 1:
                gone.update(range(k, k + length))
        want[d] = bytes(x for k, x in enumerate(raw) if k not in gone)
    assert {r.doc_id: bytes(r.kept) for r in substrings.dedup_substrings(spark, df, length=length).collect()} == want
    frame = spark.createDataFrame([(1, 1, 5, 6, "a"), (1, 1, 5, 7, "b"), (1, 1, 8, 9, "c"), (1, 1, None, None, "d"), (2, 2, None, None, "e")], "fp long, most int, before int, behind int, name string")
    assert sorted(r.name for r in substrings.with_partners(frame).collect()) == ["a", "b", "e"]
