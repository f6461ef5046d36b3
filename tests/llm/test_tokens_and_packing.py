"""Operators 1 and 7 against the tokenizer itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, queries, tokens
from tests.llm.conftest import words

SF = "/root/testdata/sf0.001"


def ids(text, name="word_bpe_49k.json"):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name):
    encoder = tokens.Encoder(public_tokenizers.path(name), most=50)
    texts = ["", "a", "Ab, cD. Ef!? g.", "it's IT'S don't 'x' ''.", "İ ß ÿ Ÿ ΣΑΣ é é", "a\tb\r\nc\x0bd\x1ce\x85f g", "3.14 1,000.5 x.y, ..., .,", "日本語 テキスト", "<|endoftext|> a<|startoftext|>b", "w" * 3000, words(1, 500), words(1, 500), words(2, 200).upper()]
    for text in texts:
        assert encoder.encode(text) == ids(text, name), text[:40]


def test_encoder_on_texts_with_added_tokens_in_any_case():
    """Added tokens are looked for in raw text, so lower-casing must not make them; memory of any size gives the same ids."""
    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    bits = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", " ", "  ", "\n", "\t", "a", "É", "B.", ", ", "x,y", ". ", "...", "don't", "1,000", "日本", "ß", "\x85", "\xa0", "</w>", "<|", "|>", "AbC", "a" * 90]
    for encoder, some in ((tokens.Encoder(path), bits), (tokens.Encoder(path, most=3000), bits), (tokens.Encoder(path), bits[4:])):
        assert encoder.by_run and encoder.apart
        for _ in range(4000):
            text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 9)))
            want = np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
            assert encoder.encode(text) == want, text
        assert max(map(len, encoder.memory)) <= encoder.LONG


def test_store_round_trip(spark, odd, tmp_path):
    at = f"file://{tmp_path}/store"
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = tokens.token_store(spark, odd, path, at).collect()
    want = [(r.doc_id, ids(r.text)) for r in odd.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter(want)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1]]
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.n_tokens * 4 == len(r.ids) for r in rows)
    some = tokens.read_store(spark, at, [3, 6]).collect()
    assert sorted(r.doc_id for r in some) == [3, 6, 6] and {r.start for r in some} <= {r.start for r in rows}


def test_many_ids_of_a_store(spark, tmp_path):
    at, path = f"file://{tmp_path}/store", public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(k * k, words(k, 5)) for k in range(600)], "doc_id long, text string")
    tokens.write_store(spark, docs, path, at)
    wanted = [k * k for k in range(0, 600, 3)] + [5, 10**12]
    got = {r.doc_id: bytes(r.ids) for r in tokens.read_store(spark, at, wanted).collect()}
    assert got == {k * k: ids(words(k, 5)) for k in range(0, 600, 3)}
    assert tokens.read_store(spark, at, []).count() == 0
    assert tokens.id_ranges({1, 2, 3, 9, 10, 50}, 3) == [(1, 3), (9, 10), (50, 50)] and tokens.id_ranges(set()) == []


def test_store_of_nothing(spark, none):
    assert tokens.token_store(spark, none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_op1(spark):
    got = {tuple(r) for r in queries.op1_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = set(), 0
    for d in docs:
        own = ids(d.text)
        want.add((d.doc_id, start, len(own) // 4, zlib.crc32(own)))
        start += len(own) // 4
    assert got == want


def test_histogram_packs_every_piece():
    rnd = random.Random(2)
    for _ in range(40):
        size = rnd.choice([8, 32, 100])
        counts = {rnd.randint(1, size): rnd.randint(1, 60) for _ in range(rnd.randint(1, 12))}
        patterns = packing.pack_histogram(counts, size)
        used = Counter()
        for n, pattern in patterns:
            assert sum(a * b for a, b in pattern) <= size and n > 0
            for length, times in pattern:
                used[length] += n * times
        assert used == Counter(counts)
    assert packing.pack_histogram({}, 8) == []


def check_packing(rows, docs, size):
    by_seq, by_doc = {}, Counter()
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc[r.doc_id] += r.length
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    want = Counter()
    for d in docs:
        want[d.doc_id] += len(ids(d.text)) // 4
    assert by_doc == want
    return by_seq


def test_pack_odd_rows(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = odd.select("doc_id", "text").collect()
    rows = packing.pack(spark, odd, path, size=64).collect()
    check_packing(rows, docs, 64)
    texts = {(d.doc_id, ids(d.text)) for d in docs}
    assert all(any(r.doc_id == k and r.doc_tokens * 4 == len(raw) and zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for k, raw in texts) for r in rows)
    assert packing.pack(spark, none, path).count() == 0


def test_op7_has_little_padding(spark):
    rows = queries.op7_packing(spark, "/root/testdata/sf0.01").collect()
    sequences = check_packing(rows, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect(), 2048)
    assert sum(r.length for r in rows) > 0.99 * 2048 * len(sequences)
