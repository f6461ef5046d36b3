"""Operator 1: token ids of every document in a compressed, randomly readable store."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, partitions_for, text_rows

END_ID = 1


class Encoder:
    """Ids of whole texts by a tokenizers file, as little-endian unsigned 32-bit bytes.

    Where the file's pre-tokenizer drops white space (checked on probes), no
    piece spans it, so a text's ids are the ids of its runs between blanks and
    line ends, one after the other; other files get whole texts.  Runs repeat,
    so their ids are remembered.  Before that, texts of Latin letters are put
    in lower case and single commas and full stops apart, as the file does
    itself (on the probes too).  A text that holds a token which the library
    looks for in raw text (its added tokens, in any letter case) goes to the
    library as it is.  New words go there many at a time where each ends in a
    token with the word-end mark, by which their ids are told apart.  Runs of
    over ``LONG`` letters are not remembered, and the memory is emptied at
    ``most`` bytes, so its size does not follow the input.
    """

    PROBES = ("One  two\n\tThree, it's 4 a.b É. ", "A.B, c. ... ,, x . y\r\nZÀÿ", "  \t1,000.50 don't #@! (x), [y]. ", "ß µ\xa0n\x85e\x1cf, g")
    CLOSE = re.compile("[^A-Za-z0-9À-ÖØ-öø-ÿ ][.,] ")
    LONG, ENTRY = 64, 170

    def __init__(self, path: str, end_id: int | None = END_ID, most: int = 256 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.most, self.memory, self.held = most, {"": b""}, 0
        self.raw = tuple({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content})
        joined = lambda text: b"".join(self._whole(x) for x in re.split("[ \n\t\r]", text))
        self.by_run = all(self._whole(p) == joined(p) for p in self.PROBES)
        self.apart = self.by_run and all(self._whole(p) == joined(p.lower().replace(", ", " , ").replace(". ", " . ")) for p in self.PROBES if not self.CLOSE.search(p))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _runs(self, text: str) -> list[str]:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if self.apart:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split(" ")
            text = text.lower() + " "
            if not self.CLOSE.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_run or self.raw and self._looked_for(text):
            return self._whole(text) + self.end
        runs = self._runs(text)
        try:
            return b"".join(map(self.memory.__getitem__, runs)) + self.end
        except KeyError:
            known = self._learn(runs)
            return b"".join(map(known.__getitem__, runs)) + self.end

    def _looked_for(self, text: str) -> bool:
        low = text.lower()
        return any(token in low for token in self.raw)

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of all ``runs``; those that are not too long are remembered."""
        if self.held > self.most:
            self.memory, self.held = {"": b""}, 0
        new = [x for x in set(runs) if x not in self.memory]
        words, got = [x for x in new if x.isalpha()], {}
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) == len(words):
            raw = ids.tobytes()
            got.update((x, raw[a:b]) for x, a, b in zip(words, [0, *cuts], cuts, strict=False))
            new = [x for x in new if not x.isalpha()]
        for run, own in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            got[run] = np.array(own.ids, "<u4").tobytes()
        short = {x: y for x, y in got.items() if len(x) <= self.LONG}
        self.memory.update(short)
        self.held += sum(self.ENTRY + 4 * len(x) + len(y) for x, y in short.items())
        return self.memory if len(short) == len(got) else {**{x: self.memory[x] for x in runs if x in self.memory}, **got}


@lru_cache(2)
def encoder_for(path: str, end_id: int | None = END_ID) -> Encoder:
    """The encoder of a Python worker, which keeps it and what it remembers from one task to the next."""
    return Encoder(path, end_id)


BLOCKS = (
    "shard int, block int, shard_offset long, n_tokens long, first_id long, last_id long, dictionary string, "
    "width int, doc_ids array<long>, lengths array<long>, ends array<long>, payload binary"
)
BLOCK_BYTES = 1 << 20


def _blocks(path: str, dictionary: bytes, end_id: int | None) -> Iterator:
    """Per partition (its number is the shard): blocks of documents, each compressed on its own."""

    def run(batches):
        encoder, shard, block, before = encoder_for(path, end_id), TaskContext.get().partitionId(), 0, 0
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True)
        name = hashlib.sha256(dictionary).hexdigest()
        ids: list = []
        lengths: list[int] = []
        ends: list[int] = []
        frames: list[bytes] = []

        def flush():
            present = [x for x in ids if x is not None]
            row = [shard, block, before, sum(lengths), min(present, default=None), max(present, default=None), name, width, ids[:], lengths[:], ends[:], b"".join(frames)]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

        for batch, texts in text_rows(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                raw = encoder.encode(text)
                frame = pack.compress(raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes())
                ids.append(doc)
                lengths.append(len(raw) // 4)
                ends.append((ends[-1] if ends else 0) + len(frame))
                frames.append(frame)
                if ends[-1] >= BLOCK_BYTES:
                    yield flush()
                    block, before = block + 1, before + sum(lengths)
                    for kept in (ids, lengths, ends, frames):
                        kept.clear()
        if ids:
            yield flush()

    return run


BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("shard_offset", pa.int64()), ("n_tokens", pa.int64()),
    ("first_id", pa.int64()), ("last_id", pa.int64()), ("dictionary", pa.string()), ("width", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def train_dictionary(docs: DataFrame, path: str, end_id: int | None = END_ID, sample_docs: int = 1000, sample_bytes: int = 8192, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary from the serialised ids of about ``sample_docs`` documents, ``sample_bytes`` of each.

    They are picked by a hash of id and text, four times as many at most where
    rows repeat, which bounds what reaches the driver (32 MB); the sample
    decides the compression ratio alone, never an id.  Too few samples to train give a
    dictionary of their raw content, none give an empty one.
    """
    every = max(1, docs.count() // sample_docs)
    width_of = np.dtype("<u2")

    def run(batches):
        encoder = encoder_for(path, end_id)
        width = width_of if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        for _, texts in text_rows(batches):
            rows = [np.frombuffer(encoder.encode(x), "<u4").astype(width).tobytes()[:sample_bytes] for x in texts]
            yield pa.record_batch([pa.array(rows, pa.binary())], names=["ids"])

    picked = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").limit(4 * sample_docs)
    samples = [bytes(r.ids) for r in picked.mapInArrow(run, "ids binary").collect()]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_store(spark: SparkSession, docs: DataFrame, path: str, at: str, end_id: int | None = END_ID) -> None:
    """Write the ids of ``docs`` (doc_id, text) to a store in folder ``at``, in ascending doc_id order.

    The store is three Parquet tables, so any file system Spark writes to will
    do: ``dictionary`` (its bytes and hash), ``blocks`` and ``shards``.  A block
    row holds about 1 MB: document ids, lengths, end offsets of their frames,
    and the frames, each one zstandard frame with the shared dictionary, ids as
    little-endian unsigned integers of ``width`` bytes.  ``shards`` has the ids
    before each shard.  Null text counts as empty, null doc_ids come first,
    equal ones stay apart; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, path, end_id)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "hash string, content binary").coalesce(1).write.parquet(f"{at}/dictionary")
    ordered = docs.repartitionByRange(partitions_for(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(_blocks(path, dictionary, end_id), BLOCKS).write.option("compression", "none").parquet(f"{at}/blocks")
    totals = spark.read.schema(BLOCKS).parquet(f"{at}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.min("first_id").alias("first_id"))
    starts, before = [], 0
    for shard, n, first in sorted(totals.collect()):  # one row for each partition
        starts.append((shard, before, n, first))
        before += n
    spark.createDataFrame(starts, "shard int, start long, n_tokens long, first_id long").coalesce(1).write.parquet(f"{at}/shards")


def id_ranges(ids: set[int], most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all ``ids``, cut at the widest gaps, so that a filter does not grow with the ids."""
    order = sorted(ids)
    widest = sorted(range(1, len(order)), key=lambda k: order[k] - order[k - 1], reverse=True)[: most - 1]
    cuts = [0, *sorted(widest), len(order)]
    return [(order[a], order[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def read_store(spark: SparkSession, at: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids binary) of a store.

    With ``doc_ids`` only the blocks whose range may hold them are read and
    only their frames decompressed.  ``start`` counts the ids of all documents
    before, ``ids`` are little-endian unsigned 32-bit integers.
    """
    dictionary = spark.read.schema("hash string, content binary").parquet(f"{at}/dictionary").first()
    content, name, wanted = bytes(dictionary.content), dictionary.hash, None if doc_ids is None else set(doc_ids)
    if hashlib.sha256(content).hexdigest() != name:
        raise ValueError("the dictionary does not match its hash")
    blocks = spark.read.schema(BLOCKS).parquet(f"{at}/blocks")
    if wanted is not None:
        near = F.lit(False)
        for low, high in id_ranges(wanted):
            near = near | ((F.col("first_id") <= high) & (F.col("last_id") >= low))
        blocks = blocks.filter(near)
    starts = {r.shard: r.start for r in spark.read.schema("shard int, start long, n_tokens long, first_id long").parquet(f"{at}/shards").collect()}

    def run(batches):
        known = zstandard.ZstdCompressionDict(content) if content else None
        unpack = zstandard.ZstdDecompressor(dict_data=known)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("a block was written with another dictionary")
                at_id, begin, out, view = starts[row["shard"]] + row["shard_offset"], 0, [], memoryview(row["payload"])
                for doc, n, end in zip(row["doc_ids"], row["lengths"], row["ends"], strict=True):
                    if wanted is None or doc in wanted:
                        raw = unpack.decompress(view[begin:end])
                        raw = raw if row["width"] == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                        if len(raw) != 4 * n:
                            raise ValueError("a frame does not have its length")
                        out.append((doc, at_id, n, zlib.crc32(raw), raw))
                    at_id, begin = at_id + n, end
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_store(spark: SparkSession, docs: DataFrame, path: str, at: str | None = None) -> DataFrame:
    """Write a store (to ``at``, or a folder of its own in the shared one) and read it back."""
    at = at or Workspace(spark, "tokens").at("store")
    write_store(spark, docs, path, at)
    return read_store(spark, at)
