"""Operator 9: benchmark leaks by latent semantic retrieval and shared word runs, then common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, mix64
from tessera.llm.hashed import BLANK, raw_chunks, word_hashes

TERMS = 1 << 14
BETWEEN = re.compile(r"[\W_]+")
#: Characters of scripts written without blanks (Thai to Myanmar, Khmer, kana and Han); each counts as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def plain(word: bytes) -> str:
    """A word in lower case without punctuation."""
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalnum() else BETWEEN.sub("", text)


def written(text: str | None) -> bytes:
    """A text as UTF-8, with blanks around the characters of unspaced scripts."""
    text = text or ""
    return (text if text.isascii() else UNSPACED.sub(r" \g<0> ", text)).encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    return [w for x in written(text).split() if (w := plain(x))]


#: What bytes are to a word: 0 punctuation of ASCII, which is left out, 1 its letters and digits, 2 white space, 3 the rest.
KINDS = np.array([3 if k > 127 else 2 if BLANK[k] else int(chr(k).isalnum()) for k in range(256)], np.uint8)
#: First bytes of characters among which are those of unspaced scripts.
UNSPACED_FIRST = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, *range(0xF0, 0xF5)])


class Codes(dict):
    """Numbers of words as written: that of the benchmark's word, -1 for other words, -2 for mere punctuation.

    Words of ASCII are found by hashes of their letters and digits, many texts
    at once; words with other characters one by one, and texts that may be in
    unspaced scripts by themselves.
    """

    def __init__(self, vocabulary: dict[str, int], most: int = 1_000_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most
        own = [(w, c) for w, c in vocabulary.items() if w.isascii()]
        text = " ".join(w for w, _ in own).encode()
        hashes, _, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
        order = np.argsort(hashes)
        self.hashes, self.numbers = np.append(hashes[order], np.uint64((1 << 64) - 1)), np.append(np.array([c for _, c in own], np.int64)[order], -1)

    def __missing__(self, word: bytes) -> int:
        p = plain(word)
        code = self.vocabulary.get(p, -1) if p else -2
        if len(self) < self.most:
            self[word] = code
        return code

    def of(self, text: str | None) -> np.ndarray:
        words = written(text).lower().split()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return codes[codes > -2] if len(codes) else codes

    def of_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The codes of each text."""
        for _, raw, begins in raw_chunks(column):
            kinds = KINDS[raw]
            at = np.flatnonzero(kinds)
            hashes, starts, bounds = word_hashes(raw[at], np.searchsorted(at, begins))
            place = np.searchsorted(self.hashes, hashes)
            codes = np.where(self.hashes[place] == hashes, self.numbers[place], -1)
            high = np.flatnonzero(kinds == 3)
            if len(high):
                blank = np.flatnonzero(kinds == 2)
                # the words that have such bytes, whole as they are written
                first = at[starts]
                some = np.searchsorted(first, high, "right") - 1
                some = some[np.append(some[1:] != some[:-1], True)]
                left, right = np.sort(np.concatenate([blank + 1, begins])), np.sort(np.concatenate([blank, begins]))
                left, right = left[np.searchsorted(left, first[some], "right") - 1], right[np.searchsorted(right, first[some], "right")]
                text = raw.tobytes()
                lower = text.lower()
                codes[some] = [self[lower[x:y]] for x, y in zip(left.tolist(), right.tolist(), strict=True)]
                doubtful = set((np.searchsorted(begins, np.flatnonzero(UNSPACED_FIRST[raw]), "right") - 1).tolist())
            else:
                doubtful = set()
            for k, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if k in doubtful:
                    yield self.of(text[begins[k] : begins[k + 1]].decode("utf-8", "surrogatepass"))
                else:
                    own = codes[x:y]
                    yield own[own > -2]


@dataclass(frozen=True)
class Passage:
    """A stretch of a benchmark item: its words' numbers and those of the answer."""

    item: int
    codes: list[int]
    answer: list[int]
    whole: bool = False  # an item of few words, which leaks only word by word

    def common(self, other: list[int]) -> int:
        """Length of the longest common subsequence with ``other``, a bit for each of the passage's words."""
        row = full = (1 << len(self.codes)) - 1
        masks = self.masks
        for c in other:
            m = masks.get(c)
            if m:
                hit = row & m
                row = (row + hit | row - hit) & full
        return len(self.codes) - row.bit_count()

    def shared_words(self, other: np.ndarray) -> int:
        """How many words both have, by times each: no common subsequence is longer."""
        if "_times" not in self.__dict__:
            self.__dict__["_times"] = np.unique(np.array(self.codes), return_counts=True)
        own, times = self.__dict__["_times"]
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == other], minlength=len(own)), times).sum())

    @property
    def masks(self) -> dict[int, int]:
        if "_masks" not in self.__dict__:
            found: dict[int, int] = {}
            for k, c in enumerate(self.codes):
                found[c] = found.get(c, 0) | 1 << k
            self.__dict__["_masks"] = found
        return self.__dict__["_masks"]

    def answered(self, other: list[int]) -> bool:
        n = len(self.answer)
        return n > 0 and any(other[k : k + n] == self.answer for k in range(len(other) - n + 1))


def passages_of(items: list[tuple[int, str | None, str | None]], window: int, least_words: int, answer_words: int) -> tuple[dict[str, int], list[Passage]]:
    """The benchmark's words with their numbers, and its items in passages of at most ``window`` words, half overlapping."""
    vocabulary: dict[str, int] = {}
    passages = []
    for item, text, answer in items:
        codes = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        if len(codes) < least_words:
            if codes:
                passages.append(Passage(item, codes, [], True))
            continue
        known = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(answer)] or codes[-answer_words:]
        for k in range(0, max(1, len(codes) - window // 2), window // 2):
            if len(part := codes[k : k + window]) >= least_words:
                passages.append(Passage(item, part, known))
    return vocabulary, passages


def coded(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, codes) of the texts with words: little-endian 16-bit numbers, 32-bit where the benchmark has more words."""
    kind = "<i2" if len(vocabulary) < 1 << 15 else "<i4"

    def run(batches) -> Iterator[pa.RecordBatch]:
        codes = Codes(vocabulary)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([x.astype(kind).tobytes() for x in codes.of_column(batch.column("text"))], pa.binary())], names=["doc_id", "codes"])

    return docs.mapInArrow(run, "doc_id long, codes binary").filter("octet_length(codes) > 0")


def document_frequency(ws: Workspace, docs: DataFrame, size: int, window: int) -> tuple[np.ndarray, int]:
    """In how many of the corpus' passages each word of the benchmark occurs, and how many passages there are."""
    kind = "<i2" if size < 1 << 15 else "<i4"

    def count(batches) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), kind) for x in batch.column("codes")]
            for k in range(0, len(parts), 50):
                own = parts[k : k + 50]
                passages = np.array([-(-len(x) // window) for x in own])
                first = np.cumsum(passages) - passages
                place = np.concatenate([f + np.arange(len(x)) // window for f, x in zip(first, own, strict=True)])
                codes = np.concatenate(own).astype(np.int64)
                known = codes >= 0
                pairs = place[known] * size + codes[known]
                pairs.sort()
                new = np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, bool)
                total += np.bincount(pairs[new] % size, minlength=size)
                n += int(passages.sum())
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[at].tolist(), n], pa.int64())], names=["word", "n"])

    found = docs.select("codes").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df, n = np.zeros(size, np.int64), 0
    for row in ws.write(found, "frequency").toLocalIterator():  # one row for each word of the benchmark
        if row.word < 0:
            n = row.n
        else:
            df[row.word] = row.n
    return df, n


def term_of(vocabulary: dict[str, int]) -> np.ndarray:
    """The hashed term of each word."""
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % TERMS for w in vocabulary], np.int64)


def latent_space(spark: SparkSession, passages: list[Passage], weight: np.ndarray, term: np.ndarray, rank: int, seed: int = 11, powers: int = 2, each: int = 500) -> np.ndarray:
    """Right singular vectors (TERMS x rank) of the TF-IDF passages, by a randomised range finder.

    The passages lie in a DataFrame; each power iteration adds up A'(A Q) of
    the partitions in blocks of terms and orthogonalises the sum.
    """
    rows = [(k // each, sorted({c for c in p.codes if weight[c] > 0})) for k, p in enumerate(passages)]
    table = spark.createDataFrame(rows, "part long, words array<int>").repartition(max(1, -(-len(rows) // each)), "part")
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(TERMS, rank)))[0].astype(np.float32)
    for step in range(powers + 1):
        held = spark.sparkContext.broadcast(basis)  # of a fixed size

        def multiply(batches, held=held) -> Iterator[pa.RecordBatch]:
            total, any_rows = np.zeros((TERMS, rank), np.float32), False
            for batch in batches:
                for words in batch.column("words").to_pylist():
                    if words:
                        any_rows, w = True, np.array(words)
                        x = weight[w] / np.linalg.norm(weight[w])
                        np.add.at(total, term[w], x[:, None] * (x @ held.value[term[w]]))
            if any_rows:
                at = np.flatnonzero(total.any(axis=1))
                yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.float64).tolist(), pa.list_(pa.float64()))], names=["term", "row"])

        sums = table.mapInArrow(multiply, "term int, row array<double>").groupBy("term").agg(*[F.sum(F.col("row")[k]).alias(f"x{k}") for k in range(rank)])
        product = np.zeros((TERMS, rank))
        for row in sums.toLocalIterator():
            product[row[0]] = row[1:]
        held.unpersist()
        q, r = np.linalg.qr(product)
        if step == powers:  # the last product holds the singular values, largest directions first
            u, _, _ = np.linalg.svd(r)
            return (q @ u).astype(np.float32)
        basis = q.astype(np.float32)
    return basis


def run_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` words from each place on; 0 where not all of them are the benchmark's."""
    size = max(0, len(codes) - n + 1)
    keys, known = np.zeros(size, np.uint64), np.ones(size, bool)
    for k in range(n):
        part = codes[k : k + size]
        keys = mix64(keys + part.astype(np.uint64) + np.uint64(k + 1))
        known &= part >= 0
    return np.where(known, keys | np.uint64(1), np.uint64(0))


class Runs:
    """The word runs of the passages: ``least`` words of long ones from every place on, all words of shorter ones."""

    BITS = 20

    def __init__(self, passages: list[Passage], least: int):
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for p, x in enumerate(passages):
            n = len(x.codes) if x.whole else min(least, len(x.codes))
            by_size.setdefault(n, []).append((run_keys(np.array(x.codes, np.int64), n), p))
        self.tables = {}
        for n, own in sorted(by_size.items()):
            keys = np.concatenate([k for k, _ in own])
            passage = np.concatenate([np.full(len(k), p) for k, p in own])
            offset = np.concatenate([np.arange(len(k)) for k, _ in own])
            order = np.argsort(keys, kind="stable")
            some = np.zeros(1 << self.BITS, bool)
            some[keys >> np.uint64(64 - self.BITS)] = True
            self.tables[n] = some, keys[order], passage[order], offset[order]

    def find(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in ``codes``, passage, place in it) of the runs that both have, for each size of runs."""
        for n, (some, keys, passage, offset) in self.tables.items():
            own = run_keys(codes, n)
            at = np.flatnonzero(some[own >> np.uint64(64 - self.BITS)] & (own > 0))
            low = np.searchsorted(keys, own[at])
            times = np.searchsorted(keys, own[at], "right") - low
            hit = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(at, times), passage[hit], offset[hit]


HITS = "doc_id long, item_id long, cosine double, common_words long, passage_words long, answer_found boolean, first_word long"


@dataclass
class Search:
    """What a task needs to compare documents with the benchmark: passages, latent rows of the words, latent passages."""

    passages: list[Passage]
    latent: np.ndarray
    place: np.ndarray
    targets: np.ndarray
    window: int
    step: int
    cosine: float
    accept: float
    paraphrase: float
    runs: Runs

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Latent sums of the windows of one document, one for each step of words."""
        per = self.window // self.step
        blocks = max(1, -(-len(codes) // self.step))
        at = np.full((blocks + per, self.step), -1, np.int64)  # the last row of the latent words is zero
        at.ravel()[: len(codes)] = self.place[codes]
        total = self.latent[at[:, 0]]
        for k in range(1, self.step):
            total += self.latent[at[:, k]]
        count = max(1, blocks - per + 1)
        # sums of 1, 2, 4 .. blocks make up those of ``per``
        out, done, part, n = None, 0, total, 1
        while True:
            if per & n:
                out = part[:count].copy() if out is None else out + part[done : done + count]
                done += n
            if done == per:
                return out
            part = part[:-n] + part[n:]
            n *= 2

    def met(self, docs: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
        """(document, passage, where the passage would start) by shared runs, once for each step of words."""
        apart = np.full(1, -1, np.int64)
        flat = np.concatenate([x for _, codes in docs for x in (codes, apart)]).astype(np.int64)
        first = np.cumsum([0, *(len(codes) + 1 for _, codes in docs)])
        found: dict[tuple[int, int, int], int] = {}
        for place, passage, offset in self.runs.find(flat):
            owner = np.searchsorted(first, place, "right") - 1
            start = place - first[owner] - offset
            for o, p, k in zip(owner.tolist(), passage.tolist(), start.tolist(), strict=True):
                found.setdefault((o, p, k if self.passages[p].whole else k // self.step), k)
        return [(o, p, k) for (o, p, _), k in found.items()]

    def judge(self, docs: list[tuple[int, np.ndarray]], parts: list[np.ndarray]) -> list[tuple]:
        """The leaks of some documents, given their windows."""
        all_windows = np.concatenate(parts)
        bound = self.cosine * np.maximum(np.linalg.norm(all_windows, axis=1, keepdims=True), 1e-6)
        scores = all_windows @ self.targets
        sizes = [len(p) for p in parts]
        owner = np.repeat(np.arange(len(parts)), sizes)
        first = np.concatenate([[0], np.cumsum(sizes)])
        best: dict[tuple[int, int], tuple] = {}

        def compare(o: int, p: int, w: int, begin: int, end: int) -> None:
            passage = self.passages[p]
            n = len(passage.codes)
            near = docs[o][1][begin:end]
            if passage.shared_words(near) < self.paraphrase * n:
                return
            near = near.tolist()
            if passage.whole:
                common, answered = (n, True) if near == passage.codes else (0, False)
            elif (common := passage.common(near)) >= self.paraphrase * n:
                answered = passage.answered(near)
            else:
                return
            if common >= self.accept * n or answered:
                row = (common / n, float(scores[w, p] / bound[w, 0] * self.cosine), common, n, answered, begin)
                if (key := (o, passage.item)) not in best or row > best[key]:
                    best[key] = row

        for w, p in zip(*np.nonzero(scores >= bound), strict=True):
            o, n = int(owner[w]), len(self.passages[p].codes)
            start = int(w - first[o]) * self.step
            spare = max(self.step, (n * 5 // 4 - self.window) // 2)
            compare(o, int(p), w, max(0, start - spare), start + self.window + spare)
        for o, p, start in self.met(docs):
            n = len(self.passages[p].codes)
            w = first[o] + min(max(0, start) // self.step, sizes[o] - 1)
            if self.passages[p].whole:
                compare(o, p, w, start, start + n)
            elif best.get((o, self.passages[p].item), (0,))[0] < 1:  # a whole passage is not surpassed
                spare = self.step + (self.window - n) // 2
                compare(o, p, w, max(0, start - spare), start + n + spare)
        return [(docs[o][0], item, *row[1:]) for (o, item), row in sorted(best.items())]


def find_leaks(
    spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 48, step: int = 8, rank: int = 128, cosine: float = 0.5, accept: float = 0.7,
    paraphrase: float = 0.5, answer_words: int = 5, least_words: int = 8, common_share: float = 0.15, most_bytes: int = 64 << 20, run_words: int = 5,
) -> DataFrame:
    """Benchmark items (item_id, text and maybe answer) that occur in documents (doc_id, text), exactly or in other words.

    Items are cut into passages of ``window`` words.  TF-IDF weighs the
    benchmark's words by their frequency in all passages of the corpus; words
    in more than ``common_share`` of them weigh half of that, but never nothing,
    for a benchmark item copied often makes its own words frequent.  The passages' latent
    space comes from a distributed randomised SVD.  Every window of a document
    (a start each ``step`` words) is projected into it; where its cosine with a
    passage reaches ``cosine``, the words around it are compared with the
    passage, and so are the words around every run of ``run_words`` words that
    a document shares with it, whatever they weigh: it is a leak if their longest common subsequence covers ``accept``
    of the passage, or ``paraphrase`` of it and the answer stands there word by
    word (the answer column, or else the item's last ``answer_words`` words).

    Rows, one for each leaking document and item, its best window: doc_id,
    item_id, cosine, common_words, passage_words, answer_found, first_word.
    An item of fewer than ``least_words`` words leaks where all its words stand
    in a row.  Characters of scripts written without blanks count as words.
    Items without an id or without words and null texts have no leaks; an
    item twice in the table gives one row.  The benchmark goes to the tasks
    whole, so more than ``most_bytes`` of it raise: call with parts of it then.
    """
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    chosen = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    size = chosen.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes; pass it in parts of at most {most_bytes}")
    rows = sorted(((r.item_id, r.text, r.answer) for r in chosen.collect()), key=lambda r: (r[0], r[1] or "", r[2] or ""))
    vocabulary, passages = passages_of(rows, window, least_words, answer_words)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not passages:
        return spark.createDataFrame([], HITS)
    ws = Workspace(spark, "leaks")
    codes = ws.write(coded(docs, vocabulary), "codes")
    df, n = document_frequency(ws, codes, len(vocabulary), window)
    weight = ((np.log((n + 1) / (df + 1)) + 0.1) * np.where(df > common_share * max(n, 20), 0.5, 1)).astype(np.float32)
    term = term_of(vocabulary)
    many = [p for p in passages if not p.whole]
    space = latent_space(spark, many, weight, term, min(rank, len(many))) if many else np.zeros((TERMS, 1), np.float32)
    latent = weight[:, None] * space[term]  # a row for each word of the benchmark
    sums = np.array([latent[sorted(set(p.codes))].sum(axis=0) * (not p.whole) for p in passages])
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    # the place of a word's latent row; -1, at the end, for code -1: zeros
    place = np.append(np.arange(len(weight)), -1)
    latent = np.vstack([latent, np.zeros((1, latent.shape[1]), np.float32)])
    targets = np.ascontiguousarray(sums.T, np.float32)
    shared = spark.sparkContext.broadcast(Search(passages, latent, place, targets, window, step, cosine, accept, paraphrase, Runs(passages, run_words)))
    kind = "<i2" if len(vocabulary) < 1 << 15 else "<i4"

    def search(batches) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        names = ["doc_id", "item_id", "cosine", "common_words", "passage_words", "answer_found", "first_word"]
        for batch in batches:
            out, own, parts, held = [], [], [], 0
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("codes"), strict=True):
                own.append((doc, np.frombuffer(raw.as_buffer(), kind)))
                parts.append(shared.value.windows(own[-1][1]))
                held += len(parts[-1])
                if held > 4000:
                    out += shared.value.judge(own, parts)
                    own, parts, held = [], [], 0
            if parts:
                out += shared.value.judge(own, parts)
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return codes.mapInArrow(search, HITS)
