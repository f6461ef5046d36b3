"""Operator 4: quality rules as a short-circuit cascade."""

from __future__ import annotations

import copy
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_rows

BLANK = re.compile("[\x20\x09-\x0d]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


class Text:
    """One text and what the rules measure of it; a measure is taken when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.known: dict[str, int] = {}

    @property
    def words(self) -> list[bytes]:
        if not hasattr(self, "_words"):
            self._words = self.text.encode("utf-8", "surrogatepass").split()
        return self._words

    @property
    def codes(self) -> np.ndarray:
        """A number for each word, equal for equal words."""
        if not hasattr(self, "_codes"):
            seen: dict[bytes, int] = {}
            self._codes = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, len(self.words))
            self.distinct = len(seen)
        return self._codes

    def get(self, name: str) -> int:
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]


def _word_chars(t: Text) -> int:
    return sum(map(len, BLANK.split(t.text)))


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _repeat_words(t: Text) -> int:
    """Words that lie in a window of three words found twice or more."""
    c = t.codes
    if len(c) < 4:
        return 0
    base = t.distinct
    if base < 1 << 21:
        key = (c[:-2] * base + c[1:-1]) * base + c[2:]
    else:  # the product of three numbers would not fit in 64 bits
        pair = np.unique(c[:-2] * base + c[1:-1], return_inverse=True)[1]
        key = pair * base + c[2:]
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = n[back] > 1
    cover = np.zeros(len(c), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def _top_word(t: Text) -> int:
    return int(np.bincount(t.codes).max()) if t.words else 0


def _upper_words(t: Text) -> int:
    return sum(1 for w in BLANK.split(t.text) if len(w) > 1 and w.isupper())


MEASURES: dict[str, Callable[[Text], int]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": _word_chars,
    "n_symbols": lambda t: len(SYMBOL.findall(t.text)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda t: sum(1 for x in t.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")),
    "top_word": _top_word,
    "upper_words": _upper_words,
}


@dataclass(frozen=True)
class Rule:
    """A named test on a text; True rejects it."""

    name: str
    rejects: Callable[[Text], bool]


#: All in whole numbers, so that any engine gives the same verdicts.
RULES = (
    Rule("too_few_words", lambda t: t.get("n_words") < 50),
    Rule("repeated_windows", lambda t: 100 * t.get("n_repeat_words") > 50 * t.get("n_words")),
    Rule("many_symbols", lambda t: 10 * t.get("n_symbols") > t.get("n_words")),
    Rule("repeated_lines", lambda t: 100 * t.get("n_dup_lines") > 50 * t.get("n_lines")),
    Rule("word_length", lambda t: not 2 * t.get("n_words") <= t.get("word_chars") <= 15 * t.get("n_words")),
    Rule("one_word", lambda t: 100 * t.get("top_word") > 30 * t.get("n_words")),
    Rule("shouting", lambda t: 100 * t.get("upper_words") > 40 * t.get("n_words")),
)
BASE_RULES = ("too_few_words", "repeated_windows")
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, first: tuple[str, ...] = (), measures: tuple[str, ...] = (), sample_docs: int = 400, sample_chars: int = 4_000_000) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) of a bounded sample, in the order that rejects most per second.

    At most about ``sample_docs`` texts and ``sample_chars`` characters are
    timed.  The rules in ``first`` and the ``measures`` are taken beforehand, as
    the cascade has them by then, and texts that ``first`` rejects never reach
    it.  Each place goes to the rule with the most rejections per second among
    the texts that get so far, timed on what the rules before have left
    measured: a rule whose measures are there costs next to nothing.  The order
    decides the work done, never the verdict: a text is kept if no rule rejects
    it, whichever is asked first.
    """
    every = max(1, docs.count() // sample_docs)
    texts, chars = [], 0
    picked = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").limit(2 * sample_docs)
    for row in picked.toLocalIterator():
        texts.append(Text(row.text))
        chars += len(row.text or "")
        if chars > sample_chars:
            break
    by_name = {r.name: r for r in rules}
    for t in texts:
        for m in measures:
            t.get(m)
    texts = [t for t in texts if not any(by_name[n].rejects(t) for n in first)]
    found, left = [], [r for r in rules if r.name not in first]
    while left:
        trials = []
        for rule in left:
            own = [copy.copy(t) for t in texts]
            for t in own:
                t.known = dict(t.known)
            begin = time.perf_counter()
            verdicts = [rule.rejects(t) for t in own]
            seconds = (time.perf_counter() - begin) / max(1, len(texts))
            trials.append((-sum(verdicts) / max(1, len(texts)) / max(seconds, 1e-9), seconds, rule.name, verdicts, own))
        _, seconds, name, verdicts, own = min(trials, key=lambda x: x[:3])
        found.append((name, seconds, sum(verdicts) / max(1, len(texts))))
        texts = [t for t, gone in zip(own, verdicts, strict=True) if not gone]
        left = [r for r in left if r.name != name]
    return found


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, first: tuple[str, ...] = (), measures: tuple[str, ...] = (), order: list[str] | None = None) -> DataFrame:
    """``docs`` with kept (boolean) and rejected_by (the rule that decided, or null).

    The rules in ``first`` are asked for every text and their joint verdict is
    returned as base_failed, with the ``measures`` as long columns; the others
    form the cascade, in ``order`` or that of ``rule_order``, and stop at the
    first that rejects.  Null and empty texts have no words.  Other columns
    pass through; those of the same names as results are replaced.
    """
    names = [n for n in (order or [r[0] for r in rule_order(docs, rules, first, measures)]) if n not in first]
    by_name = {r.name: r for r in rules}
    added = [*((m, "long", pa.int64()) for m in measures), ("base_failed", "boolean", pa.bool_()), ("kept", "boolean", pa.bool_()), ("rejected_by", "string", pa.string())]
    new = {a[0] for a in added}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches):
            out = []
            for text in texts:
                t = Text(text)
                measured = [t.get(m) for m in measures]
                failed = next((n for n in first if by_name[n].rejects(t)), None)
                by = failed or next((n for n in names if by_name[n].rejects(t)), None)
                out.append((*measured, failed is not None, by is None, by))
            yield pa.record_batch([*batch.columns, *(pa.array(c, a[2]) for c, a in zip(zip(*out, strict=True), added, strict=True))], names=[*batch.schema.names, *(a[0] for a in added)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{n} {t}" for n, t, _ in added)])
    return docs.mapInArrow(run, schema)


def rules_sql() -> str:
    """The measures and verdicts of RULES in DuckDB SQL."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) u(k)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM r, unnest([0, 1, 2]) v(o) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(l) AS n_lines, coalesce(list_max(map_values(list_aggregate(w, 'histogram'))), 0) AS top_word, len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS upper_words
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * top_word > 30 * n_words OR 100 * upper_words > 40 * n_words) AS kept FROM b
"""
