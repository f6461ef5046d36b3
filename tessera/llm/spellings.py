"""Spelling variants: a trie self-join with active-node sets at distance one.

The vocabulary is a trie whose nodes are prefixes.  Two words are near when one
inserted, deleted or replaced code point lies between them.  The active nodes
of a node x are then x itself, and every node y at distance one of it, from
where both have to go on with the same letters.  Only two things bring a pair
(x, y) about, where the two words part: siblings (replaced; the smaller letter
is taken for y), and a node with its own parent (a letter that y lacks).

``STEP`` levels of the trie are gone through as tables, for all words at once:
the pairs of a level meet the children of both sides, so pairs die where the
vocabulary has no such letters.  Words below the pairs that are left look up
the one word they can end at.  Pairs that part further down share a prefix, so
each prefix's words are a trie of their own, joined in one task, where they are
at most ``most`` words; prefixes with more of them go through the next ``STEP``
levels as tables.  A node has no more children than the alphabet has letters,
and a pair no more than one child a letter, so no key grows with the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, partitions_for

#: Levels of the trie in one round of tables; no word of the contract is shorter.
STEP = 6
#: Stands after a word; no letter.
END = "$"


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_letters: int = 6, least: int = 5, every: int | None = 199) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lower-cased, of at least ``least_letters``, that come up ``least`` times or more.

    ``every`` makes the contract's misspellings first: where it divides the
    crc32 of ``<doc_id>:<run>``, one letter of the run goes (a missing id is an
    empty text there).  Null texts have no words; all rows count, repeated ones
    too.
    """
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    run = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit("([A-Za-zÀ-ÿ]{%d,})" % least_letters), F.lit(1)))
    found = docs.select(key.alias("key"), run.alias("run"))
    plain = F.octet_length("run") == F.length("run")
    found = found.select("key", F.when(plain, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("run"))
    word = F.col("run")
    if every:
        found = found.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))).otherwise(word)
    counted = found.select(word.alias("word")).filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def node(depth: int | Column, word: str = "word") -> Column:
    """The node of a word at a depth; below its end the word goes on with ``END``."""
    return F.rpad(word, depth, END)


def _pairs(ws: Workspace, words: DataFrame, base: int, name: str) -> DataFrame:
    """The pairs (x, y) of active nodes ``base`` + STEP letters down that part below ``base``, x of that length, y of it or one less."""
    depths = F.explode(F.sequence(F.lit(base + 1), F.lit(base + STEP)))
    nodes = words.select("word", depths.alias("depth")).select("depth", node(F.col("depth")).alias("node"))
    nodes = nodes.distinct().select("depth", "node", F.expr("substring(node, 1, depth - 1)").alias("parent"), F.expr("substring(node, depth, 1)").alias("letter"))
    nodes = ws.write(nodes, f"{name}_nodes")
    at = lambda depth: nodes.filter(F.col("depth") == depth).drop("depth")
    pairs = None
    for depth in range(base + 1, base + STEP + 1):
        here = at(depth)
        left, right = here.select("parent", F.col("node").alias("x"), F.col("letter").alias("a")), here.select("parent", F.col("node").alias("y"), F.col("letter").alias("b"))
        born = left.join(right, "parent").filter("b < a").select("x", "y")
        born = born.unionByName(here.filter(F.col("letter") != END).select(F.col("node").alias("x"), F.col("parent").alias("y")))
        if pairs is not None:
            further = pairs.join(here.select(F.col("parent").alias("x"), F.col("node").alias("to"), "letter"), "x")
            further = further.select(F.col("to").alias("x"), F.concat("y", "letter").alias("y"))
            there = here.union(at(depth - 1)).select(F.col("node").alias("y"))
            born = born.unionByName(further.join(there, "y", "left_semi").select("x", "y"))
        pairs = ws.write(born.distinct(), f"{name}_{depth}")
        if depth > base + 1:
            ws.drop(f"{name}_{depth - 1}")
    return pairs


def trie(words: list[str], depth: int):
    """Nodes as dicts by letter from ``depth`` letters on, a subtree of one word as the word; ``words`` sorted, with END, distinct."""
    root: dict = {}
    todo = [(0, len(words), depth, root)]
    while todo:
        start, stop, d, at = todo.pop()
        while start < stop:
            letter, end = words[start][d], start + 1
            while end < stop and words[end][d] == letter:
                end += 1
            if end - start == 1:
                at[letter] = words[start]
            else:
                at[letter] = {}
                todo.append((start, end, d + 1, at[letter]))
            start = end
    return root


def _go(at, depth: int, letter: str):
    """The child by ``letter`` of a node or word ``depth`` letters down, None if there is none."""
    if isinstance(at, dict):
        return at.get(letter)
    return at if at[depth] == letter else None


def near_below(words: list[str], depth: int) -> set[tuple[str, str]]:
    """The near pairs of ``words`` (sorted, distinct, with END after each) that part from ``depth`` letters on, the longer or greater word first."""
    found: set[tuple[str, str]] = set()
    todo = [(trie(words, depth), depth, [])]
    while todo:
        x, depth, active = todo.pop()  # active: (y, its depth), the nodes at distance one
        if isinstance(x, str):  # what is left of the word is to be found below each y
            for y, d in active:
                k = depth
                while isinstance(y, dict):
                    y, d, k = y.get(x[k]), d + 1, k + 1
                if y is not None and y[d:] == x[k:]:
                    found.add((x, y))
            continue
        for letter, child in x.items():
            then = [(z, d + 1) for y, d in active if (z := _go(y, d, letter)) is not None]
            then += [(other, depth + 1) for smaller, other in x.items() if END != smaller < letter]
            if letter != END:
                then.append((x, depth))
            todo.append((child, depth + 1, then))
    return found


def _below(ws: Workspace, words: DataFrame, depth: int) -> DataFrame:
    """The near pairs within each prefix of ``depth`` letters, each prefix's words in one task."""
    spread = words.select(node(depth).alias("x"), "word", "n").repartition(partitions_for(words.sparkSession), "x").sortWithinPartitions("x", "word")

    def join(batches):
        held: list[tuple[str, int]] = []
        own = None

        def pairs():
            n = dict(held)
            # by the order of the words with END, which is not that of the words without
            found = near_below(sorted(w + END for w in n), depth)
            both = [(a[:-1], b[:-1]) for a, b in found]
            a, b = [x for x, _ in both] + [y for _, y in both], [y for _, y in both] + [x for x, _ in both]
            return pa.record_batch([pa.array(a, pa.string()), pa.array([n[x] for x in a], pa.int64()), pa.array(b, pa.string()), pa.array([n[x] for x in b], pa.int64())], ["word", "n", "near", "near_n"])

        for batch in batches:
            for x, word, n in zip(*(batch.column(c).to_pylist() for c in ("x", "word", "n"))):
                if x != own:
                    if len(held) > 1:
                        yield pairs()
                    own, held = x, []
                held.append((word, n))
        if len(held) > 1:
            yield pairs()

    return spread.mapInArrow(join, "word string, n long, near string, near_n long")


def near_pairs(ws: Workspace, words: DataFrame, most: int = 2000) -> DataFrame:
    """(word, n, near, near_n) for all words at distance one, both ways round, some perhaps twice.

    ``words`` (word, n) is a table whose words are distinct, have letters only
    and are not empty.  ``most`` bounds the words of a prefix that meet in a
    task; it does not bound what is found.
    """
    out, base = None, 0
    left = words
    while True:
        pairs = _pairs(ws, left, base, f"pairs_{base}")
        down = left.withColumn("x", node(base + STEP)).join(pairs, "x")
        ending = F.expr(f"trim(TRAILING '{END}' FROM concat(y, substring(word, {base + STEP + 1})))")
        down = down.select("word", "n", ending.alias("near"))
        met = down.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")
        met = ws.write(met, f"met_{base}")
        both = met.union(met.select("near", "near_n", "word", "n"))
        out = both if out is None else out.union(both)
        base += STEP
        large = ws.write(left.groupBy(node(base).alias("x")).agg(F.count("*").alias("size")).filter(F.col("size") > most).select("x"), f"large_{base}")
        keyed = left.withColumn("x", node(base))
        small = keyed.join(large, "x", "left_anti").select("word", "n")
        out = out.union(_below(ws, small, base))
        if large.isEmpty():
            return out
        left = ws.write(keyed.join(large, "x", "left_semi").select("word", "n"), f"words_{base}")


def _roots(ws: Workspace, forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form), by doubling the way that is known."""
    at = ws.write(forms.select("word", F.col("form").alias("root")), "roots_0")
    step = 0
    while True:
        step += 1
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = ws.write(moved, f"roots_{step}")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def group_spellings(spark: SparkSession, words: DataFrame, times: int = 5, most: int = 2000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row (word, n) of a vocabulary.

    ``form`` is the near word that occurs most (ties: the smallest in
    code-point order), if that is at least ``times`` as often as the word, else
    null; ``root`` is where the forms lead from the word.  Null and empty words
    take no part, a word's rows are added up, columns beside the two are left
    out, and an empty vocabulary gives no rows.  Words hold no ``$``; ``times``
    is 2 or more, so that forms lead to no circle.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    ws = Workspace(spark, "spellings")
    words = words.filter("word != ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = ws.write(words, "words")
    pairs = near_pairs(ws, words, most).distinct()
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    stats = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(stats, "word", "left")
    has = -F.col("best.less") >= F.lit(times) * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    joined = ws.write(joined, "forms")
    roots = _roots(ws, joined.filter("form IS NOT NULL"))
    out = joined.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
