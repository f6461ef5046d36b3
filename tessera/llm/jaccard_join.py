"""Operator 2: n-gram Jaccard self-join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, components, mix64, partitions_for
from tessera.llm.hashed import raw_chunks, word_hashes

#: Counters of the frequency sketch: 4 bytes each, so what is broadcast has this fixed size.
COUNTERS = 1 << 22
BLOCK = 1 << 14
SALTS = 16
BITS = ("bits0", "bits1", "bits2", "bits3")
#: Odd numbers without a pattern, one for each place in a shingle.
FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the ``n``-word shingles of each text, in order and with repeats.

    Words are what lies between ASCII white space, A-Z in lower case.  A text
    of one to n-1 words has one shingle, the whole sequence.
    """
    for _, raw, begins in raw_chunks(column):
        words, _, bounds = word_hashes(raw, begins)
        words = mix64(words)
        total = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            total += words[k : k + len(total)] * FACTORS[k]
        total = mix64(total)
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if y - x >= n:
                yield total[x : y - n + 1]
            elif y > x:
                yield mix64(np.array([(words[x:y] * FACTORS[: y - x]).sum() + np.uint64(y - x)], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted hashes."""
    for total in shingle_hashes(column, n):
        own = np.sort(total)
        if len(own) > 1:
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            own = own[new]
        yield own


def sketch(spark: SparkSession, ws: Workspace, docs: DataFrame, n: int) -> np.ndarray:
    """How many shingles there are in each counter, over all documents.

    Counters are added up in each task and then by block; what reaches the
    driver is the sketch itself, of a fixed size.
    """

    def count(batches) -> Iterator[pa.RecordBatch]:
        own, any_rows = np.zeros(COUNTERS, np.uint32), False
        for batch in batches:
            for found in shingle_hashes(batch.column("text"), n):
                any_rows = True
                np.add.at(own, (found >> np.uint64(42)).view(np.int64), np.uint32(1))
        if any_rows:
            for k in range(0, COUNTERS, BLOCK):
                yield pa.record_batch([pa.array([k // BLOCK], pa.int32()), pa.array([own[k : k + BLOCK].tobytes()], pa.binary())], names=["block", "counts"])

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.uint64)
        for batch in tables:
            for raw in batch.column("counts"):
                total += np.frombuffer(raw.as_buffer(), np.uint32)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["block", "counts"])

    parts = docs.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    for row in ws.write(parts, "sketch").toLocalIterator():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(bytes(row.counts), np.uint32)
    return out


def prefix_length(df: np.ndarray, need: int, most: int, verify: float) -> int:
    """The number of matches l (1 to ``most``) to ask of the prefix of |set| - need + l rarest shingles.

    Probing costs the postings of the prefix, verifying ``verify`` times the
    set for each candidate.  Candidates for l are estimated as postings / l,
    for each shares at least l of them.
    """
    base = len(df) - need
    reach = np.cumsum(df.astype(np.float64))
    best, cost = 1, np.inf
    for k in range(1, min(most, need) + 1):
        postings = reach[base + k - 1]
        now = postings + verify * len(df) * postings / k
        if now < cost:
            best, cost = k, now
    return best


def describe(docs: DataFrame, counts, n: int, percent: int, most_matches: int) -> DataFrame:
    """(row_id, n_shingles, signature, matches, prefix, bits0 .. bits3) of each text.

    The prefix is 64-bit hashes, rarest counter first.  The bits are the
    parities of the set's hashes in 256 places: those of two sets differ in no
    more places than the sets have elements that are not shared.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        df_of = counts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, names, matches, prefixes, bits = [], [], [], [], []
            for own in shingle_sets(batch.column("text"), n):
                size = len(own)
                sizes.append(size)
                names.append(xxhash.xxh3_128_digest(own.tobytes()))
                odd = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                if not size:
                    matches.append(0)
                    prefixes.append(b"")
                    continue
                df = df_of[(own >> np.uint64(42)).astype(np.int64)]
                need = -(-percent * size // 100)  # of any partner's shingles, at the least
                reach = size - need + min(most_matches, need)
                order = np.argpartition(df, reach - 1)[:reach] if reach < size else np.arange(size)
                # ties by hash: one order of all shingles for all documents
                edge = df[order].max()
                order = np.flatnonzero(df <= edge)
                order = order[np.lexsort((own[order], df[order]))][:reach]
                sorted_df = df[order]
                k = prefix_length(np.concatenate([sorted_df, np.zeros(size - reach, sorted_df.dtype)]), need, min(most_matches, need), 0.01)
                matches.append(k)
                prefixes.append(own[order[: size - need + k]].tobytes())
            yield pa.record_batch([batch.column("row_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(matches, pa.int32()), pa.array(prefixes, pa.binary()), *(pa.array([x[k] for x in bits], pa.int64()) for k in range(4))], names=["row_id", "n_shingles", "signature", "matches", "prefix", *BITS])

    return docs.mapInArrow(run, "row_id long, n_shingles long, signature binary, matches int, prefix binary, bits0 long, bits1 long, bits2 long, bits3 long")


POSTING = "token long, node long, size int, matches int, reach int"


def postings(reps: DataFrame, percent: int) -> DataFrame:
    """A row for each shingle of each prefix; ``reach`` is the largest size a partner may have.

    If the match at place i of the order is the k-th of a pair, at most
    |set| - i + k - 1 shingles are shared, and need * (|set| + |partner|) of
    them are asked for, which bounds the partner.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
            n = np.array([len(x) for x in parts], np.int64)
            if n.sum():
                size, matches = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "matches"))
                place = np.concatenate([np.arange(k) for k in n])
                most = np.repeat(size + matches - 1, n) - place
                reach = np.minimum(most * (100 + percent) // percent - np.repeat(size, n), (1 << 31) - 1)
                yield pa.record_batch([pa.array(np.concatenate(parts)), *(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("node", "size", "matches")), pa.array(reach.astype(np.int32))], names=["token", "node", "size", "matches", "reach"])

    return reps.select("node", F.col("n_shingles").cast("int").alias("size"), "matches", "prefix").mapInArrow(run, POSTING)


def shared_postings(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Postings whose token has a second node, streamed over sorted range partitions.

    Memory does not follow a token's count, and a token that many nodes have is
    cut into partitions.  A cut may part two postings, so the first and the last
    one of each partition stay whatever their token.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            token = table.column("token").to_numpy()
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            keep[0] |= held is None
            keep = keep[:-1]  # the last row waits for the next batch, with one row before it for its token
            start = carried if held is not None else 0
            rows = np.flatnonzero(keep)
            rows = rows[rows >= start]
            yield from table.take(pa.array(rows)).combine_chunks().to_batches()
            carried = min(len(token) - 1, 1)
            held = table.slice(len(token) - 1 - carried)
        if held is not None:
            yield from held.slice(held.num_rows - 1).combine_chunks().to_batches()

    order = ("token", "size", "node")
    dealt = found.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, POSTING)


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that link, by their whole sets.

    Both texts' sets meet in a task of the pair: the smaller node's set is sent
    once for each of its pairs, and pairs of one node are dealt out by both ids,
    so that a node with many partners is no task of its own.
    """

    def sets(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("row_id"), pa.array([x.tobytes() for x in shingle_sets(batch.column("text"), n)], pa.binary())], names=["node", "own"])

    def check(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                hit.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("row_id")).union(pairs.select("b")).distinct()
    own = docs.join(nodes, "row_id", "left_semi").mapInArrow(sets, "node long, own binary")
    met = pairs.join(own.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    return met.mapInArrow(check, "a long, b long")


def contract(ws: Workspace, labelled: DataFrame, percent: int, step: int, window: int = 16) -> DataFrame:
    """For each node at most one pair: the likeliest of the ``window`` nodes before and after it in a token's postings, in another class.

    Postings of a token are sorted by another part of the parity bits in each
    step, which brings similar sets together; of the partners that sizes,
    reaches and bits allow, the one whose bits differ in the fewest places is
    taken.  Range partitions cut a token that many nodes have, which parts a few
    neighbours.  A node that finds none here is left to ``candidate_pairs``.
    """
    turned = [BITS[(step + k) % len(BITS)] for k in range(len(BITS))]
    order = ("token", *turned, "node")
    dealt = labelled.repartitionByRange(partitions_for(ws.spark), *order).sortWithinPartitions(*order)
    names = ("token", "node", "class", "size", "reach", *BITS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            token, node, cls, size, reach, *bits = rows
            best, partner = np.full(len(token), 1 << 30), np.zeros(len(token), np.int64)
            for d in range(1, min(window, len(token) - 1) + 1):
                x, y = slice(None, -d), slice(d, None)
                ok = (token[x] == token[y]) & (cls[x] != cls[y]) & (node[x] != node[y]) & (size[x] <= reach[y]) & (size[y] <= reach[x])
                ok &= 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
                apart = sum(np.bitwise_count((w[x] ^ w[y]).view(np.uint64)).astype(np.int64) for w in bits)
                ok &= (100 + percent) * apart <= (100 - percent) * (size[x] + size[y])
                for own, other in ((x, y), (y, x)):
                    nearer = ok & (apart < best[own])
                    best[own] = np.where(nearer, apart, best[own])
                    partner[own] = np.where(nearer, node[other], partner[own])
            at = np.flatnonzero(best < 1 << 30)
            yield pa.record_batch([pa.array(node[at]), pa.array(partner[at]), pa.array(best[at])], names=["a", "b", "apart"])
            held = [r[-window:] for r in rows]

    met = dealt.mapInArrow(run, "a long, b long, apart long")
    best = met.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return ws.write(best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"near{step}")


def of_many_classes(labelled: DataFrame) -> DataFrame:
    """Postings of the tokens that nodes of two classes have, and that some of the sizes allow."""
    wide = labelled.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("size").alias("least")).filter("low != high").select("token", "least")
    return labelled.join(wide, "token").filter("reach >= least").drop("least")


def candidate_pairs(near: DataFrame, percent: int) -> DataFrame:
    """All pairs of different classes that share enough of their prefixes, by size and place.

    A node meets those of its size band and of the one below it; sizes and
    reaches, and how many parity bits differ, are part of the join condition
    and leave few pairs of a token that many nodes share.
    """
    columns = ("node", "class", "size", "matches", "reach", *BITS)
    band = F.floor(F.log("size") / float(np.log(100 / percent)) + 1e-9).cast("int")
    left = near.select("token", F.explode(F.array(band, band - 1)).alias("band"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = near.select("token", band.alias("band"), *[F.col(c).alias(f"{c}_b") for c in columns])
    larger_first = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("node_a") > F.col("node_b")))
    fits = (100 * F.col("size_b").cast("long") >= percent * F.col("size_a").cast("long")) & (F.col("size_b") <= F.col("reach_a")) & (F.col("size_a") <= F.col("reach_b"))
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in BITS), F.lit(0))
    fits &= (100 + percent) * apart <= (100 - percent) * (F.col("size_a") + F.col("size_b"))
    keys = (left["token"] == right["token"]) & (left["band"] == right["band"])
    met = left.join(right, keys & larger_first & fits & (F.col("class_a") != F.col("class_b")))
    pairs = met.groupBy("node_a", "node_b").agg(F.count("*").alias("n"), F.min(F.least("matches_a", "matches_b")).alias("need"))
    return pairs.filter("n >= need").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def joined_classes(ws: Workspace, classes: DataFrame | None, links: DataFrame, step: int) -> DataFrame:
    """(node, class) after the links (a, b): components of the graph of classes, in which many links of two are one."""
    if classes is None:
        return components(ws, links, f"merge{step}").withColumnRenamed("component", "class")
    of_a, of_b = (classes.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}")) for x in ("a", "b"))
    edges = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).distinct()
    merged = components(ws, edges, f"merge{step}").select(F.col("node").alias("class"), F.col("component"))
    known = classes.join(merged, "class", "left").select("node", F.coalesce("component", "class").alias("class"))
    # nodes that had no class of their own kind until now
    new = merged.select(F.col("class").alias("node"), F.col("component").alias("class")).join(classes.select("node"), "node", "left_anti")
    return known.union(new)


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, most_matches: int = 6, rounds: int = 3) -> DataFrame:
    """Classes of texts linked by a Jaccard similarity of ``percent`` or more of their ``n``-word shingles.

    ``docs`` has doc_id and text.  Rows: doc_id, n_shingles, class_id (of equal
    shingle sets, its smallest doc_id), component_id (smallest doc_id reachable
    by links).  Equal sets are put together first and stand as one.  Shingles
    are ordered by a frequency sketch of the whole corpus and by hash; a
    document's prefix holds its |set| - need + l rarest, l chosen by cost, and
    two linked documents share at least the smaller l of their prefixes
    (Wang, Li and Feng 2012).  Rounds of near candidates link the bulk of a
    group by a linear number of pairs; then every pair of different classes
    that the prefixes allow is verified, so no link is lost.  Texts without
    words, and null ones, stay alone, as do rows without a doc_id, which are
    left out of the result.  Equal rows are one document; of different texts
    under one doc_id only one, left to chance, is compared with others, though
    each has its row: doc_ids should be unique.
    """
    ws = Workspace(spark, "jaccard")
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    counts = spark.sparkContext.broadcast(sketch(spark, ws, docs.select("text"), n))
    described = ws.write(describe(docs, counts, n, percent, most_matches), "described")
    ws.drop("sketch")
    # sets found once need no partner; those found often are dealt out by row, so that a set of many rows is no task of its own
    by_set = described.filter("n_shingles > 0").groupBy("signature").agg(F.min("row_id").alias("node"), F.count("*").alias("rows")).filter("rows > 1")
    by_set = ws.write(by_set, "sets").select("signature", "node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = described.select("row_id", "n_shingles", "signature", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int").alias("salt"))
    members = ws.write(dealt.join(by_set, ["signature", "salt"], "left").select("row_id", "n_shingles", F.coalesce("node", "row_id").alias("node")), "members")
    one = members.filter("row_id = node AND n_shingles > 0").select(F.col("node"), F.col("row_id")).distinct()
    reps = ws.write(described.join(one, "row_id").dropDuplicates(["row_id"]), "reps")
    bits = ws.write(reps.select("node", *BITS), "bits")
    ws.drop("described")
    shared = ws.write(shared_postings(spark, postings(reps, percent)), "shared")
    ws.drop("reps")
    # (node, class) of the nodes in classes of two or more, and the postings of tokens that two classes have
    classes, left, last = None, ws.write(shared.join(bits, "node").withColumn("class", F.col("node")), "left0"), False
    ws.drop("shared")
    for step in range(rounds + 1):
        last = last or step == rounds
        pairs = ws.write(candidate_pairs(left, percent), "pairs") if last else contract(ws, left, percent, step)
        found = ws.write(verified(spark, docs, pairs, n, percent), f"links{step}")
        classes = ws.write(joined_classes(ws, classes, found, step), f"classes{step}")
        if last:
            break
        labelled = left.drop("class").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        left = ws.write(of_many_classes(ws.write(labelled, f"labelled{step}")), f"left{step + 1}")
        del labelled
        ws.drop(f"labelled{step}", f"left{step}")
        # a round that links next to nothing leaves the rest to the join
        last = 100 * found.count() < pairs.count()
    out = members.join(classes.withColumnRenamed("class", "component_id"), "node", "left")
    return out.select(F.col("row_id").alias("doc_id"), "n_shingles", F.col("node").alias("class_id"), F.coalesce("component_id", "node").alias("component_id"))
