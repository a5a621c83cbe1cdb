"""Operator 6: similarity join of word-shingle sets by rare-first prefix filtering, with length, positional and suffix filters.

A set's shingles are ordered rare first, by a fixed-width table of counts over all documents and then by hash. Two sets whose
Jaccard similarity reaches num/den share a shingle of both prefixes. Buckets of a prefix shingle are first joined with one
leader each (the member that has it earliest); what these links leave in different components is then joined in full,
so a group of near copies costs a few pairs per member while no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, parts, settle, slices, table, trimmed, utf8
from .components import connected_components
from .shingles import mix, shingle_sets, words_of

#: Counters of the rarity table. Any order gives the same links; a good one keeps common shingles out of prefixes.
SLOTS = 1 << 20
#: Slots of a worker's memory of sets that it has sent already.
SEEN = 1 << 18
#: Rows of one token that are held before they go out with their leader.
LONG = 1 << 16
#: Rows of a bucket that are compared with the rest of it at once.
BLOCK = 1024
#: Rows of a bucket that one task compares with each other; a larger bucket is cut into blocks, and each pair of blocks is a task's group.
BUCKET = 1 << 14
#: Pairs of one member that are verified in one group.
MEMBER = 256


def _sets(batch: pa.RecordBatch, spot: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number and hash of each shingle, set sizes, and a 64-bit name of each set."""
    b, at = utf8(batch.column(spot))
    doc, h = shingle_sets(b, at, k)
    n = np.bincount(doc, minlength=batch.num_rows).astype(np.int64)
    name = np.zeros(batch.num_rows, np.uint64)
    live = np.nonzero(n)[0]
    if len(live):
        begin = (np.cumsum(n) - n)[live]
        name[live] = mix(np.add.reduceat(h, begin) ^ mix(np.bitwise_xor.reduceat(h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29)), begin) + n[live].astype(np.uint64)))
    return doc, h, n, name.view(np.int64)


def parities(h: np.ndarray) -> bytes:
    """A bitmap of a set: the parity of its hashes by slot, with about as many slots as members."""
    slots = 1 << min(max(int(len(h) - 1).bit_length(), 6), 13)
    return np.packbits((np.bincount((h & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def difference_bound(x: bytes, y: bytes) -> int:
    """At least so many members are in one of two sets only; the larger bitmap is folded to the smaller."""
    a, b, n, m = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x) * 8, len(y) * 8
    while n > m:
        n //= 2
        a = (a >> n) ^ (a & (1 << n) - 1)
    while m > n:
        m //= 2
        b = (b >> m) ^ (b & (1 << m) - 1)
    return (a ^ b).bit_count()


def _heads(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row a document, and at the end one for each counter that stands out (slot, count)."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in slices(batches, "text"):
        _, h, n, name = _sets(batch, 1, k)
        bits = [parities(x) for x in np.split(h, np.cumsum(n)[:-1])]
        counts += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name), pa.array(n), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int64())], ["doc_id", "node", "n", "bits", "slot"])
    out = np.nonzero(counts > 4 * counts.mean() + 4)[0]
    yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64()), pa.array(counts[out]), pa.nulls(len(out), pa.binary()), pa.array(out)], ["doc_id", "node", "n", "bits", "slot"])


def needed(num: int, den: int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Least intersection of sets of sizes a and b that link: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SEEN, np.int64)
    for batch in slices(batches, "text"):
        doc, h, n, name = _sets(batch, 1, k)
        slot = name & (SEEN - 1)
        fresh = (n > 0) & (seen[slot] != name)
        fresh[np.setdiff1d(np.arange(len(name)), np.unique(name, return_index=True)[1])] = False
        seen[slot[fresh]] = name[fresh]
        keep = fresh[doc]
        doc, h = doc[keep], h[keep]
        order = np.lexsort((h, rank[(h & np.uint64(SLOTS - 1)).astype(np.int64)], doc))
        doc, h = doc[order], h[order]
        size = np.bincount(doc, minlength=len(n))
        pos = np.arange(len(h)) - (np.cumsum(size) - size)[doc]
        cut = pos <= n[doc] - -(-num * n[doc] // den)
        doc, h, pos = doc[cut], h[cut], pos[cut]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(name[doc]), pa.array(n[doc].astype(np.int32)), pa.array(pos.astype(np.int32))], ["token", "node", "n", "pos"])


def _star(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by token, pos, n, node. Postings of tokens that several sets share pass on, each with its token's leader."""
    names = ["token", "node", "n", "pos", "lead", "lead_n", "lead_pos"]
    carry: list[np.ndarray] | None = None
    lead: list[np.ndarray] | None = None  # the leader of a token whose first rows have gone out

    def follow(cols: list[np.ndarray], first: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols] + [pa.array(np.full(len(cols[0]), c[0], c.dtype)) for c in first[1:]], names)

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
        token = cols[0]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        group = np.cumsum(first) - 1
        shared = np.bincount(group)[group] > 1
        cols, first = [c[shared] for c in cols], first[shared]
        at = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols] + [pa.array(c[at]) for c in cols[1:]], names)

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if lead is not None and len(cols[0]):
            more = int(np.searchsorted(cols[0] != lead[0][0], True))
            if more:
                yield follow([c[:more] for c in cols], lead)
            if more < len(cols[0]):
                lead = None
            cols = [c[more:] for c in cols]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            carry = None
        token = cols[0]
        if not len(token):
            continue
        last = int(np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0][-1])
        if last:
            yield emit([c[:last] for c in cols])
        carry = [c[last:] for c in cols]
        if len(carry[0]) > LONG:
            lead, carry = carry, None
            yield follow(lead, lead)
            lead = [c[:1].copy() for c in lead]
    if carry is not None and len(carry[0]):
        yield emit(carry)


def _cross(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by token, pair of blocks, n: pairs of different components that the length and positional filters let pass.

    side: -1 and 1 for the two blocks of a pair, which are compared with each other only, 0 for a block with itself.
    """

    def pairs(node: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(node), BLOCK):
            end = int(np.searchsorted(n, n[min(i + BLOCK, len(node)) - 1] * den // num, "right"))  # length filter: n ascends
            for j in range(i, end, BLOCK):
                a, b = slice(i, min(i + BLOCK, len(node))), slice(j, min(j + BLOCK, end))
                most = 1 + np.minimum.outer(n[a] - pos[a], n[b] - pos[b]) - 1
                good = (comp[a][:, None] != comp[b][None, :]) & (most >= needed(num, den, n[a][:, None], n[b][None, :]))
                good &= np.arange(a.start, a.stop)[:, None] < np.arange(b.start, b.stop)[None, :]
                good &= (side[a][:, None] == 0) | (side[a][:, None] != side[b][None, :])
                x, y = np.nonzero(good)
                if len(x):
                    x, y = node[a][x], node[b][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    carry: list[np.ndarray] | None = None

    def edges(cols: list[np.ndarray]) -> np.ndarray:
        return np.nonzero(np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]))[0]

    def groups(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, _, node, n, pos, comp, side = cols
        edge = edges(cols).tolist() + [len(node)]
        for i, j in zip(edge, edge[1:], strict=False):
            if j - i > 1 and (comp[i:j] != comp[i]).any():
                yield from pairs(node[i:j], n[i:j].astype(np.int64), pos[i:j].astype(np.int64), comp[i:j], side[i:j])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(edges(cols)[-1])
        if last:
            yield from groups([c[:last] for c in cols])
        carry = [c[last:] for c in cols]
    if carry is not None and len(carry[0]):
        yield from groups(carry)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """Upper bound of the intersection of two ordered sets, by splitting both at the middle of y."""
    if not len(x) or not len(y):
        return 0
    if not depth:
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    hit = at < len(x) and x[at] == y[middle]
    return suffix_bound(x[:at], y[:middle], depth - 1) + hit + suffix_bound(x[at + hit :], y[middle + 1 :], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    least = needed(num, den, len(x), len(y))
    if suffix_bound(x, y) < least:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= least


def _named(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Texts with the names of their sets."""
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(_sets(batch, 0, k)[3]), batch.column(0)], ["node", "text"])


def shingles_of(text: str, k: int) -> set[tuple[str, ...]]:
    """The set itself, of words and not of hashes."""
    words = words_of(text)
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} - {()}


def _verify(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, text of b), sorted by a and part, with a's own text first: b is null there.

    Pairs that the suffix filter lets pass on hashes are verified on the words themselves.
    """
    own, mine, key = None, None, None
    for whole in batches:
        for batch in slices(iter([whole]), "text"):
            _, hashes, n, _ = _sets(batch, 3, k)
            sets = np.split(hashes, np.cumsum(n)[:-1])
            out = []
            for i, (a, part, b, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if b is None:
                    own, mine, key = sets[i], text, (a, part)
                elif (a, part) == key and linked(own, sets[i], num, den):
                    if isinstance(mine, str):
                        mine = shingles_of(mine, k)
                    other = shingles_of(text, k)
                    if den * len(mine & other) >= num * len(mine | other):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def _sift(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and bitmaps allow a link."""
    for batch in batches:
        a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
        good = [difference_bound(p, q) <= i + j - 2 * needed(num, den, i, j) for i, j, p, q in zip(n, m, x, y, strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sifted(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """A filter without false negatives before whole sets move: symmetric differences are bounded below by bitmaps."""
    one, two = (reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return settle(rows.mapInArrow(lambda x: trimmed(_sift(x, num, den)), "a bigint, b bigint"))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link; each is verified once, on whole texts. Rows are dealt by a and, where it has very many pairs, by parts of them."""
    spark = pairs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = settle(reps.join(nodes, "node", "left_semi").select("doc_id").distinct())
    rows = lookup_join(docs, wanted, ["doc_id"], "inner").select("text").mapInArrow(lambda b: trimmed(_named(b, k)), "node bigint, text string")
    texts = settle(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    busy = settle(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBER).cast("int").alias("parts")))
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1))).cast("int")
    many = busy.filter("parts > 1")
    own = texts.join(busy, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "text")
    other = lookup_join(pairs, many, ["a"]).select("a", part("b").alias("part"), "b").join(texts, F.col("b") == F.col("node")).select("a", "part", "b", "text")
    dealt = own.unionByName(other).repartition(parts(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return settle(dealt.mapInArrow(lambda x: trimmed(_verify(x, k, num, den)), "a bigint, b bigint"))


def similar_sets(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: components of documents whose k-word shingle sets have Jaccard similarity num/den or more.

    Documents without words or text have n_shingles 0 and stand alone; documents of fewer than k words have one shingle.
    Equal sets are one vertex, so copies cost nothing in the join. A null doc_id links with nothing and has a null component. Rows
    that repeat a doc_id are separate documents that share the id's component. An empty table gives no rows; further columns are not read.
    Equal sets are told by a 64-bit name; a link between different ones is verified on the words themselves.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = settle(texts.mapInArrow(lambda b: trimmed(_heads(b, k)), "doc_id bigint, node bigint, n bigint, bits binary, slot bigint"))
    heads = made.filter("slot is null").drop("slot")
    counts = made.filter("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most SLOTS rows
    rank = np.zeros(SLOTS, np.uint32)
    rank[counts["slot"].to_numpy()] = np.minimum(counts["n"].to_numpy(), 2**32 - 1)
    shared = spark.sparkContext.broadcast(rank)
    reps = heads.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    reps = settle(reps)

    known = texts.filter("doc_id is not null")
    postings = known.mapInArrow(lambda b: trimmed(_prefixes(b, k, num, den, shared.value)), "token bigint, node bigint, n int, pos int")
    dealt = postings.repartition(parts(spark), "token").sortWithinPartitions("token", "pos", "n", "node")
    starred = settle(dealt.mapInArrow(lambda b: trimmed(_star(b, num, den)), "token bigint, node bigint, n int, pos int, lead bigint, lead_n int, lead_pos int"))
    need = F.ceil(F.lit(num) * (F.col("n") + F.col("lead_n")) / (num + den))
    room = F.least(F.col("n") - F.col("pos"), F.col("lead_n") - F.col("lead_pos"))
    first = starred.filter("node <> lead").filter(room >= need).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    links = _verified(_sifted(first.distinct(), reps, num, den), known, reps, k, num, den)

    comps = settle(connected_components(links))
    bucket = starred.select("token", "node", "n", "pos").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    split = bucket.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).filter("x <> y")
    split = settle(split.select("token", F.ceil(F.col("rows") / BUCKET).cast("int").alias("blocks")))
    rest = lookup_join(bucket.select("token", "node", "n", "pos", "comp").distinct(), split, ["token"], "inner")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumn("pair", F.least("own", "with") * F.col("blocks") + F.greatest("own", "with")).withColumn("side", F.signum(F.col("own") - F.col("with")).cast("int"))
    rest = rest.select("token", "pair", "node", "n", "pos", "comp", "side").repartition(parts(spark), "token", "pair").sortWithinPartitions("token", "pair", "n", "node")
    open_pairs = rest.mapInArrow(lambda b: trimmed(_cross(b, num, den)), "a bigint, b bigint").distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verified(_sifted(open_pairs.join(tried, ["a", "b"], "left_anti"), reps, num, den), known, reps, k, num, den)

    named = links.unionByName(more)
    x, y = reps.select(F.col("node").alias("a"), F.col("doc_id").alias("x")), reps.select(F.col("node").alias("b"), F.col("doc_id").alias("y"))
    copies = heads.filter("n > 0 and doc_id is not null").select("node", "doc_id").join(reps.select("node", F.col("doc_id").alias("y")), "node").select(F.col("doc_id").alias("x"), "y").filter("x <> y")
    edges = named.join(x, "a").join(y, "b").select("x", "y").unionByName(copies)
    comps = connected_components(edges).withColumnRenamed("node", "doc_id")
    return heads.join(comps, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
