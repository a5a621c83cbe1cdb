"""Operator 7: removal of repeated passages, by merging the Burrows-Wheeler transforms of shards.

Any two equal windows of `length` bytes hold the same anchor at the same place: the anchor-long string of the least hash in them.
So a text falls into segments, one for each anchor and the window starts that choose it, and only segments of equal
anchors can share a window. Equal segments are counted; different segments of one anchor are gathered in collections, whose shards
are suffix-sorted apart and merged: the interleave of their transforms is refined symbol by symbol (a symbol being several
bytes), blocks of suffixes with a common prefix split on the way, and the blocks left after `length` bytes are the repeated intervals.

An anchor with more segments than one part of a collection holds is split by the bytes beside it, again and again: the windows that have
the anchor at the same range of places also share the bytes that all of them cover, so segments that differ there are kept apart.
Hashes only bring candidates together; what is repeated is decided on bytes.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup_join, parts, settle, slices, table, trimmed, utf8
from .shingles import prefix_sums, span_hash

#: Bytes of an anchor, and of a passage that may not stay when it occurs twice.
ANCHOR, LENGTH = 32, 200
#: Bits an anchor in the two filters that spare the second scan most of its rows (no false negatives), and bits of a filter at
#: most, as it is sent to every executor. More anchors than that are looked up by a join instead.
ANCHOR_BITS, MOST_BITS = 8, 28
#: Bits of one row of a filter on its way to the driver.
FILTER_ROW = 16
#: Bytes of a collection that is merged at once, and of one of its shards.
COLLECTION, SHARD = 1 << 18, 1 << 16
#: Different segments of one key that are merged as one part; a key with more is split by the bytes beside its anchor.
GROUP = 1500
#: Bytes of text that are cut into segments at once; a longer text goes piece by piece.
PIECE = 1 << 18
#: Slots of a worker's memory of segments whose content it has sent.
SENT = 1 << 18


def segments(b: np.ndarray, at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, first window start in it, number of starts, anchor hash, anchor's place from that start, first byte, byte after) of every segment."""
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(b) < length:
        return none
    sums = prefix_sums(b)
    spots = np.arange(len(b) - anchor + 1)
    h = span_hash(sums, spots, spots + anchor)
    width = length - anchor + 1
    value = (h >> np.uint64(34) << np.uint64(34)) | spots.astype(np.uint64)
    pad = -len(value) % width
    grid = np.append(value, np.full(pad, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n = np.maximum(np.diff(at) - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    if not len(doc):
        return none
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + at[doc]
    chosen = (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64((1 << 34) - 1)).astype(np.int64)
    edge = np.ones(len(doc), bool)
    edge[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.nonzero(edge)[0]
    count = np.diff(np.append(first, len(doc)))
    a, z = start[first], start[first] + count + length - 1
    return doc[first], a - at[doc[first]], count, h[chosen[first]].view(np.int64), chosen[first] - a, a, z


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, first byte) of slices of about PIECE bytes; a longer text comes in pieces that overlap by a window less one byte."""
    for batch in slices(batches, "text", PIECE):
        b, at = utf8(batch.column(batch.schema.get_field_index("text")))
        if batch.num_rows > 1 or len(b) <= PIECE + length:
            yield batch, b, at, 0
        else:
            for i in range(0, len(b) - length + 1, PIECE):
                part = b[i : i + PIECE + length - 1]
                yield batch, part, np.array([0, len(part)]), i


def names(raw: bytes, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit names of spans by their content."""
    name = xxhash.xxh3_64_intdigest
    return np.fromiter((name(raw[i:j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)


def _dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique(first * np.int64(int(second.max()) + 1) + second, return_inverse=True)[1]


def gram_ranks(text: np.ndarray, size: int) -> np.ndarray:
    """For each place the rank of the size bytes from there on, counted round at the end: one wide symbol for them."""
    now = min(size, 8)
    ring = np.concatenate([text, text[: now - 1]]) if now > 1 else text
    packed = np.zeros(len(text), np.uint64)
    for k in range(now):
        packed = packed << np.uint64(8) | ring[k : k + len(text)]
    rank = np.unique(packed, return_inverse=True)[1]
    while now < size:
        step = min(now, size - now)
        rank, now = _dense(rank, np.roll(rank, -step)), now + step
    return rank


def suffix_order(symbols: np.ndarray, wide: int, length: int) -> np.ndarray:
    """Places of a shard in the order of their first `length` bytes, by prefix doubling over wide symbols."""
    rank, now = symbols, wide
    while now < length:
        step = min(now, length - now)
        rank, now = _dense(rank, np.roll(rank, -step)), now + step
    return np.argsort(rank, kind="stable")


def _by_symbol(symbol: np.ndarray) -> np.ndarray:
    """A stable order by symbols below 2 ** 32: two passes of a counting sort."""
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    high = (symbol >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def merge_blocks(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, place in it, block) of all suffixes of a collection, in the order of their first `length` bytes.

    The shards' transforms are merged by refining their interleave: each round deals the shard numbers out by the symbol before
    each suffix, stably, so that the order holds one symbol more. A block is a run of suffixes whose first symbols agree. A
    symbol stands for as many bytes as divide the length, 40 at most, so that a few rounds do. A shard is read round at its end; what
    crosses an end mark is of no use to the caller.
    """
    wide = max(w for w in range(1, 41) if length % w == 0)
    # ranks of the wide symbols hold for all shards; each shard's ring is closed by itself
    rings = [np.concatenate([s, np.resize(s, wide - 1)]) for s in shards]
    starts = np.cumsum([0, *(len(r) for r in rings)])
    everything = gram_ranks(np.concatenate(rings), wide)
    symbols = [everything[i : i + len(s)] for i, s in zip(starts, shards, strict=False)]
    arrays = [suffix_order(x, wide, length) for x in symbols]
    transform = np.concatenate([x[a - wide] if len(x) >= wide else x[(a - wide) % len(x)] for x, a in zip(symbols, arrays, strict=True)]).astype(np.int32)
    sizes = [len(s) for s in shards]
    total = sum(sizes)
    which = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    block = np.zeros(total, np.int32)
    symbol = np.empty(total, np.int32)
    for _ in range(length // wide):
        symbol[np.argsort(which, kind="stable")] = transform
        order = _by_symbol(symbol)
        which, block, dealt = which[order], block[order], symbol[order]
        edge = np.empty(total, bool)
        edge[0] = False
        np.not_equal(block[1:], block[:-1], out=edge[1:])
        edge[1:] |= dealt[1:] != dealt[:-1]
        block = np.cumsum(edge, dtype=np.int32)
    place = np.empty(total, np.int64)
    place[np.argsort(which, kind="stable")] = np.concatenate(arrays)
    return which, place, block


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of its length-byte windows that occur at another start of the collection."""
    shards: list[np.ndarray] = []
    owner: list[list[tuple[int, int]]] = []  # by shard: text and its first place
    held: list[bytes] = []
    size, mine = 0, []
    for i, t in enumerate(texts):
        mine.append((i, size))
        held += [t, b"\xff"]  # an end mark that UTF-8 lacks
        size += len(t) + 1
        if size >= SHARD or i == len(texts) - 1:
            shards.append(np.frombuffer(b"".join(held), np.uint8))
            owner.append(mine)
            held, mine, size = [], [], 0
    which, place, block = merge_blocks(shards, length)
    many = np.bincount(block)[block] > 1
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for s, mine in enumerate(owner):
        spots = np.sort(place[many & (which == s)])
        for i, first in mine:
            a, z = np.searchsorted(spots, (first, first + len(texts[i]) - length + 1))
            out[i] = spots[a:z] - first
    return out


def intervals(starts: np.ndarray) -> bytes:
    """Runs of consecutive starts as pairs (first, last + 1) of little-endian 32-bit numbers."""
    if not len(starts):
        return b""
    edge = np.nonzero(np.diff(starts, prepend=starts[0] - 2) != 1)[0]
    return np.stack([starts[edge], starts[np.append(edge[1:], len(starts)) - 1] + 1], 1).astype("<i4").tobytes()


def _anchors(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for _, b, at, _ in pieces(batches, length):
        _, _, _, a, _, first, stop = segments(b, at, length, anchor)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(names(b.tobytes(), first, stop))], ["anchor", "seg"])


def _occurrences(batches: Iterator[pa.RecordBatch], length: int, anchor: int, repeated: np.ndarray | None, varied: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Segments whose anchor may occur twice; content goes along where the anchor may have several, mostly once a worker. Without filters: all, and no content."""
    sent = np.zeros(SENT, np.int64)
    for batch, b, at, base in pieces(batches, length):
        doc, start, count, a, spot, first, stop = segments(b, at, length, anchor)
        if repeated is not None:
            keep = np.nonzero(_has(repeated, a))[0]
            doc, start, count, a, spot, first, stop = (x[keep] for x in (doc, start, count, a, spot, first, stop))
        raw = b.tobytes()
        s = names(raw, first, stop)
        content: list[bytes | None] = [None] * len(doc)
        if varied is not None:
            name, slot = a ^ s, s & (SENT - 1)
            new = _has(varied, a) & (sent[slot] != name)
            sent[slot[new]] = name[new]
            for i in np.nonzero(new)[0].tolist():
                content[i] = raw[first[i] : stop[i]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(s), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(start + base), pa.array(count), pa.array(spot), pa.array(content, pa.binary())], ["anchor", "seg", "k1", "k2", "start", "count", "spot", "content"])


def _has(words: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    slot = anchors & (len(words) * 64 - 1)
    return (words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)) == 1


def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, anchor, seg, copies, off, spot, crowd, content), sorted by key: found starts by segment, and crowded rows as they are."""
    held: list[tuple[int, int, int, int, bytes]] = []  # a collection: whole groups
    group: list[tuple[int, int, int, int, bytes]] = []
    size, now = 0, None
    out: list[tuple] = []

    def flush_out() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["anchor", "seg", "found", "spot", "content"])

    def solve() -> None:
        nonlocal size
        for (a, s, copies, off, _), starts in zip(held, repeated_starts([t for *_, t in held], length) if held else [], strict=True):
            if copies < 2 and len(starts):
                out.append((a, s, intervals(starts + off), None, None))
        held.clear()
        size = 0

    def close() -> None:
        nonlocal size
        if len(group) > 1:
            held.extend(group)
            size += sum(len(t) for *_, t in group)
        group.clear()

    for batch in batches:
        for key, a, s, copies, off, spot, crowd, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if copies > 1:
                out.append((a, s, np.array([off, off + (spot[1] if content is None else len(content) - length + 1)], "<i4").tobytes(), None, None))
            if content is None:
                continue
            if crowd:
                out.append((a, s, None, spot[0], content))
                continue
            if key != now:
                close()
                now = key
                if size >= COLLECTION:
                    solve()
            group.append((a, s, copies, off, content))
        if len(out) > 20_000:
            yield flush_out()
    close()
    solve()
    yield flush_out()


def _filter_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor), all of a filter row in one task: the filter's rows as bytes."""
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        slot = batch.column(0).to_numpy() & ((1 << bits) - 1)
        for row in np.unique(slot >> FILTER_ROW).tolist():
            here = np.bincount(slot[slot >> FILTER_ROW == row] & ((1 << FILTER_ROW) - 1), minlength=1 << FILTER_ROW) > 0
            rows[row] = np.packbits(here, bitorder="little") | rows.get(row, np.uint8(0))
    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], ["row", "bits"])


def _filter(anchors: DataFrame, bits: int) -> np.ndarray:
    """A bit for each anchor's low bits (its high ones are small by choice); at most 2 ** MOST_BITS bits reach the driver."""
    row = F.shiftright(F.col("anchor").bitwiseAND((1 << bits) - 1), FILTER_ROW)
    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, (1 << FILTER_ROW) // 8)
    for r in anchors.select("anchor").repartition(parts(anchors.sparkSession), row).mapInArrow(lambda b: _filter_rows(b, bits), "row bigint, bits binary").collect():
        out[r.row] = np.frombuffer(r.bits, np.uint8)
    return out.ravel().view(np.uint64)


def _looked_up(texts: DataFrame, found: DataFrame, length: int, anchor: int) -> DataFrame:
    """What _occurrences gives with filters, by joins: segments of repeated anchors, and content of one place each where an anchor has several."""
    plain = "anchor bigint, seg bigint, k1 bigint, k2 bigint, start bigint, count bigint, spot bigint, content binary"
    every = texts.mapInArrow(lambda b: _occurrences(b, length, anchor, None, None), plain).drop("content")
    known = settle(every.join(found.select("anchor", (F.col("kinds") > 1).alias("varied")), "anchor"))
    place = F.struct("k1", "k2", "start", "count", "spot")
    one = known.filter("varied").groupBy("anchor", "seg").agg(F.min(place).alias("p")).select("anchor", "seg", "p.*")
    wanted = one.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "seg", "start", "count", "spot")).alias("wanted"))
    whole = texts.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    cut = whole.withColumn("w", F.explode("wanted")).select("w.*", F.expr(f"substring(cast(text as binary), cast(w.start as int) + 1, cast(w.count as int) + {length - 1})").alias("content"))
    none = lambda t: F.lit(None).cast(t)
    return known.select("anchor", "seg", "k1", "k2", "start", "count", "spot", none("binary").alias("content")).unionByName(cut.select("anchor", "seg", none("bigint").alias("k1"), none("bigint").alias("k2"), none("bigint").alias("start"), "count", "spot", "content"))


def _ranges(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, lo, hi, least and greatest of all that stands left of the anchor, read backwards, and from it on, both as hexadecimals).

    Emits key, the places [x, y] of the anchor for which all segments share the window, if any, and up to four ranges of the other places.
    """
    for batch in batches:
        out = []
        for key, lo, hi, l0, l1, r0, r1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            left, right = (len(os.path.commonprefix([p, q])) // 2 for p, q in ((l0, l1), (r0, r1)))
            x, y = max(lo, length - right), min(hi, left)
            rest = [(lo, x - 1), (y + 1, hi)] if x <= y else [(lo, hi)]
            rest = [r for i, j in rest if i <= j for r in ((i, (i + j) // 2), ((i + j) // 2 + 1, j)) if r[0] <= r[1]]
            out.append((key, *((x, y) if x <= y else (None, None)), [i for i, _ in rest], [j for _, j in rest]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)], ["key", "x", "y", "los", "his"])


def _pair(first: F.Column, stop: F.Column) -> F.Column:
    """One interval as _cut reads it."""
    little = lambda c: F.reverse(F.array(*[F.substring(F.lpad(F.hex(c), 8, "0"), i, 2) for i in (1, 3, 5, 7)]))
    return F.unhex(F.concat(F.array_join(little(first), ""), F.array_join(little(stop), "")))


def _split(crowd: DataFrame, length: int, group: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(marks, parts that can be merged, rows that are still crowded) of crowded keys (key, lo, hi, at, off, content, anchor, seg).

    lo to hi are the places of the anchor in the windows in question. A key's segments are told apart by the bytes that all windows of a range of
    places cover; equal contents are one row with a count, and marked whole.
    """
    left = F.expr("reverse(hex(substring(content, 1, cast(at as int))))")
    right = F.expr("hex(substring(content, cast(at as int) + 1))")
    ends = crowd.groupBy("key", "lo", "hi").agg(F.min(left), F.max(left), F.min(right), F.max(right))
    ranges = settle(ends.mapInArrow(lambda b: _ranges(b, length), "key bigint, x bigint, y bigint, los array<bigint>, his array<bigint>"))
    rows = settle(lookup_join(crowd, ranges, ["key"], "inner"))
    marks = [rows.filter("x is not null").select("anchor", "seg", _pair(F.col("off") + F.col("at") - F.col("y"), F.col("off") + F.col("at") - F.col("x") + 1).alias("found"))]
    kids = None
    for i in range(4):
        lo, hi = F.expr(f"get(los, {i})"), F.expr(f"get(his, {i})")
        kid = rows.filter(hi.isNotNull()).withColumns({"lo": lo, "hi": hi}).withColumns({"s0": F.expr("greatest(0L, at - hi)"), "s1": F.expr(f"least(length(content) - {length}L, at - lo)")}).filter("s0 <= s1")
        core = F.expr(f"substring(content, cast(at - lo as int) + 1, cast({length} - hi + lo as int))")
        kid = kid.select(F.xxhash64("lo", "hi", core).alias("key"), "lo", "hi", (F.col("at") - F.col("s0")).alias("at"), (F.col("off") + F.col("s0")).alias("off"), F.expr(f"substring(content, cast(s0 as int) + 1, cast(s1 - s0 as int) + {length})").alias("content"), "anchor", "seg")
        kids = kid if kids is None else kids.unionByName(kid)
    kids = settle(kids)
    same = settle(kids.groupBy("key", "lo", "hi", "content").agg(F.count("*").alias("copies"), F.min(F.struct("anchor", "seg", "off", "at")).alias("one")))
    keys = settle(same.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("copies").alias("n")).filter("n > 1").select("key", "kinds"))
    twice = same.filter("copies > 1").select("key", "content")
    marks.append(kids.join(twice, ["key", "content"], "left_semi").select("anchor", "seg", _pair(F.col("off"), F.col("off") + F.length("content") - length + 1).alias("found")))
    several = same.join(keys.filter("kinds > 1"), "key").select("key", "lo", "hi", "content", "copies", "one.*", "kinds")
    small = several.filter((F.col("kinds") <= group) | (F.col("lo") == F.col("hi")))
    more = keys.filter(F.col("kinds") > group).limit(1).count()
    return marks[0].unionByName(marks[1]), small, several.filter((F.col("kinds") > group) & (F.col("lo") < F.col("hi"))).drop("kinds", "copies") if more else None


#: The column of found starts while texts are cut.
MARKS = "__marks"


def _cut(batches: Iterator[pa.RecordBatch], length: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Remove covered bytes; MARKS: found starts by segment start."""
    for batch in batches:
        text, marks = (batch.column(batch.schema.get_field_index(x)) for x in ("text", MARKS))
        rows, texts = [], []
        for t, m in zip(text, marks, strict=True):
            raw = (t.as_py() or "").encode()
            spans = []
            for x in m.as_py() or ():
                spans.append(np.frombuffer(x["found"], "<i4").reshape(-1, 2).astype(np.int64) + x["start"])
            kept, removed, n = raw, 0, 0
            if spans:
                s = np.concatenate(spans)
                s = s[np.argsort(s[:, 0])]
                first, last = s[:, 0], np.maximum.accumulate(s[:, 1] + length - 1)
                new = np.concatenate([[True], first[1:] > last[:-1]])
                begin, end = first[new], last[np.append(np.nonzero(new)[0][1:], len(s)) - 1]
                pieces, at = [], 0
                for i, j in zip(begin.tolist(), end.tolist(), strict=True):
                    pieces.append(raw[at:i])
                    at = j
                kept = b"".join([*pieces, raw[at:]])
                removed, n = len(raw) - len(kept), len(begin)
            rows.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest()))
            if keep_text:
                texts.append(kept.decode("utf-8", "ignore") if removed else t.as_py())
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, types, strict=True)]
        kept_names = [x for x in batch.schema.names if x != MARKS]
        own = [pa.array(texts, pa.string()) if keep_text and x == "text" else batch.column(batch.schema.get_field_index(x)) for x in kept_names]
        yield pa.RecordBatch.from_arrays([*own, *cols], [*kept_names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256; with keep_text the text is what is left (without cut characters).

    Each byte that a length-byte string covers which also starts anywhere else, in the same document or another, goes; strings
    are judged on the input and never cross documents. Null texts are empty; texts below length bytes lose nothing. Repeated
    rows and copies of length bytes or more lose everything, whatever their ids. An empty table gives no rows. Columns of docs that already have
    one of the new names are dropped; others stay, whatever their names. Texts of any length go through in pieces.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256")
    body = F.coalesce("text", F.lit(""))
    k1, k2 = F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")
    texts = docs.filter(F.octet_length("text") >= length).select(k1, k2, "text")
    seen = texts.select("text").mapInArrow(lambda b: trimmed(_anchors(b, length, anchor)), "anchor bigint, seg bigint")
    kinds = seen.groupBy("anchor", "seg").agg(F.count("*").alias("copies"))
    found = settle(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("n")).filter("n > 1").select("anchor", "kinds"))
    several = found.filter("kinds > 1")
    counts = found.agg(F.count("*"), F.count_if(F.col("kinds") > 1), F.count_if(F.col("kinds") > GROUP)).first()
    bits = max(FILTER_ROW, (ANCHOR_BITS * counts[0]).bit_length())
    if bits <= MOST_BITS:
        repeated, varied = (spark.sparkContext.broadcast(_filter(x, max(FILTER_ROW, (ANCHOR_BITS * n).bit_length()))) for x, n in ((found, counts[0]), (several, counts[1])))
        occurs = texts.mapInArrow(lambda b: trimmed(_occurrences(b, length, anchor, repeated.value, varied.value)), "anchor bigint, seg bigint, k1 bigint, k2 bigint, start bigint, count bigint, spot bigint, content binary")
    else:
        occurs = _looked_up(texts, found, length, anchor)
    occurs = settle(occurs)
    counted = occurs.groupBy("anchor", "seg").agg(F.count("k1").alias("copies"), F.first(F.array("spot", "count")).alias("spot"), F.first("content", ignorenulls=True).alias("content")).filter("copies > 1 or content is not null")
    crowded = found.filter(F.col("kinds") > GROUP).select("anchor", F.lit(True).alias("crowd"))
    counted = lookup_join(counted, crowded, ["anchor"], rows=counts[2]) if counts[2] else counted.withColumn("crowd", F.lit(False))
    merging = lambda rows: rows.mapInArrow(lambda b: trimmed(_merge(b, length)), "anchor bigint, seg bigint, found binary, spot bigint, content binary")
    columns = ["key", "anchor", "seg", "copies", "off", "spot", "crowd", "content"]
    dealt = counted.select(F.when(F.col("crowd"), F.col("seg")).otherwise(F.col("anchor")).alias("key"), "anchor", "seg", "copies", F.lit(0).cast("bigint").alias("off"), "spot", F.coalesce("crowd", F.lit(False)).alias("crowd"), "content").repartition(parts(spark), "key").sortWithinPartitions("key", "seg")
    merged = settle(merging(dealt))
    marks, left, small = [merged.filter("found is not null").select("anchor", "seg", "found")], None, []
    if counts[2]:
        number = lambda n: F.lit(n).cast("bigint")
        left = merged.filter("content is not null").select(F.col("anchor").alias("key"), number(0).alias("lo"), number(length - anchor).alias("hi"), F.col("spot").alias("at"), number(0).alias("off"), "content", "anchor", "seg")
    while left is not None:
        whole, some, left = _split(left, length, GROUP)
        marks.append(whole)
        small.append(some.select("key", "anchor", "seg", "copies", "off", F.array("at").alias("spot"), F.lit(False).alias("crowd"), "content"))
    if small:
        rest = small[0]
        for x in small[1:]:
            rest = rest.unionByName(x)
        marks.append(merging(rest.select(columns).repartition(parts(spark), "key").sortWithinPartitions("key", "content")).filter("found is not null").select("anchor", "seg", "found"))
    every = marks[0]
    for x in marks[1:]:
        every = every.unionByName(x)
    places = occurs.filter("k1 is not null").select("anchor", "seg", "k1", "k2", "start").distinct()
    by_text = places.join(every, ["anchor", "seg"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "found")).alias(MARKS))
    joined = docs.withColumns({"__k1": k1, "__k2": k2}).join(by_text, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left").select(*(docs[x] for x in docs.columns), MARKS)
    more = [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    return joined.mapInArrow(lambda b: _cut(b, length, keep_text), T.StructType(docs.schema.fields + more))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
