"""Operator 4: pack token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, table, trimmed

#: Documents that one packing group gets on average; groups are dealt by a hash of the row's place.
GROUP_DOCS = 1500
#: Distinct words whose ids a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 100_000, 40


#: Words of these characters only are split here: printable ASCII and the letters of Latin-1 and Latin Extended-A.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
#: The tokenizer's own split, for those characters after lower-casing; a line feed ends a word.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017f]+|[0-9]|[^\sa-z0-9\u00c0-\u017f]+|\n")

#: Texts of these characters only are split by arrays of their bytes.
LATIN = re.compile("[\\0-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[97:123] = CLASS[128:] = LETTER
CLASS[48:58] = DIGIT
#: Slots of the table by hash, and ids it may hold before it is emptied.
SLOT_BITS, STORE_IDS = 19, 1 << 21


class WordEncoder:
    """Ids of a byte-level BPE tokenizer with word ends, lower-casing, whose pre-tokens never hold a space or line feed.

    Words between spaces and line feeds are encoded once and remembered. A new word of plain characters is split
    into pre-tokens here and merged by tiktoken: the vocabulary numbers its merges in order, so ids are ranks, with
    a byte that UTF-8 lacks as the word end. Any other word goes to the tokenizer itself.
    """

    END = b"\xff"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ends = {k: k.endswith("</w>") and len(k) > 4 for k in vocab}
        ranks = {bytes(byte[c] for c in (k[:-4] if ends[k] else k)) + self.END * ends[k]: v for k, v in vocab.items()}
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        rng = np.random.default_rng(5)
        self.salt = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0xD1342543DE82EF95
        self.power = np.array([1, base], np.uint64)
        self.inverse = np.array([1, pow(base, -1, 1 << 64)], np.uint64)
        self.forget()

    def forget(self) -> None:
        """Drop all that is remembered of words; the vocabulary stays."""
        self._reset()
        self.power, self.inverse = self.power[:2], self.inverse[:2]
        self.keys, self.at, self.n = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int32)
        self.store, self.top = np.zeros(1 << 18, np.int32), 0

    def _reset(self) -> None:
        self.words: dict[str, int] = {"": 0}
        self.flat, self.used, self.known = np.zeros(1 << 18, np.int32), 0, 1
        self.start, self.length = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int64)
        self.tokens: dict[str, list[int]] = {}

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(words), len(ids)
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + m] = ids
        self.start[self.known : self.known + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.known : self.known + n] = lengths
        self.words.update(zip(words, range(self.known, self.known + n), strict=True))
        self.used, self.known = self.used + m, self.known + n

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if PLAIN.fullmatch(w) and "<|" not in w]
        if plain:
            tokens = self.tokens
            if len(tokens) > CACHE_WORDS:
                tokens.clear()
            got = SPLIT.findall("\n".join(plain).lower() + "\n")
            for t in set(got).difference(tokens):
                tokens[t] = self.merge(t.encode() + self.END) if t != "\n" else [-1]
            ids = np.fromiter(chain.from_iterable(map(tokens.__getitem__, got)), np.int32)
            ends = np.nonzero(ids < 0)[0]
            self._keep(plain, ids[ids >= 0], np.diff(ends, prepend=-1) - 1)
        other = list(set(new).difference(plain)) if len(plain) < len(new) else []
        for i in range(0, len(other), 10_000):
            some = other[i : i + 10_000]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._keep(some, np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids]))

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of any texts, and how many each has."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        seen = set().union(*split)
        new = seen.difference(self.words)
        if self.known + len(new) > CACHE_WORDS and self.known > 1:
            self._reset()
            new = seen.difference(self.words)
        self._learn(list(new))
        words = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64)
        ids, n = _ragged(self.flat, self.start[words], self.length[words]), self.length[words]
        for word in new:
            if len(word) > CACHE_CHARS:
                del self.words[word]
        return ids, np.add.reduceat(n, np.cumsum([0] + [len(s) for s in split[:-1]]))

    def _latin(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that LATIN matches, by arrays: byte classes, pre-token spans, and a table by the span's hash."""
        low = [t.lower().encode() for t in texts]
        b = np.frombuffer(b"\n".join([*low, b""]), np.uint8)
        kind = CLASS[b]
        edge = np.empty(len(b), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == DIGIT
        bounds = np.nonzero(edge)[0]
        start, stop = bounds, np.append(bounds[1:], len(b))
        sort = kind[start]
        # a lone apostrophe takes the ending that follows it
        lone = np.nonzero((b[start[:-1]] == 39) & (stop[:-1] - start[:-1] == 1) & (sort[1:] == LETTER))[0]
        if len(lone):
            at = start[lone] + 1
            one, two = b[at], b[np.minimum(at + 1, len(b) - 1)]
            take = np.isin(one, (115, 116, 109, 100)).astype(np.int64)
            pair = one.astype(np.int64) << 8 | two
            take = np.where((take == 0) & np.isin(pair, (0x7265, 0x7665, 0x6C6C)), 2, take)
            start, stop = start.copy(), stop.copy()
            stop[lone] += take
            start[lone + 1] += take
        real = (sort != SPACE) & (stop > start)
        start, stop = start[real], stop[real]
        size = stop - start
        while len(b) >= len(self.power):
            self.power, self.inverse = (np.concatenate([x, x * (x[-1:] * x[1:2])]) for x in (self.power, self.inverse))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.salt[b] * self.inverse[: len(b)], out=sums[1:])
        h = (sums[stop] - sums[start]) * self.power[stop]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = (self.keys[slot] == h) & (size <= CACHE_CHARS)
        first, length = self.at[slot], self.n[slot]
        miss = np.nonzero(~hit)[0]
        if len(miss):
            if self.top > STORE_IDS:
                self.keys[:] = 0
                self.top = 0
                hit[:] = False
                miss = np.arange(len(h))
            key = np.where(size[miss] <= CACHE_CHARS, h[miss], h[miss] + miss.astype(np.uint64))  # long spans are not matched by hash
            _, pick, back = np.unique(key, return_index=True, return_inverse=True)
            raw, merge, end = b.tobytes(), self.merge, self.END
            got = [merge(raw[i:j] + end) for i, j in zip(start[miss[pick]].tolist(), stop[miss[pick]].tolist(), strict=True)]
            n = np.fromiter(map(len, got), np.int32, len(got))
            ids = np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))
            while self.top + len(ids) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            self.store[self.top : self.top + len(ids)] = ids
            new = self.top + np.cumsum(n, dtype=np.int64) - n
            self.top += len(ids)
            first[miss], length[miss] = new[back], n[back]
            where, one = np.unique(slot[miss[pick]], return_index=True)  # of keys that share a slot one stays
            keep = size[miss[pick]][one] <= CACHE_CHARS
            where, one = where[keep], one[keep]
            self.keys[where], self.at[where], self.n[where] = h[miss[pick]][one], new[one], n[one]
        ids = _ragged(self.store, first, length.astype(np.int64))
        total = np.concatenate([[0], np.cumsum(length)])
        cut = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in low]))
        return ids, np.diff(total[cut])

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text closed by end, and the len(texts) + 1 offsets."""
        fast = np.array([(t.isascii() or LATIN.fullmatch(t) is not None) and "<|" not in t for t in texts], bool)
        n = np.zeros(len(texts), np.int64)
        parts = []
        for mask, run in ((fast, self._latin), (~fast, self._words)):
            if mask.any():
                ids, count = run([t for t, m in zip(texts, mask, strict=True) if m])
                n[mask] = count
                parts.append((mask, ids))
        at = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(int(at[-1]), end, np.int32)
        for mask, ids in parts:
            k = n[mask]
            out[np.repeat(at[:-1][mask] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return out, at


def _ragged(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return flat[np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, grain: int, end: int, groups: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Cut each document's ids into full windows, and the rest into pieces of at most grain."""
    words = encoder(path)
    encode, row, task = words.encode, 0, TaskContext.get().partitionId()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp", "place"] + ["ids"] * keep_ids
    for batch in slices(batches, "text"):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids, at = encode(texts, end)
        raw = memoryview(ids.astype("<u4").tobytes())
        n = np.diff(at)
        full = n // capacity
        cuts = full + -(-(n % capacity) // grain)
        doc = np.repeat(np.arange(len(texts)), cuts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.minimum(nth, full[doc]) * capacity + np.maximum(nth - full[doc], 0) * grain
        length = np.minimum(np.where(nth < full[doc], capacity, grain), n[doc] - start)
        first = (at[doc] + start) * 4
        crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(first.tolist(), (length * 4).tolist(), strict=True)]
        place = (task << 40) + row + doc
        grp = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(groups)
        row += len(texts)
        cols = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(grp.astype(np.int64)), pa.array(place)]
        if keep_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ids)))
        yield pa.RecordBatch.from_arrays(cols, names)
    words = encode = None
    _encoders.clear()  # a worker serves other operators next; its memory is theirs


def differencing(sizes: list[int] | np.ndarray, k: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: k lists of item numbers with near-equal sums.

    The two partial partitions of the largest imbalance are merged again and again, the fullest windows
    of one with the emptiest of the other. Bins that are still empty are not stored.
    """
    if not len(sizes):
        return [[] for _ in range(k)]
    left: list[int] = []
    right: list[int] = []
    n = len(sizes)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, a_at = heapq.heappop(heap)
        _, i, b, b_at = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both <= 0:
            sums, at = np.concatenate([a, b]), np.concatenate([a_at, b_at])
        else:
            low = k - len(b)
            sums = np.concatenate([a, np.zeros(k - len(a), np.int64)])
            sums[low:] += b[::-1]
            at = np.concatenate([a_at[:low], np.arange(made, made + both), b_at[::-1][both:]])
            left.extend(a_at[low:].tolist())
            right.extend(b_at[::-1][:both].tolist())
            made += both
        order = np.argsort(-sums, kind="stable")
        sums, at = sums[order], at[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), i, sums, at))
    out = []
    for node in heap[0][3].tolist():
        stack, leaves = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                leaves.append(x)
            else:
                stack += (left[x - n], right[x - n])
        out.append(sorted(leaves))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most capacity; their number rises until none is exceeded."""
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        bins = differencing(sizes, k)
        most = max(int(sizes[b].sum()) for b in bins if b) if len(sizes) else 0
        if most <= capacity:
            return [b for b in bins if b]
        k += max(1, min(k, int(0.5 * k * (most - capacity) / capacity)))


def _pack_group(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "start"], kind="stable", ignore_index=True)
        size = rows["length"].to_numpy()
        full, part = np.nonzero(size == capacity)[0], np.nonzero(size < capacity)[0]
        bins = [[int(i)] for i in full] + [part[b].tolist() for b in windows(size[part], capacity)]
        seq, off = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for number, members in enumerate(bins):
            seq[members] = (int(key[0]) << 24) | number
            off[members] = np.cumsum(size[members]) - size[members]
        return rows.drop(columns=["grp", "place"]).assign(sequence_id=seq, offset=off)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, grain: int = 512, end_id: int = 1, keep_ids: bool = False, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of documents and their place in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids and one end_id are cut into full windows of capacity, and the rest into pieces of at most grain (fine
    enough that padding stays under one per cent); the pieces of a group of about group_docs documents go to near-equal windows by differencing. Groups are dealt by a hash of a row's place
    in the scan, so repeated rows and equal or null ids spread evenly; pieces are written once before they are packed, so that
    a task that runs again finds the same groups. Null and empty texts are one end_id each; an
    empty table gives no pieces. Further columns are not read.
    """
    spark = docs.sparkSession
    groups = max(1, math.ceil(docs.count() / group_docs))
    ids = ", ids array<int>" * keep_ids
    kind = dict(docs.dtypes)["doc_id"]
    base = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = settle(docs.select("doc_id", "text").mapInArrow(lambda b: trimmed(_pieces(b, tokenizer, capacity, grain, end_id, groups, keep_ids)), f"{base}, grp bigint, place bigint{ids}"))
    return pieces.groupBy("grp").applyInPandas(_pack_group(capacity), f"{base}{ids}, sequence_id bigint, offset bigint")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
