"""Operator 11: benchmark decontamination by an Aho-Corasick automaton over normalised windows of the benchmark's words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, table, trimmed

#: Words of a window; an item of fewer words is one window.
WORDS = 10
#: Characters of windows that one automaton holds (some 40 bytes of memory each at most); a larger benchmark is cut into blocks of items, each an automaton of its own.
BLOCK_CHARS = 2_000_000
#: Bytes of a text that are normalised and scanned at once; the automaton's state goes on from piece to piece.
PIECE = 1 << 20

#: ASCII letters in lower case, digits and all bytes of other code points stay, the rest separates words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalised_words(text: str) -> list[bytes]:
    """The words of a text as UTF-8: runs of digits, letters a to z in lower case, and code points beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


@dataclass
class Automaton:
    """Windows between spaces, byte for character, so that no match begins or ends inside a word."""

    words: int = WORDS
    windows: dict[str, tuple[int, list[int]]] = field(default_factory=dict)  # window -> (its words, items)
    machine: ahocorasick.Automaton | None = None

    def add(self, item: int, text: str | None) -> None:
        found = normalised_words(text or "")
        for i in range(max(1, len(found) - self.words + 1) if found else 0):
            part = found[i : i + self.words]
            items = self.windows.setdefault(" " + b" ".join(part).decode("latin-1") + " ", (len(part), []))[1]
            if not items or items[-1] != item:
                items.append(item)

    def scan(self, text: str | None) -> tuple[int, int, set[int], list[tuple[int, int]]]:
        """(words, words hit, items whose windows occur, runs of hit words as byte ranges of the text's UTF-8), in one pass.

        The text is read in pieces cut between words; positions of matches count on over pieces, and a mask of the last words tells which of
        a window's words are hit already, so what is held beside the text follows the runs alone.
        """
        if self.machine is None and self.windows:
            self.machine = ahocorasick.Automaton()
            for window, value in self.windows.items():
                self.machine.add_word(window, value)
            self.machine.make_automaton()
        norm = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)
        words = hit = passed = start = mask = 0
        last, full = -1, (1 << self.words) - 1
        items: set[int] = set()
        runs: list[tuple[int, int, int, int]] = []  # first and last word, first and last byte
        recent: list[tuple[int, int]] = []  # byte ranges of the last words of the pieces before
        seeker = None
        while start < len(norm):
            end = norm.find(b" ", start + PIECE)
            end = end if end >= 0 else len(norm)
            piece = norm[start:end]
            found = piece.split()
            if found and self.machine is not None:
                plain = b" ".join(found).decode("latin-1") + " "
                if seeker is None:
                    plain = " " + plain
                    seeker = self.machine.iter(plain)
                else:
                    seeker.set(plain)
                ends = places = None
                for at, (n, of) in seeker:
                    if ends is None:
                        solid = np.concatenate(([0], (np.frombuffer(piece, np.uint8) != 32).view(np.int8), [0]))
                        edge = np.diff(solid)
                        places = np.stack((np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]), 1) + start
                        spaces = np.nonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)[0]
                        ends = spaces[1:] if plain[0] == " " else spaces
                    word = words + int(np.searchsorted(ends, at - passed))
                    mask = (mask << min(word - last, self.words)) & full
                    last = word
                    items.update(of)
                    new = ((1 << n) - 1) & ~mask
                    if new:
                        hit += new.bit_count()
                        mask |= new
                        first = word - n + 1
                        low = places[first - words][0] if first >= words else recent[first - words][0]
                        while runs and runs[-1][1] + 1 >= first:
                            before = runs.pop()
                            first, low = min(first, before[0]), min(low, before[2])
                        runs.append((first, word, int(low), int(places[word - words][1])))
                passed += len(plain)
            words += len(found)
            if end < len(norm):
                recent = _last_places(piece, start, self.words, recent)
            start = end
        return words, hit, items, [x[2:] for x in runs]


def _last_places(piece: bytes, start: int, n: int, before: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the last n words up to the end of a piece."""
    out: list[tuple[int, int]] = []
    end = len(piece)
    while len(out) < n:
        end = len(piece[:end].rstrip(b" "))
        if not end:
            break
        low = piece.rfind(b" ", 0, end) + 1
        out.append((start + low, start + end))
        end = low
    out.reverse()
    return (before + out)[-n:]


_AUTOMATA: dict[str, Automaton] = {}


def _automaton(name: str, rows: Sequence[tuple[int, str]], words: int) -> Automaton:
    """That of a block of items, built once in a worker; only the latest is kept."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        made = Automaton(words)
        for i, text in rows:
            made.add(i, text)
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def _scan(batches: Iterator[pa.RecordBatch], name: str, shared, words: int) -> Iterator[pa.RecordBatch]:
    ids, rows = shared.value
    made = _automaton(name, rows, words)
    for batch in slices(batches, "text", 1 << 22):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        out = [made.scan(x) for x in texts]
        spans = []
        for text, (_, _, _, runs) in zip(texts, out, strict=True):
            spans.append(_code_points(text, runs) if runs else [])
        rest = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"]
        found = [sorted({ids[i] for i in x[2] if i >= 0}) for x in out]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, kind)],
            [*(n for n in batch.schema.names if n != "text"), "n_words", "n_hit", "items", "spans"],
        )


def _code_points(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte ranges as ranges of code points."""
    if text.isascii():
        return [{"start": a, "end": b} for a, b in runs]
    before = np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)
    upto = lambda b: int(before[b - 1]) if b else 0
    return [{"start": upto(a), "end": upto(b)} for a, b in runs]


def blocks_of(items: DataFrame, words: int, block_chars: int) -> int:
    """How many automata a benchmark takes: windows repeat each word `words` times."""
    chars = items.agg(F.sum(F.octet_length("text") + 2)).first()[0] or 0
    return max(1, -(-chars * words // block_chars))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items, spans) for each document: its words, those inside any occurrence of a benchmark window, the ids of the items
    whose windows occur as strings in order, and the maximal runs of hit words as (start, end) in code points of the text.

    A text is scanned once, by one automaton of all windows. The automaton's items are collected and broadcast only after their size was counted: a benchmark of over block_chars
    characters of windows is cut into blocks of items by hash, and documents are scanned once for each block, its spans merged by document. One item must fit into memory. Null and empty
    texts have no words and no hits; an item without words has no window; items of equal text or id are each found, an id listed once; an item without id marks words but is not listed. Repeated documents,
    and ones without id, are rows of their own. Other columns of either table are not read, and an empty table on either side is fine.
    """
    spark = docs.sparkSession
    items = settle(benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).filter("text is not null"))
    n = blocks_of(items, words, block_chars)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"

    def scanned(rows: DataFrame, block: int, *keys: str) -> DataFrame:
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == block)
        held = part.collect()  # bounded by block_chars, or one item
        ids = {i: r.id for i, r in enumerate(held) if r.id is not None}
        known = sorted(set(ids.values()))
        number = {x: i for i, x in enumerate(known)}
        pairs = [(number[r.id] if r.id is not None else -1, r.text) for r in held]
        pairs.sort(key=lambda x: (x[1], x[0]))
        name = hashlib.sha256(repr((pairs, known)).encode("utf-8", "surrogatepass")).hexdigest()
        shared = spark.sparkContext.broadcast((known, pairs))
        types = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
        return rows.select(*keys, "text").mapInArrow(lambda b: trimmed(_scan(b, name, shared, words)), f"{types}, {schema}")

    if n == 1:
        return scanned(plain, 0, "doc_id")
    numbered = settle(plain.withColumn("row", F.monotonically_increasing_id()))
    out = None
    for block in range(n):
        one = scanned(numbered, block, "row")
        out = one if out is None else out.unionByName(one)
    return _merged(settle(out), numbered)


def _merged(parts: DataFrame, numbered: DataFrame) -> DataFrame:
    """One row a document from its rows of several blocks: spans of words united, their words counted again in the text."""
    kind = "array<struct<start: bigint, end: bigint>>"
    rows = parts.groupBy("row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    whole = numbered.join(rows, "row").select("doc_id", "n_words", "items", "spans", "text")
    return whole.mapInArrow(lambda b: trimmed(_recount(b)), f"doc_id {dict(numbered.dtypes)['doc_id']}, n_words bigint, n_hit bigint, items array<string>, spans {kind}")


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 22):
        doc, words, items, spans, texts = batch.columns
        hit, merged = [], []
        for text, runs in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            out: list[dict[str, int]] = []
            for x in runs:
                if out and (x["start"] <= out[-1]["end"] or not normalised_words(text[out[-1]["end"] : x["start"]])):
                    out[-1]["end"] = max(out[-1]["end"], x["end"])
                else:
                    out.append(x)
            merged.append(out)
            hit.append(sum(len(normalised_words(text[x["start"] : x["end"]])) for x in out))
        yield pa.RecordBatch.from_arrays([doc, words, pa.array(hit, pa.int64()), items, pa.array(merged, spans.type)], ["doc_id", "n_words", "n_hit", "items", "spans"])


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
