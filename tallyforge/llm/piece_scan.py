"""Operator 1: SentencePiece encoding and decoding by a max-plus parallel scan.

The public model is of BPE type: its ids are the one segmentation whose neighbouring pieces all fit, that is, where merging the two
pieces' text by itself gives these two pieces again. So encoding is the heaviest path of a lattice whose arcs weigh 0 where two
pieces fit and minus infinity where they don't. A giant document is split into chunks; a boundary state is the piece that starts last before a
boundary (how far it reaches back and over it), each chunk gives a matrix of path weights from every way in to every way out, matrices combine
associatively in the max-plus semiring, and once the boundary states are known every chunk is backtraced alone. Between places where no
piece can cross (before a space mark that follows another character) a chunk's inside needs no matrix and is merged as it is.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, settle, slices, table, trimmed

SPACE = "▁"
#: Characters of one chunk of a giant document; shorter documents are encoded whole.
CHUNK = 1 << 15
#: Chunks whose matrices one task combines at a level of the scan.
FAN = 64
#: Pairs of pieces whose fit a worker remembers.
FITS = 200_000
NEG = -math.inf


class Pieces:
    """Vocabulary of a SentencePiece model file of BPE type: pieces, merges, and which pieces fit side by side."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        text = [self.model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.id = {text[i]: i for i in normal}
        self.score = {text[i]: self.model.get_score(i) for i in normal}
        self.longest = max(map(len, self.id))
        self.byte_id = {int(text[i][3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.unknown = self.model.unk_id()
        self.value = [bytes([int(text[i][3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else text[i].replace(SPACE, " ").encode() for i in range(n)]
        #: No piece holds a space mark after another character, so no merge crosses the place before a mark that follows one.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.known: dict[tuple[str, str], bool] = {}

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.byte_id[b] for b in piece.encode()] if len(self.byte_id) == 256 else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the neighbours whose union has the best score are merged, the first of equals, until none can be."""
        now = list(text)
        while len(now) > 1:
            best, at = max((self.score.get(a + b, NEG), -i) for i, (a, b) in enumerate(zip(now, now[1:], strict=False)))
            if best == NEG:
                break
            now[-at : 2 - at] = [now[-at] + now[1 - at]]
        return now

    def fits(self, a: str, b: str) -> bool:
        """Whether the text of both, merged by itself, is these two pieces; an empty one stands for the text's start."""
        key = (a, b)
        if key not in self.known:
            if len(self.known) >= FITS:
                self.known.clear()
            self.known[key] = self.merged(a + b) == [x for x in key if x]
        return self.known[key]

    def starts(self, text: str, i: int) -> Iterator[str]:
        """Pieces that start at i; a character without a piece of its own is one."""
        if i < len(text):
            yield text[i]
            for j in range(i + 2, min(i + self.longest, len(text)) + 1):
                if text[i:j] in self.id:
                    yield text[i:j]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def escape(text: str) -> str:
    """The lattice's text: spaces as marks, and one before the text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def cuts(text: str) -> list[int]:
    """Places that no piece crosses: before a mark that follows another character."""
    out, at = [], text.find(SPACE, 1)
    while at > 0:
        if text[at - 1] != SPACE:
            out.append(at)
        at = text.find(SPACE, at + 1)
    return out


def decode(pieces: Pieces, ids: list[int]) -> str:
    """Text of ids: byte pieces joined, marks as spaces, the first mark dropped."""
    raw = b"".join(map(pieces.value.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


# ---- the scan over chunks of a giant document


@dataclass
class Span:
    """A chunk: what stands before it, its text and what follows it, either as far as a piece can reach."""

    before: str
    text: str
    size: int


def spans(text: str, chunk: int, width: int) -> Iterator[Span]:
    """Chunks of at least a piece's width; what is left over at the end goes to the last one."""
    chunk = max(chunk, width)
    at = list(range(0, len(text), chunk))
    if len(at) > 1 and len(text) - at[-1] < width:
        at.pop()
    for i, j in zip(at, [*at[1:], len(text)], strict=True):
        yield Span(text[max(0, i - width) : i], text[i : j + width - 1], j - i)


def states(pieces: Pieces, before: str, after: str) -> list[tuple[str, int]]:
    """(piece, characters of it behind the boundary) of every piece that can be the last to start before a boundary."""
    if not before:
        return [("", 0)]
    out = [(before[-1], 0)]
    for back in range(1, min(pieces.longest, len(before)) + 1):
        for over in range(back == 1, min(pieces.longest - back, len(after)) + 1):
            piece = before[-back:] + after[:over]
            if piece in pieces.id:
                out.append((piece, over))
    return out


def ways(pieces: Pieces, span: Span) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """States at the chunk's two boundaries, in an order that its neighbours find too."""
    return states(pieces, span.before, span.text[: pieces.longest - 1]), states(pieces, span.before + span.text[: span.size], span.text[span.size :])


def sweep(pieces: Pieces, text: str, size: int, into: list[tuple[str, int]]) -> list[dict[str, tuple[int, tuple | None]]]:
    """By place, the pieces that end there and can be reached: which of `into` reach each, as bits, and the piece before it of the last one found.

    Pieces start before size. All ways in go side by side.
    """
    ends: list[dict[str, tuple[int, tuple | None]]] = [{} for _ in range(size + pieces.longest)]
    for k, (piece, over) in enumerate(into):
        ends[over][piece] = (ends[over].get(piece, (0, None))[0] | 1 << k, None)
    for i in range(size):
        if not ends[i]:
            continue
        for b in pieces.starts(text, i):
            to = ends[i + len(b)]
            for a, (reach, _) in list(ends[i].items()):
                if pieces.fits(a, b):
                    had = to.get(b)
                    to[b] = (reach | (had[0] if had else 0), (a, i))
    return ends


def inner_cuts(pieces: Pieces, span: Span) -> list[int]:
    """Places inside the chunk, behind what a piece over its first boundary can reach, that no piece crosses."""
    return [c for c in cuts(span.text) if pieces.longest <= c < span.size] if pieces.splits else []


def transfer(pieces: Pieces, span: Span) -> np.ndarray:
    """The chunk's matrix: ways in by ways out.

    Between the chunk's first and last place that no piece crosses all is possible, so the matrix is the sum of a column and a row.
    """
    into, out = ways(pieces, span)
    inner = inner_cuts(pieces, span)
    m = np.full((len(into), len(out)), NEG)
    if inner:
        head = sweep(pieces, span.text, inner[0], into)[inner[0]]
        tail = sweep(pieces, span.text[inner[-1] :], span.size - inner[-1], [("", 0)])
        enter = np.array([any(reach >> k & 1 for reach, _ in head.values()) for k in range(len(into))])
        leave = np.array([p in tail[span.size - inner[-1] + over] for p, over in out])
        m[np.ix_(enter, leave)] = 0.0
        return m
    ends = sweep(pieces, span.text, span.size, into)
    for j, (piece, over) in enumerate(out):
        reach = ends[span.size + over].get(piece, (0, None))[0]
        m[[k for k in range(len(into)) if reach >> k & 1], j] = 0.0
    return m


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def trace(pieces: Pieces, text: str, size: int, enter: tuple[str, int], leave: tuple[str, int] | None) -> list[str]:
    """Pieces that start in the first size characters; leave: the last of them and how far it reaches over, or None for any that ends there."""
    ends = sweep(pieces, text, size, [enter])
    piece, at = (next(iter(ends[size])), size) if leave is None else (leave[0], size + leave[1])
    out = []
    while (back := ends[at][piece][1]) is not None:
        out.append(piece)
        piece, at = back
    return out[::-1]


def backtrace(pieces: Pieces, span: Span, enter: int, leave: int) -> list[int]:
    """Ids of the pieces that start in the chunk, given the boundary states."""
    into, out = ways(pieces, span)
    inner = inner_cuts(pieces, span)
    listed = lambda found: list(chain.from_iterable(map(pieces.ids, found)))
    if not inner:
        return listed(trace(pieces, span.text, span.size, into[enter], out[leave]))
    first, last = inner[0], inner[-1]
    middle = span.text[first + 1 : last].replace(SPACE, " ")  # its first mark is the one that the library puts before a text
    tail = trace(pieces, span.text[last:], span.size - last, ("", 0), out[leave])
    return listed(trace(pieces, span.text, first, into[enter], None)) + (pieces.encode([middle])[0] if last > first else []) + listed(tail)


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _pack(m: np.ndarray) -> bytes:
    return len(m).to_bytes(4, "little") + m.astype("<f4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f4", offset=4).reshape(int.from_bytes(raw[:4], "little"), -1)


def _digest(pieces: Pieces, doc_ids: pa.Array, id_lists: list[np.ndarray], keep: bool) -> pa.RecordBatch:
    texts = [decode(pieces, ids.tolist()) for ids in id_lists]
    cols = [
        doc_ids,
        pa.array([len(x) for x in id_lists], pa.int64()),
        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in id_lists], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
    ]
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"]
    if keep:
        cols += [pa.array([x.tolist() for x in id_lists], pa.list_(pa.int32())), pa.array(texts)]
        names += ["ids", "decoded"]
    return pa.RecordBatch.from_arrays(cols, names)


def _encode_short(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(path)
    for batch in slices(batches, "text", 1 << 18):
        yield _digest(pieces, batch.column(0), [np.array(x, np.int32) for x in pieces.encode([t or "" for t in batch.column(1).to_pylist()])], keep)


def _chunks(batches: Iterator[pa.RecordBatch], path: str, chunk: int) -> Iterator[pa.RecordBatch]:
    width, task, row = pieces_of(path).longest, TaskContext.get().partitionId(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            for i, span in enumerate(spans(escape(text.as_py()), chunk, width)):
                yield pa.RecordBatch.from_arrays([pa.array([task << 40 | row]), pa.array([doc_id.as_py()], batch.schema.types[0]), pa.array([i], pa.int64()), pa.array([span.size], pa.int64()), pa.array([span.before]), pa.array([span.text])], ["place", "doc_id", "at", "size", "before", "text"])
            row += 1


def _matrices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(path)
    for batch in batches:
        made = [_pack(transfer(pieces, Span(b, t, n))) for n, b, t in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["place", "at", "matrix"])


def _join_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    m = reduce(combine, map(_unpack, rows["matrix"]))
    return pd.DataFrame({"place": [key[0]], "at": [key[1]], "matrix": [_pack(m)]})


def _top(rows: pd.DataFrame) -> pd.DataFrame:
    """The states of a whole text: it has one way in, and the way out of the heaviest path."""
    return rows.assign(enter=0, leave=[int(np.argmax(_unpack(m)[0])) for m in rows["matrix"]])[["place", "at", "enter", "leave"]]


def _states_down(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """States at the members' boundaries from those of their group."""
    rows = rows.sort_values("at")
    ms = [_unpack(x) for x in rows["matrix"]]
    enter, leave = int(rows["enter"].iloc[0]), int(rows["leave"].iloc[0])
    way = np.full(len(ms[0]), NEG)
    way[enter] = 0.0
    before = [way]
    for m in ms[:-1]:
        before.append((before[-1][:, None] + m).max(0))
    outs = [leave]
    for v, m in zip(before[::-1], ms[::-1], strict=True):
        outs.append(int(np.argmax(v + m[:, outs[-1]])))
    outs.reverse()
    return pd.DataFrame({"place": key[0], "at": rows["at"], "enter": outs[:-1], "leave": outs[1:]})


def _backtraces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(path)
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("before", "text", "size", "enter", "leave"))
        ids = [np.array(backtrace(pieces, Span(b, t, n), i, j), "<i4").tobytes() for b, t, n, i, j in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)) for x in ("place", "doc_id", "at")] + [pa.array(ids, pa.binary())], ["place", "doc_id", "at", "ids"])


def _digest_long(batches: Iterator[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(path)
    for batch in batches:
        for i in range(batch.num_rows):
            ids = np.concatenate([np.frombuffer(x, "<i4") for x in batch.column(1)[i].as_py()])
            yield _digest(pieces, batch.column(0).slice(i, 1), [ids], keep)


def _encode_long(docs: DataFrame, path: str, chunk: int, schema: str, kind: str, keep: bool) -> DataFrame:
    """Chunks, their matrices combined FAN by FAN, boundary states from the top down, backtraces."""
    rows = settle(docs.mapInArrow(lambda b: trimmed(_chunks(b, path, chunk)), f"place bigint, doc_id {kind}, at bigint, size bigint, before string, text string"))
    flat = rows.select("place", "at", "size", "before", "text").repartition(parts(docs.sparkSession), "place", "at")
    levels = [settle(flat.mapInArrow(lambda b: trimmed(_matrices(b, path)), "place bigint, at bigint, matrix binary"))]
    most = (rows.agg(F.max("at")).first()[0] or 0) + 1
    while most > 1:
        most = -(-most // FAN)
        levels.append(settle(levels[-1].withColumn("up", F.floor(F.col("at") / FAN)).groupBy("place", "up").applyInPandas(_join_up, "place bigint, at bigint, matrix binary")))
    known = levels[-1].mapInPandas(lambda frames: map(_top, frames), "place bigint, at bigint, enter int, leave int")
    for level in levels[-2::-1]:
        known = known.select("place", F.col("at").alias("up"), "enter", "leave")
        members = level.withColumn("up", F.floor(F.col("at") / FAN)).join(known, ["place", "up"])
        known = members.groupBy("place", "up").applyInPandas(_states_down, "place bigint, at bigint, enter int, leave int")
    traced = rows.join(known, ["place", "at"]).mapInArrow(lambda b: trimmed(_backtraces(b, path)), f"place bigint, doc_id {kind}, at bigint, ids binary")
    whole = traced.groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("all"))
    return whole.select("doc_id", F.col("all.ids").alias("ids")).mapInArrow(lambda b: trimmed(_digest_long(b, path, keep)), schema)


def encode_documents(docs: DataFrame, model: str, chunk: int = CHUNK, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit), decoded_sha256; with keep also ids and the decoded text.

    The ids are the model's own, with byte fallback, for texts of any length: those of up to chunk
    characters are encoded in place, longer ones by the scan. Decoding gives the text back, but for space marks
    (U+2581) in it, which come back as spaces. Null and empty texts have no ids; an empty table gives no rows; repeated rows give
    repeated results; further columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    text = docs.select("doc_id", "text")
    long = F.length("text") > chunk
    short = text.filter(~F.coalesce(long, F.lit(False))).mapInArrow(lambda b: trimmed(_encode_short(b, model, keep)), schema)
    return short.unionByName(_encode_long(text.filter(long), model, chunk, schema, kind, keep))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
