"""Operator 3: toxicity by compression distance between zstandard dictionaries of toxic and of ordinary text.

Two raw-content dictionaries are trained. The ordinary one holds the commonest words of ordinary documents and the stretches
of ordinary words that look like toxic ones. The toxic one is the same with the stems that set toxic documents apart added, so
the two differ by toxic content alone; a third holds only the strongest stems. A window is one word, closed in by filler that both know; its distance is how many
bytes shorter the toxic dictionary makes it. A document's score is calibrated on
the training documents by its number of windows at the threshold or beyond, of all toxic content and of the strongest.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, trimmed

#: Bounds of the labelled sample that the model is fitted on: documents of each class, and characters of each.
TOXIC_DOCS, ORDINARY_DOCS, SAMPLE_CHARS = 1500, 4500, 24_000_000
#: Bytes of common words in either dictionary.
COMMON_BYTES = 8192
#: Shortest string that the compressor can match, which with two marks before each word keeps chance matches out.
MATCH = 6
#: Characters of a window at most; longer words are cut into overlapping windows.
WINDOW, OVERLAP = 256, 32
#: Bytes saved from which on a window counts.
THRESHOLD = 1
#: Words without toxic content that a worker remembers.
CACHE_WORDS = 200_000
MARK = "\x01 "
LEAD = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2
TRAIL = b"\n\0\1\2\3\4\5\6\7"
HELD_OUT = 2
WORD = re.compile(r"[^\W\d_]{3,}")


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _stems(toxic: Iterable[str], ordinary: Iterable[str], known: tuple[str, ...], share: float, contrast: float, shortest: int = 4, longest: int = 10) -> list[str]:
    """Words, and beginnings of longer words, that are commoner in toxic documents, rarest first; none begins with another or a known one.

    Where a beginning is an ordinary word by itself, its continuations by one letter stand for it.
    """

    def frequencies(texts: Iterable[str]) -> tuple[Counter, int]:
        found: Counter = Counter()
        n = 0
        for n, t in enumerate(texts, 1):
            words = {w for w in WORD.findall(t.lower()) if not w.startswith(known)}
            found.update({w[:k] for w in words for k in range(shortest, min(len(w) - 1, longest) + 1)})
            found.update(w + "$" for w in words)
        return found, n

    here, n1 = frequencies(toxic)
    there, n0 = frequencies(ordinary)
    ratio = lambda s: here[s] * max(n0, 1) / ((there[s] + 0.25) * max(n1, 1))
    least = max(4, share * n1)
    good = {s: n for s, n in here.items() if n >= least and ratio(s) > contrast}
    nexts: dict[str, list[str]] = {}
    for s in here:
        nexts.setdefault(s[:-1], []).append(s)
        if s.endswith("$"):
            nexts.setdefault(s[:-2], []).append(s)
    out: set[str] = set()
    for s in sorted(good, key=lambda s: (len(s), s)):
        if any(s[:k] in good for k in range(shortest, len(s))):
            continue
        n = good[s]
        while more := [x for x in nexts.get(s, ()) if good.get(x, 0) >= 0.85 * n]:
            s = max(more, key=lambda x: (good[x], x))
        if not s.endswith("$") and there[s + "$"] and ratio(s + "$") < contrast:
            out.update(x.rstrip("$") for x in nexts[s] if x != s + "$" and here[x] > 1 and ratio(x) > contrast / 2)
        else:
            out.add(s.rstrip("$"))
    return sorted(out, key=lambda s: (here[s] + here[s + "$"], s))


def toxic_stems(toxic: list[str], ordinary: list[str]) -> tuple[list[str], list[str]]:
    """(strong, weak): what hardly any ordinary document holds, and what toxic ones hold much more of."""
    strong = _stems(toxic, ordinary, (), 0.02, 40.0)
    return strong, _stems(toxic, ordinary, tuple(strong), 0.04, 6.0)


@dataclass
class Model:
    ordinary: bytes
    strong: bytes
    weak: bytes
    table: tuple[tuple[float, ...], ...] = ((0.0,),)

    def distances(self) -> Distances:
        return Distances(self)

    def score(self, strong: int, hits: int) -> float:
        row = self.table[min(strong, len(self.table) - 1)]
        p, rest = row[min(hits, len(row) - 1)], max(strong + hits - 4, 0)
        return 1 - (1 - p) ** (1 + 0.05 * min(rest, 40)) if p >= 0.3 else p


class Distances:
    """Compression distances of words, with ordinary ones remembered."""

    def __init__(self, model: Model) -> None:
        import zstandard as zs

        log = max(15, len(model.ordinary + model.weak + model.strong + LEAD).bit_length())  # the match tables hold whole dictionaries
        how = zs.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log - 1, search_log=5, min_match=MATCH, target_length=32, strategy=zs.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        made = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(model.ordinary + x + LEAD, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how) for x in (b"", model.weak + model.strong, model.strong)]
        self.ordinary, self.toxic, self.strong = (x.compress for x in made)
        self.clean: set[str] = set()

    def window(self, text: str) -> tuple[int, int]:
        """Bytes that toxic content saves, and that its strong part alone saves."""
        raw = LEAD + (MARK + text).encode() + TRAIL
        plain = len(self.ordinary(raw))
        d = plain - len(self.toxic(raw))
        return d, plain - len(self.strong(raw)) if d > 0 else 0

    def word(self, w: str) -> tuple[int, int]:
        if len(w) <= WINDOW:
            return self.window(w)
        return max(self.window(w[i : i + WINDOW]) for i in range(0, len(w), WINDOW - OVERLAP))

    def document(self, text: str) -> tuple[int, int, int]:
        """Words with a strong distance at the threshold, words with any, and the greatest distance."""
        words = text.lower().split()
        greatest = 0
        marked: dict[str, bool] = {}
        for w in set(words) - self.clean:
            d, firm = self.word(w)
            greatest = max(greatest, d)
            if d >= THRESHOLD:
                marked[w] = firm >= THRESHOLD
            elif len(w) <= WINDOW:
                self.clean.add(w)
        if len(self.clean) > CACHE_WORDS:
            self.clean.clear()
        hits = [marked[w] for w in words if w in marked] if marked else []
        return sum(hits), len(hits), greatest


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries and score table from labelled texts; without any of either class all scores are 0."""
    if not toxic or not ordinary:
        return Model(b"", b"", b"")
    strong, weak = toxic_stems(toxic, ordinary)
    words = Counter(w for t in ordinary for w in t.lower().split())
    common, size = [], 0
    for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        if size > COMMON_BYTES:
            break
        common.append(MARK + w)
        size += len(w) + 2
    contents = ["".join(MARK + s for s in stems).encode() for stems in (strong, weak)]
    grams = {c[i : i + MATCH] for c in contents for i in range(len(c) - MATCH + 1)}
    stems = tuple(strong + weak)
    alike: set[bytes] = set()
    for w in words:
        if stems and w.startswith(stems):
            continue
        raw = (MARK + w).encode()
        i = 0
        while i + MATCH <= len(raw):
            if raw[i : i + MATCH] in grams:
                j = i + MATCH
                while j < len(raw) and raw[j - MATCH + 1 : j + 1] in grams:
                    j += 1
                alike.add(raw[i:j])
                i = j
            i += 1
    model = Model("".join(reversed(common)).encode() + b"".join(sorted(alike)), *contents)
    measure = model.distances()
    cells = [Counter(), Counter()]
    for side, texts in enumerate((ordinary, toxic)):
        for t in texts:
            s, h, _ = measure.document(t)
            cells[side][min(s, 2), min(h, 6)] += 1
    table = []
    for s in range(3):
        row = []
        for h in range(7):
            # pooled with a little weight from the cell's neighbours in hits, which keeps empty cells sensible
            n0, n1 = (cells[side][s, h] + 0.15 * sum(cells[side][s, x] for x in (h - 1, h + 1)) + extra for side, extra in ((0, 0.2), (1, 0.2 if s or h > 2 else 0.02)))
            p = n1 / (n0 + n1)
            row.append(max([p, *row[-1:], *(table[-1][h : h + 1] if table else [])]))
        table.append(tuple(row))
    model.table = tuple(table)
    return model


def _sample(docs: DataFrame, labels: DataFrame, value: int, most: int) -> list[str]:
    """Texts of at most `most` labelled documents, those with the smallest hashes of their ids, as far as SAMPLE_CHARS characters go in that order, but one document at least.

    What is chosen follows from ids, labels and lengths, so neither the order of rows nor their partitions change the model.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    chosen = known.filter(F.col("toxic") == value).select("doc_id").orderBy(place).limit(most)
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select(place.alias("place"), "text")
    sizes = texts.groupBy("place").agg(F.sum(F.length("text")).alias("n")).orderBy("place").toPandas()  # at most `most` rows
    if not len(sizes):
        return []
    kept = int(((sizes["n"].cumsum() <= SAMPLE_CHARS) | (sizes.index == 0)).sum())
    last = sizes["place"].iloc[kept - 1]
    upto = F.col("place") <= F.struct(F.lit(last.h).cast("bigint").alias("h"), F.lit(last.doc_id).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"))
    return [row.text for row in sorted(texts.filter(upto).collect(), key=lambda r: (r.place.h, r.place.doc_id, r.text))]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out quarter; repeated labels of a document count as the greatest."""
    return fit(_sample(docs, labels, 1, TOXIC_DOCS), _sample(docs, labels, 0, ORDINARY_DOCS))


def _score(batches: Iterator[pa.RecordBatch], model: Model, spot: int, threshold: float) -> Iterator[pa.RecordBatch]:
    measure = model.distances()
    for batch in batches:
        got = [measure.document(t or "") for t in batch.column(spot).to_pylist()]
        scores = [model.score(strong, hits) for strong, hits, _ in got]
        more = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([d for *_, d in got], pa.int32()), pa.array([n for _, n, _ in got], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "score", "predicted", "distance", "hits"])


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with score, predicted, distance (greatest of a word) and hits (words at the model's threshold).

    Whole texts are scored by text alone, word by word; null and empty texts have distance 0 and the lowest score. Equal
    texts have equal scores; an empty table gives no rows. Columns of docs that already have one of the new
    names are dropped.
    """
    docs = docs.drop("score", "predicted", "distance", "hits")
    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("distance", T.IntegerType()), T.StructField("hits", T.LongType())]
    spot = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: trimmed(_score(b, model, spot, threshold)), T.StructType(docs.schema.fields + more))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
