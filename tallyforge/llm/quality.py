"""Operator 2: quality from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of all documents'
vote patterns estimates each labeller's accuracy and the share of good documents without any true label; the posteriors
of a bounded sample then train a linear scorer of hashed features, and that scorer judges every document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, trimmed, utf8
from .shingles import LOWER, SPACE, mix, word_hash

#: Bounds of the sample that the scorer is fitted on: documents, and bytes of them.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 12_000_000
#: Hashed features: byte trigrams and the buckets of the measures.
TRIGRAMS, BUCKETS = 1 << 13, 1 << 10
MEASURES = ("symbols", "capitals", "doubled", "repeated", "top", "length", "looped")
#: (measure, good below, bad from, fewest words): a labeller each; between the two, and below that many words, it says nothing.
LABELLERS = (
    ("symbols", 0.01, 0.06, 1),
    ("capitals", 0.08, 0.30, 5),
    ("doubled", 0.03, 0.08, 12),
    ("repeated", 0.50, 0.75, 25),
    ("top", 0.15, 0.22, 25),
    ("length", 5.9, 6.4, 12),
    ("looped", 0.15, 0.40, 25),
)
#: Documents that the share of good ones starts with, four in five of them good: a handful of documents cannot make all others bad.
PRIOR_DOCS = 20
SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"%*$&#|!<>{}[]\\^~=_@+", np.uint8)] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True


def measures(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, measures) and words by document, of whole texts side by side."""
    n_docs = len(at) - 1
    size = np.maximum(np.diff(at), 1)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    out = np.zeros((n_docs, len(MEASURES)))
    out[:, 0] = total(SYMBOL[b]) / size
    out[:, 1] = total(CAPITAL[b]) / size
    low = LOWER[b]
    word = ~SPACE[low]
    new = word.copy()
    new[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    new[first] = word[first]
    start = np.nonzero(new)[0]
    if not len(start):
        return out, np.zeros(n_docs, np.int64)
    gap = ~word
    gap[first] = True
    bounds = np.append(np.nonzero(gap)[0], len(b))
    stop = bounds[np.searchsorted(bounds, start, "right")]
    h = word_hash(low, start, stop)
    doc = np.searchsorted(at, start, "right") - 1
    n = np.bincount(doc, minlength=n_docs)
    words = np.maximum(n, 1)
    same = doc[1:] == doc[:-1]
    out[:, 2] = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n_docs) / words

    def runs(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and size of each group of equal keys of a document."""
        order = np.lexsort((keys, of))
        k, d = keys[order], of[order]
        edge = np.nonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]))[0]
        return d[edge], np.diff(np.append(edge, len(k)))

    d, count = runs(h, doc)
    out[:, 3] = 1 - np.bincount(d, minlength=n_docs) / words
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, d, count)
    out[:, 4] = top / words
    out[:, 5] = np.bincount(doc, stop - start, n_docs) / words
    if len(h) > 4:
        full = np.nonzero(doc[4:] == doc[:-4])[0]
        five = sum((h[full + i] * np.uint64(2 * i + 3) for i in range(5)), np.zeros(len(full), np.uint64))
        d, count = runs(mix(five), doc[full])
        out[:, 6] = np.bincount(d, np.where(count > 1, count, 0), n_docs) / words
    return out, n


def votes(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 nothing, by document and labeller."""
    out = np.full((len(n), len(LABELLERS)), 2, np.int8)
    for i, (name, good, bad, least) in enumerate(LABELLERS):
        v = values[:, MEASURES.index(name)]
        out[(v < good) & (n >= least), i] = 1
        out[(v >= bad) & (n >= least), i] = 0
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ 3 ** np.arange(v.shape[1])


@dataclass
class LabelModel:
    good: float
    says: np.ndarray  # (labeller, truth, vote): probabilities of bad and good, given that it votes; silence says nothing

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good, by row of votes."""
        log = np.log([1 - self.good, self.good])[None, :].repeat(len(v), 0)
        for i in range(v.shape[1]):
            log = log + np.concatenate([np.log(self.says[i]), np.zeros((2, 1))], 1)[:, v[:, i]].T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Labellers' accuracies from how often each pattern of votes occurs; labellers start as better than chance."""
    k = patterns.shape[1]
    says = np.tile(np.array([[0.5, 0.5], [0.05, 0.95]]), (k, 1, 1))
    model = LabelModel(0.8, says)
    total = counts.sum()
    for _ in range(rounds):
        p = model.posterior(patterns)
        weight = np.stack([(1 - p) * counts, p * counts])
        new = np.empty_like(says)
        for i in range(k):
            for vote in range(2):
                new[i, :, vote] = weight[:, patterns[:, i] == vote].sum(1)
            new[i] += np.array([[2.0, 2.0], [0.1, 9.9]])  # a prior that fixes which class is which
            new[i] /= new[i].sum(1, keepdims=True)
        good = float(np.clip((weight[1].sum() + 0.8 * PRIOR_DOCS) / (total + PRIOR_DOCS), 0.02, 0.98))
        done = abs(good - model.good) < 1e-9 and np.abs(new - model.says).max() < 1e-9
        model = LabelModel(good, new)
        if done:
            break
    return model


def bucket_ids(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashed features of the measures: one bucket each, and one of the length."""
    edges = [*(np.array([good * 0.3, good, (good + bad) / 2, bad, bad * 1.5, bad * 2.5]) for _, good, bad, _ in LABELLERS), np.array([1, 5, 12, 25, 60, 200, 1000])]
    columns = [*(values[:, MEASURES.index(name)] for name, *_ in LABELLERS), n]
    short = np.digitize(n, [12, 25])
    return np.stack([(i * 977 + np.digitize(c, e) * 31 + short * 389) % BUCKETS for i, (c, e) in enumerate(zip(columns, edges, strict=True))], 1)


def trigram_ids(b: np.ndarray) -> np.ndarray:
    x = LOWER[b].astype(np.uint32)
    return ((x[:-2] * 0x1F35 + x[1:-1] * 0x3D4D51 + x[2:] * 0x9E3779B1) >> np.uint32(8)) % TRIGRAMS if len(x) > 2 else np.zeros(0, np.uint32)


@dataclass
class Scorer:
    buckets: np.ndarray
    trigrams: np.ndarray
    bias: float = 0.0

    def scores(self, b: np.ndarray, at: np.ndarray, values: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability of good, by document."""
        z = self.buckets[bucket_ids(values, n)].sum(1) + self.bias
        size = np.diff(at)
        sums = np.concatenate([[0.0], np.cumsum(self.trigrams[trigram_ids(b)])])
        last = np.maximum(at[1:] - 2, at[:-1])
        z += (sums[np.minimum(last, len(sums) - 1)] - sums[np.minimum(at[:-1], len(sums) - 1)]) / np.maximum(size - 2, 1)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _shares(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, trigram and its share of each text's trigrams."""
    rows, cols, shares = [], [], []
    for i, t in enumerate(texts):
        tri = trigram_ids(np.frombuffer(t, np.uint8))
        col, count = np.unique(tri, return_counts=True)
        rows.append(np.full(len(col), i, np.int32))
        cols.append(col.astype(np.int32))
        shares.append((count / max(len(tri), 1)).astype(np.float32))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(shares)


def fit_scorer(texts: list[bytes], values: np.ndarray, n: np.ndarray, target: np.ndarray, rounds: int = 250, rate: float = 0.5) -> Scorer:
    """Logistic regression on posterior labels by full-batch gradients with a per-weight step."""
    docs = len(n)
    ids = bucket_ids(values, n)
    row, col, share = _shares(texts)
    scorer = Scorer(np.zeros(BUCKETS), np.zeros(TRIGRAMS))
    seen = [np.full(BUCKETS, 1e-3), np.full(TRIGRAMS, 1e-6)]
    for _ in range(rounds):
        z = scorer.buckets[ids].sum(1) + scorer.bias + np.bincount(row, share * scorer.trigrams[col], docs)
        off = (1 / (1 + np.exp(-z)) - target) / docs
        for weights, g, s in ((scorer.buckets, np.bincount(ids.ravel(), np.repeat(off, ids.shape[1]), BUCKETS), seen[0]), (scorer.trigrams, np.bincount(col, off[row] * share, TRIGRAMS), seen[1])):
            g += 1e-5 * weights
            s += g * g
            weights -= rate * g / np.sqrt(s)
        scorer.bias -= rate * off.sum()
    return scorer


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in slices(batches, "text"):
        p, k = np.unique(pattern(votes(*measures(*utf8(batch.column(0))))), return_counts=True)
        for x, y in zip(p.tolist(), k.tolist(), strict=True):
            counts[x] = counts.get(x, 0) + y
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


def sample(rows: DataFrame) -> list[bytes]:
    """Different texts with the smallest hashes: at most 1.5 * SAMPLE_DOCS and, but for the first, SAMPLE_BYTES.

    Texts over an eighth of these bytes come after all others. Copies count once and the order of rows does not matter: what is chosen
    follows from hashes and lengths, before a text is read.
    """
    h, n = F.xxhash64("text"), F.octet_length("text")
    hashed = rows.filter("text is not null").select("text", n.alias("n"), F.struct((n > SAMPLE_BYTES // 8).alias("long"), h.alias("h")).alias("place"))
    keys = hashed.select("place.long", "place.h", "n").distinct().orderBy("long", "h").limit(int(1.5 * SAMPLE_DOCS)).toPandas()
    if not len(keys):
        return []
    last = keys[(keys["n"].cumsum() <= SAMPLE_BYTES) | (keys.index == 0)].iloc[-1]
    chosen = hashed.filter(F.col("place") <= F.struct(F.lit(bool(last["long"])).alias("long"), F.lit(int(last["h"])).cast("bigint").alias("h"))).dropDuplicates(["place"])
    return [row.text.encode() for row in sorted(chosen.collect(), key=lambda r: tuple(r.place))]


def train(docs: DataFrame) -> tuple[LabelModel, Scorer]:
    """Label model from the vote patterns of all documents, scorer from a bounded sample of their different texts (smallest hashes)."""
    rows = docs.select("text")
    found = rows.mapInArrow(lambda b: trimmed(_patterns(b)), "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()  # at most 3 ** len(LABELLERS)
    kinds = np.array(list(itertools.product(range(3), repeat=len(LABELLERS))), np.int8)[:, ::-1]
    model = expectation_maximisation(kinds[found["pattern"].to_numpy(int)], found["n"].to_numpy(float)) if len(found) else LabelModel(0.5, np.full((len(LABELLERS), 2, 2), 0.5))
    texts = sample(rows)
    if not len(texts):
        return model, Scorer(np.zeros(BUCKETS), np.zeros(TRIGRAMS))
    got = []
    for i in range(0, len(texts), 200):
        some = texts[i : i + 200]
        got.append(measures(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)))
    values, count = (np.concatenate(x) for x in zip(*got, strict=True))
    return model, fit_scorer(texts, values, count, model.posterior(votes(values, count)))


def _score(batches: Iterator[pa.RecordBatch], model: LabelModel, scorer: Scorer, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        b, at = utf8(batch.column(batch.schema.get_field_index("text")))
        values, n = measures(b, at)
        score = scorer.scores(b, at, values, n)
        more = [pa.array(score), pa.array(model.posterior(votes(values, n))), pa.array(score >= threshold)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "quality_score", "weak_posterior", "quality_kept"])


def score_quality(docs: DataFrame, models: tuple[LabelModel, Scorer], threshold: float = 0.3) -> DataFrame:
    """docs with quality_score (probability of good), weak_posterior (by votes alone) and quality_kept.

    Whole texts are measured; null and empty ones have no words and get the score of a text on which no labeller
    votes. Equal texts have equal scores; an empty table gives no rows. Columns of docs that already have one
    of the new names are dropped.
    """
    docs = docs.drop("quality_score", "weak_posterior", "quality_kept")
    more = [T.StructField("quality_score", T.DoubleType()), T.StructField("weak_posterior", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())]
    return docs.mapInArrow(lambda b: trimmed(_score(b, *models, threshold)), T.StructType(docs.schema.fields + more))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train(docs)).select("doc_id", "quality_score", "weak_posterior", "quality_kept")
