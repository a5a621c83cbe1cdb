"""Whitening against fractions and a plain eigen decomposition."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from tallyforge.llm.whitening import exact_scatter, op13_embedding_whitening, whiten

SF = "/root/testdata/sf0.001"


def fractions(rows):
    """(n, sums, n XtX - S St, deviations) of lists of numbers, all exact."""
    x = [[floor(Fraction(c) * 64) + 1_000_000 for c in r] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    scatter = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, s, scatter, [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x], x


def hold(rows, usable, components):
    n, s, scatter, far, x = fractions([v for _, v in usable])
    d = len(s)
    cov = np.array([[float(Fraction(v, n * n)) for v in r] for r in scatter])
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, d)
    w = np.full((n, k), np.nan)
    place = {i: p for p, (i, _) in enumerate(usable)}
    for r in rows:
        p = place[r.vec_id]
        w[p, r.component - 1] = nan if r.whitened is None else r.whitened
        assert r.n == n and int(r.deviation_exact) == far[p] and r.deviation == (far[p] if far[p] < 2**63 else None)
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-6, abs=1e-13)
    good = ~np.isnan(w).any(0)
    z = w[:, good] - w[:, good].mean(0)
    off = np.abs(z.T @ z / n - np.eye(good.sum())).max(initial=0)
    assert off < 1e-6 and all(abs(r.identity_error - off) < 1e-9 for r in rows)
    y = np.array([[float(Fraction(n * v[i] - s[i], n)) for i in range(d)] for v in x])
    axes = np.linalg.lstsq(y, w[:, good], rcond=None)[0] * np.sqrt(values[:k][good])
    assert np.allclose(np.linalg.norm(axes, axis=0), 1, atol=1e-6)
    assert np.allclose(cov @ axes, axes * values[:k][good], atol=1e-6 * max(values))
    return good


def test_whole_table(spark):
    rows = op13_embedding_whitening(spark, SF).collect()
    usable = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert len(rows) == 32 * len(usable)
    assert hold(rows, usable, 32).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=5) * [1, 2, 0.5, 100, 3]]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [nan] * 5), (103, [inf, 0.0, 0.0, 0.0, 0.0]), (104, [])]
    df = spark.createDataFrame([(*r, 1) for r in good + bad], "vec_id bigint, embedding array<double>, component int").repartition(3)
    rows = whiten(df).collect()
    assert len(rows) == 5 * 60 and hold(rows, good, 32).all()
    far = [(i, [c * 1e13 for c in v]) for i, v in good]  # beyond 64 bits
    rows = whiten(spark.createDataFrame(far, "vec_id bigint, embedding array<double>")).collect()
    assert rows[0].deviation is None and hold(rows, far, 32).all()


def test_few_vectors_other_lengths_and_none(spark):
    rows = whiten(spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [3.0, 2.0, 1.0]), (3, [9.0]), (None, [8.0])], "vec_id bigint, embedding array<float>")).collect()
    three = sorted((r.component, r.vec_id, None if r.whitened is None else round(abs(r.whitened), 9), round(r.explained, 9)) for r in rows if r.vec_id in (1, 2))
    assert three == [(1, 1, 1.0, 1.0), (1, 2, 1.0, 1.0), (2, 1, None, 0.0), (2, 2, None, 0.0), (3, 1, None, 0.0), (3, 2, None, 0.0)]
    assert sorted((str(r.vec_id), r.n, round(abs(r.whitened), 9)) for r in rows if r.vec_id not in (1, 2)) == [("3", 2, 1.0), ("None", 2, 1.0)]
    same = whiten(spark.createDataFrame([(1, [5.0, 5.0])] * 3, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in same} == {(None, 0.0, 0, 0.0)} and len(same) == 6
    assert whiten(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<double>")).count() == 0


def test_scatter_of_large_numbers():
    rng = np.random.default_rng(1)
    for top in (10, 2**30, 2**52, 2**61):
        y = rng.integers(-top, top, (5000, 3))
        sums, cross = exact_scatter(y)
        plain = y.astype(object)
        assert sums == plain.sum(0).tolist() and [cross[i][j] for i in range(3) for j in range(i, 3)] == [(plain[:, i] * plain[:, j]).sum() for i in range(3) for j in range(i, 3)]
