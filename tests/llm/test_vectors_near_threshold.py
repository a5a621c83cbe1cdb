"""Vectors as near the threshold as doubles can tell, and as far as 16-bit steps can, against plain cosines."""

import numpy as np
import pytest

from tallyforge.llm.neardup_vectors import near_duplicate_vectors


@pytest.mark.parametrize("kind", ["float", "double"])
def test_doubtful_pairs_are_decided_exactly(spark, kind):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 16))
    rows = []
    for b in base:
        b = b / np.linalg.norm(b)
        side = rng.normal(size=16)
        side -= b * (side @ b)
        side /= np.linalg.norm(side)
        rows.append(b * 3)
        for cos in (0.98, 0.98 + 1e-9, 0.98 - 1e-9, 0.98 + 2e-5, 0.98 - 2e-5, 0.9805, 0.9795, 0.999):
            rows.append((b * cos + side * np.sqrt(1 - cos * cos)) * 0.7)
    x = np.array(rows, np.float32 if kind == "float" else np.float64)
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)] + [(1000 + i, x[i].tolist(), 1) for i in range(3)], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df, recall=0.9999999).collect()}
    every = [*ids, 1000, 1001, 1002]
    u = np.concatenate([x, x[:3]]).astype(np.float64)
    u = u / np.abs(u).max(1, keepdims=True)
    u = u / np.sqrt((u * u).sum(1, keepdims=True))
    near = np.array([[(a * b).sum() >= 0.98 for b in u] for a in u])
    for i, one in enumerate(every):
        assert got[one][0] == near[i].sum() - 1
    group = dict(zip(every, every, strict=True))
    for _ in every:
        for i, one in enumerate(every):
            group[one] = min(group[every[j]] for j in np.nonzero(near[i])[0])
    assert {k: c for k, (_, c) in got.items()} == group
