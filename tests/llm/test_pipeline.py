"""The pipeline's stages against plain versions, each on its own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import duckdb
import pandas as pd
import numpy as np
from test_operators import brute_kept, check_packing, shingle_set

from tallyforge.llm import quality, toxicity
from tallyforge.llm.components import Forest
from tallyforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def quality_alone(models, text):
    raw = (text or "").encode()
    b, at = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    return models[1].scores(b, at, *quality.measures(b, at))[0]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(2)
    kinds = docs.schema
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs_before = {r.doc_id: r.text for r in docs.collect()}, docs
        out = stage(spark, docs, SF)
        if number < 4:
            assert out.schema == kinds
            rows = out.collect()
            after = {r.doc_id: r.text for r in rows}
            assert len(rows) == len(after) and set(after) <= set(before)
            docs = spark.createDataFrame(rows, kinds)
        if number == 0:  # every document judged by itself
            models = quality.train(docs_before)
            one = {i: quality_alone(models, t) for i, t in before.items()}
            assert set(after) == {i for i, score in one.items() if score >= 0.3}
        if number == 1:
            model = toxicity.train(docs_before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {i for i, t in before.items() if model.score(*model.distances().document(t or "")[:2]) < 0.3}
        if number == 2:
            sets, forest = {i: shingle_set(t, 5) for i, t in before.items()}, Forest()
            for a in sets:
                for b in sets:
                    if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        forest.union(a, b)
            assert set(after) == {i for i in sets if forest.root(i) == i}
        if number == 3:
            ids = sorted(before)
            kept = brute_kept([(before[i] or "").encode() for i in ids], 200)
            assert {i: after[i] or "" for i in ids} == {i: k.decode("utf-8", "ignore") for i, k in zip(ids, kept, strict=True)}
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None and r.text != before[r.doc_id])
        if number == 4:
            check_packing(out.toPandas().rename(columns={"doc_id": "key"}), before, 2048)


def test_stages_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_stand_odd_rows(spark):
    """Null ids and texts, repeated rows, one id with two texts, clashing and further columns, a long text."""
    long = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
    prose = " ".join(f"the plain sentence number {i} says something else again" for i in range(12))
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (1, "quite another text that has this very id, and nothing in common with the first", "en", "a", 2), (2, None, "en", None, None), (3, "", None, "a", 0), (None, "no id at all, but a plain text of its own", "en", "a", 3), (4, long, "en", "a", 4)]
    docs = spark.createDataFrame([(*r, "clash", 1.5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, node double, marks string").repartition(3)
    (_, quality_stage), (_, toxicity_stage), (_, near_stage), (_, repeats_stage), (_, packing_stage) = corpus_pipeline.STAGES
    for stage in (quality_stage, toxicity_stage):
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema
        kept = [tuple(r)[:2] for r in out.collect()]
        assert {(2, None), (3, ""), (None, rows[5][1])} <= set(kept) and kept.count((1, prose)) in (0, 2)
    near = sorted((str(r.doc_id), str(r.text)[:20]) for r in near_stage(spark, docs, SF).collect())
    assert near == sorted((str(i), str(t)[:20]) for i, t, *_ in {r[:2]: r for r in rows}.values())
    cut = {(r.doc_id, r.source, r.n_chars): r.text for r in repeats_stage(spark, docs, SF).collect()}
    assert cut[2, None, None] is None and cut[3, "a", 0] == "" and cut[1, "a", 0] == "" and len(cut[1, "a", 2]) > 50
    assert packing_stage(spark, docs, SF).select("doc_id", "doc_tokens").distinct().filter("doc_id is null or doc_tokens = 1").count() == 3


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark", "clicks"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    mine = QUERIES[name](spark, SF)
    cols = sorted(mine.columns)
    theirs = con.sql(ORACLES[name]).df()[cols]
    key = lambda row: [None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in row]
    rows = lambda df: sorted(repr(key(r)) for r in df.astype(object).itertuples(index=False, name=None))
    assert rows(mine.select(cols).toPandas()) == rows(theirs)
