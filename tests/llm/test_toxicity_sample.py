"""The toxicity model's sample follows from ids and lengths alone."""

from pyspark.sql import functions as F

from tallyforge.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_order_and_partitions_do_not_matter(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = [r.doc_id for r in labels.filter(~toxicity.held_out(F.col("doc_id")) & (F.col("toxic") == 0)).select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").collect()]
    for chars in (1, 20_000, 10**9):
        monkeypatch.setattr(toxicity, "SAMPLE_CHARS", chars)
        want, size = [], 0
        for i in ids:
            size += len(texts[i])
            if want and size > chars:
                break
            want.append(texts[i])
        for way in (docs, docs.repartition(5), docs.orderBy(F.desc("doc_id"))):
            assert toxicity._sample(way, labels, 0, 10**6) == want
    assert toxicity._sample(docs.limit(0), labels, 0, 10) == []


def test_scores_against_a_plain_count(spark):
    """Brute force: a document's cell is the number of its words that the toxic dictionary shortens, by distances of one word at a time."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    measure = model.distances()
    for r in toxicity.score_toxicity(docs.select("doc_id", "text"), model).limit(60).collect():
        strong, hits, distance = measure.document(r.text or "")
        assert (r.score, r.hits, r.distance, r.predicted) == (model.score(strong, hits), hits, distance, int(r.score >= 0.3))
        alone = [measure.document(w) for w in (r.text or "").split()]
        assert hits == sum(h for _, h, _ in alone) and distance == max((d for *_, d in alone), default=0)
