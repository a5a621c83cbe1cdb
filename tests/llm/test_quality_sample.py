"""The scorer's sample does not depend on the order of rows, on copies or on one very long text."""

from tallyforge.llm import quality


def test_sample_follows_hashes(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 40_000)
    texts = [f"{lang} text {i} " + "word " * 50 for lang in ("de", "en", "fr") for i in range(300)]
    rows = lambda t: spark.createDataFrame([(x,) for x in t], "text string")
    got = quality.sample(rows([*texts, None, ""]))
    assert got == quality.sample(rows([None, "", *reversed(texts)])) and len(got) == len(set(got)) and sum(map(len, got)) <= 40_000
    assert len(got) > 130 and {x[:2] for x in got if x} == {b"de", b"en", b"fr"}
    assert set(quality.sample(rows([*[got[-1].decode()] * 500, *texts, "", "x" * 50_000]))) == set(got)
    assert quality.sample(rows([None])) == []
    assert quality.sample(rows(["x" * 50_000])) == [b"x" * 50_000]
