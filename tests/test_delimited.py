"""Delimited text as columns against the plain reading, one character after the other."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import delimited

ODD = ["", "\n", "\r\n", "\n\n", ",", ",\n", '"', '""', '"""', '""""', '"a""', 'a"b,c"d,e', '"x\n', '"x\ny",z', "\ufeffa,b\r\n1,2", 'a,""\n""', "\r", '"a"\r"b"', "a\n\r", '"\r"', " a , b \n\n \n1,2,3\n4"]


def made(n: int, alphabet: str, longest: int) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("delimiter", [",", "|", "\t", ";", "^", "]", "\\"])
def test_rows_equal_the_plain_reading(spark, delimiter):
    texts = [x.replace(",", delimiter) for x in ODD + made(600, 'ab,"\r\n ', 24)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    by_column = df.withColumn("d", F.lit(delimiter)).select("id", delimited.rows_of("value", delimiter).alias("rows"), delimited.rows_of("value", F.col("d")).alias("again"))
    for r in by_column.collect():
        assert r.rows == list(delimited.parse_rows(texts[r.id], delimiter)) == r.again, texts[r.id]


def test_long_quoted_text_and_null(spark):
    long = "a," + '"' + 'x""\n' * 300_000 + '"' + "\n" + "b," * 200_000
    got = spark.createDataFrame([(long,), (None,)], "value string").select(delimited.rows_of("value").alias("rows")).collect()
    assert got[0].rows == list(delimited.parse_rows(long)) and got[1].rows is None


def test_records_equal_the_plain_reading(spark, tmp_path):
    texts = ["h1, h2\n1\n\n2,3,4\n", "h2,h1,h2\n1,2,3\n , \n\u00a0\n5", "", "h1\n", '\ufeff"h1",h3\n"a\n b" ,"c"', *("h1,h2\n" + x for x in [x.lstrip("\ufeff") for x in ODD] + made(300, 'ab,"\r\n ', 24))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    got = sorted((tuple(r) for r in delimited.records_of(df, ["h1", "h2"]).collect()), key=lambda r: (r[0], r[3]))
    want = [(i, r.get("h1"), r.get("h2"), r["_row"], r.get("_extra")) for i, x in enumerate(texts) for r in delimited.parse_records(x, "f")]
    assert got == want
    (tmp_path / "a.csv").write_text("h1;h2\n1;2\n")
    (tmp_path / "b.csv").write_text("h1|h2\n3\n")
    assert sorted(map(tuple, delimited.read_irregular(spark, str(tmp_path), ["h1", "h2"]).collect())) == [("1", "2", 2, "a.csv", None), ("3", "", 2, "b.csv", None)]
