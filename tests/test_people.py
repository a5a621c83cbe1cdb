"""Names of a register, masked by joins, against one alternation of all of them."""

import random

from pyspark.sql import functions as F

from tallyforge.functions import core as c
from tallyforge.operators import people
from tallyforge.operators.people import mask_people, register


def test_as_one_alternation_of_all_names(spark):
    r = random.Random(5)
    parts = ["Ann", "anna", "Lee", "O'Neil", "Émile", "de", "la", "Cruz-Diaz", "J.", "李小龙", "x_y", "Bo", "Marie", "\\E", "a.b"]
    names = [" ".join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(60)] + ["  Ann Lee  ", "ANN", None, "", "Al"]
    texts = ["".join(r.choice([*parts, "hat", "Lee's", "annax"]) + r.choice([" ", " ", "", ", ", "\n", "-"]) for _ in range(r.randrange(30))) for _ in range(150)] + ["", None, "  ", "ANN LEE and anna", "Ann Lee"]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "id int, text string, name string").repartition(4)
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = {x.id: (x.text, x.person_hit, x.name) for x in mask_people(df, "text", known).collect()}
    plain = c.name_pattern([n for n in names if n])
    want = df.select("id", F.regexp_replace("text", plain, "[REDACTED:PERSON]").alias("m"), "text").collect()
    assert got == {x.id: (x.m, x.m != x.text if x.text is not None else False, "keep") for x in want}
    assert sum(x[1] for x in got.values()) > 50


def test_empty_registers_and_anchors(spark):
    df = spark.createDataFrame([(1, "Ann Lee")], "id int, text string")
    none = spark.createDataFrame([], "name string")
    assert mask_people(df, "text", none).collect() == [(1, "Ann Lee", False)]
    assert mask_people(df.limit(0), "text", none).count() == 0
    known = {x.name: x.anchor for x in register(spark.createDataFrame([("Maria Lopez",), ("maria Cruz",), ("Maria",)], "name string")).collect()}
    assert known == {"maria lopez": "lopez", "maria cruz": "cruz", "maria": "maria"}


def test_both_ways_of_a_register(spark, monkeypatch):
    """A register too large to go along gives the same; one that goes along leaves a text's words where they are but those of longer names."""
    df = spark.createDataFrame([(1, "Ann met Ann Lee, Lee and Bo"), (2, None), (3, "lee ann"), (4, "")], "id int, text string")
    known = spark.createDataFrame([("Ann",), ("Ann Lee",), ("Bob",)], "name string")
    small = mask_people(df, "text", known)
    assert small._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 1
    got = sorted(small.collect())
    monkeypatch.setattr(people, "BROADCAST_ROWS", 0)
    assert sorted(mask_people(df, "text", known).collect()) == got == [(1, "[REDACTED:PERSON] met [REDACTED:PERSON], Lee and Bo", True), (2, None, False), (3, "lee [REDACTED:PERSON]", True), (4, "", False)]
