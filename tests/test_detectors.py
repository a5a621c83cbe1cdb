"""Detectors look once at a text: same findings, and plans that do not work the text out again for each of them."""

from pyspark.sql import functions as F

from tallyforge.functions import core as c
from tallyforge.operators import emit
from tallyforge.sources import registers

TEXTS = ["", None, "none", "a@b.co", "ops@depot.example", "id 1234 5678 9012.", "hr16 20128663605", "HR-16-20128663605 a@b.co", "call +91 98765 43210", "9876543210 now", "91-9876543210", "1234 5678 901", "x@y", "12345\n67890", "5.9876543210", "Ann 9876543210",
         "brake job", "brakes", "brakepad", "padlock", "a pad.", "Temporary Fix", "replaced drum", "naya lagwaya jugaad", "Road test OK", "brake pad under warranty", "rebrake pads"]


def plainly(text, allow=(), names=()):
    """As each detector by itself says."""
    for a in allow:
        text = F.replace(text, F.lit(a), F.lit(" "))
    found = [F.when(text.rlike(p), k) for k, p in [*c.DETECTORS, *([("PERSON_NAME", c.name_pattern(names))] if names else [])]]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def test_findings_are_those_of_single_detectors(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string")
    for more in ({}, {"allow": ("ops@depot.example",)}, {"names": ("Ann",)}):
        assert [r[0] == r[1] for r in df.select(c.violations("v", **more), plainly(F.col("v"), **more)).collect()] == [True] * len(TEXTS)
    n = F.lower(F.coalesce("v", F.lit("")))
    flags = c.note_flags("v")
    assert all(r[0] == r[1] for k in ("jugaad", "brake_work", "road_tested", "under_warranty") for r in df.select(flags[k], n.rlike(c.NOTE_MARKERS[k])).collect())
    assert [r[0] for r in df.select(c.redacted_text("v", names=("Ann",))).collect()] == [r[0] for r in df.select(c.redact("v", names=("Ann",))["text"]).collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_gated_row_is_made_once(spark):
    """Before, the row's JSON stood in the plan once for each detector, in the filter and again in the result."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, v string")
    report = emit.gate_report(df, "id", allow=["ops@depot.example"])
    assert plan(report).count("evaluate(struct(") == 1 and "lambda" not in plan(report)
    want = df.select("id", plainly(F.regexp_replace("v", "\n", " "), allow=["ops@depot.example"]).alias("kinds")).filter(F.size("kinds") > 0)
    assert sorted(report.collect()) == sorted(want.collect())


def test_notes_are_masked_without_lambdas(spark):
    rows = spark.createDataFrame([("ab-1", "2020-01-01", "5", "m", t, i, "f") for i, t in enumerate(TEXTS)], "vehicle string, date string, odometer_km string, mechanic string, notes string, _row int, _source string")
    assert "lambda" not in plan(registers.maintenance(rows, b"k")[0])
