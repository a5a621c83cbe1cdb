"""Operators against DuckDB on the driver's tables, and functions against literals."""

import datetime as dt
import glob
import hashlib
import hmac
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import core as c
from tallyforge.operators import dedup, emit, resolve
from tallyforge.plans import bindings, case_bindings, more_bindings, source_bindings  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or v != v:
        return None
    return v if isinstance(v, (bool, str)) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = bindings.QUERIES[name](spark, SF)
    rel = duck.sql(bindings.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(r[x]) for x in cols]) for r in df.collect())
    theirs = sorted(repr([plain(v) for v in row]) for row in rel.df()[cols].itertuples(index=False, name=None))
    assert mine == theirs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_pseudonym_is_hmac(spark):
    for key in (b"k", b"y" * 64, b"z" * 100):
        want = "PERSON-" + hmac.new(key, b"PERSON:ANN LEE", hashlib.sha256).hexdigest()[:10].upper()
        assert one(spark, c.pseudonym("v", "PERSON", key), v=" Ann  lee ") == want


@pytest.mark.parametrize(("text", "iso", "ok", "form"), [
    ("2026-03-02T07:00:00Z", "2026-03-02T07:00:00", True, "iso"), ("2026-03-02", "2026-03-02T00:00:00", True, "iso_date_only"), ("2/3/2026 7:05", "2026-03-02T07:05:00", True, "dd/mm/yyyy"),
    ("31/02/2026", "2026-02-31T00:00:00", False, "dd/mm/yyyy"), ("1700000000", "2023-11-14T22:13:20", True, "epoch_s"), ("1700000000000", "2023-11-14T22:13:20", True, "epoch_ms"), ("soon", None, False, "unparseable"), ("", None, False, "empty"),
])
def test_timestamps(spark, text, iso, ok, form):
    x = one(spark, c.timestamp_of("v"), v=text)
    assert (x.iso, x.ok, x.form) == (iso, ok, form)


def test_redaction_and_gate(spark):
    text = "Ann at ann.lee@example.org, 1234 5678 9012, +91 98765 43210, 9876543210, HR16 20128663605"
    r = one(spark, c.redact("v", names=("Ann",)), v=text)
    assert r.hits == ["AADHAAR", "DL_NUMBER", "EMAIL", "PERSON_NAME", "PHONE"]
    assert not any(d in r.text for d in ("9876", "1234", "@", "Ann "))
    assert one(spark, c.violations("v", allow=("ops@example.org",)), v="ops@example.org") == []
    with pytest.raises(emit.GateError):
        emit.gate(spark.createDataFrame([("a@example.org",)], "x string"), "out")


def test_small_functions(spark):
    assert one(spark, c.months_between("a", "b"), a="2024-01-31", b="2024-02-28") == 0
    assert one(spark, c.padded_hours(F.lit(36), 20), v="") == math.ceil(36 * 1.2) == 44
    assert one(spark, c.js_number(F.lit(25.0)), v="") == "25"
    assert one(spark, c.js_number(F.lit(2.5)), v="") == "2.5"
    assert one(spark, c.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), v="") == 1.0
    assert one(spark, c.kilometres("v"), v=" -4.5 km") == -4.5


def test_leader_clusters_are_greedy(spark):
    r = random.Random(3)
    edges = sorted({(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(45)) if a < b} | {(50, 51), (51, 52), (52, 53)})
    members = spark.createDataFrame([(i, i) for i in range(60)] + [(100, 52)], "id long, rep long")
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "id_a long, id_b long, similarity double")
    leads = {}
    for i in range(60):
        leads[i] = min((a for a, b in edges if b == i and leads[a] == a), default=i)
    assert {r.id: r.leader for r in dedup.leader_clusters(members, pairs).collect()} == leads | {100: leads[52]}


def test_as_of_state_over_slices(spark):
    """Slices of time change nothing: every unit gives what a plain look back gives, ties and nulls included."""
    r = random.Random(5)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(days=r.randrange(400), hours=r.randrange(3))
    probes = [(i, r.choice("ab"), day() if i % 17 else None) for i in range(150)]
    events = [(r.choice("ab"), day() if i % 13 else None, bool(i % 3)) for i in range(200)] + [("a", probes[1][2], True)]
    p, e = spark.createDataFrame(probes, "id int, k string, at timestamp"), spark.createDataFrame(events, "k string, seen timestamp, flag boolean")
    want = {i: max((s for kk, s, f in events if kk == k and f and s is not None and at is not None and s <= at), default=None) for i, k, at in probes}
    for unit in ("day", "month", "year"):
        assert {x.id: x.last for x in resolve.as_of_state(p, e, "k", "at", "seen", {"last": F.col("flag")}, unit).collect()} == want
