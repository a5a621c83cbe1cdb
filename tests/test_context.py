"""The whole context: trips, claims, conflicts, tenures and names over an invented fleet."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyforge.operators.context import save_context
from tallyforge.plans.context_build import build_full, claims_of
from tallyforge.plans.decision import Rulebook
from tallyforge.sources import names


def test_all_sources_meet(spark, tmp_path):
    fleet = spark.createDataFrame([("V1", None, 2019, "f#1"), ("V1", "M-1", 2021, "f#2"), ("V2", "M-2", 2020, "f#3")], "reg_key string, vehicle_id string, year int, citation string")
    for name, kind in (("model", "string"), ("bs_stage", "string"), ("engine_heater", "boolean"), ("home_hub", "string"), ("capacity_tonnes", "double"), ("status", "string")):
        fleet = fleet.withColumn(name, F.lit(None).cast(kind))
    day = lambda n: dt.date(2025, 1, n)
    log = spark.createDataFrame([("V1", day(1), 100.0, "l#1"), ("V1", day(2), None, "l#2"), ("V1", day(3), 90.0, "l#3"), ("V2", day(9), 5.0, "l#4"), ("V9", day(1), 1.0, "l#5")], "reg_key string, date date, odometer_km double, citation string")
    log = log.withColumns({k: F.lit(False) for k in ("jugaad", "brake_work", "permanent_repair")})
    trips = spark.createDataFrame([("V1", "A", "DONE", "2025-01-05"), ("V1", "A", "CANCELLED", "2025-01-02"), ("V1", None, "DONE", None), ("V7", "A", "DONE", "x"), (None, "B", "DONE", "y")], "reg_key string, client string, status string, dispatch_time string")
    drivers = spark.createDataFrame([("D1", dt.date(2024, 1, 20)), ("D2", None)], "driver_id string, joining_date date")
    mails = spark.createDataFrame([("a.txt", "Gate", "Open at eight", ["10 Feb 2025", "soon"], "k1")], "file string, subject string, body string, dates array<string>, claim_key string")
    roads = spark.createDataFrame([("North", "South", 1.0)], "hub string, other string, km double")
    people = names.of_column(spark.createDataFrame([("Mira Bo",)], "who string"), "who")
    full = build_full(fleet, log, trips, drivers, roads, mails, Rulebook(), [people])
    got = {r.reg_key: r for r in full.vehicles.collect()}
    assert (got["V1"].year, got["V1"].citations, got["V1"].year_conflict, got["V1"].odometer_trusted, got["V2"].odometer_trusted) == (2021, ["f#1", "f#2"], True, False, True)
    assert (got["V1"].trips.total, got["V1"].trips.cancelled, got["V1"].trips.by_client, got["V1"].trips.last) == (3, 1, {"A": 2}, "2025-01-05") and got["V2"].trips.total == 0
    assert full.orphans == {"maintenance": 1, "trips": 2} and full.as_of == "2025-02-10"
    assert {r.driver_id: r.tenure_months for r in full.drivers.collect()} == {"D1": 12, "D2": None}
    assert {(r.reg_key, r.field, r["values"]) for r in full.conflicts.collect()} == {("V1", "year", "2019|2021"), ("V1", "odometer_km", "100.0>90.0")}
    assert [r.name for r in full.names.collect()] == ["Mira Bo"]
    saved = {r.source: r.n_rows for r in save_context(full.snapshot(), str(tmp_path / "context")).collect()}
    assert saved == {"vehicles": 2, "drivers": 2, "email_claims": 1, "conflicts": 2}


def test_claims_as_a_plain_fold(spark):
    r = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    bodies = [" ".join(r.sample(words, 14)) for _ in range(6)]
    rows = []
    for i in range(60):
        body = r.choice(bodies).split()
        if r.random() < 0.5:
            body[r.randrange(14)] = r.choice(words)
        rows.append((f"m{i:03}", r.choice(["one", "two"]), " ".join(body)))
    df = spark.createDataFrame(rows, "file string, subject string, body string").withColumn("claim_key", F.sha2("body", 256))
    want = []
    for subject in ("one", "two"):
        groups: dict = {}
        for f, s, b in sorted(rows):
            if s == subject:
                groups.setdefault(b, []).append(f)
        leaders: list = []
        for b, files in sorted(groups.items(), key=lambda x: x[1][0]):
            tokens = set(b.split())
            for lead in leaders:
                if len(tokens & lead[0]) / len(tokens | lead[0]) >= 0.85:
                    lead[1].extend(files)
                    break
            else:
                leaders.append((tokens, list(files)))
        want += [(subject, sorted(files)) for _, files in leaders]
    assert sorted((x.subject, x.files) for x in claims_of(df).collect()) == sorted(want)
