"""Decisions over an invented fleet: incidents over batches, regions, ranking, waivers, and what a decision says of itself."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import resolve, select
from tallyforge.operators.ledger import Ledger
from tallyforge.plans.decision import Context, Rulebook, decide, outputs, run_batch
from tallyforge.sources import tickets

DAY = dt.date(2026, 3, 1)
BOOK = Rulebook(
    clients={"Acme": {"sla_hours": 48, "mailbox": "desk@acme.example"}, "Rota": {"sla_hours": 10}}, rotation={"client": "Rota"}, newest={"client": "Acme"}, always=("A-0",),
    rules={"R-011": {"name": "service", "citations": ["book#11"], "assumptions": ["A-11"]}, "R-010": {"citations": ["book#10"], "assumptions": ["A-10"]}, "R-013": {"citations": ["book#13"]}}, issues={"tyre burst": ("DEGRADED", "ROADSIDE")},
)


@pytest.fixture(scope="module")
def ctx(spark):
    fleet = [("AA01BB0001", 2021, "North"), ("AA01BB0002", 2022, "North"), ("AA01BB0003", 2019, "South"), ("AA01BB0004", 2023, "East")]
    vehicles = spark.createDataFrame([(k, y, "BS6", True, h, "Active") for k, y, h in fleet], "reg_key string, year int, bs_stage string, engine_heater boolean, home_hub string, status string")
    log = [("AA01BB0001", DAY, False, False, False, "log#1"), ("AA01BB0002", DAY, False, False, False, "log#2"), ("AA01BB0003", dt.date(2026, 2, 28), True, False, False, "log#3")]
    log = spark.createDataFrame(log, "reg_key string, date date, jugaad boolean, brake_work boolean, permanent_repair boolean, citation string")
    pairs = [("North", "South", 50.0), ("North", "East", 90.0), ("South", "North", 50.0), ("South", "East", 60.0), ("East", "North", 90.0), ("East", "South", 60.0)]
    drivers = spark.createDataFrame([("D1", dt.date(2020, 1, 1))], "driver_id string, joining_date date")
    places = spark.createDataFrame([("North", "up"), ("South", "down"), ("Lodge", "down"), ("East", "up")], "hub string, region string")
    return Context(vehicles, log, spark.createDataFrame(pairs, "hub string, other string, km double"), drivers, BOOK, places)


BASE = {"ticket_id": "T1", "created_at": "2026-03-02T07:00:00", "vehicle": "AA01BB0001", "driver_id": "D1", "origin_hub": "North", "km_from_origin_hub": 25, "destination": "South", "issue": "tyre burst", "severity": "MEDIUM", "client": "Acme"}


def batch(spark, folder, *records, name="queue.json"):
    (folder / name).write_text(json.dumps([BASE | r for r in records]))
    return tickets.read_tickets(spark, str(folder / name))


def made(ctx, spark, *records):
    rows = [BASE | {"created_iso": BASE["created_at"], "occurrences": 1, "citation": "queue#0"} | r for r in records]
    df = spark.createDataFrame([json.dumps(r) for r in rows], "string")
    kind = "ticket_id string, created_iso string, vehicle string, driver_id string, origin_hub string, km_from_origin_hub double, destination string, issue string, severity string, client string, occurrences int, citation string"
    return {r.ticket_id: r for r in decide(ctx, df.select(F.from_json("value", kind).alias("x")).select("x.*")).collect()}


def test_two_batches_are_one(spark, ctx, tmp_path):
    """The vehicle of an earlier incident of the client does not come, whether that ticket is in the batch or in the ledger."""
    one, two = {"client": "Rota", "ticket_id": "T1"}, {"client": "Rota", "ticket_id": "T2", "vehicle": "AA01BB0002", "created_at": "2026-03-03T07:00:00"}
    (tmp_path / "a").mkdir()
    whole = run_batch(ctx, batch(spark, tmp_path, one, two), Ledger(spark, str(tmp_path / "a" / "ledger")))
    parts = Ledger(spark, str(tmp_path / "b"))
    run_batch(ctx, batch(spark, tmp_path, one), parts)
    run_batch(ctx, batch(spark, tmp_path, one, two, name="more.json"), parts)
    said = lambda book: {r.ticket_id: (r.status, r.replacement and r.replacement.reg_key, [x.rule_id for x in r.failed_vehicle.blocking_rules]) for r in book.load("accepted").collect()}
    assert said(whole) == said(parts)
    assert said(whole)["T1"][:2] == ("DISPATCHED", "AA01BB0002") and said(whole)["T2"][0] == "ESCALATED_NO_VEHICLE"
    assert said(whole)["T2"][2] == ["R-006"]


def test_regions_bound_temporary_fixes(spark, ctx):
    """A fix of two days: within the home region, to an unknown place, and out of the region."""
    got = made(ctx, spark, *({"ticket_id": d, "origin_hub": "South", "destination": d} for d in ("Lodge", "Moon", "North")))
    assert {k: (r.replacement and r.replacement.reg_key) for k, r in got.items()} == {"Lodge": "AA01BB0003", "Moon": "AA01BB0003", "North": None}
    assert got["North"].hubs_examined[0].reasons[0].code == "R-012"


def test_waiver_goes_hub_by_hub(spark, ctx):
    """South is nearer, but its vehicle may not leave; East's has no history, so it is not fully eligible; a ticket that any hub may serve gets what lies beyond."""
    got = made(ctx, spark, {"ticket_id": "near", "origin_hub": "East", "vehicle": "AA01BB0004", "destination": "North"}, {"ticket_id": "far", "origin_hub": "East", "vehicle": "AA01BB0004", "destination": "North", "km_from_origin_hub": 51})
    near = got["near"].escalation
    assert (near.waiver_option.hub, near.waiver_option.km, near.waiver_option.reg_key, near.rule_that_would_be_waived) == ("North", 90.0, "AA01BB0002", "R-010")
    assert [(h.hub, h.considered, h.n_eligible, h.n_rejected) for h in got["near"].hubs_examined] == [("East", 1, 0, 1)]
    assert (got["far"].replacement.from_hub, got["far"].escalation) == ("North", None)
    assert [h.hub for h in got["far"].hubs_examined] == ["East", "South", "North"]


def test_a_decision_explains_itself(spark, ctx, tmp_path):
    book = run_batch(ctx, batch(spark, tmp_path, {"origin_hub": "South", "km_from_origin_hub": 60, "vehicle": "AA01BB0003"}, {"origin_hub": "South", "km_from_origin_hub": 60, "vehicle": "AA01BB0003", "resolution_note": "x"}), Ledger(spark, str(tmp_path / "ledger")))
    row = book.load("accepted").first()
    assert row.replacement.reg_key == "AA01BB0002" and row.replacement.rests_on_assumption and [c.rule_id for c in row.replacement.derived_checks] == ["R-011"]
    assert {"book#10", "book#11", "log#2", "log#3"} <= set(row.citations) and "book#13" not in row.citations  # its driver's rule does not apply by day
    assert row.assumptions_used == ["A-0", "A-10", "A-11"]
    assert [(a.step, a.rule_id) for a in row.actions] == [(1, None), (2, "R-010")]
    assert (row.failed_vehicle.open_fix.citation, [x.rule_id for x in row.failed_vehicle.blocking_rules]) == ("log#3", [])
    trail = [json.loads(x) for x in outputs(ctx, book)["audit"][0].orderBy("seq").toJSON().collect()]
    assert [r["seq"] for r in trail] == list(range(1, len(trail) + 1))
    assert [r["step"] for r in trail if r["step"] != "RULE_EVALUATED"] == ["INGESTED", "VALIDATED", "DEDUPLICATED", "CLASSIFIED", "REPLACEMENT_SOURCING", "REPLACEMENT_SELECTED", "WORK_ORDER_EMITTED", "COMMS_DRAFTED"]
    assert [r["rule_id"] for r in trail if r["step"] == "RULE_EVALUATED"] == ["R-004", "R-009", "R-005", "R-008", "R-013", "R-000", "R-001", "R-002", "R-003", "R-006", "R-007", "R-011", "R-012"]


def test_packed_ranks_order_like_structs(spark):
    r = random.Random(1)
    rows = [(i, r.random() < 0.5, r.random() < 0.5, r.random() < 0.5, r.choice([None, 0, 3]), r.choice([None, 0, 1999, 2020, 65535])) for i in range(300)]
    df = spark.createDataFrame(rows, "n long, e boolean, d boolean, c boolean, h long, y int")
    args = [F.col(x) for x in "edchyn"]
    both = df.select("n", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(select.ranking(*args)))).alias("s"), select.packed(*args).alias("p"), "e", "d", "c")
    for c in (True, False):  # a ticket has one client
        got = [x for x in both.collect() if x.c == c]
        assert [x.n for x in sorted(got, key=lambda x: tuple(x.s))] == [x.n for x in sorted(got, key=lambda x: x.p)]
    said = select.unpacked(F.col("p"))
    assert both.filter((said["eligible"] == F.col("e")) & (said["derived"] == F.col("d")) & (said["number"] == F.col("n"))).count() == 300


def test_payloads_and_lags_over_slices(spark):
    """Against plain walks, with a key that holds most rows, ties and nulls."""
    r = random.Random(2)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(120))
    key = lambda: "hot" if r.random() < 0.6 else r.choice(["a", "b", None])
    events = [(key(), at(), f"t{i}", f"c{i}") for i in range(200)]
    probes = [(i, key(), at()) for i in range(200)]
    e, p = spark.createDataFrame(events, "k string, at timestamp, ticket_id string, citation string"), spark.createDataFrame(probes, "id int, k string, seen timestamp")
    for unit in ("day", "month", "year"):
        got = {x.id: (x.n_incidents, x.latest_incident and tuple(x.latest_incident)[1:]) for x in resolve.prior_incidents(p, e, "k", "seen", unit).collect()}
        for i, k, t in probes:
            own = sorted(x[1:] for x in events if x[0] == k and x[1] <= t)
            assert got[i] == (len(own), own[-1][1:] if own else None)
    rows = [(i, key(), at(), r.choice([None, *range(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, at timestamp, v int")
    want, last = set(), {}
    for i, k, t, v in sorted(rows, key=lambda x: (str(x[1]), x[2], x[0])):
        if v is not None:
            if k in last and v < last[k]:
                want.add((i, last[k]))
            last[k] = v
    for unit in ("day", "month", "year"):
        assert {(x.id, x.previous) for x in resolve.regressions(df, "k", ["at", "id"], "v", unit).collect()} == want
