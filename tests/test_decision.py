"""The batch run over an invented fleet: duplicates, replays, broken records, unknown containers."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.ledger import Ledger, LedgerError
from tallyforge.plans.decision import Context, Rulebook, outputs, run_batch
from tallyforge.sources import delimited, tickets, xlsx
from tallyforge.streaming.ledger_stream import stream_into_ledger


@pytest.fixture(scope="module")
def ctx(spark):
    vehicles = spark.createDataFrame(
        [("AA01BB0001", 2021, "BS6", True, "North", "Active"), ("AA01BB0002", 2022, "BS6", True, "North", "Active"), ("AA01BB0003", 2019, "BS4", False, "South", "Active"), ("AA01BB0004", 2023, "BS6", True, "South", "Sold")],
        "reg_key string, year int, bs_stage string, engine_heater boolean, home_hub string, status string",
    )
    day = dt.date(2026, 2, 1)
    maintenance = spark.createDataFrame([("AA01BB0002", day, False, False, False), ("AA01BB0003", day, True, False, False)], "reg_key string, date date, jugaad boolean, brake_work boolean, permanent_repair boolean")
    distances = spark.createDataFrame([("North", "South", 100.0), ("South", "North", 100.0)], "hub string, other string, km double")
    drivers = spark.createDataFrame([("D1", dt.date(2020, 1, 1))], "driver_id string, joining_date date")
    return Context(vehicles, maintenance, distances, drivers, Rulebook(clients={"Acme": {"sla_hours": 48, "mailbox": "desk@acme.example"}, "Internal": {}}))


BASE = {"ticket_id": "T1", "created_at": "2026-03-02T07:00:00", "vehicle": "AA-01-BB-0001", "driver_id": "D1", "origin_hub": "North", "km_from_origin_hub": 25, "destination": "South", "issue": "tyre burst", "severity": "MEDIUM", "client": "Acme"}


def read(spark, folder, text, name="queue.json"):
    (folder / name).write_text(text)
    return tickets.read_tickets(spark, str(folder / name))


def test_duplicates_and_replay(spark, ctx, tmp_path):
    rows = read(spark, tmp_path, json.dumps([BASE, BASE, BASE | {"resolution_note": "x"}]))
    book = Ledger(spark, str(tmp_path / "ledger"))
    run_batch(ctx, rows, book)
    first = {k: sorted(df.toJSON().collect()) for k, (df, _) in outputs(ctx, book).items()}
    assert [len(first[k]) for k in ("work_orders", "comms_pending", "quarantine")] == [1, 1, 0]
    order = json.loads(first["work_orders"][0])
    assert (order["replacement"], order["from_hub"], order["status"]) == ("AA01BB0002", "North", "DISPATCHED")
    steps = [json.loads(x)["step"] for x in first["audit"]]
    assert steps.count("DEDUPLICATED") == steps.count("INGESTED") == 1
    run_batch(ctx, rows, book)
    assert {k: sorted(df.toJSON().collect()) for k, (df, _) in outputs(ctx, book).items()} == first


def test_broken_records_are_quarantined(spark, ctx, tmp_path):
    broken = {"C1": {"vehicle": ""}, "C2": {"created_at": "whenever"}, "C3": {"vehicle": "ZZ99"}, "C4": {"origin_hub": "Moon"}, "C5": {"km_from_origin_hub": None}, "C6": {"destination": ""}}
    records = [BASE | {"ticket_id": k} | v for k, v in broken.items()] + [{k: v for k, v in BASE.items() if k != "ticket_id"}, "text", 7, None]
    book = run_batch(ctx, read(spark, tmp_path, json.dumps(records)), Ledger(spark, str(tmp_path / "ledger")))
    held = {r.ticket_id: r for r in book.load("quarantine").collect()}
    want = {"C1": "MISSING_VEHICLE", "C2": "UNPARSEABLE_TIMESTAMP", "C3": "UNKNOWN_VEHICLE", "C4": "UNKNOWN_ORIGIN_HUB", "C5": "MISSING_DISTANCE", "C6": "MISSING_DESTINATION"}
    assert {k: held[k].reason_codes for k in want} == {k: [v] for k, v in want.items()}
    assert book.load("accepted").count() == 0
    assert sum(r.occurrences for r in held.values()) == len(records)


def test_recovery_and_schema_guard(spark, ctx, tmp_path):
    book = Ledger(spark, str(tmp_path / "ledger"))
    run_batch(ctx, read(spark, tmp_path, json.dumps([BASE | {"vehicle": ""}])), book)
    assert book.load("quarantine").count() == 1
    run_batch(ctx, read(spark, tmp_path, json.dumps([BASE]), "again.json"), book)
    assert (book.load("quarantine").count(), book.load("accepted").count()) == (0, 1)
    (tmp_path / "ledger" / "CURRENT").write_text('{"schema_version": 99, "snapshot": "x"}')
    (tmp_path / "ledger" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(LedgerError):
        book.load("accepted")


def test_camel_case_queue(spark, ctx, tmp_path):
    record = {"ticketId": "S1", "raisedAt": "02/03/2026 07:00", "truckNo": "aa01bb0001", "driver": "D1", "from": "North", "distance": "25 km", "to": "South", "problem": "tyre burst", "priority": "P2", "customer": "Acme", "extra": 1}
    rows = read(spark, tmp_path, json.dumps({"queue": [record, record | {"ticketId": "S2"}, {"ticketId": "S3", "raisedAt": "02/03/2026"}]}))
    seen = rows.filter("ticket_id = 'S1'").first()
    assert (seen.format, seen.severity, seen.km_from_origin_hub, seen.unmapped) == ("json_object.queue", "MEDIUM", 25.0, ["extra"])
    book = run_batch(ctx, rows, Ledger(spark, str(tmp_path / "ledger")))
    assert sorted((r.ticket_id, r.created_iso) for r in book.load("accepted").collect()) == [("S1", "2026-03-02T07:00:00"), ("S2", "2026-03-02T07:00:00")]


def test_escalation_when_only_origin_counts(spark, ctx, tmp_path):
    rows = read(spark, tmp_path, json.dumps([BASE | {"vehicle": "AA01BB0003", "origin_hub": "South", "destination": "South", "km_from_origin_hub": 50}, BASE | {"ticket_id": "T2", "vehicle": "AA01BB0003", "origin_hub": "South", "km_from_origin_hub": 51}]))
    book = run_batch(ctx, rows, Ledger(spark, str(tmp_path / "ledger")))
    got = {r.ticket_id: (r.status, r.replacement and r.replacement.from_hub) for r in book.load("accepted").collect()}
    assert got == {"T1": ("ESCALATED_NO_VEHICLE", None), "T2": ("DISPATCHED", "North")}


@pytest.mark.parametrize(("text", "name", "form", "n"), [
    ('[{"id": 1}]', "a.json", "json_array", 1), ('{"rows": [1, 2]}', "a.json", "json_object.rows", 2), ('{"id": 1}', "a.json", "json_single_object", 1),
    ('{"id": 1}\n{bad\n{"id": 2}', "a.jsonl", "jsonl", 2), ("a;b\n1;2\n", "a.csv", "csv_semicolon", 1), ("a\tb\n1\t2\n", "a.tsv", "tsv", 1), ("a|b\n1|2", "x", "psv", 1), ("plain", "x", "unknown", 0), ("[bad", "x", "json_array", 0),
])
def test_containers(spark, text, name, form, n):
    got = tickets.containers(spark.createDataFrame([(name, text)], "name string, value string")).first()
    assert (got.format, sum("_bad_line" not in r.raw for r in got.records)) == (form, n)


def test_delimited_tokens():
    assert list(delimited.parse_rows('﻿a,"b,""c""",d\r\n"x\ny",z')) == [["a", 'b,"c"', "d"], ["x\ny", "z"]]
    assert delimited.parse_records("h1, h2\n1\n\n2,3,4\n", "f") == [{"h1": "1", "h2": "", "_row": 2, "_source": "f"}, {"h1": "2", "h2": "3", "_extra": ["4"], "_row": 3, "_source": "f"}]
    assert delimited.sniff("a;b,c;d") == ";" and delimited.sniff("abc") == ","


def test_sheet(tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>A&amp;</t></r><r><t>B</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>km</t></is></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>12.5</v></c></row></sheetData></worksheet>')
    assert xlsx.read_sheet((tmp_path / "a.xlsx").read_bytes()) == [{"name": "A&B", "km": "12.5", "_row": 3}]


def test_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ticket_id": "1", "v": 1}\n{"ticket_id": "2", "v": -1}\n')
    book = Ledger(spark, str(tmp_path / "ledger"))
    split = lambda b: (b.filter("v > 0"), b.filter("v <= 0"))
    for n in range(2):
        stream_into_ledger(spark, str(tmp_path / "in"), "ticket_id string, v int", book, split, str(tmp_path / f"cp{n}"), "ticket_id").awaitTermination()
        assert [r.ticket_id for r in book.load("accepted").collect()] == ["1"]
    (tmp_path / "in" / "b.json").write_text('{"ticket_id": "2", "v": 2}\n{"ticket_id": "1", "v": 9}\n')
    stream_into_ledger(spark, str(tmp_path / "in"), "ticket_id string, v int", book, split, str(tmp_path / "cp1"), "ticket_id").awaitTermination()
    assert {r.ticket_id: r.v for r in book.load("accepted").orderBy(F.col("ticket_id")).collect()} == {"1": 1, "2": 2}
    assert book.load("quarantine").count() == 0
