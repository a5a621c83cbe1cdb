"""Bucketed merges and outputs that change together."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import emit
from tallyforge.operators.ledger import BUCKETS, Ledger


def rows(spark, *ids, origin="x"):
    return spark.createDataFrame([(str(i), origin) for i in ids], "id string, origin string")


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "ledger"))
    book.upsert("id", rows(spark, *range(300), origin="first"), rows(spark, *range(300, 400), origin="held"))
    before = book.current()["tables"]
    touched = book.upsert("id", rows(spark, 5, 310, 999, origin="second"), rows(spark, 6, 1000))
    after = book.current()["tables"]
    assert 0 < len(touched) <= 5 < BUCKETS
    for name in ("accepted", "quarantine"):
        same = {k for k in before[name]["buckets"] if before[name]["buckets"][k] == after[name]["buckets"].get(k)}
        assert {int(k) for k in before[name]["buckets"]} - {int(k) for k in same} <= touched
    accepted = {r.id: r.origin for r in book.load("accepted").collect()}
    assert accepted == {str(i): "first" for i in range(300)} | {"310": "second", "999": "second"}
    assert {r.id for r in book.load("quarantine").collect()} == {str(i) for i in range(300, 400)} - {"310"} | {"1000"}
    assert book.upsert("id", rows(spark), rows(spark)) == set()


def test_parts_are_dealt_out_and_old_folders_go(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "ledger"))
    book.append(accepted=rows(spark, 1, 2), quarantine=rows(spark, 3))
    book.append(accepted=rows(spark, 4).withColumn("more", F.lit(1)))
    assert book.parts() == 2
    book.upsert("id", rows(spark, 3), rows(spark, 9))
    assert book.parts() == 0
    assert {r.id for r in book.load("accepted").collect()} == {"1", "2", "3", "4"} and [r.id for r in book.load("quarantine").collect()] == ["9"]
    book.upsert("id", rows(spark, 9), rows(spark))
    assert book.load("quarantine").count() == 0 and book.load("quarantine").columns == ["id", "origin"]
    kept = {p.name for p in (tmp_path / "ledger").iterdir() if p.name.startswith("snapshot")}
    assert {x.split("/")[0] for t in book.current()["tables"].values() for x in t["buckets"].values()} <= kept
    for folder in (tmp_path / "ledger").glob("snapshot-*/*"):
        assert folder.name in ("accepted", "quarantine")


def test_outputs_change_together(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    first = {"a": (rows(spark, 2, 1), "id"), "b": (rows(spark, 7), "id")}
    emit.materialise(first, folder)
    read = lambda: {k: [r.value for r in df.collect()] for k, df in emit.read_outputs(spark, folder).items()}
    old = read()
    assert old == {"a": ['{"id":"1","origin":"x"}', '{"id":"2","origin":"x"}'], "b": ['{"id":"7","origin":"x"}']}
    with monkeypatch.context() as m:  # a crash after all files are written, before the pointer moves
        m.setattr(emit, "put_text", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            emit.materialise({"a": (rows(spark, 3), "id"), "b": (rows(spark, 8), "id")}, folder)
    assert read() == old
    with pytest.raises(emit.GateError):
        emit.materialise({"a": (rows(spark, 4), "id"), "b": (rows(spark, "write to a@b.example"), "id")}, folder)
    assert read() == old
    emit.materialise({"b": (rows(spark, 9), "id")}, folder)
    assert read() == {"b": ['{"id":"9","origin":"x"}']}
