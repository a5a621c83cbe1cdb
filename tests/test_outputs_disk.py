"""What an output was checked on does not stay on disk."""

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import emit


def test_checked_copies_go_and_a_held_output_stops_the_rest(spark, monkeypatch, tmp_path):
    """Before, copies of all outputs stayed until the session ended, and all were made even if the first was held."""
    made = []
    monkeypatch.setattr(emit, "fresh", lambda s, name: (made.append(f"{tmp_path}/{name}-{len(made)}"), made[-1])[1])
    later = spark.range(5).withColumn("x", F.raise_error(F.lit("made although an output was held")).cast("string"))
    good, bad = spark.range(3).withColumn("x", F.lit("plain")), spark.range(3).withColumn("x", F.lit("a@example.org"))
    with pytest.raises(emit.GateError):
        emit.materialise({"a": (good, "id"), "b": (bad, "id"), "c": (later, "id")}, f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")
    emit.materialise({"a": (good, "id"), "b": (bad, "id")}, f"{tmp_path}/out", allow=["a@example.org"])
    assert {k: v.count() for k, v in emit.read_outputs(spark, f"{tmp_path}/out").items()} == {"a": 3, "b": 3}
    assert len(made) == 2 and not any(map(os.path.exists, made))
