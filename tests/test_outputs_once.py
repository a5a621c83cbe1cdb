"""The outputs of a run read accepted and held tickets from where they were settled."""

from tallyforge.operators import emit
from tallyforge.plans import case_bindings as cb

SF = "/root/testdata/sf0.001"


def test_outputs_do_not_make_their_tickets_anew(spark, monkeypatch):
    """Before, each of five outputs joined, validated and hashed the orders again, three times over."""
    seen = []
    whole = emit.materialise
    monkeypatch.setattr(emit, "materialise", lambda frames, *a, **k: (seen.append(frames), whole(frames, *a, **k))[1])
    assert {r.label: r.n for r in cb.snk_04(spark, SF).collect()}["written despite the gate"] == 0
    files = {f for frames in seen for df, _ in frames.values() for f in df.inputFiles()}
    assert len(seen) == 3 and files and not [f for f in files if f.endswith("orders.parquet")]
