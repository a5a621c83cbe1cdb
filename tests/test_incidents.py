"""Queries take whole tables: every order is an incident and has a decision."""

from tallyforge.plans import bindings, case_bindings, fleet_bindings, more_bindings, source_bindings  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_every_order_is_decided(spark):
    orders = {r.o_orderkey for r in bindings.t(spark, SF, "orders").select("o_orderkey").collect()}
    for name in ("dec_01", "flt_11"):
        got = [r.o_orderkey for r in bindings.QUERIES[name](spark, SF).collect()]
        assert len(got) == len(orders) and set(got) == orders


def test_no_query_is_registered_twice():
    made = [(f.__module__, f.__qualname__) for f in bindings.QUERIES.values()]
    assert len({f for f in made if "rule" not in f[1]}) == len([f for f in made if "rule" not in f[1]])
