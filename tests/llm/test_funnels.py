"""Funnels against a plain walk over each client's rows."""

import datetime as dt
import random

import pytest

from tallyforge.llm.funnels import FUNNELS, Funnel, count_funnels

BASE = dt.datetime(2024, 3, 31, 1, 0)
SCHEMA = "client_id bigint, kind string, arrived_at timestamp_ntz, funnel string, n1 string, slice int"


def plain(rows, funnels, within=30 * 60 * 10**6, percent=90):
    seen = sorted({(c, (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), k) for c, k, t in rows if None not in (c, k, t)})
    by: dict = {}
    for c, t, k in seen:
        by.setdefault(c, []).append((t, k))
    out = {}
    for name, f in funnels.items():
        for c, own in by.items():
            reached, took = [0] * len(f.steps), [[] for _ in f.steps]
            for t1, k in own:
                if k != f.steps[0]:
                    continue
                reached[0] += 1
                at = t1
                for n, want in enumerate(f.steps[1:], 1):
                    nxt = min((t for t, kind in own if kind == want and t > at), default=None)
                    if nxt is None or nxt > t1 + within or any(kind == f.excluded and at < t <= nxt for t, kind in own):
                        break
                    reached[n] += 1
                    took[n].append(nxt - at)
                    at = nxt
            if reached[0]:
                rank = [sorted(x)[-(-percent * len(x) // 100) - 1] if x else None for x in took[1:]]
                out[name, c] = (*reached, max(i + 1 for i, n in enumerate(reached) if n), *rank)
    return {k: (*v, sum(1 for (f, _), w in out.items() if f == k[0] and w[len(reached)] == v[len(reached)])) for k, v in out.items()}


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def got(df):
    return {(r[0], r[1]): tuple(r[2:]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    kinds = ["view", "click", "purchase", "error", "signup", "other", None]
    rows = []
    for _ in range(900):
        client = 7 if rng.random() < 0.4 else rng.choice([1, 2, 3, None])
        step = dt.timedelta(microseconds=rng.choice([1, 10**6, 60 * 10**6])) * rng.randrange(0, 200)
        rows.append((client, rng.choices(kinds, [6, 5, 3, 1, 2, 1, 1])[0], None if rng.random() < 0.02 else BASE + step))
    rows += rows[:50]
    assert got(count_funnels(made(spark, rows), FUNNELS)) == plain(rows, FUNNELS)


def test_edges_of_time_slices_ties_and_bars(spark):
    at = lambda m, us=0: BASE + dt.timedelta(minutes=m, microseconds=us)
    rows = [
        (1, "view", at(59)), (1, "click", at(60)), (1, "view", at(88)), (1, "purchase", at(89)),  # over the end of a slice
        (2, "view", at(0)), (2, "click", at(30)), (3, "view", at(0)), (3, "click", at(30, 1)),  # just within, just beyond
        (4, "view", at(0)), (4, "click", at(0)), (4, "click", at(5)), (4, "error", at(5)),  # equal times: not later, and barred
        (5, "view", at(0)), (5, "error", at(0)), (5, "click", at(1)),  # an excluded row at the step before does not bar
        (6, "purchase", at(0)),
    ]
    out = got(count_funnels(made(spark, rows), {"A": FUNNELS["A"]}))
    assert out == plain(rows, {"A": FUNNELS["A"]})
    assert [out["A", c][:4] for c in range(1, 6)] == [(2, 1, 1, 1), (1, 1, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0)]


def test_other_lengths_empty_tables_and_zones(spark):
    two = {"x": Funnel(("view", "click")), "y": Funnel(("click", "view", "view"), "error")}
    rows = [(1, "view", BASE), (1, "click", BASE + dt.timedelta(seconds=3)), (1, "view", BASE + dt.timedelta(seconds=9)), (1, "view", BASE + dt.timedelta(seconds=10))]
    want = {("x", 1): (3, 1, 0, 2, 3_000_000, None, 1), ("y", 1): (1, 1, 1, 3, 6_000_000, 1_000_000, 1)}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin"):  # the clocks there change within these rows
            spark.conf.set("spark.sql.session.timeZone", z)
            assert got(count_funnels(made(spark, rows), two)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert count_funnels(made(spark, []), FUNNELS).count() == 0
