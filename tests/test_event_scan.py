"""Contamination of events and epoch sums without one row per event and second within reach."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nearpass.operators import events as evs, eventstats as es

SCHEMA = "approach_id bigint, outcome string, t_low bigint, t_climb bigint, k string"


def _approaches(spark, n=400, reach=6 * 86400):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["go_around", "touch_and_go", "ga_ambiguous", "full_stop"]), t, t + 20 if i % 3 == 0 else None, "xy"[i % 2])
            for i in range(n) for t in [rnd.randrange(reach)]]
    rows += [(n + i, "go_around", t, None, "x") for i, t in enumerate((86400, 86400, 86399, 0, 79200))]  # the edges of days, one second twice
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_contamination_looks_back_over_days(spark, keys):
    rows, df = _approaches(spark)
    at = {r[0]: (r[3] if r[3] is not None else r[2], r[1], r[4] if keys else None) for r in rows}
    got = {r.approach_id: r.pre_contaminated for r in evs.event_table(df, 120, keys=keys).collect()}
    want = {i: any(k == k2 and o != "full_stop" and t - 7200 <= t2 < t for t2, o, k2 in at.values()) for i, (t, own, k) in at.items() if own in ("go_around", "touch_and_go")}
    assert got == want and len(set(want.values())) == 2


def test_contamination_meets_no_pairs(spark):
    _, df = _approaches(spark, 50)
    assert "explode(" not in evs.event_table(df, 120)._jdf.queryExecution().analyzed().toString()


def test_epoch_sums_count_every_event(spark):
    rnd = random.Random(5)
    seconds = sorted({rnd.randrange(80_000, 96_000) for _ in range(2_000)})
    points = [(t, rnd.randrange(4), rnd.randrange(900)) for t in seconds]
    events = [("a" if t < 88_000 else "b", t) for t in (rnd.choice(seconds) for _ in range(60))] * 2 + [("a", 80_000), ("b", 95_999)]
    out = es.epoch_sums(spark.createDataFrame(points, "t bigint, u bigint, v bigint"), spark.createDataFrame(events, "day string, t0 bigint"), ["u", "v"])
    want = {(d, m): (sum(e[0] == d for e in events), *[sum(p[c] for e, t0 in events if e == d for p in points if t0 + 60 * m <= p[0] < t0 + 60 * m + 60) for c in (1, 2)])
            for d in "ab" for m in range(-30, 30)}
    assert {(r.day, r.minute): (r.n, r.u, r.v) for r in out.collect()} == want


def test_epoch_reads_a_shared_second_once(spark):
    """A thousand events of one second ask for the edges of 60 minutes, not for 120 edges each."""
    events = spark.createDataFrame([("d", 90_000)] * 1_000, "day string, t0 bigint")
    out = es.epoch_sums(spark.createDataFrame([(t, 1) for t in range(88_000, 92_000)], "t bigint, u bigint"), events, ["u"])
    plan = out._jdf.queryExecution().analyzed().toString()  # parents first
    assert plan.rindex("explode(") < plan.rindex("count(1)") and all(r.u == 60_000 and r.n == 1_000 for r in out.filter("minute > -25").collect())
