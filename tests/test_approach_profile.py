"""The profile of an approach sorts its rows twice, whatever the number of windows over them."""

from __future__ import annotations

from nearpass.operators import approaches as ap
from nearpass.plans import q_approaches, views


def test_profile_sorts_twice(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = q_approaches.rows_of(spark, "/root/testdata/sf0.001")
        spans = ap.detect_approaches(rows, views.FINAL_RUNWAYS).localCheckpoint()
        plan = ap.measure(rows.localCheckpoint(), spans)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    lines = [x.strip(" :+-") for x in plan.splitlines()]
    profile = lines[:next(i for i, x in enumerate(lines) if "Join" in x)]
    assert sum("Sort [" in x for x in profile) == 2
