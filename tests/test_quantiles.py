"""Distributed selection against sorted lists."""

import math
import random

import numpy as np
import pytest

from nearpass.operators import quantiles as qt

QS = [0.0, 1 / 3, 0.5, 0.975, 1.0]


def expected(values, q):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    if not v:
        return None
    p = q * (len(v) - 1)
    low, high = v[math.floor(p)], v[math.ceil(p)]
    return low if low == high else low * (math.ceil(p) - p) + high * (p - math.floor(p))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    rows = [("normal", rng.gauss(0, 1), rng.randrange(5) / 4) for _ in range(700)]
    rows += [("crowded", rng.choice([7.0, 7.0, 7.0, 7.000000001, -1e300, 1e300]), None) for _ in range(300)]
    rows += [("infinite", rng.choice([math.inf, -math.inf, 1.0, -2.5, 40.0, 5e-324]), math.nan) for _ in range(300)]
    rows += [(None, float(i), float(-i)) for i in range(90)] + [("one", 3.0, None), ("none", None, math.nan)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("gathered,buckets", [(1, 2), (5, 4), (50, 64), (10_000, 1024)])
def test_quantiles_of_groups(spark, data, gathered, buckets):
    df = spark.createDataFrame(data, "g string, a double, b double").repartition(5)
    got = {r["g"]: r for r in qt.grouped_quantiles(df, ["a", "b"], QS, ["g"], gathered=gathered, buckets=buckets).collect()}
    assert set(got) == {g for g, _, _ in data}
    for g, r in got.items():
        for i, name in ((1, "a"), (2, "b")):
            own = [row[i] for row in data if row[0] == g]
            want = [expected(own, q) for q in QS]
            assert r[f"n_{name}"] == sum(v is not None and not math.isnan(v) for v in own)
            if want[0] is None:
                assert r[name] is None
            else:
                np.testing.assert_allclose(r[name], want, rtol=1e-12)


def test_ranks_beyond_the_broadcast_bound(spark, data, monkeypatch):
    monkeypatch.setattr(qt, "BROADCAST_RANKS", -1)
    df = spark.createDataFrame(data, "g string, a double, b double")
    got = {r["g"]: r["a"] for r in qt.grouped_quantiles(df, ["a"], [0.5], ["g"], gathered=5, buckets=8).collect()}
    assert got["normal"] == [pytest.approx(expected([a for g, a, _ in data if g == "normal"], 0.5))] and got["none"] is None


def test_without_groups_and_rows(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(1001)], "a double")
    assert qt.grouped_quantiles(df, ["a"], [0.5, 0.25], gathered=3, buckets=4).first()["a"] == [4.0, 2.0]
    assert qt.grouped_quantiles(df.limit(0), ["a"], [0.5]).first()["a"] is None


def test_passes_do_not_collect_values(spark):
    """No plan of a pass gathers a list or an exact percentile."""
    df = spark.createDataFrame([(float(i),) for i in range(5000)], "a double")
    ranges = spark.createDataFrame([(0, 2500, 0, 0.0, 4999.0, 5000)], "_c int, _k long, _base long, _lo double, _hi double, _size long")
    rows = df.selectExpr("0 AS _c", "a AS _v")
    narrowed = qt._narrowed(qt._inside(rows, ranges, ["_c"]), ["_c"], 16)
    plan = narrowed._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan
    r = narrowed.first()
    assert r["_lo"] <= 2500 <= r["_hi"] and r["_size"] <= 5000 / 15
