"""Operators on small frames against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpass.functions import geo, zones
from nearpass.functions.dist import norm_cdf, norm_ppf
from nearpass.operators import baseline, bootstrap, cleaning, crosscheck, glm, pairs, probability, sweeps
from nearpass.plans import q_pairs, views
from nearpass.settings import Airport, Spec
from nearpass.sources import files, profiles, sinks

SF = "/root/testdata/sf0.001"
PORT = Airport("KTST", 36.1245, -86.6782, 599.0, "UTC")


def test_zone_interval_against_sampling(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        vz = 0.0 if i % 10 == 0 else rng.uniform(-30, 30)
        vx, vy = (0.0, 0.0) if i % 15 == 0 else (rng.uniform(-.15, .15), rng.uniform(-.15, .15))
        rows.append((i, rng.uniform(-5, 5), rng.uniform(-5, 5), vx, vy, rng.uniform(-1500, 1500), vz))
    df = spark.createDataFrame(rows, "i int, rx double, ry double, vx double, vy double, dz double, vz double")
    t_in, t_out = zones.zone_interval(*[F.col(c) for c in ("rx", "ry", "vx", "vy", "dz", "vz")], 3.0, 1000.0, 60.0)
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", t_in.alias("a"), t_out.alias("b")).collect()}
    t = np.arange(0, 60.005, 0.01)
    for i, rx, ry, vx, vy, dz, vz in rows:
        inside = (np.hypot(rx + vx * t, ry + vy * t) < 3) & (np.abs(dz + vz * t) < 1000)
        a, b = got[i]
        if inside.sum() > 3:
            assert a == pytest.approx(t[inside][0], abs=0.011) and b == pytest.approx(t[inside][-1], abs=0.011)
        elif not inside.any():
            assert a is None or b - a < 0.02


def test_level_pair_exactly_at_the_limit_is_outside(spark):
    df = spark.createDataFrame([(750.0,), (-750.0,), (749.9,)], "dz double")
    z = F.lit(0.0)
    a, _ = zones.zone_interval(F.lit(1.0), z, z, z, F.col("dz"), z, 3.0, 750.0, 1.0)
    assert [r["a"] for r in df.select(a.alias("a")).collect()] == [None, None, 0.0]


def test_pair_join_variants_agree(spark):
    rows = q_pairs.presence(spark, SF).cache()
    small = {**q_pairs.WIDE, "lookahead_s": 10.0}
    key = ("day", "t", "a", "b")

    def ids(**kw):
        out = [tuple(r) for r in pairs.flagged_pairs(rows, small, **kw).select(*key).collect()]
        assert len(out) == len(set(out))
        return set(out)

    plain = ids(cells=False)
    assert plain and plain == ids(cells=True) == ids(cells=False, crowd=4)


def test_sweep_equals_single_runs(spark):
    p = q_pairs.pairs(spark, SF).cache()
    grid = [g for g in sweeps.settings_grid(Spec()) if g[0] in ("base", "radius_nm", "T1_H")]
    got = {(r["parameter"], r["value"]): r["n"] for r in sweeps.sweep_encounters(p, grid, q_pairs.RWY).groupBy("parameter", "value").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    from nearpass.operators.encounters import encounters

    for name, value, spec in grid:
        assert got.get((name, value), 0) == encounters(p, spec, q_pairs.RWY).count()


def test_drop_jumps_keeps_the_good_fix_after_a_bad_one(spark):
    rows = [("d", "a", t, 0.1 * t + (20 if t == 5 else 0), 0.0) for t in range(10)] + [("d", "b", t, 0.1 * t, 0.0) for t in range(5)]
    df = spark.createDataFrame(rows, "day string, icao24 string, t long, x double, y double")
    kept = cleaning.drop_jumps(df)
    assert sorted(r["t"] for r in kept.filter("icao24 = 'a'").collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert kept.filter("icao24 = 'b'").count() == 5


def test_freshness_retimes_and_drops_copies(spark):
    rows = [("d", "a", 10, 9.4), ("d", "a", 11, 9.4), ("d", "a", 13, 12.2), ("d", "a", 40, 20.0)]
    df = spark.createDataFrame(rows, "day string, icao24 string, s long, position_time double").withColumn("timestamp", F.timestamp_seconds("s"))
    assert [r["t"] for r in cleaning.fresh_reports(df).select(F.unix_seconds("timestamp").alias("t")).orderBy("t").collect()] == [9, 12]


def test_projection_and_bearing(spark):
    lat, lon = geo.unproject(*geo.project(F.col("lat"), F.col("lon"), 36.1245, -86.6782), 36.1245, -86.6782)
    fwd, back = geo.azimuths(F.lit(36.10329818725586), F.lit(-86.68800354003906), F.lit(36.12419891357422), F.lit(-86.67960357666016))
    r = spark.createDataFrame([(36.3, -86.9)], "lat double, lon double").select(lat.alias("a"), lon.alias("o"), fwd.alias("f"), back.alias("b")).first()
    assert r["a"] == pytest.approx(36.3, abs=1e-8) and r["o"] == pytest.approx(-86.9, abs=1e-8)
    assert r["f"] == pytest.approx(18.058715, abs=1e-4) and r["b"] == pytest.approx(198.063666, abs=1e-4)


def test_normal_functions(spark):
    r = spark.range(1).select(norm_cdf(F.lit(1.959963984540054)).alias("c"), norm_ppf(F.lit(0.975)).alias("p"), norm_cdf(F.lit(-9.0)).alias("t")).first()
    assert r["c"] == pytest.approx(0.975, abs=1e-12) and r["p"] == pytest.approx(1.959964, abs=1e-6) and r["t"] == pytest.approx(1.12858840595e-19, rel=1e-6)


def test_signed_rank_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, -6)], "v double")
    r = bootstrap.signed_rank(df, "v", exact=True).first()
    assert r["n"] == 6 and r["w"] == 6.0 and r["p_value"] == pytest.approx(2 * 14 / 64)


def test_conflict_probability_against_sampling(spark):
    cols = "rx double, ry double, vx double, vy double, dz double, vz double, t_cpa double, tra double, trb double"
    sig = {"sa_a": .4, "sc_a": .2, "sz_a": 200., "sa_b": .3, "sc_b": .25, "sz_b": 150.}
    cases = [(4.0, 1.5, -.08, .0, 300., 0., 50., 90., 270.), (1.0, 2.5, 0., 0., 200., 0., 10., 45., 45.)]
    df = spark.createDataFrame(cases, cols).withColumns({k: F.lit(v) for k, v in sig.items()})
    got = [r["prob"] for r in probability.conflict_probability(df, 3.0, 1000.0).collect()]
    rng = np.random.default_rng(1)
    for (rx, ry, vx, vy, dz, vz, t, ta, tb), p in zip(cases, got):
        def err(a, sa, sc):
            e, c, b = rng.normal(size=200000) * sa, rng.normal(size=200000) * sc, math.radians(a)
            return e * math.sin(b) + c * math.cos(b), e * math.cos(b) - c * math.sin(b)
        (ax, ay), (bx, by) = err(ta, .4, .2), err(tb, .3, .25)
        px, py = rx + vx * t + bx - ax, ry + vy * t + by - ay
        s = math.hypot(vx, vy)
        miss = np.abs(-px * vy + py * vx) / s if s else np.hypot(px, py)
        hit = (miss < 3) & (np.abs(dz + vz * t + rng.normal(size=200000) * math.hypot(200, 150)) < 1000)
        assert p == pytest.approx(hit.mean(), abs=0.01)


def test_count_model_recovers_known_effects(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        h, w, e = i % 24, "weekend" if (i // 24) % 7 > 4 else "weekday", rng.uniform(2, 6)
        mu = e * math.exp(-0.5 + (0.6 if w == "weekend" else 0))
        y = int(rng.poisson(rng.gamma(2.0, mu / 2.0)))
        rows.append((f"w{i}", h, w, "2024-01", "north", 1 + i % 9, float(e), y))
    df = spark.createDataFrame(rows, "window_id string, local_hour int, daytype string, month string, flow string, n_aircraft int, pair_hours double, T1_any int")
    m = glm.fit_count_model(df, "T1_any", factors=("daytype",))
    assert m.kind == "nb" and m.alpha == pytest.approx(0.5, abs=0.12) and m.coef["daytype=weekend"] == pytest.approx(0.6, abs=0.15)
    s = baseline.score(df, m, seed=1).agg(F.avg(F.col("T1_any_exceed95").cast("int")).alias("e"), F.avg("T1_any_z").alias("z")).first()
    assert 0.02 < s["e"] < 0.08 and abs(s["z"]) < 0.12


def test_detector_matching_is_one_to_one(spark):
    ours = spark.createDataFrame([("l", "e1", 100), ("l", "e2", 110)], "leg_id string, event_id string, t_low long")
    other = spark.createDataFrame([("l", 1, 90, 120), ("l", 2, 500, 520)], "leg_id string, det_id long, d_start long, d_stop long")
    got = sorted((r["event_id"] or "", r["det_id"] or 0, r["status"]) for r in crosscheck.match_detectors(ours, other).collect())
    assert got == [("", 2, "only_theirs"), ("e1", 1, "both"), ("e2", 0, "only_ours")]


def test_baseline_verdict(spark):
    oos = lambda a, b: spark.createDataFrame([(a, b)], "pass95 boolean, pass99 boolean")
    strata = lambda bad: spark.createDataFrame([(i >= bad, i < bad) for i in range(10)], "agree boolean, flagged boolean")
    curve = lambda ok: spark.createDataFrame([(0.5, ok), (1.0, True)], "fraction double, stable_from_here boolean")
    good = {"n_days": 60, "out_of_sample": oos(True, True), "crosscheck": strata(2), "stability": curve(True), "sufficiency": strata(0)}
    cases = [({}, 0, "VALID"), ({"n_days": 27}, 1, "VALID WITH WARNINGS"), ({"out_of_sample": oos(False, True)}, 1, "VALID WITH WARNINGS"),
             ({"out_of_sample": oos(False, False)}, 2, "NOT VALID"), ({"crosscheck": strata(3)}, 1, "VALID WITH WARNINGS"),
             ({"stability": curve(False)}, 1, "VALID WITH WARNINGS"), ({"sufficiency": strata(1)}, 1, "VALID WITH WARNINGS")]
    for change, n, want in cases:
        k = {**good, **change}
        said = baseline.baseline_warnings(**k)
        assert len(said) == n and baseline.verdict(True, k["out_of_sample"], said) == want
    assert baseline.verdict(False, None, []) == "NOT VALID"


def test_mixed_file_layouts_keep_every_row(spark, tmp_path):
    raw = views.reports(spark, SF).drop("event_id").limit(120).toPandas()
    names = list(raw.columns.drop("position_time"))
    for i, (kind, time_name) in enumerate((("csv", "last_position"), ("csv", "time_position"), ("parquet", "lastposupdate"), ("parquet", "time_position"))):
        day = raw.rename(columns={"position_time": time_name})
        day = day[[time_name, *names[::-1]] if i % 2 else [*names, time_name]]
        path = tmp_path / f"KTST_2024010{i + 1}.{kind}"
        day.to_csv(path, index=False) if kind == "csv" else day.to_parquet(path)
    found = files.daily_files(spark, str(tmp_path))
    got = files.load_reports(spark, found).groupBy("day").agg(F.count("*").alias("n"), F.count("position_time").alias("p"), F.sum("latitude").alias("la")).collect()
    assert len(got) == 4 and {(r["n"], r["p"]) for r in got} == {(len(raw), int(raw["position_time"].notna().sum()))}
    assert all(r["la"] == pytest.approx(raw["latitude"].sum()) for r in got)
    raw.drop(columns="latitude").to_csv(tmp_path / "KTST_20240109.csv", index=False)
    again = files.daily_files(spark, str(tmp_path))
    assert [r["missing"] for r in files.schema_audit(spark, again).filter("not ok").collect()] == ["latitude"]
    with pytest.raises(ValueError, match="latitude"):
        files.load_reports(spark, again)


def test_profile_rules():
    doc = {"icao": "ktst", "latitude": 36.0, "longitude": -86.0, "elevation_ft": 600, "preset": "air_carrier",
           "runways": {"09": [36.0, -86.0, 90.0]}, "airspace": {"ceiling_ft_msl": 4600}, "flows": {"east": ["09"]}}
    port, cfg, space = profiles.read_profile(doc)
    assert port.icao == "KTST" and cfg.touchdown_gs_kt == 80.0 and space["ceiling_ft"] == 4000.0 and port.flows == (("09", "east"),)
    for bad in ({"preset": "x"}, {"flows": {"a": ["27"]}}, {"airspace": {"ceiling_ft_msl": 1000}}, {"overrides": {"nope": 1}}):
        with pytest.raises(ValueError):
            profiles.read_profile({**doc, **bad})


def test_files_sources_and_sinks(spark, tmp_path):
    raw = views.reports(spark, SF).drop("event_id").withColumnRenamed("position_time", "last_position")
    one = raw.limit(300).toPandas()
    (tmp_path / "in" / "sub").mkdir(parents=True)
    one.to_parquet(tmp_path / "in" / "sub" / "KTST_20240101.parquet")
    one.to_csv(tmp_path / "in" / "KTST_20240101.csv", index=False)
    one.to_csv(tmp_path / "in" / "KTST_20240102.csv", index=False)
    (tmp_path / "in" / "._KTST_20240103.csv").write_text("x")
    found = files.daily_files(spark, str(tmp_path / "in"))
    assert sorted((r["stem"], r["suffix"]) for r in found.collect()) == [("KTST_20240101", "parquet"), ("KTST_20240102", "csv")]
    rep = files.load_reports(spark, found)
    assert rep.groupBy("day").count().count() == 2 and "position_time" in rep.columns
    sinks.write_days(rep, str(tmp_path / "out"))
    assert files.day_table(spark, str(tmp_path / "out"), "KTST_20240101").count() == rep.filter("day = 'KTST_20240101'").count()
    one.to_csv(tmp_path / "in" / "sub" / "KTST_20240102.csv", index=False)
    with pytest.raises(ValueError):
        files.daily_files(spark, str(tmp_path / "in"))
