"""Catalogue: probability, sweeps, audits and gridded products (Q1-Q8, J14, J15, V1, D1-D3, D5, D6, SRC8-SRC10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.plan import cut_lineage
from ..operators import audit, cleaning as cl, exposure as ex, grid as gr, pairs as pr, probability as pb, products as pd_, sweeps
from ..settings import BASELINE, DAY_S, Spec
from ..sources import airports, profiles
from . import q_clean, q_pairs, q_windows, views
from .q_pairs import RWY, SPEC, cpa_cols, zone_cols
from .q_stats import boot_cte
from .registry import cte, query, statement
from .tidy import r, rounded
from .views import AIRPORT

cte("errs", """SELECT p.day, p.leg, p.t AS t0, tau, CASE WHEN phase = 0 THEN 'other' WHEN phase > 100 THEN 'departure' ELSE 'arrival' END AS phase,
   (g.x - p.x - p.vx*tau) * sin(radians(p.track)) + (g.y - p.y - p.vy*tau) * cos(radians(p.track)) AS e_along,
   (g.x - p.x - p.vx*tau) * cos(radians(p.track)) - (g.y - p.y - p.vy*tau) * sin(radians(p.track)) AS e_cross, g.h - p.h - p.vz*tau AS e_z
  FROM pres p JOIN (SELECT unnest(generate_series(10, 180, 10)) AS tau) ON true JOIN grid g ON g.day = p.day AND g.leg = p.leg AND g.t = p.t + tau""", "pres", "grid")


def samples(spark, d):
    return pb.error_samples(views.grid(spark, d), q_pairs.presence(spark, d))


def model(spark, d):
    return pb.error_model(pr.with_presence(views.grid(spark, d), RWY, q_pairs.WIDE["ceiling_ft"]))


@query("q1_error_samples", statement(f"SELECT day, leg, t0, tau, phase, {r('e_along', 'e_cross', 'e_z')} FROM errs", "errs"))
def q1(spark, d):
    return rounded(samples(spark, d))


@query("j14_future_state_join", statement("SELECT day, tau, count(*) AS n FROM errs GROUP BY ALL", "errs"))
def j14(spark, d):
    return rounded(samples(spark, d).groupBy("day", "tau").agg(F.count(F.lit(1)).alias("n")))


cte("errs2", "SELECT tau, phase, e_along, e_cross, e_z FROM errs UNION ALL SELECT tau, 'all', e_along, e_cross, e_z FROM errs", "errs")
cte("emodel", """SELECT phase, tau AS tau_s, count(*) AS n, CASE WHEN count(*) >= 20 THEN 1.4826 * median(abs(e_along - ma)) END AS sa,
   CASE WHEN count(*) >= 20 THEN 1.4826 * median(abs(e_cross - mc)) END AS sc, CASE WHEN count(*) >= 20 THEN 1.4826 * median(abs(e_z - mz)) END AS sz
  FROM errs2 JOIN (SELECT phase, tau, median(e_along) AS ma, median(e_cross) AS mc, median(e_z) AS mz FROM errs2 GROUP BY ALL) USING (phase, tau) GROUP BY ALL""", "errs2")


@query("q2_error_model", statement(f"SELECT phase, tau_s, n, {r('sa AS sigma_along_nm', 'sc AS sigma_cross_nm', 'sz AS sigma_z_ft')} FROM emodel", "emodel"))
def q2(spark, d):
    return rounded(model(spark, d))


def curves(spark, d):
    return cut_lineage(pb.sigma_curves(model(spark, d)))


cte("emall", "SELECT 0.0::DOUBLE AS t, 25.0::DOUBLE AS sz UNION ALL SELECT tau_s, sz FROM emodel WHERE phase = 'all' AND sz IS NOT NULL", "emodel")


@query("q3_sigma_interpolation", statement(f"""SELECT event_id, {r('greatest(CASE WHEN h.t IS NULL THEN l.sz ELSE l.sz + (h.sz - l.sz) * (s.tau - l.t) / (h.t - l.t) END, 25) AS sigma_z_ft')}
   FROM (SELECT event_id, value / 3 AS tau FROM study) s ASOF JOIN emall l ON s.tau >= l.t ASOF LEFT JOIN emall h ON s.tau < h.t""", "study", "emall"))
def q3(spark, d):
    s = views.study(spark, d).select("event_id", (F.col("value") / 3).alias("tau"), F.lit("all").alias("phase"))
    return rounded(pb.add_sigma(s, curves(spark, d), "phase", "tau", "q").select("event_id", F.col("sz_q").alias("sigma_z_ft")))


def tier1(spark, d):
    p = pr.within_volume(q_pairs.pairs(spark, d), SPEC.radius_nm, SPEC.ceiling_ft)
    return pr.evaluate_tiers(p, Spec(tiers=SPEC.tiers[:1]))


@query("q4_conflict_probability")
def q4(spark, d):
    """Probability of every pair-second that is not inside yet (checked against sampling in the tests)."""
    return rounded(pb.pair_probabilities(tier1(spark, d), curves(spark, d), 3.0, 1000.0, 120))


cte("cal", "SELECT event_id, least(value / 120, 1) AS prob, event_type IN ('click', 'error') AS hit FROM study", "study")


def calib(spark, d):
    return views.study(spark, d).select(F.least(F.col("value") / 120, F.lit(1.0)).alias("prob"), F.col("event_type").isin("click", "error").alias("hit"))


@query("q6_calibration", statement(f"SELECT least(floor(prob * 10), 9)::BIGINT AS bin, count(*) AS n, {r('avg(prob) AS mean_pred', 'avg(hit::INT) AS obs_frac')} FROM cal GROUP BY 1", "cal"))
def q6(spark, d):
    return rounded(pb.calibration(calib(spark, d)))


@query("q6_calibration_scores", statement(f"""SELECT n, {r('b AS base_rate', 'br AS brier', '1 - br / (b * (1 - b)) AS bss')} FROM (SELECT count(*) AS n, avg(hit::INT) AS b, avg(pow(prob - hit::INT, 2)) AS br FROM cal)""", "cal"))
def q6_scores(spark, d):
    return rounded(pb.calibration_scores(calib(spark, d)).select("n", "base_rate", "brier", "bss"))


cte("t1all", "SELECT * FROM ev WHERE tier = 'T1' AND ha <= 4000 AND hb <= 4000", "ev")


@query("j15_observed_ahead", statement("""SELECT day, t, a, b, EXISTS (SELECT 1 FROM t1all o WHERE o.day = e.day AND o.a = e.a AND o.b = e.b AND o.observed AND o.t > e.t AND o.t <= e.t + 120) AS hit
   FROM t1all e""", "t1all"))
def j15(spark, d):
    return pb.with_hit(tier1(spark, d), 120).select("day", "t", "a", "b", "hit")


@query("q7_pair_hits", statement("""SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM t1all o WHERE o.day = e.day AND o.a = e.a AND o.b = e.b AND o.observed AND o.t > e.t AND o.t <= e.t + 120)) AS hits
   FROM t1all e WHERE NOT observed AND cp_t > 0 AND cp_t <= 120""", "t1all"))
def q7(spark, d):
    q = pb.pair_probabilities(tier1(spark, d), curves(spark, d), 3.0, 1000.0, 120)
    return q.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


@query("q8_expected_conflicts", statement(f"""SELECT window_id, {r('sum(p) AS expected_conflicts')} FROM (SELECT window_id, e.day, a, b, max(1 / (1 + s_cpa)) AS p FROM clock c JOIN t1all e
   ON e.t >= c.t_start AND e.t < c.t_end GROUP BY ALL) GROUP BY 1""", "clock", "t1all"))
def q8(spark, d):
    """Per-pair maxima summed per window, here on a simple closeness score."""
    p = tier1(spark, d).select("day", "t", "a", "b", (1 / (1 + F.col("s_cpa"))).alias("prob"))
    return rounded(pb.expected_conflicts(p, q_windows.clock(spark, d).drop("day")))


GRID = sweeps.analysis_grid(SPEC, 1.0, (0.5, 2.0), 0.05, (0.02, 0.1))


def _settings_sql():
    rows = [(p, v, t, float(h), float(z), float(s.lookahead_s), float(s.radius_nm), float(s.ceiling_ft)) for p, v, s in sweeps.settings_grid(SPEC) for t, h, z in s.tiers]
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in row) + ")" for row in rows)


def sweep_ctes(p, values, columns):
    """Episodes of every setting; ``columns`` tell the settings apart."""
    cte(f"{p}s", f"SELECT * FROM (VALUES {values}) v({columns}, tier, h_lim, v_lim, look, rad, ceil)")
    cte(f"{p}p", f"SELECT * FROM pairs CROSS JOIN {p}s", "pairs", f"{p}s")
    q_pairs.ev_cte(f"{p}e", f"{p}p", "look", "ra <= rad AND rb <= rad AND ha <= ceil + 2000 AND hb <= ceil + 2000", f"{p}p")
    keep = f"{columns}, tier, day, t, a, b, h_lim, ceil, ha, hb"
    cte(f"{p}k", f"""SELECT {keep}, 'observed' AS kind, s_step AS s, st_d AS d_h FROM {p}e WHERE observed UNION ALL SELECT {keep}, 'predicted', s_cpa, cp_d FROM {p}e WHERE predicted
      UNION ALL SELECT {keep}, 'any', CASE WHEN observed THEN s_step ELSE s_cpa END, CASE WHEN observed THEN st_d ELSE cp_d END FROM {p}e WHERE observed OR predicted""", f"{p}e")
    cte(f"{p}m", f"""SELECT *, sum(CASE WHEN t - pt > 11 THEN 1 ELSE 0 END) OVER (PARTITION BY {columns}, tier, kind, day, a, b ORDER BY t) AS ep
      FROM (SELECT *, lag(t) OVER (PARTITION BY {columns}, tier, kind, day, a, b ORDER BY t) AS pt FROM {p}k)""", f"{p}k")
    cte(f"{p}x", f"""SELECT {columns}, tier, kind, t AS t_min, greatest(ha, hb) <= ceil AS inside FROM {p}m
      QUALIFY row_number() OVER (PARTITION BY {columns}, tier, kind, day, a, b, ep ORDER BY round(s + 1e-6 * d_h / h_lim, 9), t) = 1""", f"{p}m")


sweep_ctes("sw", _settings_sql(), "parameter, value")


@query("v1_sensitivity_sweep", statement("SELECT parameter, value, tier, kind, count(*) AS n, count(*) FILTER (inside) AS n_inside FROM swx GROUP BY ALL", "swx"))
def v1(spark, d):
    """Encounter counts of all settings in one job."""
    e = sweeps.sweep_encounters(q_pairs.pairs(spark, d), sweeps.settings_grid(SPEC), RWY)
    return e.groupBy("parameter", "value", "tier", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside_ceiling").alias("n_inside"))


def track_approaches(spark, d):
    """Rows of the track view read as classified approaches."""
    st = views.states(spark, d)
    v, kind = F.col("value"), F.col("event_type")
    outcome = (F.when((kind == "error") & v.between(100, 110), "go_around").when((kind == "error") & (v > 110), "touch_and_go").when((kind == "signup") & (v > 150), "ga_ambiguous")
               .when(kind == "purchase", "full_stop").otherwise("unresolved"))
    return st.select(F.col("event_id").alias("approach_id"), "icao24", outcome.alias("outcome"), F.col("t").alias("t_low"), F.lit(None).cast("bigint").alias("t_climb"))


cte("tap", """SELECT event_id AS id, t AS t0, CASE WHEN event_type = 'error' AND value BETWEEN 100 AND 110 THEN 'go_around' WHEN event_type = 'error' AND value > 110 THEN 'touch_and_go'
   WHEN event_type = 'signup' AND value > 150 THEN 'ga_ambiguous' WHEN event_type = 'purchase' THEN 'full_stop' END AS outcome FROM states""", "states")
cte("tzone", "SELECT DISTINCT t0 AS te FROM tap WHERE outcome IN ('go_around', 'touch_and_go', 'ga_ambiguous')", "tap")
cte("tcl0", "SELECT id, t0, coalesce(t0 - lag(t0) OVER (ORDER BY t0, id) > 60, true) AS fresh FROM tap WHERE outcome IN ('go_around', 'touch_and_go')", "tap")
cte("tcl", """SELECT id, count(*) OVER (PARTITION BY c) AS many FROM (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (ORDER BY t0, id) AS c FROM tcl0)""", "tcl0")


def _grid_sql():
    rows = []
    for i, v in enumerate(GRID):
        (t, h, z), = [x for x in v.spec.tiers if x[0] == "T1"]
        given = (i, round(v.window_min * 60), round(v.exclusion_min * 60), int("ga_ambiguous" in v.outcomes), int("go_around" in v.outcomes), int("touch_and_go" in v.outcomes), int(v.isolated))
        rows.append(f"({', '.join(f'{x}::BIGINT' for x in given)}, '{v.parameter}', '{v.value}', '{t}', {h!r}::DOUBLE, {z!r}::DOUBLE, {v.spec.lookahead_s!r}::DOUBLE, {v.spec.radius_nm!r}::DOUBLE, {v.spec.ceiling_ft!r}::DOUBLE)")
    return ", ".join(rows)


sweep_ctes("sv", _grid_sql(), "variant, w, ex, amb, ga, tg, iso, parameter, value")
cte("svx1", "SELECT variant, t_min AS t FROM svx WHERE kind = 'any' AND inside", "svx")
cte("svg", """SELECT s.*, a.id, a.t0, 1 AS ig FROM svs s JOIN tap a ON (a.outcome = 'ga_ambiguous' AND amb = 1) OR (a.outcome = 'go_around' AND ga = 1) OR (a.outcome = 'touch_and_go' AND tg = 1)
   LEFT JOIN tcl ON tcl.id = a.id WHERE iso = 0 OR many = 1""", "svs", "tap", "tcl")
cte("svc", """SELECT s.*, a.id, a.t0, 0 AS ig FROM svs s JOIN tap a ON a.outcome = 'full_stop' AND NOT EXISTS (SELECT 1 FROM tzone z WHERE z.te BETWEEN a.t0 - s.ex AND a.t0 + s.ex)""", "svs", "tap", "tzone")
cte("svclock", """SELECT s.*, day_no * 86400 + k * w AS c0 FROM svs s CROSS JOIN gdays g, generate_series(0, 2879) x(k) WHERE k < 86400 // w
   AND NOT EXISTS (SELECT 1 FROM tzone z WHERE z.te BETWEEN day_no * 86400 + k * w - s.ex AND day_no * 86400 + k * w + w + s.ex)""", "svs", "gdays", "tzone")
cte("svsec", "SELECT v.variant, t, count(*) * (count(*) - 1) // 2 AS ps FROM pres p JOIN svs v ON p.r <= v.rad AND p.h <= v.ceil GROUP BY ALL", "pres", "svs")
cte("svspan", """SELECT variant, ig, id::VARCHAR AS id, 'pre' AS wn, t0 - w AS ta, t0 AS tb FROM (SELECT * FROM svg UNION ALL SELECT * FROM svc) UNION ALL
   SELECT variant, ig, id::VARCHAR, 'post', t0, t0 + w FROM (SELECT * FROM svg UNION ALL SELECT * FROM svc) UNION ALL SELECT variant, 2, c0::VARCHAR, 'clock', c0, c0 + w FROM svclock""", "svg", "svc", "svclock")
cte("svn", "SELECT p.variant, ig, id, wn, count(*) AS n FROM svspan p JOIN svx1 x ON x.variant = p.variant AND x.t >= ta AND x.t < tb GROUP BY ALL", "svspan", "svx1")
cte("svh", "SELECT p.variant, ig, id, wn, sum(ps) / 3600.0::DOUBLE AS h FROM svspan p JOIN svsec x ON x.variant = p.variant AND x.t >= ta AND x.t < tb GROUP BY ALL", "svspan", "svsec")
cte("svcell", "SELECT p.*, coalesce(n, 0) AS n, coalesce(h, 0) AS h FROM svspan p LEFT JOIN svn USING (variant, ig, id, wn) LEFT JOIN svh USING (variant, ig, id, wn)", "svspan", "svn", "svh")
cte("svrate", "SELECT variant, sum(n) / nullif(sum(h), 0) AS rate FROM svcell WHERE wn = 'clock' GROUP BY 1", "svcell")
cte("svrow", """SELECT a.variant, a.ig, a.id, a.n AS n0, b.n AS n1, rate * a.h AS x0, rate * b.h AS x1, strftime(make_timestamp(a.ta * 1000000), '%Y-%m-%d') AS day, (a.tb // 3600) % 24 AS hour
   FROM svcell a JOIN svcell b ON a.wn = 'pre' AND b.wn = 'post' AND a.variant = b.variant AND a.ig = b.ig AND a.id = b.id LEFT JOIN svrate r ON r.variant = a.variant""", "svcell", "svrate")
cte("svday", "SELECT variant, day, sum(n1)::DOUBLE AS a, sum(n0)::DOUBLE AS b FROM svrow WHERE ig = 1 GROUP BY ALL", "svrow")
boot_cte("svb", "svday", "variant", ["a", "b"], ["svday"], reps=BASELINE.sweep_reps)
cte("svmatch", """SELECT c.variant, sum(ng * c0 / nc) AS m0, sum(ng * c1 / nc) AS m1, sum(nc) AS nc, sum(g0) AS g0, sum(g1) AS g1 FROM
   (SELECT variant, hour, count(*)::DOUBLE AS nc, sum(n0) AS c0, sum(n1) AS c1 FROM svrow WHERE ig = 0 GROUP BY ALL) c
   JOIN (SELECT variant, hour, count(*) AS ng, sum(n0) AS g0, sum(n1) AS g1 FROM svrow WHERE ig = 1 GROUP BY ALL) g ON g.variant = c.variant AND g.hour = c.hour GROUP BY 1""", "svrow")


@query("v1_sweep_results", statement(f"""SELECT parameter, value, x.variant = 0 AS is_base, n_events, nc::BIGINT AS n_controls, s0::DOUBLE AS sum_pre, s1::DOUBLE AS sum_post,
   {r('s1 / nullif(s0, 0)::DOUBLE AS total_ratio', 'CASE WHEN s0 > 0 THEN q_lo END AS total_ratio_lo', 'CASE WHEN s0 > 0 THEN q_hi END AS total_ratio_hi', '(g1 / nullif(g0, 0)::DOUBLE) / nullif(m1 / nullif(m0, 0), 0) AS vs_normal',
      's0 / nullif(e0, 0) AS sir_pre', 's1 / nullif(e1, 0) AS sir_post')}
   FROM (SELECT variant, count(*) AS n_events, sum(n0) AS s0, sum(n1) AS s1, sum(x0) AS e0, sum(x1) AS e1 FROM svrow WHERE ig = 1 GROUP BY 1) x JOIN svs USING (variant)
   LEFT JOIN svmatch ON svmatch.variant = x.variant LEFT JOIN (SELECT g, CASE WHEN any_value(nd) >= 2 THEN quantile_cont(a / nullif(b, 0), 0.025) END AS q_lo, CASE WHEN any_value(nd) >= 2 THEN quantile_cont(a / nullif(b, 0), 0.975) END AS q_hi FROM svb GROUP BY g) y ON y.g = x.variant""",
   "svrow", "svs", "svmatch", "svb"))
def v1_results(spark, d):
    """Every analysis of the sweep to its results, the variant being a grouping key."""
    out = sweeps.sweep_results(cut_lineage(q_pairs.pairs(spark, d)), q_pairs.presence(spark, d), track_approaches(spark, d), q_windows.grid_days(spark, d), GRID, RWY)
    return rounded(out.select("parameter", "value", "is_base", "n_events", "n_controls", "sum_pre", "sum_post", "total_ratio", "total_ratio_lo", "total_ratio_hi", "vs_normal", "sir_pre", "sir_post"))


def _known(col):
    k = f"(SELECT day, icao24, leg_no, t, {col} AS v FROM fix WHERE {col} IS NOT NULL)"
    return f"""SELECT s.day, s.icao24, s.leg_no, s.t, CASE WHEN p.t = s.t THEN p.v ELSE p.v + (n.v - p.v) * (s.t - p.t) / (n.t - p.t) END AS {col} FROM secs s
      ASOF LEFT JOIN {k} p ON p.day = s.day AND p.icao24 = s.icao24 AND p.leg_no = s.leg_no AND p.t <= s.t ASOF LEFT JOIN {k} n ON n.day = s.day AND n.icao24 = s.icao24 AND n.leg_no = s.leg_no AND n.t > s.t"""


cte("kgs", _known("groundspeed"), "secs", "fix")
cte("kh", _known("h"), "secs", "fix")
cte("shares", """SELECT b.day, avg((t > t1)::INT) AS interp, avg((t > t1 AND t2 - t1 > 4)::INT) AS long,
    count(DISTINCT CASE WHEN NOT (CASE WHEN t = t1 THEN o1 ELSE o1 + (o2 - o1) * w END > 0.5) AND groundspeed >= 50 AND h IS NOT NULL
      AND sqrt(pow(CASE WHEN t = t1 THEN x1 ELSE x1 + (x2 - x1) * w END, 2) + pow(CASE WHEN t = t1 THEN y1 ELSE y1 + (y2 - y1) * w END, 2)) <= 10 THEN icao24 || '_' || leg_no END) AS inside
  FROM base b JOIN kgs USING (day, icao24, leg_no, t) JOIN kh USING (day, icao24, leg_no, t) GROUP BY 1""", "base", "kgs", "kh")


@query("d1_data_audit", statement(f"""SELECT a.day, rows_in_file, messages, aircraft, legs, messages_in_legs, near AS messages_in_radius, inside AS airborne_in_volume, near - kept AS dropped_jumps, gaps AS gaps_over_10s,
    coalesce(outages, 0) AS outages, coalesce(outage_s, 0)::BIGINT AS outage_s, {r('1 - messages / rows_in_file AS stale_position_share', 'baro AS baro_alt_share', 'geo AS geo_alt_share', 'ground AS onground_share', 'interp AS interp_share', 'long AS interp_long_share')}
   FROM (SELECT day, count(*) AS rows_in_file FROM rep GROUP BY 1) a JOIN (SELECT day, count(*) AS messages, avg((altitude IS NOT NULL)::INT) AS baro,
     avg((geoaltitude IS NOT NULL)::INT) AS geo, avg(onground::INT) AS ground FROM fresh GROUP BY 1) b USING (day)
   JOIN (SELECT day, count(DISTINCT icao24) AS aircraft, count(DISTINCT icao24 || '_' || leg_no) AS legs, count(*) AS messages_in_legs FROM smoothed GROUP BY 1) c USING (day)
   JOIN (SELECT day, count(*) FILTER (t2 - t > 10) AS gaps FROM fix GROUP BY 1) h USING (day)
   JOIN shares USING (day) JOIN (SELECT day, count(*) AS near FROM num GROUP BY 1) j USING (day) JOIN (SELECT day, count(*) AS kept FROM kept GROUP BY 1) k USING (day)
   LEFT JOIN (SELECT day, count(*) AS outages, sum(b - a) AS outage_s FROM silence s WHERE EXISTS (SELECT 1 FROM flights f WHERE f.day = s.day AND f.t_first < s.a AND f.t_last > s.b) GROUP BY 1) o USING (day)""",
   "rep", "fresh", "smoothed", "fix", "num", "kept", "silence", "flights", "shares"))
def d1(spark, d):
    raw = q_clean._reports(spark, d)
    near = q_clean._fresh_sec(spark, d)
    clean = cut_lineage(q_clean.clean(spark, d))
    out = audit.audit_days(raw, cl.fresh_reports(raw), near, cl.drop_jumps(near), clean, gr.leg_to_grid(clean), gr.report_gaps(clean), q_clean.c18(spark, d))
    return rounded(out.select("day", "rows_in_file", "messages", "aircraft", "legs", "messages_in_legs", "messages_in_radius", "airborne_in_volume", "dropped_jumps", "gaps_over_10s", "outages",
                              "outage_s", "stale_position_share", "baro_alt_share", "geo_alt_share", "onground_share", "interp_share", "interp_long_share"))


@query("d2_profile_detection")
def d2(spark, d):
    return rounded(audit.detect_profile(q_clean._reports(spark, d), AIRPORT))


@query("d3_encounter_density", statement("""SELECT ix, iy, count(*) AS n, part FROM (SELECT least(floor((xa + xb) / 2 + 10), 19)::BIGINT AS ix, least(floor((ya + yb) / 2 + 10), 19)::BIGINT AS iy, 'after' AS part FROM enc e
   WHERE tier = 'T1' AND kind = 'any' AND EXISTS (SELECT 1 FROM tev WHERE e.t_min >= t0 AND e.t_min < t0 + 60)
   UNION ALL SELECT least(floor((xa + xb) / 2 + 10), 19)::BIGINT, least(floor((ya + yb) / 2 + 10), 19)::BIGINT, 'normal' FROM enc e WHERE tier = 'T1' AND kind = 'any' AND NOT EXISTS (SELECT 1 FROM tev WHERE e.t_min >= t0 - 5 AND e.t_min < t0 + 5)) GROUP BY ALL""", "enc", "tev"))
def d3(spark, d):
    e = cut_lineage(q_pairs.enc(spark, d, Spec(ceiling_ft=4000.0, tiers=SPEC.tiers[:1])).filter("kind = 'any'"))
    return pd_.density(e, q_windows.track_events(spark, d), 60, 5)


@query("d5_traffic_around_events", statement("""SELECT event_id, dt, coalesce(aircraft_s, 0) AS n FROM tev CROSS JOIN generate_series(-60, 59) g(dt) LEFT JOIN sec1 s ON s.t = t0 + dt""", "tev", "sec1"))
def d5(spark, d):
    return rounded(pd_.traffic_around(q_windows.track_events(spark, d), ex.per_second(q_pairs.presence(spark, d), SPEC), 60))


@query("d6_encounters_around_events", statement("""SELECT event_id, a, b, t_start, t_end FROM enc e JOIN tev ON e.t_end >= t0 - 60 AND e.t_start < t0 + 60 WHERE tier = 'T1' AND kind = 'any'""", "enc", "tev"))
def d6(spark, d):
    e = q_pairs.enc(spark, d, Spec(ceiling_ft=4000.0, tiers=SPEC.tiers[:1])).filter("kind = 'any'")
    return pd_.encounters_around(q_windows.track_events(spark, d), e, 60).select("event_id", "a", "b", "t_start", "t_end")


@query("src8_profile_parameters", statement("""SELECT s_suppkey AS airport, name, CASE WHEN s_suppkey % 7 = 0 AND name = 'max_dist_nm' THEN 6.5::DOUBLE WHEN s_suppkey % 2 = 0 AND name = 'touchdown_gs_kt' THEN 80 WHEN s_suppkey % 2 = 0 AND name = 'max_dist_nm' THEN 8
    WHEN name = 'touchdown_gs_kt' THEN 50 ELSE 5 END AS value FROM supplier, (VALUES ('touchdown_gs_kt'), ('max_dist_nm')) v(name)"""))
def src8(spark, d):
    s = views.load(spark, d, "supplier").select(F.col("s_suppkey").alias("airport"))
    prof = s.withColumn("preset", F.when(F.col("airport") % 2 == 0, "air_carrier").otherwise("training_ga"))
    over = s.filter("airport % 7 = 0").withColumns({"name": F.lit("max_dist_nm"), "value": F.lit(6.5)})
    out = profiles.effective_params(prof, over, ["touchdown_gs_kt", "max_dist_nm"], {"touchdown_gs_kt": 50.0, "max_dist_nm": 5.0})
    return out.select("airport", "name", "value")


@query("src9_runway_ends", statement("""SELECT airport, runway, round(lat, 6) AS lat FROM (SELECT s_nationkey::BIGINT AS airport, 'L' || s_suppkey AS runway, 30 + s_suppkey / 1000.0 AS lat, s_suppkey % 5 AS closed FROM supplier
   UNION ALL SELECT s_nationkey::BIGINT, 'H' || s_suppkey, 30.02 + s_suppkey / 1000.0, s_suppkey % 5 FROM supplier) WHERE closed <> 1"""))
def src9(spark, d):
    s = views.load(spark, d, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(
        F.col("s_nationkey").cast("bigint").alias("airport_ident"), (k % 5 == 1).cast("int").alias("closed"),
        F.concat(F.lit("L"), k).alias("le_ident"), (30 + k / 1000).alias("le_latitude_deg"), F.lit(-80.0).alias("le_longitude_deg"),
        F.concat(F.lit("H"), k).alias("he_ident"), (30.02 + k / 1000).alias("he_latitude_deg"), F.lit(-79.98).alias("he_longitude_deg"))
    return rounded(airports.runway_ends(rows).select(F.col("airport"), "runway", "lat"))


@query("src10_sample_days", statement("""SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM study))
   WHERE i IN (SELECT round_even(k * (n - 1) / 4.0, 0) FROM generate_series(0, 4) g(k))""", "study"))
def src10(spark, d):
    """An even sample of days."""
    return audit.sample_days(views.study(spark, d).select("day").distinct())


@query("src2_typed_reports", statement("""SELECT icao24, us, round(latitude, 6) AS latitude, altitude, geoaltitude, onground, round(position_time, 6) AS position_time FROM reports""", "reports"))
def src2(spark, d):
    """Reports read as text and typed again."""
    from ..sources.files import typed_reports

    raw = views.reports(spark, d).withColumnRenamed("position_time", "last_position")
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    t = typed_reports(text)
    return rounded(t.select("icao24", F.unix_micros("timestamp").alias("us"), "latitude", "altitude", "geoaltitude", "onground", "position_time"))


@query("src5_event_outcomes", statement("SELECT approach_id, outcome FROM approaches WHERE outcome IN ('go_around', 'touch_and_go', 'ga_ambiguous')", "approaches"))
def src5(spark, d):
    from ..settings import EVENT_OUTCOMES_AMBIGUOUS

    return views.approaches(spark, d).filter(F.col("outcome").isin(*EVENT_OUTCOMES_AMBIGUOUS)).select("approach_id", "outcome")


def _nodes_sql(n=48):
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(n)
    return ", ".join(f"({float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for a, b in zip(x, w))


cte("node", f"SELECT * FROM (VALUES {_nodes_sql()}) v(x, w)")
cte("still", "SELECT event_id, least(value, 100) / 50 AS px, (user_id % 10) / 5 AS py FROM study", "study")


@query("q5_disc_probability", statement("""SELECT event_id, round(sum(w * exp(-0.5 * (0.3*dx*dx - 2*0.1*dx*dy + 0.5*dy*dy) / 0.14)) / (2 * pi() * sqrt(0.14::DOUBLE)), 5) AS p FROM (
   SELECT event_id, a.w * b.w * pi() / 2 * (a.x + 1) / 2 AS w, (a.x + 1) / 2 * cos(pi() * (b.x + 1)) - px AS dx, (a.x + 1) / 2 * sin(pi() * (b.x + 1)) - py AS dy
   FROM still CROSS JOIN node a CROSS JOIN node b) GROUP BY 1""", "still", "node"))
def q5(spark, d):
    """Mass of a correlated normal error inside the unit disc around an offset point."""
    s = views.study(spark, d).select("event_id", (F.least("value", F.lit(100.0)) / 50).alias("px"), ((F.col("user_id") % 10) / 5).alias("py"))
    p = pb.disc_probability(F.col("px"), F.col("py"), F.lit(0.5), F.lit(0.3), F.lit(0.1), 1.0, 48)
    return rounded(s.select("event_id", p.alias("p")), 5)
