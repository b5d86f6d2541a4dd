"""Catalogue: approaches, outcomes and their summaries (A1-A8, AG1-AG6, V2)."""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import functions as F

from ..functions import timefns
from ..operators import approaches as ap, summaries as sm
from ..settings import APPROACH, OUTCOME_GRID
from . import views
from .registry import cte, query, statement
from .tidy import r, rounded
from .views import AIRPORT, FINAL_RUNWAYS as RWY

cte("frwy", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {x}::DOUBLE, {y}::DOUBLE, {b}::DOUBLE)" for k, (n, x, y, b) in enumerate(RWY)) + ") v(k, runway, tx, ty, bearing)")
cte("fr", """SELECT * FROM (SELECT *, row_number() OVER w AS i, lead(t) OVER w AS t_next, count(*) OVER (PARTITION BY day, leg) AS n
  FROM finals WINDOW w AS (PARTITION BY day, leg ORDER BY t)) WHERE n >= 60""", "finals")
cte("fal", """SELECT day, leg, icao24, t, agl, arg_min(runway, struct_pack(s := turn + 20 * abs(cr), k := k)) AS runway FROM (
    SELECT f.*, k, runway, -((x - tx) * sin(radians(bearing)) + (y - ty) * cos(radians(bearing))) AS al,
      (x - tx) * cos(radians(bearing)) - (y - ty) * sin(radians(bearing)) AS cr,
      abs((track - bearing + 180) - 360 * floor((track - bearing + 180) / 360) - 180) AS turn FROM fr f CROSS JOIN frwy)
  WHERE al > -0.3 AND al < 5 AND abs(cr) < 0.3 AND turn < 25 AND agl < 1500 GROUP BY ALL""", "fr", "frwy")
cte("fgrp", """SELECT *, sum(CASE WHEN t - pt > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY day, leg ORDER BY t) AS g
  FROM (SELECT *, lag(t) OVER (PARTITION BY day, leg ORDER BY t) AS pt FROM fal)""", "fal")
cte("fvote", """SELECT day, leg, g, runway, sum(CASE WHEN agl < 500 THEN 5 ELSE 1 END) AS w, min(t) AS seen FROM fgrp GROUP BY ALL""", "fgrp")
cte("fspan", """SELECT s.day, s.leg, s.icao24, s.st AS start, s.en AS "end", v.runway FROM (
    SELECT day, leg, icao24, g, min(t) AS st, max(t) AS en, count(*) AS n FROM fgrp GROUP BY ALL) s
  JOIN (SELECT *, row_number() OVER (PARTITION BY day, leg, g ORDER BY w DESC, seen) AS rn FROM fvote) v
    ON v.day = s.day AND v.leg = s.leg AND v.g = s.g AND rn = 1
  WHERE n >= 2 AND en - st >= 20
    AND (SELECT min(agl) FROM fr WHERE fr.day = s.day AND fr.leg = s.leg AND fr.t BETWEEN st AND en) <= 800
    AND (SELECT max(agl) - min(agl) FROM fr WHERE fr.day = s.day AND fr.leg = s.leg AND fr.t BETWEEN st AND en) >= 100""", "fgrp", "fvote", "fr")
cte("zone", """SELECT s.start, s."end", s.runway, f.* FROM fspan s JOIN fr f ON f.day = s.day AND f.leg = s.leg
  AND f.t >= s.start AND f.t <= s."end" + 180""", "fspan", "fr")
cte("lowpt", """SELECT day, leg, start, min(agl) AS lo, arg_min(i, struct_pack(a := agl, i := i)) AS ilow, arg_min(t, struct_pack(a := agl, i := i)) AS tlow
  FROM zone WHERE t <= "end" GROUP BY ALL""", "zone")
cte("zl", "SELECT z.*, lo, ilow, tlow FROM zone z JOIN lowpt USING (day, leg, start)", "zone", "lowpt")
cte("band", """SELECT *, sum(CASE WHEN i - pi > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY day, leg, start ORDER BY i) AS br FROM (
  SELECT *, lag(i) OVER (PARTITION BY day, leg, start ORDER BY i) AS pi FROM zl WHERE agl <= lo + 60)""", "zl")
cte("plateau", """SELECT day, leg, start, (max(t) - min(t))::DOUBLE AS plateau_s FROM band b
  JOIN (SELECT day, leg, start, br FROM band WHERE i = ilow) x USING (day, leg, start, br) GROUP BY ALL""", "band")
cte("climbs", """SELECT day, leg, start, cr, min(i) AS ci, min(t) AS c0, max(t) AS c1, any_value(tlow) AS tlow FROM (
  SELECT *, sum(CASE WHEN i - pi > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY day, leg, start ORDER BY i) AS cr FROM (
    SELECT *, lag(i) OVER (PARTITION BY day, leg, start ORDER BY i) AS pi FROM zl WHERE i >= ilow AND vrate >= 300)) GROUP BY ALL""", "zl")
cte("cs", "SELECT day, leg, start, min(ci) AS ci, min(c0) AS ct FROM climbs WHERE c1 - c0 >= 15 AND c0 - tlow <= 120 GROUP BY ALL", "climbs")
cte("prof", """SELECT z.day, z.leg, z.start, z."end", z.runway, z.icao24, any_value(lo) AS min_agl_ft, any_value(tlow) AS t_low, any_value(ct) AS t_climb, any_value(ci) AS ci,
   any_value(plateau_s) AS plateau_s, max(agl) FILTER (i >= ilow) - any_value(lo) AS alt_regain_ft,
   CASE WHEN any_value(ilow) > min(i) THEN max(agl) FILTER (i <= ilow) - any_value(lo) ELSE 0 END AS observed_descent_ft,
   coalesce(max(i) FILTER (i <= ilow AND agl > lo + 60) + 1, min(i)) AS ei,
   coalesce(arg_max(t_next, i) FILTER (i <= ilow AND agl > lo + 60), min(t)) AS et,
   max(vrate) FILTER (i >= ci AND i < ci + 90) AS peak_climb_fpm, min(agl) FILTER (i = ci) AS init_agl_ft,
   coalesce(bool_or(t <= z."end" AND agl < 300), false) AND (coalesce(bool_or(t <= z."end" AND agl < 300 AND onground), false) OR any_value(lo) <= 25
     OR (any_value(lo) <= 120 AND any_value(plateau_s) >= 20) OR coalesce(min(groundspeed) FILTER (t <= z."end" AND agl < 200) <= 50, false)
     OR coalesce(bool_or(t_next <= z."end" AND t_next - t > 12 AND agl < 150), false)) AS touchdown
 FROM zl z LEFT JOIN plateau p USING (day, leg, start) LEFT JOIN cs USING (day, leg, start) GROUP BY z.day, z.leg, z.start, z."end", z.runway, z.icao24""", "zl", "plateau", "cs")
cte("prof2", "SELECT *, (CASE WHEN ci > ei THEN t_climb - et ELSE plateau_s END)::DOUBLE AS level_s, t_climb IS NOT NULL AND alt_regain_ft >= 250 AS up FROM prof", "prof")
cte("outc", """SELECT *, CASE WHEN touchdown AND up THEN 'touch_and_go' WHEN touchdown THEN 'full_stop' WHEN up AND observed_descent_ft < 150 THEN 'unresolved'
   WHEN up AND min_agl_ft <= 1000 THEN CASE WHEN level_s <= 20 THEN 'go_around' WHEN level_s >= 30 THEN 'low_approach' ELSE 'ga_ambiguous' END
   WHEN up THEN 'high_breakoff' ELSE 'unresolved' END AS outcome FROM prof2""", "prof2")
cte("hid", """SELECT o.*, coalesce((SELECT sum(least(t_next, t_climb) - greatest(t, t_climb - level_s)) FROM fr WHERE fr.day = o.day AND fr.leg = o.leg
     AND least(t_next, t_climb) - greatest(t, t_climb - level_s) > 5), 0)::DOUBLE AS hidden FROM outc o""", "outc", "fr")
cte("hid2", """SELECT * EXCLUDE (outcome, hidden), CASE WHEN outcome IN ('low_approach', 'ga_ambiguous') THEN hidden ELSE 0 END AS hidden,
   CASE WHEN outcome IN ('low_approach', 'ga_ambiguous') AND hidden > 0 AND level_s - hidden <= 20 THEN outcome ELSE '' END AS reclassified_from,
   CASE WHEN outcome IN ('low_approach', 'ga_ambiguous') AND hidden > 0 AND level_s - hidden <= 20 THEN 'go_around' ELSE outcome END AS outcome FROM hid""", "hid")
cte("chained", """SELECT * EXCLUDE (outcome), CASE WHEN gap IS NULL THEN 'leg_end' ELSE 'reapproach' END AS next_action,
   CASE WHEN outcome = 'unresolved' AND gap <= 240 THEN 'continued_approach' ELSE outcome END AS outcome FROM (
   SELECT *, (lead(start) OVER (PARTITION BY day, leg ORDER BY start) - "end")::DOUBLE AS gap FROM hid2)""", "hid2")


def rows_of(spark, d):
    pts = views.finals(spark, d)
    n = pts.groupBy("day", "leg").agg(F.count(F.lit(1)).alias("n")).filter("n >= 60")
    return ap.with_row_index(pts.join(n.select("day", "leg"), ["day", "leg"], "left_semi"))


def measured(spark, d):
    rows = rows_of(spark, d)
    return rows, ap.measure(rows, ap.detect_approaches(rows, RWY))


KEY = "day, leg, start"


@query("a1_detect_approaches", statement(f'SELECT {KEY}, "end", runway FROM fspan', "fspan"))
def a1(spark, d):
    return ap.detect_approaches(rows_of(spark, d), RWY).select("day", "leg", "start", "end", "runway")


cte("back", "SELECT *, row_number() OVER (PARTITION BY day, leg ORDER BY i DESC) AS rb, max(t) OVER (PARTITION BY day, leg) AS tl FROM fr", "fr")
cte("ends", """SELECT day, leg, max(t) AS tl, min(t) FILTER (t >= tl - 120) AS start, min(agl) FILTER (rb = 1) AS agl, min(sqrt(x*x + y*y)) FILTER (rb = 1) AS dist,
   median(vrate) FILTER (rb <= 60) AS vr, median(abs((track - 90 + 180) - 360 * floor((track - 90 + 180) / 360) - 180)) FILTER (rb <= 30) AS d0,
   median(abs((track + 180) - 360 * floor((track + 180) / 360) - 180)) FILTER (rb <= 30) AS d1 FROM back GROUP BY ALL""", "back")


@query("a2_truncated_finals", statement("""SELECT day, leg, start, tl AS "end", CASE WHEN d0 < 45 AND d0 <= d1 THEN '09' WHEN d1 < 45 THEN '36' ELSE '' END AS runway
 FROM ends e WHERE agl <= 2000 AND dist <= 6 AND vr <= 100 AND NOT EXISTS (SELECT 1 FROM fspan s WHERE s.day = e.day AND s.leg = e.leg AND e.tl - s."end" < 50)""", "ends", "fspan"))
def a2(spark, d):
    """Wider limits than the defaults, so that the view has legs of this kind."""
    rows = rows_of(spark, d)
    wide = dc.replace(APPROACH, truncated_agl_ft=2000.0, truncated_dist_nm=6.0, truncated_covered_s=50.0)
    out = ap.truncated_finals(rows, ap.detect_approaches(rows, RWY), RWY, wide)
    return out.select("day", "leg", "start", "end", "runway")


@query("a3_plateau_duration", statement(f"SELECT {KEY}, plateau_s FROM prof", "prof"))
def a3(spark, d):
    return measured(spark, d)[1].select("day", "leg", "start", "plateau_s")


@query("a4_touchdown_evidence", statement(f"SELECT {KEY}, touchdown FROM prof", "prof"))
def a4(spark, d):
    return measured(spark, d)[1].select("day", "leg", "start", ap.touchdown().alias("touchdown"))


@query("a5_outcomes", statement(f"SELECT {KEY}, outcome, t_low, t_climb, {r('min_agl_ft', 'level_s', 'alt_regain_ft', 'observed_descent_ft', 'peak_climb_fpm')} FROM outc", "outc"))
def a5(spark, d):
    m = ap.outcome(measured(spark, d)[1])
    return rounded(m.select("day", "leg", "start", "outcome", "t_low", "t_climb", "min_agl_ft", "level_s", "alt_regain_ft", "observed_descent_ft", "peak_climb_fpm"))


@query("a6_hidden_low_point", statement(f"SELECT {KEY}, outcome, reclassified_from, hidden AS low_point_hidden_s FROM hid2", "hid2"))
def a6(spark, d):
    rows, m = measured(spark, d)
    return ap.reveal_hidden(rows, ap.outcome(m)).select("day", "leg", "start", "outcome", "reclassified_from", "low_point_hidden_s")


def classified(spark, d):
    rows, m = measured(spark, d)
    return ap.chain(ap.reveal_hidden(rows, ap.outcome(m)))


@query("a7_approach_chain", statement(f"SELECT {KEY}, outcome, next_action, gap AS next_gap_s FROM chained", "chained"))
def a7(spark, d):
    return classified(spark, d).select("day", "leg", "start", "outcome", "next_action", "next_gap_s")


@query("a8_approach_table", statement("""SELECT day, leg, runway, outcome, touchdown, round_even(min_agl_ft, 1) AS min_agl_ft, round_even(level_s, 1) AS level_low_duration_s,
   round_even(init_agl_ft, 1) AS init_agl_ft, round_even(peak_climb_fpm, 0) AS peak_climb_fpm, round_even(alt_regain_ft, 1) AS alt_regain_ft, start AS t_start,
   strftime(make_timestamp(t_low * 1000000) - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS local_text, next_action, reclassified_from FROM chained""", "chained"))
def a8(spark, d):
    t = ap.approach_table(classified(spark, d), RWY, AIRPORT)
    return t.select("day", "leg", "runway", "outcome", "touchdown", "min_agl_ft", "level_low_duration_s", "init_agl_ft", "peak_climb_fpm", "alt_regain_ft",
                    F.unix_seconds("approach_start_utc").alias("t_start"), F.date_format("t_local", "yyyy-MM-dd HH:mm:ss").alias("local_text"),
                    "next_action", "reclassified_from")


def _grid_sql():
    cols = {"level_go_around_max_s": ("level_s <= {v}", 0), }
    parts = []
    base = dict(ga="level_s <= 20", low="level_s >= 30", up="alt_regain_ft >= 250", td="20", top="1000")
    for name, values in OUTCOME_GRID.items():
        if name in ap.MEASURED:
            continue
        for v in values:
            p = dict(base)
            if name == "level_go_around_max_s":
                p["ga"] = f"level_s <= {v}"
            elif name == "level_low_approach_min_s":
                p["low"] = f"level_s >= {v}"
            elif name == "regain_min_ft":
                p["up"] = f"alt_regain_ft >= {v}"
            elif name == "max_low_agl_ft":
                p["top"] = str(v)
            else:
                p["td"] = str(v)
            up = f"(t_climb IS NOT NULL AND {p['up']})"
            td = f"(td0 OR (lows AND min_agl_ft <= 120 AND plateau_s >= {p['td']}))"
            clear = f"NOT {td} AND {up} AND observed_descent_ft >= 150 AND min_agl_ft <= {p['top']}"
            parts.append(f"""SELECT '{name}' AS param, {v}::DOUBLE AS value, {str(v == values[0]).lower()} AS baseline, count(*) AS approaches,
              count(*) FILTER ({clear} AND {p['ga']}) AS go_around, count(*) FILTER ({clear} AND NOT ({p['ga']}) AND NOT ({p['low']})) AS ga_ambiguous,
              count(*) FILTER ({clear} AND NOT ({p['ga']}) AND {p['low']}) AS low_approach, count(*) FILTER ({td} AND {up}) AS touch_and_go FROM tdsplit""")
    return "SELECT *, go_around + ga_ambiguous AS ga_total FROM (" + " UNION ALL ".join(parts) + ")"


cte("tdsplit", """SELECT p.*, lows, lows AND (og OR min_agl_ft <= 25 OR gs50 OR gapl) AS td0 FROM prof2 p JOIN (
   SELECT day, leg, start, coalesce(bool_or(t <= "end" AND agl < 300), false) AS lows, coalesce(bool_or(t <= "end" AND agl < 300 AND onground), false) AS og,
     coalesce(min(groundspeed) FILTER (t <= "end" AND agl < 200) <= 50, false) AS gs50,
     coalesce(bool_or(t_next <= "end" AND t_next - t > 12 AND agl < 150), false) AS gapl FROM zl GROUP BY ALL) USING (day, leg, start)""", "prof2", "zl")


@query("v2_threshold_grid", statement(_grid_sql(), "tdsplit"))
def v2(spark, d):
    rows = rows_of(spark, d)
    grid = {k: v for k, v in OUTCOME_GRID.items() if k not in ap.MEASURED}
    return ap.threshold_grid(rows, ap.detect_approaches(rows, RWY), grid)


@query("v2_profile_thresholds")
def v2_profile(spark, d):
    rows = rows_of(spark, d)
    grid = {k: v for k, v in OUTCOME_GRID.items() if k in ap.MEASURED}
    out = ap.threshold_grid(rows, ap.detect_approaches(rows, RWY), {"level_go_around_max_s": (20.0,), **grid})
    return out


# ------------------------------------------------------------ summaries ----

ATT = "outcome <> 'continued_approach'"


@query("ag1_outcome_shares", statement(f"""SELECT outcome, n AS count, round(100.0 * n / sum(n) OVER (), 3) + 0.0 AS pct_of_segments,
  CASE WHEN {ATT} THEN round(100.0 * n / sum(CASE WHEN {ATT} THEN n ELSE 0 END) OVER (), 3) END AS pct_of_attempts
  FROM (SELECT outcome, count(*) AS n FROM approaches GROUP BY 1)""", "approaches"))
def ag1(spark, d):
    return sm.outcome_shares(views.approaches(spark, d))


@query("ag2_by_runway", statement(f"""SELECT runway, count(*) AS attempts, count(*) FILTER (outcome = 'go_around') AS go_around, count(*) FILTER (outcome = 'ga_ambiguous') AS ga_ambiguous,
  count(*) FILTER (outcome = 'touch_and_go') AS touch_and_go, count(*) FILTER (outcome = 'low_approach') AS low_approach, count(*) FILTER (outcome = 'full_stop') AS full_stop,
  round(1000.0 * count(*) FILTER (outcome = 'go_around') / count(*), 2) AS ga_per_1000 FROM approaches WHERE {ATT} AND runway <> '' GROUP BY 1""", "approaches"))
def ag2(spark, d):
    return sm.by_runway(views.approaches(spark, d))


@query("ag3_by_month", statement(f"""SELECT strftime(make_timestamp(t_low * 1000000) - INTERVAL 6 HOUR, '%Y-%m') AS month, count(*) AS attempts,
  count(*) FILTER (outcome = 'go_around') AS go_around, count(*) FILTER (outcome = 'ga_ambiguous') AS ga_ambiguous,
  round(1000.0 * count(*) FILTER (outcome = 'go_around') / count(*), 2) AS ga_per_1000 FROM approaches WHERE {ATT} GROUP BY 1""", "approaches"))
def ag3(spark, d):
    return sm.by_month(views.approaches(spark, d), F.date_format(timefns.local_time(F.col("t_low"), AIRPORT.timezone), "yyyy-MM"))


@query("ag4_headline_rate", statement(f"""SELECT count(*) AS segments, count(*) FILTER ({ATT}) AS attempts, count(*) FILTER (outcome = 'go_around') AS go_arounds,
  round(1000.0 * count(*) FILTER (outcome = 'go_around') / count(*) FILTER ({ATT}), 2) AS per_1000 FROM approaches""", "approaches"))
def ag4(spark, d):
    return sm.headline(views.approaches(spark, d))


GA2 = "outcome IN ('go_around', 'ga_ambiguous')"


@query("ag5_local_hours", statement(f"""SELECT g.h AS hour, coalesce(n, 0) AS approaches, coalesce(ga, 0) AS ga FROM generate_series(0, 23) g(h) LEFT JOIN (
  SELECT hour(make_timestamp(t_low * 1000000) - INTERVAL 6 HOUR) AS h, count(*) AS n, count(*) FILTER ({GA2}) AS ga FROM approaches WHERE {ATT} GROUP BY 1) x ON x.h = g.h""", "approaches"))
def ag5_hours(spark, d):
    return sm.by_local_hour(views.approaches(spark, d), timefns.local_hour(F.col("t_low"), AIRPORT.timezone))


@query("ag5_runway_ranking", statement(f"""SELECT runway, count(*) AS approaches, count(*) FILTER ({GA2}) AS ga, {r(f'1000.0 * count(*) FILTER ({GA2}) / count(*) AS rate')}, count(*) >= 200 AS enough
  FROM approaches WHERE {ATT} AND runway <> '' GROUP BY 1""", "approaches"))
def ag5_ranking(spark, d):
    return rounded(sm.runway_ranking(views.approaches(spark, d)))


@query("ag5_describe_metrics", statement("SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS metric, count({c}) AS n, {r(f'avg({c}) AS mean', f'stddev({c}) AS std', f'min({c}) AS min', f'quantile_cont({c}, 0.25) AS q25', f'quantile_cont({c}, 0.5) AS q50',
     f'quantile_cont({c}, 0.75) AS q75', f'max({c}) AS max', digits=4)} FROM approaches WHERE outcome = 'go_around'""" for c in ("min_agl_ft", "t_low")) + ")", "approaches"))
def ag5_describe(spark, d):
    return rounded(sm.describe(views.approaches(spark, d).filter("outcome = 'go_around'").withColumn("t_low", F.col("t_low").cast("double")), ["min_agl_ft", "t_low"]), 4)


@query("ag5_next_actions", statement(f"SELECT next_action, count(*) AS n FROM chained WHERE {GA2} GROUP BY 1", "chained"))
def ag5_next(spark, d):
    return sm.next_actions(classified(spark, d))


@query("ag6_plateau_histogram", statement("""SELECT outcome, least(floor(least(min_agl_ft, 87) / 3), 28)::BIGINT * 3 AS bin_s, count(*) AS n FROM approaches
  WHERE outcome IN ('go_around', 'ga_ambiguous', 'low_approach', 'touch_and_go') GROUP BY ALL""", "approaches"))
def ag6(spark, d):
    return sm.plateau_histogram(views.approaches(spark, d).withColumn("level_s", F.col("min_agl_ft")))


@query("ag_order_flags", statement("""SELECT l_returnflag AS outcome, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 3) AS pct_of_segments,
  round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 3) AS pct_of_attempts FROM lineitem GROUP BY 1"""))
def ag_lineitem(spark, d):
    """The same share summary on the largest table."""
    return sm.outcome_shares(views.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("outcome")))
