"""Catalogue: windows, exposure, interval joins, events (W1-W10, J2-J12, J16, J19, J21, E1-E6, SNK5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crosscheck, encounters as en, events as evs, exposure as ex, grid as gr, pairs as pr, windows as wn
from ..operators.intervals import interval_sums
from ..settings import DAY_S, GEOMETRY_CLASSES, Spec
from ..sources import profiles
from . import q_pairs, views
from .q_pairs import RWY, SPEC
from .registry import cte, query, statement
from .tidy import r, rounded
from .views import AIRPORT

TIERS = ("T1", "T2")
FLOW = dict(AIRPORT.flows)


def flow(col):
    return profiles.flow_of(col, AIRPORT.flows)


FLOW_SQL = "CASE runway " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FLOW.items()) + " ELSE 'other' END"

# ------------------------------------------------ encounters on the event log


def study_encounters(spark, d):
    s = views.study(spark, d).filter(F.col("event_type").isin("click", "view"))
    classes = F.array(*[F.lit(c) for c in GEOMETRY_CLASSES])
    kinds = F.array(*[F.lit(k) for k in ("observed", "predicted", "any")])
    return s.select(
        "event_id", F.when(F.col("event_type") == "click", "T1").otherwise("T2").alias("tier"),
        F.element_at(kinds, (F.col("user_id") % 3 + 1).cast("int")).alias("kind"),
        F.element_at(classes, (F.col("event_id") % 6 + 1).cast("int")).alias("geometry_class"),
        (F.col("value") < 80).alias("inside_ceiling"), F.col("t").alias("t_min"), "day",
        F.concat(F.lit("u"), F.col("user_id")).alias("icao24_a"),
        F.concat(F.lit("u"), (F.col("user_id") * 7 + 3) % 150).alias("icao24_b"),
    )


CLASSES = "[" + ", ".join(f"'{c}'" for c in GEOMETRY_CLASSES) + "]"
cte("senc", f"""SELECT event_id, CASE WHEN event_type = 'click' THEN 'T1' ELSE 'T2' END AS tier,
   ['observed', 'predicted', 'any'][user_id % 3 + 1] AS kind, {CLASSES}[event_id % 6 + 1] AS geometry_class,
   value < 80 AS inside_ceiling, t AS t_min, day, 'u' || user_id AS icao24_a, 'u' || ((user_id * 7 + 3) % 150) AS icao24_b
  FROM study WHERE event_type IN ('click', 'view')""", "study")


def go_arounds(spark, d, minutes=60):
    return evs.event_table(views.approaches(spark, d), minutes)


cte("anch", """SELECT *, coalesce(t_climb, t_low) AS t0, CASE WHEN t_climb IS NULL THEN 't_low' ELSE 'climb_start' END AS anchor
  FROM approaches""", "approaches")
cte("ga0", """SELECT *, row_number() OVER (ORDER BY t_low, approach_id) - 1 AS n FROM anch
  WHERE outcome IN ('go_around', 'touch_and_go')""", "anch")
cte("ga1", """SELECT *, CASE outcome WHEN 'go_around' THEN 'ga_' ELSE 'tg_' END ||
    CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS event_id,
    t0 - 3600 AS t_pre_start, t0 + 3600 AS t_post_end, lag(t0) OVER (ORDER BY t0, n) AS pt FROM ga0""", "ga0")
cte("ga2", """SELECT *, coalesce(t0 - pt > 3600, true) AS cluster_first,
    sum(CASE WHEN coalesce(t0 - pt > 3600, true) THEN 1 ELSE 0 END) OVER (ORDER BY t0, n)::BIGINT - 1 AS cluster_id FROM ga1""", "ga1")
cte("ga", """SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cluster_size,
    EXISTS (SELECT 1 FROM anch o WHERE o.outcome IN ('go_around', 'touch_and_go', 'ga_ambiguous')
            AND o.t0 >= ga2.t_pre_start AND o.t0 < ga2.t0) AS pre_contaminated FROM ga2""", "ga2", "anch")
cte("gw", """SELECT event_id, 'pre' AS "window", t_pre_start AS t_start, t0 AS t_end FROM ga
  UNION ALL SELECT event_id, 'post', t0, t_post_end FROM ga""", "ga")
cte("ctl", """SELECT a.*, 'ctl_' || lpad((row_number() OVER (ORDER BY t_low, approach_id) - 1)::VARCHAR, 5, '0') AS event_id
  FROM approaches a WHERE outcome = 'full_stop' AND NOT EXISTS (SELECT 1 FROM anch o
    WHERE o.outcome IN ('go_around', 'touch_and_go', 'ga_ambiguous') AND o.t0 BETWEEN a.t_low - 1800 AND a.t_low + 1800)""",
    "approaches", "anch")


def windows_of(events, which=("pre", "post")):
    return evs.event_windows(events, which)


# -------------------------------------------------------------- windows ----

cte("gdays", "SELECT DISTINCT day, t // 86400 AS day_no FROM grid", "grid")
cte("clock", """SELECT day || '_' || lpad(k::VARCHAR, 3, '0') AS window_id, day, day_no * 86400 + k * 600 AS t_start,
    day_no * 86400 + (k + 1) * 600 AS t_end FROM gdays, generate_series(0, 143) s(k)""", "gdays")


def grid_days(spark, d):
    return views.grid(spark, d).select("day", F.floor(F.col("t") / DAY_S).alias("day_no")).distinct()


def clock(spark, d, minutes=10):
    return wn.clock_windows(grid_days(spark, d), minutes)


@query("w1_clock_windows", statement("SELECT * FROM clock", "clock"))
def w1(spark, d):
    return clock(spark, d)


cte("inv", "SELECT * FROM pres WHERE r <= 10 AND h <= 4000", "pres")
cte("sec1", """SELECT t, count(*) AS aircraft_s, count(*) * (count(*) - 1) // 2 AS pair_s,
    count(*) FILTER (r <= 5) * (count(*) FILTER (r <= 5) - 1) // 2 AS pair_s_inner,
    count(*) FILTER (interp_long) AS interp_s FROM inv GROUP BY t""", "inv")


@query("w2_per_second_counts", statement("SELECT t, aircraft_s, pair_s, pair_s_inner, interp_s FROM sec1", "sec1"))
def w2(spark, d):
    return ex.per_second(q_pairs.presence(spark, d), SPEC).select("t", "aircraft_s", "pair_s", "pair_s_inner", "interp_s")


# one-minute event windows on the track view
cte("tev", """SELECT 'ev_' || event_id AS event_id, icao24, t AS t0, t - 60 AS t_pre_start, t + 60 AS t_post_end, day FROM states
  WHERE event_type = 'error' AND value > 100 AND value <= 120""", "states")
cte("tw", """SELECT event_id, 'pre' AS "window", t_pre_start AS t_start, t0 AS t_end, icao24 FROM tev
  UNION ALL SELECT event_id, 'post', t0, t_post_end, icao24 FROM tev""", "tev")


def track_events(spark, d):
    st = views.states(spark, d).filter((F.col("event_type") == "error") & (F.col("value") > 100) & (F.col("value") <= 120))
    return st.select(
        F.concat(F.lit("ev_"), F.col("event_id")).alias("event_id"), "icao24", F.col("t").alias("t0"),
        (F.col("t") - 60).alias("t_pre_start"), (F.col("t") + 60).alias("t_post_end"), "day")


cte("ggaps", """SELECT day, leg, t AS t_start, t2 AS t_end FROM (
  SELECT day, leg, t, lead(t) OVER (PARTITION BY day, leg ORDER BY t) AS t2 FROM grid) WHERE t2 - t > 10""", "grid")


def grid_gaps(spark, d):
    from pyspark.sql import Window as W

    g = views.grid(spark, d)
    return (
        g.select("day", "leg", F.col("t").alias("t_start"), F.lead("t").over(W.partitionBy("day", "leg").orderBy("t")).alias("t_end"))
        .filter(F.col("t_end") - F.col("t_start") > 10)
    )


@query("j5_gaps_in_volume", statement("""SELECT day, leg, t_start FROM ggaps g WHERE EXISTS (
  SELECT 1 FROM inv i WHERE i.day = g.day AND i.leg = g.leg AND i.t = g.t_start)""", "ggaps", "inv"))
def j5(spark, d):
    return ex.gaps_in_volume(grid_gaps(spark, d), q_pairs.presence(spark, d), SPEC).select("day", "leg", "t_start")


cte("expo", """SELECT w.event_id, w."window", coalesce(sum(aircraft_s), 0)::BIGINT AS aircraft_s, coalesce(sum(pair_s), 0)::BIGINT AS pair_s,
    coalesce(sum(pair_s_inner), 0)::BIGINT AS pair_s_inner, coalesce(sum(interp_s), 0)::BIGINT AS interp_s
  FROM tw w LEFT JOIN sec1 s ON s.t >= w.t_start AND s.t < w.t_end GROUP BY ALL""", "tw", "sec1")
cte("nair", """SELECT w.event_id, w."window", count(DISTINCT i.icao24) AS n_aircraft
  FROM tw w JOIN inv i ON i.t >= w.t_start AND i.t < w.t_end GROUP BY ALL""", "tw", "inv")


@query("j4_window_exposure", statement("""SELECT e.*, coalesce(n.n_aircraft, 0) AS n_aircraft FROM expo e
  LEFT JOIN nair n ON n.event_id = e.event_id AND n."window" = e."window" """, "expo", "nair"))
def j4(spark, d):
    p = q_pairs.presence(spark, d)
    spans = windows_of(track_events(spark, d))
    ids = ["event_id", "window"]
    out = ex.span_exposure(p, spans, SPEC, ids=ids)
    n = ex.distinct_aircraft(ex.presence_runs(p, SPEC), spans, ids=ids)
    return out.join(n, ids, "left").fillna(0, ["n_aircraft"])


@query("j6_own_exposure", statement("""SELECT w.event_id, w."window", count(i.t) AS own_present_s, coalesce(sum(s.aircraft_s - 1), 0)::BIGINT AS own_pair_s
  FROM tw w LEFT JOIN inv i ON i.icao24 = w.icao24 AND i.t >= w.t_start AND i.t < w.t_end LEFT JOIN sec1 s ON s.t = i.t GROUP BY ALL""",
    "tw", "inv", "sec1"))
def j6(spark, d):
    spans = evs.event_windows(track_events(spark, d), keep=("event_id", "icao24"))
    return ex.own_exposure(q_pairs.presence(spark, d), spans, SPEC)


@query("j2_encounter_counts", statement("""SELECT g.event_id, g."window", count(*) FILTER (tier = 'T1' AND kind = 'observed') AS T1_observed,
   count(*) FILTER (tier = 'T1' AND kind = 'any') AS T1_any, count(*) FILTER (tier = 'T2' AND kind = 'predicted') AS T2_predicted,
   count(*) FILTER (tier = 'T1' AND kind = 'any' AND geometry_class = 'crossing') AS T1_any_crossing,
   count(*) FILTER (tier = 'T1' AND kind = 'any' AND geometry_class NOT IN ('in_trail_same_runway', 'parallel_runways')) AS T1_any_nonprocedural
 FROM gw g LEFT JOIN (SELECT * FROM senc WHERE inside_ceiling) e ON e.t_min >= g.t_start AND e.t_min < g.t_end GROUP BY ALL""", "gw", "senc"))
def j2(spark, d):
    spans = windows_of(go_arounds(spark, d))
    out = wn.encounter_counts(study_encounters(spark, d), spans, TIERS, ids=("event_id", "window"))
    return out.select("event_id", "window", "T1_observed", "T1_any", "T2_predicted", "T1_any_crossing", "T1_any_nonprocedural")


cte("t1ev", "SELECT * FROM ev WHERE tier = 'T1' AND ha <= 4000 AND hb <= 4000", "ev")


def flagged_t1(spark, d):
    """Every stored pair-second in the nominal volume, measured against T1."""
    p = pr.within_volume(q_pairs.pairs(spark, d), SPEC.radius_nm, SPEC.ceiling_ft)
    return pr.evaluate_tiers(p, Spec(tiers=SPEC.tiers[:1]))


@query("j3_closest_per_window", statement(f"""SELECT w.window_id, {r('min(s_step) AS s_min')} FROM clock w JOIN t1ev e
  ON e.t >= w.t_start AND e.t < w.t_end GROUP BY 1""", "clock", "t1ev"))
def j3(spark, d):
    return rounded(wn.span_minimum(flagged_t1(spark, d), clock(spark, d)))


@query("w5_flow_map", statement("""SELECT s_nationkey::BIGINT AS airport, s_suppkey AS runway, 'flow_' || lpad((CAST(round_even(head / 10.0, 0) AS BIGINT) * 10 % 360)::VARCHAR, 3, '0') AS flow
 FROM (WITH RECURSIVE ends AS (SELECT s_nationkey, s_suppkey, (s_suppkey * 37) % 360 AS brg, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
 fold AS (SELECT s_nationkey, i, [brg] AS heads, brg AS head, s_suppkey FROM ends WHERE i = 1
   UNION ALL SELECT e.s_nationkey, e.i, CASE WHEN m IS NULL THEN list_append(f.heads, e.brg) ELSE f.heads END, coalesce(m, e.brg), e.s_suppkey
   FROM (SELECT f.heads, e.*, list_filter(f.heads, lambda h: abs((e.brg - h + 180) - 360 * floor((e.brg - h + 180) / 360.0) - 180) <= 30)[1] AS m
         FROM fold f JOIN ends e ON e.s_nationkey = f.s_nationkey AND e.i = f.i + 1) e JOIN fold f ON f.s_nationkey = e.s_nationkey AND f.i = e.i - 1)
 SELECT * FROM fold)"""))
def w5(spark, d):
    s = views.load(spark, d, "supplier")
    ends = s.select(F.col("s_nationkey").cast("bigint").alias("airport"), F.col("s_suppkey").alias("runway"),
                    F.col("s_suppkey").alias("seq"), ((F.col("s_suppkey") * 37) % 360).cast("double").alias("bearing"))
    return profiles.auto_flows(ends)


cte("usage0", """SELECT t_low AS t, runway, 'arrival' AS kind FROM approaches WHERE runway IN ('05L', '23R', '13')
  UNION ALL SELECT t, (SELECT runway FROM rwy WHERE k = phase - 101), 'departure' FROM (
    SELECT day, leg, min(t) AS t, arg_min(phase, t) AS phase FROM pres WHERE phase > 100 GROUP BY ALL)""", "approaches", "pres", "rwy")
cte("usage", f"SELECT *, {FLOW_SQL} AS flow FROM usage0", "usage0")


def usage(spark, d):
    return wn.runway_usage(views.approaches(spark, d), q_pairs.presence(spark, d), RWY, flow)


@query("w6_runway_usage", statement("SELECT t, runway, kind, flow FROM usage", "usage"))
def w6(spark, d):
    return usage(spark, d)


@query("j19_flow_lookup", statement(f"SELECT approach_id, runway, {FLOW_SQL} AS flow FROM approaches", "approaches"))
def j19(spark, d):
    return views.approaches(spark, d).select("approach_id", "runway", flow(F.col("runway")).alias("flow"))


cte("flw0", """SELECT event_id, flow, count(*) AS n FROM ga g JOIN usage u ON u.t >= g.t0 - 1800 AND u.t < g.t0 + 1800 GROUP BY ALL""", "ga", "usage")
cte("flw", """SELECT event_id, CASE WHEN max(n) / sum(n) >= 0.7 THEN arg_min(flow, struct_pack(a := -n, b := flow)) ELSE 'mixed' END AS flow
  FROM flw0 GROUP BY event_id""", "flw0")


@query("w7_flow_labels", statement("SELECT g.event_id, coalesce(f.flow, 'none') AS flow FROM ga g LEFT JOIN flw f USING (event_id)", "ga", "flw"))
def w7(spark, d):
    centres = go_arounds(spark, d).select("event_id", F.col("t0").alias("centre"))
    return wn.flow_labels(centres, usage(spark, d), ids=("event_id",))


@query("w4_window_quality", statement("""SELECT event_id, "window", CASE WHEN interp_s / nullif(aircraft_s, 0) > 0.4 OR gaps > 5 THEN 'bad'
   WHEN interp_s / nullif(aircraft_s, 0) > 0.2 OR gaps > 2 THEN 'degraded' ELSE 'good' END AS quality
 FROM (SELECT e.*, (SELECT count(*) FROM ggaps g WHERE g.t_start >= w.t_start AND g.t_start < w.t_end) AS gaps
   FROM expo e JOIN tw w ON w.event_id = e.event_id AND w."window" = e."window")""", "expo", "tw", "ggaps"))
def w4(spark, d):
    spans = windows_of(track_events(spark, d))
    ids = ["event_id", "window"]
    out = ex.span_exposure(q_pairs.presence(spark, d), spans, SPEC, ids=ids)
    out = out.join(ex.gap_counts(grid_gaps(spark, d), spans, ids=ids), ids, "left").fillna(0, ["gap_count"])
    q = wn.quality_class(F.coalesce(F.try_divide("interp_s", "aircraft_s"), F.lit(0.0)), F.col("gap_count"), F.lit(False))
    return out.select(*ids, q.alias("quality"))


def _count_sql(name, alias="e"):
    conds = []
    for t in TIERS:
        for k in ("observed", "predicted", "any"):
            conds.append((f"{t}_{k}", f"tier = '{t}' AND kind = '{k}'"))
        for c in GEOMETRY_CLASSES:
            conds.append((f"{t}_any_{c}", f"tier = '{t}' AND kind = 'any' AND geometry_class = '{c}'"))
        conds.append((f"{t}_any_nonprocedural", f"tier = '{t}' AND kind = 'any' AND geometry_class NOT IN ('in_trail_same_runway', 'parallel_runways')"))
    return ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in conds)


cte("hours", """SELECT day || '_' || lpad(k::VARCHAR, 3, '0') AS window_id, day, day_no * 86400 + k * 3600 AS t_start,
    day_no * 86400 + (k + 1) * 3600 AS t_end FROM (SELECT DISTINCT day, t // 86400 AS day_no FROM study), generate_series(0, 23) s(k)""", "study")


@query("w8_count_columns", statement(f"""SELECT window_id, {_count_sql('e')} FROM hours h LEFT JOIN (SELECT * FROM senc WHERE inside_ceiling) e
   ON e.t_min >= h.t_start AND e.t_min < h.t_end GROUP BY window_id""", "hours", "senc"))
def w8(spark, d):
    days = views.study(spark, d).select("day", F.floor(F.col("t") / DAY_S).alias("day_no")).distinct()
    return wn.encounter_counts(study_encounters(spark, d), wn.clock_windows(days, 60), TIERS)


ENC12 = "(SELECT * FROM enc WHERE tier IN ('T1', 'T2') AND inside_ceiling)"
SPEC2 = Spec(ceiling_ft=4000.0, tiers=SPEC.tiers[:2])


@query("w9_encounter_rates", statement(f"""SELECT window_id, n AS T1_any, {r('p / 3600.0 AS pair_hours', 'n / nullif(p / 3600.0, 0) AS T1_any_rate')} FROM (
  SELECT window_id, (SELECT count(*) FROM enc e WHERE tier = 'T1' AND kind = 'any' AND inside_ceiling AND e.t_min >= clock.t_start AND e.t_min < clock.t_end) AS n,
    coalesce((SELECT sum(pair_s) FROM sec1 s WHERE s.t >= t_start AND s.t < t_end), 0) AS p FROM clock)""", "clock", "enc", "sec1"))
def w9(spark, d):
    spans = clock(spark, d)
    e = q_pairs.enc(spark, d, Spec(ceiling_ft=4000.0, tiers=SPEC.tiers[:1]))
    out = wn.encounter_counts(e, spans, ("T1",)).select("window_id", "T1_any").join(
        ex.span_exposure(q_pairs.presence(spark, d), spans, SPEC), "window_id")
    hours = F.col("pair_s") / 3600.0
    return rounded(out.select("window_id", "T1_any", hours.alias("pair_hours"), F.try_divide("T1_any", hours).alias("T1_any_rate")))


cte("fl_clock", """SELECT window_id, CASE WHEN max(n) / sum(n) >= 0.7 THEN arg_min(flow, struct_pack(a := -n, b := flow)) ELSE 'mixed' END AS flow
  FROM (SELECT window_id, flow, count(*) AS n FROM clock JOIN usage u ON u.t >= t_start + 300 - 1800 AND u.t < t_start + 300 + 1800 GROUP BY ALL) GROUP BY 1""",
    "clock", "usage")


@query("w3_interval_metrics", statement(f"""SELECT window_id, day, t_start, coalesce(aircraft_s, 0)::BIGINT AS aircraft_s,
   {r('coalesce(pair_s, 0) / 3600.0 AS pair_hours', 'coalesce(pair_s_inner, 0) / 3600.0 AS pair_hours_inner', 'coalesce(interp_s / aircraft_s, 0) AS interp_fraction', 'sm AS s_min')},
   coalesce(nac, 0) AS n_aircraft, gap_count, false AS outage, false AS partial_coverage,
   CASE WHEN coalesce(interp_s / aircraft_s, 0) > 0.4 OR coalesce(gap_count / nullif(nac, 0), 0) > 5 THEN 'bad'
     WHEN coalesce(interp_s / aircraft_s, 0) > 0.2 OR coalesce(gap_count / nullif(nac, 0), 0) > 2 THEN 'degraded' ELSE 'good' END AS quality,
   hour(make_timestamp(t_start * 1000000) - INTERVAL 6 HOUR)::BIGINT AS local_hour,
   CASE WHEN dayofweek(make_timestamp(t_start * 1000000) - INTERVAL 6 HOUR) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS daytype,
   strftime(make_timestamp(t_start * 1000000), '%Y-%m') AS month, coalesce(flow, 'none') AS flow,
   coalesce(T1_any, 0) AS T1_any, coalesce(T2_observed, 0) AS T2_observed, coalesce(T1_any_crossing, 0) AS T1_any_crossing
 FROM (SELECT c.*, (SELECT count(*) FROM ggaps g SEMI JOIN inv i ON i.day = g.day AND i.leg = g.leg AND i.t = g.t_start WHERE g.t_start >= c.t_start AND g.t_start < c.t_end) AS gap_count FROM clock c) c
 LEFT JOIN (SELECT t // 600 AS k, sum(aircraft_s) AS aircraft_s, sum(pair_s) AS pair_s, sum(pair_s_inner) AS pair_s_inner, sum(interp_s) AS interp_s FROM sec1 GROUP BY 1) s ON s.k = c.t_start // 600
 LEFT JOIN (SELECT t // 600 AS k, count(DISTINCT icao24) AS nac FROM inv GROUP BY 1) n ON n.k = c.t_start // 600
 LEFT JOIN (SELECT t // 600 AS k, min(s_step) AS sm FROM t1ev GROUP BY 1) m ON m.k = c.t_start // 600
 LEFT JOIN (SELECT t_min // 600 AS k, {_count_sql('e')} FROM {ENC12} e GROUP BY 1) e ON e.k = c.t_start // 600
 LEFT JOIN fl_clock f USING (window_id)""", "clock", "ggaps", "inv", "sec1", "t1ev", "enc", "fl_clock"))
def w3(spark, d):
    p = q_pairs.presence(spark, d)
    none = views.grid(spark, d).select(F.col("t").alias("a"), F.col("t").alias("b")).filter(F.lit(False))
    out = wn.interval_metrics(
        clock(spark, d), presence=p, gaps=grid_gaps(spark, d), outages=none, days=grid_days(spark, d), usage=usage(spark, d),
        enc=q_pairs.enc(spark, d, SPEC2), spec=SPEC2, tz=AIRPORT.timezone, flagged=flagged_t1(spark, d))
    return rounded(out.select(
        "window_id", "day", "t_start", "aircraft_s", "pair_hours", "pair_hours_inner", "interp_fraction", "s_min", "n_aircraft", "gap_count",
        "outage", "partial_coverage", "quality", "local_hour", "daytype", "month", "flow", "T1_any", "T2_observed", "T1_any_crossing"))


@query("w10_minute_bins", statement("""SELECT event_id, m AS minute, coalesce(sum(aircraft_s), 0)::BIGINT AS aircraft_s, coalesce(sum(pair_s), 0)::BIGINT AS pair_s
 FROM tev CROSS JOIN generate_series(-30, 29) g(m) LEFT JOIN sec1 s ON s.t >= t0 + m * 60 AND s.t < t0 + m * 60 + 60 GROUP BY ALL""", "tev", "sec1"))
def w10(spark, d):
    bins = wn.minute_bins(track_events(spark, d).select("event_id", "t0"))
    sec = ex.per_second(q_pairs.presence(spark, d), SPEC)
    return rounded(interval_sums(sec, bins, ["aircraft_s", "pair_s"], ids=("event_id", "minute")))


# ------------------------------------------------------------- interval joins

cte("tags", """SELECT e.event_id AS enc_id, g.event_id AS ga_event_id, CASE WHEN e.t_min < g.t0 THEN 'pre' ELSE 'post' END AS ga_window,
   row_number() OVER (PARTITION BY e.event_id ORDER BY CASE WHEN g.icao24 = e.icao24_a THEN 0 ELSE 1 END, g.t0, g.event_id) AS rn
  FROM senc e JOIN ga g ON (g.icao24 = e.icao24_a OR g.icao24 = e.icao24_b) AND e.t_min >= g.t_pre_start AND e.t_min < g.t_post_end""", "senc", "ga")
cte("tagged", """SELECT e.*, t.ga_event_id, t.ga_window FROM senc e LEFT JOIN tags t ON t.enc_id = e.event_id AND rn = 1""", "senc", "tags")


def tagged(spark, d, events=None):
    ev = go_arounds(spark, d) if events is None else events
    enc = study_encounters(spark, d).withColumnRenamed("event_id", "enc_id")
    return evs.tag_encounters(enc, ev, enc_id=["enc_id"])


@query("j7_tag_encounters", statement("SELECT event_id AS enc_id, ga_event_id, ga_window FROM tagged", "tagged"))
def j7(spark, d):
    return tagged(spark, d).select("enc_id", "ga_event_id", "ga_window")


@query("j8_landing_controls", statement("SELECT event_id, approach_id, t_low AS t0 FROM ctl", "ctl"))
def j8(spark, d):
    return evs.control_table(views.approaches(spark, d), 30, 60).select("event_id", "approach_id", "t0")


# windows of the event log with a quality label, for the baseline exclusion rule
cte("swin", """SELECT h.*, count(s.event_id) AS n, coalesce(sum(s.value), 0) AS load,
    CASE WHEN coalesce(max(s.value), 0) > 300 THEN 'bad' ELSE 'good' END AS quality, count(s.event_id) < 3 AS partial_coverage
  FROM hours h LEFT JOIN study s ON s.t >= h.t_start AND s.t < h.t_end GROUP BY ALL""", "hours", "study")
cte("keepwin", """SELECT *, EXISTS (SELECT 1 FROM ga WHERE t0 BETWEEN t_start - 1800 AND t_end + 1800) AS near FROM swin""", "swin", "ga")


def study_hours(spark, d):
    s = views.study(spark, d)
    per = s.groupBy(F.floor(F.col("t") / 3600).alias("hr")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("load"), F.max("value").alias("top"))
    days = s.select("day", F.floor(F.col("t") / DAY_S).alias("day_no")).distinct()
    w = wn.clock_windows(days, 60).withColumn("hr", F.floor(F.col("t_start") / 3600))
    return w.join(per, "hr", "left").fillna(0, ["n", "load", "top"]).select(
        "window_id", "day", "t_start", "t_end", "n", F.col("load").alias("pair_hours"),
        F.when(F.col("top") > 300, "bad").otherwise("good").alias("quality"), (F.col("n") < 3).alias("partial_coverage"))


@query("j9_exclude_windows", statement("""SELECT count(*) AS n_windows, count(*) FILTER (near) AS excluded_near_event,
   count(*) FILTER (quality = 'bad' AND NOT near) AS excluded_bad_quality,
   count(*) FILTER (partial_coverage AND NOT near AND quality <> 'bad') AS excluded_partial,
   count(*) FILTER (NOT near AND quality <> 'bad' AND NOT partial_coverage) AS kept,
   count(*) FILTER (NOT near AND quality <> 'bad' AND NOT partial_coverage AND load <= 0) AS kept_zero_exposure,
   count(*) FILTER (NOT near AND quality <> 'bad' AND NOT partial_coverage AND load > 0) AS kept_used FROM keepwin""", "keepwin"))
def j9(spark, d):
    _, log = evs.exclude_windows(study_hours(spark, d), go_arounds(spark, d).select("t0"), 30)
    return log


@query("j9_kept_windows", statement("SELECT window_id FROM keepwin WHERE NOT near AND quality <> 'bad' AND NOT partial_coverage", "keepwin"))
def j9_kept(spark, d):
    kept, _ = evs.exclude_windows(study_hours(spark, d), go_arounds(spark, d).select("t0"), 30)
    return kept.select("window_id")


@query("j10_pre_contaminated", statement("SELECT event_id, pre_contaminated FROM ga", "ga"))
def j10(spark, d):
    return go_arounds(spark, d).select("event_id", "pre_contaminated")


@query("j11_clock_rate_lookup", statement(f"""SELECT event_id, m AS minute, {r('w.load / 3600 AS rate')} FROM ga CROSS JOIN generate_series(-30, 29) g(m)
  LEFT JOIN swin w ON w.t_start <= t0 + m * 60 + 30 AND w.t_end > t0 + m * 60 + 30""", "ga", "swin"))
def j11(spark, d):
    """Clock windows tile the day, so the backward as-of lookup is an equality on the window number."""
    bins = wn.minute_bins(go_arounds(spark, d).select("event_id", "t0"))
    rate = study_hours(spark, d).select(F.floor(F.col("t_start") / 3600).alias("k"), (F.col("pair_hours") / 3600).alias("rate"))
    k = F.floor((F.col("t_start") + F.col("t_end")) / 2 / 3600)
    return rounded(bins.withColumn("k", k).join(rate, "k", "left").select("event_id", "minute", "rate"))


@query("j12_day_lookup", statement("SELECT event_id, coalesce(d.day, '') AS day FROM ga LEFT JOIN (SELECT DISTINCT day FROM study) d ON d.day = strftime(make_timestamp(ga.t0 * 1000000), '%Y-%m-%d')", "ga", "study"))
def j12(spark, d):
    days = views.study(spark, d).select("day", F.floor(F.col("t") / DAY_S).alias("day_no")).distinct()
    ev = go_arounds(spark, d).select("event_id", F.floor(F.col("t0") / DAY_S).alias("day_no"))
    return ev.join(days, "day_no", "left").select("event_id", F.coalesce("day", F.lit("")).alias("day"))


@query("j16_event_heights", statement(f"""SELECT e.event_id, {r('max(p.h) FILTER (p.r <= 6) AS max_height_post_ft')}, count(p.t) AS post_present_s,
   count(*) FILTER (p.r > 6) AS post_beyond_radius_s FROM tev e LEFT JOIN pres p ON p.icao24 = e.icao24 AND p.t >= e.t0 AND p.t < e.t_post_end GROUP BY 1""",
    "tev", "pres"))
def j16(spark, d):
    return rounded(ex.event_heights(q_pairs.presence(spark, d), track_events(spark, d), 6.0))


cte("other", """SELECT event_id AS det_id, 'u' || user_id AS icao24, t - 3600 AS d_start, t + 3600 AS d_stop FROM study WHERE event_type = 'view' AND value > 60""", "study")
cte("m0", """SELECT g.event_id, o.det_id, g.t_low, o.d_start FROM ga g JOIN other o ON o.icao24 = g.icao24 AND g.t_low BETWEEN o.d_start - 90 AND o.d_stop + 90""", "ga", "other")
# one to one, round by round: a pair is settled when it is the first of both sides
ROUNDS = 20
cte("match_left0", "SELECT event_id, det_id, t_low, d_start FROM m0", "m0")
for _i in range(ROUNDS):
    cte(f"match{_i}", f"""SELECT event_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d_start, det_id) AS i, row_number() OVER (PARTITION BY det_id ORDER BY t_low, event_id) AS j
      FROM match_left{_i}) WHERE i = 1 AND j = 1""", f"match_left{_i}")
    cte(f"match_left{_i + 1}", f"SELECT * FROM match_left{_i} WHERE event_id NOT IN (SELECT event_id FROM match{_i}) AND det_id NOT IN (SELECT det_id FROM match{_i})", f"match_left{_i}", f"match{_i}")
cte("paired21", " UNION ALL ".join(f"SELECT * FROM match{_i}" for _i in range(ROUNDS)), *[f"match{_i}" for _i in range(ROUNDS)])


@query("j21_detector_match", statement("""SELECT event_id, det_id, CASE WHEN det_id IS NULL THEN 'only_ours' ELSE 'both' END AS status FROM ga LEFT JOIN paired21 USING (event_id)
   UNION ALL SELECT NULL, det_id, 'only_theirs' FROM other WHERE det_id NOT IN (SELECT det_id FROM paired21)""", "ga", "other", "paired21"))
def j21(spark, d):
    """Our events against another detector's intervals, one to one."""
    other = views.study(spark, d).filter((F.col("event_type") == "view") & (F.col("value") > 60)).select(
        F.col("event_id").alias("det_id"), F.concat(F.lit("u"), "user_id").alias("leg_id"),
        (F.col("t") - 3600).alias("d_start"), (F.col("t") + 3600).alias("d_stop"))
    ours = go_arounds(spark, d).select("event_id", F.col("icao24").alias("leg_id"), "t_low")
    return crosscheck.match_detectors(ours, other)


# ----------------------------------------------------------------- events --

@query("e1_event_anchor", statement("SELECT approach_id, t0, anchor FROM anch", "anch"))
def e1(spark, d):
    return evs.anchor(views.approaches(spark, d)).select("approach_id", "t0", "anchor")


@query("e2_event_table", statement("""SELECT event_id, approach_id, outcome, t0, t_pre_start, t_post_end, cluster_id, cluster_size, cluster_first, pre_contaminated
  FROM ga""", "ga"))
def e2(spark, d):
    return go_arounds(spark, d).select("event_id", "approach_id", "outcome", "t0", "t_pre_start", "t_post_end", "cluster_id", "cluster_size",
                                       "cluster_first", "pre_contaminated")


@query("e3_seeded_sample", statement("""SELECT event_id FROM study ORDER BY ('0x' || substr(md5('7|' || event_id), 1, 8))::BIGINT, event_id LIMIT 300""", "study"))
def e3(spark, d):
    """The sampling operator itself: 300 rows in seeded hash order."""
    return evs.seeded_sample(views.study(spark, d).select("event_id"), "event_id", 300, 7)


@query("e4_event_windows", statement("""SELECT event_id, 'early' AS "window", t_pre_start - 3600 AS t_start, t_pre_start AS t_end FROM ga
  UNION ALL SELECT * FROM gw""", "ga", "gw"))
def e4(spark, d):
    return evs.event_windows(go_arounds(spark, d), ("early", "pre", "post"))


cte("inv_cnt", f"""SELECT g.event_id, g."window", {_count_sql('e')} FROM gw g LEFT JOIN (SELECT * FROM tagged WHERE inside_ceiling) e
  ON e.ga_event_id = g.event_id AND e.ga_window = g."window" GROUP BY ALL""", "gw", "tagged")


@query("e5_involved_counts", statement("SELECT * FROM inv_cnt", "inv_cnt"))
def e5(spark, d):
    ev = go_arounds(spark, d)
    win = evs.event_windows(ev).select("event_id", "window")
    return evs.involved_counts(tagged(spark, d, ev), win, TIERS)


cte("tenc", """SELECT * FROM (SELECT e.tier, e.kind, e.geometry_class, e.inside_ceiling, e.a, e.b, e.t_start, e.t_min,
    t.event_id AS ga_event_id, CASE WHEN e.t_min < t.t0 THEN 'pre' ELSE 'post' END AS ga_window,
    row_number() OVER (PARTITION BY e.a, e.b, e.tier, e.kind, e.t_start ORDER BY CASE WHEN t.icao24 = 'ac' || lpad((e.a % 12)::VARCHAR, 2, '0') THEN 0 ELSE 1 END, t.t0, t.event_id) AS rn
  FROM enc e JOIN tev t ON (t.icao24 = 'ac' || lpad((e.a % 12)::VARCHAR, 2, '0') OR t.icao24 = 'ac' || lpad((e.b % 12)::VARCHAR, 2, '0'))
    AND e.t_min >= t.t_pre_start AND e.t_min < t.t_post_end) WHERE rn = 1""", "enc", "tev")


@query("e6_involved_frame", statement(f"""SELECT w.event_id, w."window", x.n AS T1_any, o.own_present_s, {r('o.own_pair_s / 3600.0 AS pair_hours',
   'x.n / nullif(o.own_pair_s / 3600.0, 0) AS T1_any_rate')} FROM tw w
  JOIN (SELECT w.event_id, w."window", count(e.tier) AS n FROM tw w LEFT JOIN (SELECT * FROM tenc WHERE tier = 'T1' AND kind = 'any' AND inside_ceiling) e
     ON e.ga_event_id = w.event_id AND e.ga_window = w."window" GROUP BY ALL) x ON x.event_id = w.event_id AND x."window" = w."window"
  JOIN (SELECT w.event_id, w."window", count(i.t) AS own_present_s, coalesce(sum(s.aircraft_s - 1), 0) AS own_pair_s
     FROM tw w LEFT JOIN inv i ON i.icao24 = w.icao24 AND i.t >= w.t_start AND i.t < w.t_end LEFT JOIN sec1 s ON s.t = i.t GROUP BY ALL) o
     ON o.event_id = w.event_id AND o."window" = w."window" """, "tw", "tenc", "inv", "sec1"))
def e6(spark, d):
    p = q_pairs.presence(spark, d)
    ev = track_events(spark, d)
    spans = evs.event_windows(ev, keep=("event_id", "icao24"))
    legs = views.grid(spark, d).groupBy("day", "leg").agg(F.min("icao24").alias("icao24"))
    enc = en.with_identity(q_pairs.enc(spark, d, Spec(ceiling_ft=4000.0, tiers=SPEC.tiers[:1])), legs, AIRPORT)
    key = ["day", "a", "b", "tier", "kind", "t_start"]
    tag = evs.tag_encounters(enc, ev.drop("day"), enc_id=key)
    win = spans.select("event_id", "window").withColumn("pair_hours", F.lit(0.0))
    counts = evs.involved_counts(tag, win.select("event_id", "window"), ("T1",))
    out = evs.involved_frame(win, counts, ex.own_exposure(p, spans, SPEC), ("T1",))
    return rounded(out.select("event_id", "window", "T1_any", "own_present_s", "pair_hours", "T1_any_rate"))


@query("snk5_day_quality", statement(f"""SELECT day, count(*) AS windows, count(*) FILTER (quality = 'good') AS good, 0::BIGINT AS degraded,
   count(*) FILTER (quality = 'bad') AS bad, {r('avg(load) AS interp_fraction', 'sum(load) AS pair_hours', digits=4)}, sum(n)::BIGINT AS gaps,
   count(*) FILTER (partial_coverage) AS outage_windows, max(n) AS aircraft_max FROM swin GROUP BY day""", "swin"))
def snk5(spark, d):
    w = study_hours(spark, d).withColumns({
        "interp_fraction": F.col("pair_hours"), "gap_count": F.col("n"), "outage": F.col("partial_coverage"), "n_aircraft": F.col("n")})
    return rounded(wn.day_quality(w), 4)
