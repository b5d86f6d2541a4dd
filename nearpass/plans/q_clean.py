"""Catalogue: cleaning and resampling of position reports (C1-C20, R1-R6)."""

from __future__ import annotations

import dataclasses as dc
import math

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cleaning as cl, grid as gr, terrain
from ..settings import CLEANING
from . import views
from .registry import cte, query, statement
from .tidy import r, rounded
from .views import AIRPORT

NEAR = dc.replace(CLEANING, load_radius_nm=10.0)


def _reports(spark, d):
    return views.reports(spark, d).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))


def _project_sql(lat: str, lon: str) -> tuple[str, str]:
    """Plane coordinates as SQL, written from the published series."""
    p = f"radians({lat})"
    w = f"sqrt(1 - {geo.E2!r}::DOUBLE * pow(sin({p}), 2))"
    x = f"(radians({lon} - ({AIRPORT.longitude}::DOUBLE)) * {geo.WGS84_A}::DOUBLE * cos({p}) / {w})"
    arc = (f"{geo.WGS84_A}::DOUBLE * ({geo.ARC0!r}::DOUBLE * {p} - {geo.ARC2!r}::DOUBLE * sin(2 * {p})"
           f" + {geo.ARC4!r}::DOUBLE * sin(4 * {p}) - {geo.ARC6!r}::DOUBLE * sin(6 * {p}))")
    y = f"({arc} - {geo.meridian_arc(AIRPORT.latitude)!r}::DOUBLE + {x} * {x} * tan({p}) * {w} / (2 * {geo.WGS84_A}::DOUBLE))"
    return f"({x} / 1852)", f"({y} / 1852)"


PX, PY = _project_sql("latitude", "longitude")

cte("rep", "SELECT *, us // 1000000 AS t, strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM reports", "reports")
cte("c1", """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY day, icao24, t ORDER BY us) AS rn FROM rep) WHERE rn = 1""", "rep")
cte("f0", "SELECT *, lag(position_time) OVER (PARTITION BY day, icao24 ORDER BY us) AS prev FROM rep", "rep")
cte("f1", """SELECT * EXCLUDE (us, t), us AS old_us,
  CASE WHEN position_time IS NULL THEN us ELSE CAST(round_even(position_time, 0) AS BIGINT) * 1000000 END AS us
FROM f0 WHERE position_time IS NULL
  OR (position_time IS DISTINCT FROM prev AND abs(us / 1e6 - position_time) <= 10)""", "f0")
cte("fresh", """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY day, icao24, us ORDER BY old_us) AS rn FROM f1) WHERE rn = 1""", "f1")
cte("sec", """SELECT * EXCLUDE (rn) FROM (
  SELECT *, us // 1000000 AS t, row_number() OVER (PARTITION BY day, icao24, us // 1000000 ORDER BY us) AS rn
  FROM fresh) WHERE rn = 1""", "fresh")
cte("plane", f"SELECT *, {PX} AS x, {PY} AS y FROM sec", "sec")
cte("num", "SELECT *, row_number() OVER (PARTITION BY day, icao24 ORDER BY t) AS rn FROM plane WHERE sqrt(x*x+y*y) <= 25", "plane")
cte("walk(day, icao24, rn, keep, lt, lx, ly)", """
SELECT day, icao24, rn, true, t, x, y FROM num WHERE rn = 1
UNION ALL
SELECT n.day, n.icao24, n.rn, ok, CASE WHEN ok THEN n.t ELSE lt END, CASE WHEN ok THEN n.x ELSE lx END,
  CASE WHEN ok THEN n.y ELSE ly END
FROM (SELECT n.*, w.lt, w.lx, w.ly,
        NOT (n.t - w.lt <= 0 OR sqrt(pow(n.x - w.lx, 2) + pow(n.y - w.ly, 2)) * 3600 > 600 * (n.t - w.lt)) AS ok
      FROM walk w JOIN num n ON n.day = w.day AND n.icao24 = w.icao24 AND n.rn = w.rn + 1) n""", "num")
cte("kept", "SELECT n.* EXCLUDE (rn) FROM num n JOIN walk w USING (day, icao24, rn) WHERE w.keep",
    "walk(day, icao24, rn, keep, lt, lx, ly)")
cte("legs0", """SELECT *, sum(CASE WHEN t - pt > 1200 THEN 1 ELSE 0 END)
    OVER (PARTITION BY day, icao24 ORDER BY t)::BIGINT AS leg_no
  FROM (SELECT *, lag(t) OVER (PARTITION BY day, icao24 ORDER BY t) AS pt FROM kept)""", "kept")
cte("legs1", """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY day, icao24, leg_no) AS leg_n FROM legs0)
  WHERE leg_n >= 2""", "legs0")
cte("med1", """SELECT day, icao24, leg_no, median(geoaltitude - altitude) AS m FROM legs1 GROUP BY ALL""", "legs1")
cte("nospike", """SELECT l.* EXCLUDE (geoaltitude),
    CASE WHEN abs(l.geoaltitude - l.altitude - m) > 1000 THEN NULL ELSE l.geoaltitude END AS geoaltitude
  FROM legs1 l JOIN med1 USING (day, icao24, leg_no)""", "legs1", "med1")
cte("med2", """SELECT day, icao24, leg_no, median(geoaltitude - altitude) AS off, count(geoaltitude) AS n_geo
  FROM nospike GROUP BY ALL""", "nospike")
cte("height", """SELECT n.*, n_geo = 0 AS geo_missing,
    CASE WHEN n_geo = 0 THEN altitude - 599 ELSE coalesce(geoaltitude - 599, altitude - 599 + off) END AS h
  FROM nospike n JOIN med2 USING (day, icao24, leg_no)""", "nospike", "med2")
cte("smoothed", """SELECT *, median(vertical_rate) OVER (PARTITION BY day, icao24, leg_no ORDER BY t
    ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS vrate FROM height""", "height")
cte("legtab", """SELECT day, icao24, leg_no, min(t) AS t_first, max(t) AS t_last, count(*) AS n_raw,
    bool_and(geo_missing) AS geo_missing FROM height GROUP BY ALL""", "height")


def _fresh_sec(spark, d):
    return cl.within_radius(cl.floor_to_second(cl.fresh_reports(_reports(spark, d))), AIRPORT)


def _legs(spark, d):
    return cl.split_legs(cl.drop_jumps(_fresh_sec(spark, d)))


def _height(spark, d):
    return cl.height_above_field(cl.drop_geo_spikes(_legs(spark, d)), AIRPORT.elevation_ft)


def clean(spark, d):
    return _height(spark, d).withColumn("vrate", cl.smooth("vertical_rate", 3, cl.leg_keys()))


@query("c1_second_dedup", statement("SELECT day, icao24, t, event_id FROM c1", "c1"))
def c1(spark, d):
    return cl.floor_to_second(_reports(spark, d)).select("day", "icao24", "t", "event_id")


@query("c2_load_radius", statement(
    f"SELECT icao24, us, {r('x', 'y')} FROM (SELECT icao24, us, {PX} AS x, {PY} AS y FROM reports) WHERE sqrt(x*x+y*y) <= 10",
    "reports"))
def c2(spark, d):
    near = cl.within_radius(_reports(spark, d), AIRPORT, NEAR)
    return rounded(near.select("icao24", F.unix_micros("timestamp").alias("us"), "x", "y"))


@query("c3_fresh_positions", statement("SELECT day, icao24, us, event_id FROM fresh", "fresh"))
def c3(spark, d):
    return cl.fresh_reports(_reports(spark, d)).select("day", "icao24", F.unix_micros("timestamp").alias("us"), "event_id")


@query("c4_drop_jumps", statement("SELECT day, icao24, t, event_id FROM kept", "kept"))
def c4(spark, d):
    return cl.drop_jumps(_fresh_sec(spark, d)).select("day", "icao24", "t", "event_id")


@query("c5_flight_legs", statement("SELECT day, icao24, t, leg_no FROM legs1", "legs1"))
def c5(spark, d):
    return _legs(spark, d).select("day", "icao24", "t", "leg_no")


@query("c5_user_sessions", statement("""
SELECT user_id, s AS session_no, count(*) AS n, min(t) AS t_first, max(t) AS t_last FROM (
  SELECT user_id, t, sum(CASE WHEN t - p > 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS s
  FROM (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM study))
GROUP BY ALL HAVING count(*) >= 2""", "study"))
def c5_sessions(spark, d):
    """The same silence rule on the event log; the running number crosses day blocks."""
    from ..operators.scan import previous_value, running_sum

    s = views.study(spark, d)
    s = previous_value(s, ["user_id"], "day", ["t", "event_id"], "t", "p")
    new = (F.coalesce(F.col("t") - F.col("p"), F.lit(0)) > CLEANING.leg_gap_s).cast("bigint")
    s = running_sum(s, ["user_id"], "day", ["t", "event_id"], new, "session_no")
    out = s.groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    return out.filter("n >= 2")


@query("c6_altitude_spikes", statement(
    "SELECT day, icao24, t, geoaltitude FROM nospike", "nospike"))
def c6(spark, d):
    return cl.drop_geo_spikes(_legs(spark, d)).select("day", "icao24", "t", "geoaltitude")


@query("c7_height_above_field", statement(
    f"SELECT day, icao24, t, {r('h')}, geo_missing FROM height", "height"))
def c7(spark, d):
    return rounded(_height(spark, d).select("day", "icao24", "t", "h", "geo_missing"))


cte("agl", """SELECT day, icao24, leg_no, t, coalesce(
    median(geoaltitude - 599) OVER w, median(altitude + off - 599) OVER w) AS agl
  FROM legs1 JOIN (SELECT day, icao24, leg_no, median(geoaltitude - altitude) AS off FROM legs1 GROUP BY ALL)
    USING (day, icao24, leg_no)
  WINDOW w AS (PARTITION BY day, icao24, leg_no ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", "legs1")


@query("c8_approach_height", statement(f"SELECT day, icao24, t, {r('agl')} FROM agl", "agl"))
def c8(spark, d):
    out = cl.approach_height(_legs(spark, d), F.lit(AIRPORT.elevation_ft))
    return rounded(out.select("day", "icao24", "t", "agl"))


@query("c9_rolling_median", statement(f"SELECT day, icao24, t, {r('vrate')} FROM smoothed", "smoothed"))
def c9(spark, d):
    return rounded(clean(spark, d).select("day", "icao24", "t", "vrate"))


cte("calls", """SELECT day, icao24, leg_no, trim(callsign) AS callsign FROM (
  SELECT day, icao24, leg_no, callsign, row_number() OVER (PARTITION BY day, icao24, leg_no
    ORDER BY count(*) DESC, callsign) AS rn FROM height GROUP BY day, icao24, leg_no, callsign) WHERE rn = 1""", "height")
cte("legfull", """SELECT l.*, callsign, icao24 || '_' || strftime(make_timestamp(t_first * 1000000), '%Y%m%d_%H%M%S') AS leg_id
  FROM legtab l JOIN calls USING (day, icao24, leg_no)""", "legtab", "calls")


def legs_table(spark, d):
    return cl.leg_table(_height(spark, d))


@query("c10_leg_callsign", statement("SELECT day, icao24, leg_no, callsign FROM calls", "calls"))
def c10(spark, d):
    return legs_table(spark, d).select("day", "icao24", "leg_no", "callsign")


@query("c11_leg_id", statement("SELECT leg_id FROM legfull", "legfull"))
def c11(spark, d):
    return legs_table(spark, d).select("leg_id")


@query("c12_project", statement(f"SELECT event_id, {r(PX + ' AS x', PY + ' AS y', digits=5)} FROM reports", "reports"))
def c12(spark, d):
    return rounded(cl.with_plane(views.reports(spark, d), AIRPORT).select("event_id", "x", "y"), 5)


@query("c12_unproject", statement(
    "SELECT event_id, round(latitude, 7) AS lat, round(longitude, 7) AS lon FROM reports", "reports"))
def c12_inverse(spark, d):
    """Round trip: projecting and unprojecting returns the reported position."""
    p = cl.with_plane(views.reports(spark, d), AIRPORT)
    lat, lon = geo.unproject(F.col("x"), F.col("y"), AIRPORT.latitude, AIRPORT.longitude)
    return rounded(p.select("event_id", lat.alias("lat"), lon.alias("lon")), 7)


@query("c13_epoch_seconds", statement("SELECT event_id, t FROM study", "study"))
def c13(spark, d):
    return views.study(spark, d).select("event_id", "t")


cte("motion", """SELECT day, icao24, t, groundspeed / 3600 * sin(radians(track)) AS vx,
   groundspeed / 3600 * cos(radians(track)) AS vy, vrate / 60 AS vz, sqrt(x*x + y*y) AS r,
   coalesce(NOT onground AND groundspeed >= 50 AND h IS NOT NULL, false) AS airborne FROM smoothed""", "smoothed")


def _motion(spark, d):
    return gr.with_motion(clean(spark, d).withColumn("gs", F.col("groundspeed")))


@query("c14_velocity", statement(f"SELECT day, icao24, t, {r('vx', 'vy', 'vz', 'r')} FROM motion", "motion"))
def c14(spark, d):
    return rounded(_motion(spark, d).select("day", "icao24", "t", "vx", "vy", "vz", "r"))


@query("c15_airborne", statement("SELECT day, icao24, t, airborne FROM motion", "motion"))
def c15(spark, d):
    return _motion(spark, d).select("day", "icao24", "t", "airborne")


@query("c16_file_day", statement("""
SELECT CAST(user_id % 5 AS VARCHAR) AS file, max(CASE WHEN rn = n // 2 + 1 THEN day END) AS date FROM (
  SELECT user_id, day, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts) AS rn,
    count(*) OVER (PARTITION BY user_id % 5) AS n
  FROM (SELECT user_id, ts, strftime(ts, '%Y-%m-%d') AS day FROM events)) GROUP BY 1"""))
def c16(spark, d):
    ev = views.load(spark, d, "events").select(
        (F.col("user_id") % 5).cast("string").alias("file"), F.col("ts").cast("timestamp").alias("timestamp"))
    return cl.file_day(ev, "file")


@query("c17_messages_per_second", statement(
    "SELECT day, t % 86400 AS sec, count(*) AS n FROM rep GROUP BY 1, 2", "rep"))
def c17(spark, d):
    return cl.messages_per_second(_reports(spark, d))


cte("silence", """SELECT day, a, t AS b FROM (SELECT day, t, lag(t) OVER (PARTITION BY day ORDER BY t) AS a
  FROM (SELECT DISTINCT day, t FROM rep)) WHERE t - a > 60""", "rep")
# flights by callsign span the silences between the blocks of the view
cte("flights", "SELECT day, icao24, min(t) AS t_first, max(t) AS t_last FROM rep GROUP BY ALL", "rep")


@query("c18_outages", statement("""SELECT day, a, b FROM silence s WHERE EXISTS (
  SELECT 1 FROM flights f WHERE f.day = s.day AND f.t_first < s.a AND f.t_last > s.b)""", "silence", "flights"))
def c18(spark, d):
    rep = _reports(spark, d)
    flights = rep.groupBy("day", "icao24").agg(
        F.min(F.unix_seconds("timestamp")).alias("t_first"), F.max(F.unix_seconds("timestamp")).alias("t_last"))
    return cl.outages(rep, flights)


@query("c19_legs_table", statement(
    "SELECT day, icao24, leg_no, leg_id, callsign, t_first, t_last, n_raw, geo_missing FROM legfull", "legfull"))
def c19(spark, d):
    return legs_table(spark, d).select(
        "day", "icao24", "leg_no", "leg_id", "callsign", "t_first", "t_last", "n_raw", "geo_missing")


# raster of average values per node, standing in for an elevation grid
RASTER = terrain.Raster(zoom=6, origin_px=(4237.0, 6392.0), width=20, height=20)
cte("dem", """SELECT event_id % 20 AS ix, (event_id // 20) % 20 AS iy, avg(value) AS elev_m FROM events GROUP BY ALL""")
cte("cell0", f"""SELECT event_id, latitude, longitude,
    least(greatest((longitude + 180) / 360 * 16384 - {RASTER.origin_px[0]}, 0), 18.999) AS fx,
    least(greatest((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 16384 - {RASTER.origin_px[1]}, 0), 18.999) AS fy
  FROM reports""", "reports")
cte("cell", "SELECT *, floor(fx)::BIGINT AS ix, floor(fy)::BIGINT AS iy, fx - floor(fx) AS tx, fy - floor(fy) AS ty FROM cell0", "cell0")


@query("c20_terrain_height", statement("""SELECT event_id, round((a.elev_m * (1-tx) * (1-ty) + b.elev_m * tx * (1-ty)
    + c.elev_m * (1-tx) * ty + e.elev_m * tx * ty) * 3.28084, 4) AS ground_ft
  FROM cell JOIN dem a ON a.ix = cell.ix AND a.iy = cell.iy JOIN dem b ON b.ix = cell.ix + 1 AND b.iy = cell.iy
  JOIN dem c ON c.ix = cell.ix AND c.iy = cell.iy + 1 JOIN dem e ON e.ix = cell.ix + 1 AND e.iy = cell.iy + 1""",
    "dem", "cell"))
def c20(spark, d):
    ev = views.load(spark, d, "events")
    dem = ev.groupBy((F.col("event_id") % 20).alias("ix"), (F.floor(F.col("event_id") / 20) % 20).alias("iy")).agg(
        F.avg("value").alias("elev_m"))
    out = terrain.ground_elevation(views.reports(spark, d), dem, RASTER)
    return rounded(out.select("event_id", "ground_ft"), 4)


# ------------------------------------------------------------- resampling --
# each column gets its nearest known neighbours by self-join on the fix table
cte("fix", """SELECT day, icao24, leg_no, t, x, y, altitude, geoaltitude, h, groundspeed, track, vrate, onground,
    lead(t) OVER (PARTITION BY day, icao24, leg_no ORDER BY t) AS t2 FROM smoothed""", "smoothed")
cte("secs", """SELECT day, icao24, leg_no, t AS t1, t2, unnest(CASE WHEN t2 - t <= 10 THEN generate_series(t, t2 - 1) ELSE [t] END) AS t
  FROM fix""", "fix")
cte("base", """SELECT s.*, f.x AS x1, f.y AS y1, g.x AS x2, g.y AS y2,
    sin(radians(f.track)) AS s1, cos(radians(f.track)) AS k1, sin(radians(g.track)) AS s2, cos(radians(g.track)) AS k2,
    f.onground::INT AS o1, g.onground::INT AS o2, (s.t - s.t1) / (s.t2 - s.t1)::DOUBLE AS w, f.vrate AS v1, g.vrate AS v2
  FROM secs s JOIN fix f ON f.day = s.day AND f.icao24 = s.icao24 AND f.leg_no = s.leg_no AND f.t = s.t1
  LEFT JOIN fix g ON g.day = s.day AND g.icao24 = s.icao24 AND g.leg_no = s.leg_no AND g.t = s.t2""", "secs", "fix")


def grid_rows(spark, d):
    return gr.leg_to_grid(clean(spark, d))


@query("r1_one_second_grid", statement(f"""
SELECT day, icao24, leg_no, t, {r("CASE WHEN t = t1 THEN x1 ELSE x1 + (x2 - x1) * w END AS x",
                                  "CASE WHEN t = t1 THEN y1 ELSE y1 + (y2 - y1) * w END AS y")},
  t > t1 AS interpolated FROM base""", "base"))
def r1(spark, d):
    return rounded(grid_rows(spark, d).select("day", "icao24", "leg_no", "t", "x", "y", "interpolated"))


def _known_sql(col: str) -> str:
    """Linear value between nearest known fixes, by ASOF joins in both directions."""
    k = f"(SELECT day, icao24, leg_no, t, {col} AS v FROM fix WHERE {col} IS NOT NULL)"
    return f"""
SELECT s.day, s.icao24, s.leg_no, s.t,
  round(CASE WHEN p.t = s.t THEN p.v ELSE p.v + (n.v - p.v) * (s.t - p.t) / (n.t - p.t) END, 6) + 0.0 AS {col}
FROM secs s
ASOF LEFT JOIN {k} p ON p.day = s.day AND p.icao24 = s.icao24 AND p.leg_no = s.leg_no AND p.t <= s.t
ASOF LEFT JOIN {k} n ON n.day = s.day AND n.icao24 = s.icao24 AND n.leg_no = s.leg_no AND n.t > s.t"""


@query("r2_known_value_interp", statement(_known_sql("geoaltitude"), "secs", "fix"))
def r2(spark, d):
    return rounded(grid_rows(spark, d).select("day", "icao24", "leg_no", "t", F.col("z_geo").alias("geoaltitude")))


cte("turn0", """SELECT day, icao24, leg_no, t, CASE WHEN t = t1 THEN s1 ELSE s1 + (s2 - s1) * w END AS sn,
  CASE WHEN t = t1 THEN k1 ELSE k1 + (k2 - k1) * w END AS cs FROM base""", "base")


@query("r3_heading_interp", statement("""SELECT day, icao24, leg_no, t,
  round(CASE WHEN degrees(atan2(sn, cs)) < 0 THEN degrees(atan2(sn, cs)) + 360 ELSE degrees(atan2(sn, cs)) END, 4) % 360 + 0.0 AS track
  FROM turn0""", "turn0"))
def r3(spark, d):
    return grid_rows(spark, d).select(
        "day", "icao24", "leg_no", "t", (F.round("track", 4) % 360 + F.lit(0.0)).alias("track"))


@query("r4_onground_interp", statement("""SELECT day, icao24, leg_no, t,
  CASE WHEN t = t1 THEN o1 ELSE o1 + (o2 - o1) * w END > 0.5 AS onground FROM base""", "base"))
def r4(spark, d):
    return grid_rows(spark, d).select("day", "icao24", "leg_no", "t", "onground")


@query("r5_report_gaps", statement(
    "SELECT day, icao24, leg_no, t AS t_start, t2 AS t_end, t2 - t AS gap_s FROM fix WHERE t2 - t > 10", "fix"))
def r5(spark, d):
    return gr.report_gaps(clean(spark, d)).select("day", "icao24", "leg_no", "t_start", "t_end", "gap_s")


@query("r6_long_interp", statement(
    "SELECT day, icao24, leg_no, t, (t > t1 AND t2 - t1 > 4) AS interp_long FROM secs", "secs"))
def r6(spark, d):
    return grid_rows(spark, d).select("day", "icao24", "leg_no", "t", "interp_long")
