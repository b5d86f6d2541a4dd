"""Traffic-like views over the given tables.

``study``     event rows read as approaches, encounters and presence
``states``    one row per event row: an aircraft state on a triangle-wave course
``reports``   the same states as raw position reports with realistic defects
``grid``      the same states as clean grid rows, input of the pair join
``finals``    the same rows flown along a runway course with four outcomes
``paired``    before/after measures around go-arounds and landings

Every view reads all rows of ``events``; the arithmetic only shapes the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.plan import cut_lineage
from ..settings import Airport
from .registry import cte

EPOCH = 1704067200  # 2024-01-01 00:00 UTC
AIRPORT = Airport(
    icao="KTST",
    latitude=36.1245,
    longitude=-86.6782,
    elevation_ft=599.0,
    timezone="America/Chicago",
    runways=(
        ("05L", -1.0, 0.4, 50.0),
        ("23R", 1.0, 2.0, 230.0),
        ("05R", 0.0, -1.0, 53.0),
        ("23L", 2.0, 0.5, 233.0),
        ("13", -0.5, 0.5, 133.0),
        ("31", 0.5, -0.5, 313.0),
    ),
    flows=(("05L", "north"), ("05R", "north"), ("23R", "south"), ("23L", "south"), ("13", "cross")),
)
COSLAT = 0.8077399364374087  # cos(36.1245 deg)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- study ----

def study(spark, sf_dir) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ev.select(
        "event_id", "user_id", "event_type", "value", t.alias("t"),
        F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd").alias("day"),
    )


cte("study", """
SELECT event_id, user_id, event_type, value,
       CAST(floor(epoch(ts)) AS BIGINT) AS t, strftime(ts, '%Y-%m-%d') AS day
FROM events""")


def approaches(spark, sf_dir) -> DataFrame:
    """Event rows read as classified approaches."""
    s = study(spark, sf_dir)
    outcome = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 100), "go_around")
        .when((F.col("event_type") == "signup") & (F.col("value") > 100), "touch_and_go")
        .when((F.col("event_type") == "click") & (F.col("value") > 150), "ga_ambiguous")
        .when(F.col("event_type") == "purchase", "full_stop")
        .when(F.col("value") < 10, "continued_approach")
        .otherwise("unresolved")
    )
    rwy = F.element_at(F.array(*[F.lit(x) for x in ("05L", "23R", "13", "")]), (F.col("user_id") % 4 + 1).cast("int"))
    return s.select(
        F.col("event_id").alias("approach_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("icao24"),
        F.concat(F.lit("CS"), F.col("user_id") % 7).alias("callsign"),
        rwy.alias("runway"), outcome.alias("outcome"), F.col("t").alias("t_low"),
        F.when(F.col("value") > 120, F.col("t") + 20).alias("t_climb"),
        F.col("value").alias("min_agl_ft"), "day",
    )


cte("approaches", """
SELECT event_id AS approach_id, 'u' || user_id AS icao24, 'CS' || (user_id % 7) AS callsign,
  CASE user_id % 4 WHEN 0 THEN '05L' WHEN 1 THEN '23R' WHEN 2 THEN '13' ELSE '' END AS runway,
  CASE WHEN event_type = 'error' AND value > 100 THEN 'go_around'
       WHEN event_type = 'signup' AND value > 100 THEN 'touch_and_go'
       WHEN event_type = 'click' AND value > 150 THEN 'ga_ambiguous'
       WHEN event_type = 'purchase' THEN 'full_stop'
       WHEN value < 10 THEN 'continued_approach' ELSE 'unresolved' END AS outcome,
  t AS t_low, CASE WHEN value > 120 THEN t + 20 END AS t_climb, value AS min_agl_ft, day
FROM study""", "study")


# -------------------------------------------------------------- states ----

def states(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    e = e.withColumns({"a": F.col("event_id") % 12, "s": F.floor(F.col("event_id") / 12)})
    sx, sy = 0.040 * (1 + (F.col("a") % 3) / 4), 0.030 * (1 + (F.col("a") % 4) / 4)
    e = e.withColumns({
        "t": EPOCH + F.col("s") + 1500 * F.floor(F.col("s") / 400),
        "ux": F.pmod(7 * F.col("a") + sx * F.col("s"), F.lit(32.0)) - 16,
        "uy": F.pmod(11 * F.col("a") + sy * F.col("s"), F.lit(32.0)) - 16,
        "block": F.floor(F.col("s") / 400),
    })
    e = e.withColumns({
        "x": F.abs("ux") - 8, "y": F.abs("uy") - 8,
        "vx": F.when(F.col("ux") >= 0, sx).otherwise(-sx),
        "vy": F.when(F.col("uy") >= 0, sy).otherwise(-sy),
        "h": 1500.0 + (370 * F.col("a")) % 2600 + 5 * (F.col("s") % 120),
        "leg": F.col("a") + 12 * F.col("block"),
        "vz": F.when(F.col("a") % 3 == 0, 0.0).otherwise(5.0),
    })
    return e.withColumns({
        "track": F.pmod(F.degrees(F.atan2("vx", "vy")), F.lit(360.0)),
        "gs": F.hypot("vx", "vy") * 3600,
        "vrate": F.col("vz") * 60,
        "icao24": F.concat(F.lit("ac"), F.lpad(F.col("a").cast("string"), 2, "0")),
        "day": F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd"),
        "hole": (F.col("value") > 120)
        | (F.col("a").isin(1, 5, 9) & (F.col("s") % 97).between(40, 55)),
    })


cte("states0", f"""
SELECT event_id, event_type, value, event_id % 12 AS a, event_id // 12 AS s,
  {EPOCH} + event_id // 12 + 1500 * (event_id // 4800) AS t, event_id // 4800 AS block,
  0.040 * (1 + ((event_id % 12) % 3) / 4.0) AS sx, 0.030 * (1 + ((event_id % 12) % 4) / 4.0) AS sy
FROM events""")
cte("states1", """
SELECT *, (7 * a + sx * s) - 32 * floor((7 * a + sx * s) / 32) - 16 AS ux,
  (11 * a + sy * s) - 32 * floor((11 * a + sy * s) / 32) - 16 AS uy FROM states0""", "states0")
cte("states2", """
SELECT event_id, event_type, value, a, s, t, block, abs(ux) - 8 AS x, abs(uy) - 8 AS y,
  CASE WHEN ux >= 0 THEN sx ELSE -sx END AS vx, CASE WHEN uy >= 0 THEN sy ELSE -sy END AS vy,
  CAST(1500 + (370 * a) % 2600 + 5 * (s % 120) AS DOUBLE) AS h, a + 12 * block AS leg,
  CASE WHEN a % 3 = 0 THEN 0.0::DOUBLE ELSE 5.0::DOUBLE END AS vz FROM states1""", "states1")
cte("states", """
SELECT *, CASE WHEN degrees(atan2(vx, vy)) < 0 THEN degrees(atan2(vx, vy)) + 360
               ELSE degrees(atan2(vx, vy)) END AS track,
  sqrt(vx * vx + vy * vy) * 3600 AS gs, vz * 60 AS vrate, 'ac' || lpad(a::VARCHAR, 2, '0') AS icao24,
  strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day,
  (value > 120 OR (a IN (1, 5, 9) AND (s % 97) BETWEEN 40 AND 55)) AS hole
FROM states2""", "states2")


def grid(spark, sf_dir) -> DataFrame:
    """Clean grid rows (one per aircraft-second), the input of the pair join."""
    st = states(spark, sf_dir).filter(~F.col("hole"))
    return st.select(
        "day", "leg", "icao24", "t", "x", "y",
        F.when(F.col("value") >= 3, F.col("h") + 749.0).alias("z_baro"),
        (F.col("h") + 599.0).alias("z_geo"),
        "h", "gs", "track", "vrate", "vx", "vy", "vz", F.hypot("x", "y").alias("r"),
        (F.col("event_type") == "signup").alias("interpolated"),
        ((F.col("event_type") == "signup") & (F.col("value") > 40)).alias("interp_long"),
        (F.col("event_type") == "never").alias("onground"), (F.col("gs") >= 50).alias("airborne"),
    )


cte("grid", """
SELECT day, leg, icao24, t, x, y, CASE WHEN value >= 3 THEN h + 749 END AS z_baro, h + 599 AS z_geo,
  h, gs, track, vrate, vx, vy, vz, sqrt(x * x + y * y) AS r, event_type = 'signup' AS interpolated,
  (event_type = 'signup' AND value > 40) AS interp_long
FROM states WHERE NOT hole""", "states")


# ------------------------------------------------------------- reports ----

def reports(spark, sf_dir) -> DataFrame:
    """Raw position reports: duplicates, frozen positions, jumps, spikes, missing values."""
    st = states(spark, sf_dir).filter(~F.col("hole"))
    v, k = F.col("value"), F.col("event_type")
    jump = F.when((k == "purchase") & (v > 100), 9.0).otherwise(0.0)
    geo = F.col("h") + 599
    st = st.select(
        "event_id", "icao24",
        (F.col("t") * 1000000 + (F.col("event_id") * 37 % 600) * 1000).alias("us"),
        F.when(v > 60, F.lit("LATE")).when(v > 30, F.lit("MID")).otherwise(F.lit("EARLY ")).alias("callsign"),
        (AIRPORT.latitude + F.col("y") / 60).alias("latitude"),
        (AIRPORT.longitude + (F.col("x") + jump) / (60 * COSLAT)).alias("longitude"),
        F.when(~v.between(3, 4), geo + 150).alias("altitude"),
        F.when(v >= 3, geo + F.when((k == "view") & (v > 90), 2500).otherwise(0)).alias("geoaltitude"),
        (F.col("vrate") + (v - 50)).alias("vertical_rate"), F.col("gs").alias("groundspeed"),
        "track", ((k == "error") & (v > 110)).alias("onground"),
        F.when(k == "signup", F.col("t") - 25.0)
        .when(k != "error", F.col("t") - 0.4 - F.col("t") % 3).alias("position_time"),
        F.col("event_type"),
    )
    twin = st.filter(F.col("event_type") == "click").withColumns({
        "us": F.col("us") + 300000, "latitude": F.col("latitude") + 0.001,
        "event_id": F.col("event_id") + 0.5,
    })
    both = st.withColumn("event_id", F.col("event_id").cast("double")).unionByName(twin)
    return both.drop("event_type").withColumn("timestamp", F.timestamp_micros("us")).drop("us")


cte("reports0", f"""
SELECT event_id::DOUBLE AS event_id, icao24, t * 1000000 + (event_id * 37 % 600) * 1000 AS us,
  CASE WHEN value > 60 THEN 'LATE' WHEN value > 30 THEN 'MID' ELSE 'EARLY ' END AS callsign,
  36.1245::DOUBLE + y / 60 AS latitude,
  -86.6782::DOUBLE + (x + CASE WHEN event_type = 'purchase' AND value > 100 THEN 9.0 ELSE 0.0 END) / (60 * {COSLAT}::DOUBLE) AS longitude,
  CASE WHEN NOT (value BETWEEN 3 AND 4) THEN h + 599 + 150 END AS altitude,
  CASE WHEN value >= 3 THEN h + 599 + CASE WHEN event_type = 'view' AND value > 90 THEN 2500 ELSE 0 END END AS geoaltitude,
  vrate + (value - 50) AS vertical_rate, gs AS groundspeed, track,
  (event_type = 'error' AND value > 110) AS onground,
  CASE WHEN event_type = 'signup' THEN t - 25.0::DOUBLE
       WHEN event_type <> 'error' THEN t - 0.4::DOUBLE - t % 3 END AS position_time, event_type
FROM states WHERE NOT hole""", "states")
cte("reports", """
SELECT event_id, icao24, us, callsign, latitude, longitude, altitude, geoaltitude, vertical_rate,
  groundspeed, track, onground, position_time FROM reports0
UNION ALL
SELECT event_id + 0.5, icao24, us + 300000, callsign, latitude + 0.001, longitude, altitude, geoaltitude,
  vertical_rate, groundspeed, track, onground, position_time FROM reports0 WHERE event_type = 'click'""", "reports0")

# -------------------------------------------------------------- finals ----

FINAL_RUNWAYS = (("09", 0.0, 0.0, 90.0), ("36", 0.5, -0.5, 0.0))


def finals(spark, sf_dir) -> DataFrame:
    """Approach tracks: landing, go-around, low pass and touch-and-go in turn."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    e = e.withColumns({"a": F.col("event_id") % 12, "s": F.floor(F.col("event_id") / 12)})
    e = e.withColumns({
        "u": F.col("s") % 200, "v": (F.col("a") + F.floor(F.col("s") / 200)) % 4,
        "t": EPOCH + F.col("s") + 60 * F.floor(F.col("s") / 200) + 1500 * F.floor(F.col("s") / 400),
        "leg": F.col("a") + 12 * F.floor(F.col("s") / 400),
    })
    u, v, a = F.col("u"), F.col("v"), F.col("a")
    e = e.filter(~((F.col("value") > 120) | (a.isin(2, 6) & u.between(112, 124)) | (a.isin(7, 8) & (v == 0) & (u > 112))))
    slope = 12.72 * (125 - u) + 10
    up = F.when(a.isin(5, 10), 132).otherwise(150)
    agl = (
        F.when(v == 0, F.when(u < 125, slope).otherwise(10.0))
        .when(v == 1, F.when(u < 110, slope).otherwise(200.8 + 20 * (u - 110)))
        .when(v == 2, F.when(u < 110, slope).when(u < up, 200.8).otherwise(200.8 + 20 * (u - up)))
        .otherwise(F.when(u < 125, slope).when(u < 140, 10.0).otherwise(10.0 + 20 * (u - 140)))
    )
    climb = F.when(v == 1, u >= 110).when(v == 2, u >= up).when(v == 3, u >= 140).otherwise(F.lit(False))
    level = F.when(v == 0, u >= 125).when(v == 2, u.between(110, up - 1)).when(v == 3, u.between(125, 139)).otherwise(F.lit(False))
    along, cross = 5 - 0.04 * u, 0.05 * (a % 3)
    odd = a % 2 == 1
    return e.select(
        "leg", F.concat(F.lit("ac"), F.lpad(a.cast("string"), 2, "0")).alias("icao24"), "t",
        F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd").alias("day"),
        F.when(odd, 0.5 + cross).otherwise(-along).alias("x"),
        F.when(odd, -0.5 - along).otherwise(-cross).alias("y"),
        F.when(odd, 0.0).otherwise(90.0).alias("track"), agl.alias("agl"),
        F.when(climb, 1200.0).when(level, 0.0).otherwise(-763.0).alias("vrate"),
        F.when((v == 0) & (u >= 125), 40.0).when((v == 3) & (u >= 125), 80.0).otherwise(120.0).alias("groundspeed"),
        (((v == 0) & (u >= 128)) | ((v == 3) & u.between(126, 139))).alias("onground"),
    )


cte("finals0", f"""
SELECT *, (a + s // 200) % 4 AS v, s % 200 AS u, {EPOCH} + s + 60 * (s // 200) + 1500 * (s // 400) AS t,
  a + 12 * (s // 400) AS leg, CASE WHEN a IN (5, 10) THEN 132 ELSE 150 END AS up
FROM (SELECT event_id % 12 AS a, event_id // 12 AS s, value FROM events)""")
cte("finals", """
SELECT leg, 'ac' || lpad(a::VARCHAR, 2, '0') AS icao24, t,
  strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day,
  CASE WHEN a % 2 = 1 THEN 0.5::DOUBLE + 0.05::DOUBLE * (a % 3) ELSE -(5 - 0.04::DOUBLE * u) END AS x,
  CASE WHEN a % 2 = 1 THEN -0.5::DOUBLE - (5 - 0.04::DOUBLE * u) ELSE -(0.05::DOUBLE * (a % 3)) END AS y,
  CASE WHEN a % 2 = 1 THEN 0.0::DOUBLE ELSE 90.0::DOUBLE END AS track,
  (CASE WHEN v = 0 THEN CASE WHEN u < 125 THEN 12.72 * (125 - u) + 10 ELSE 10 END
       WHEN v = 1 THEN CASE WHEN u < 110 THEN 12.72 * (125 - u) + 10 ELSE 200.8 + 20 * (u - 110) END
       WHEN v = 2 THEN CASE WHEN u < 110 THEN 12.72 * (125 - u) + 10 WHEN u < up THEN 200.8 ELSE 200.8 + 20 * (u - up) END
       ELSE CASE WHEN u < 125 THEN 12.72 * (125 - u) + 10 WHEN u < 140 THEN 10 ELSE 10 + 20 * (u - 140) END END)::DOUBLE AS agl,
  (CASE WHEN (v = 1 AND u >= 110) OR (v = 2 AND u >= up) OR (v = 3 AND u >= 140) THEN 1200
       WHEN (v = 0 AND u >= 125) OR (v = 2 AND u >= 110 AND u < up) OR (v = 3 AND u BETWEEN 125 AND 139) THEN 0
       ELSE -763 END)::DOUBLE AS vrate,
  (CASE WHEN v = 0 AND u >= 125 THEN 40 WHEN v = 3 AND u >= 125 THEN 80 ELSE 120 END)::DOUBLE AS groundspeed,
  ((v = 0 AND u >= 128) OR (v = 3 AND u BETWEEN 126 AND 139)) AS onground
FROM finals0
WHERE NOT (value > 120 OR (a IN (2, 6) AND u BETWEEN 112 AND 124) OR (a IN (7, 8) AND v = 0 AND u > 112))""", "finals0")

# -------------------------------------------------------------- paired ----

COUNTS = {
    "n": "true", "T1_any": "event_type = 'click'", "T2_any": "event_type = 'view'",
    "T3_any": "event_type = 'click' AND value > 100", "T1_observed": "event_type = 'click' AND value < 40",
    "big": "value > 300",
}


def window_metrics(spark, sf_dir, events: DataFrame, which=("early", "pre", "post")) -> DataFrame:
    """Counts of event rows in two-hour windows around each event, with a simple expectation."""
    from ..operators.events import event_windows
    from ..operators.intervals import interval_sums

    s = study(spark, sf_dir)
    per = s.groupBy("t").agg(
        *[F.count_if(F.expr(c)).alias(n) for n, c in COUNTS.items()],
        F.sum(F.when(F.col("event_type") == "view", F.round(F.col("value") * 100)).otherwise(0)).cast("bigint").alias("cents"))
    spans = event_windows(events, which)
    m = interval_sums(per, spans, [*COUNTS, "cents"], ids=("event_id", "window"))
    out = spans.join(m, ["event_id", "window"]).join(events.select("event_id", "flow"), "event_id")
    hours = F.col("cents") / 10000
    expected = F.col("cents") / 6000 + 1
    z = (F.col("T1_any") - expected) / F.sqrt(expected)
    return out.withColumns({
        "aircraft_s": F.col("n") * 60, "pair_hours": hours, "quality": F.when(F.col("big") > 0, "bad").otherwise("good"),
        "partial_coverage": F.col("n") == 0, "T1_any_expected": expected, "T1_any_z": z, "T1_any_exceed95": z > 1.645,
        "T1_any_in_control": z <= 1.645, "n_aircraft": F.col("n"), "local_hour": F.col("t_start") % 24,
    })


PAIR_COLS = ("aircraft_s", "pair_hours", "T1_any", "T2_any", "T3_any", "T1_observed")


def _with_flow(spark, sf_dir) -> DataFrame:
    from ..sources.profiles import flow_of

    return approaches(spark, sf_dir).withColumn("flow", flow_of(F.col("runway"), AIRPORT.flows))


def event_rows(spark, sf_dir) -> DataFrame:
    """Go-arounds with two-hour windows and a flow."""
    from ..operators import events as evs

    return cut_lineage(evs.event_table(_with_flow(spark, sf_dir), 120))


def event_frames(spark, sf_dir):
    """(go-arounds, landings) with two-hour windows and a flow."""
    from ..operators import events as evs

    return event_rows(spark, sf_dir), cut_lineage(evs.control_table(_with_flow(spark, sf_dir), 30, 120))


def paired(spark, sf_dir, bands: bool = True):
    from ..operators import matching as mt

    ev, ctl = event_frames(spark, sf_dir)
    which = ("early", "pre", "post")
    g, c = (cut_lineage(mt.paired_windows(window_metrics(spark, sf_dir, e), e, PAIR_COLS, which)) for e in (ev, ctl))
    return mt.add_traffic_band(g, c) if bands else (g, c)


_FLOW = "CASE runway " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AIRPORT.flows) + " ELSE 'other' END"
cte("ga2h", f"""SELECT event_id, approach_id, t0, outcome, runway, {_FLOW} AS flow, 'g' AS grp,
    count(*) OVER (PARTITION BY c2) AS cluster_size,
    EXISTS (SELECT 1 FROM anch o WHERE o.outcome IN ('go_around', 'touch_and_go', 'ga_ambiguous') AND o.t0 >= x.t0 - 7200 AND o.t0 < x.t0) AS pre_contaminated
  FROM (SELECT *, sum(CASE WHEN coalesce(t0 - pt > 7200, true) THEN 1 ELSE 0 END) OVER (ORDER BY t0, n) AS c2 FROM ga1) x""", "ga1", "anch")
cte("both2h", f"""SELECT event_id, t0, flow, grp, cluster_size, pre_contaminated FROM ga2h
  UNION ALL SELECT event_id, t_low, {_FLOW}, 'c', NULL, NULL FROM ctl""", "ga2h", "ctl")
cte("w2h", """SELECT event_id, grp, t0, flow, 'early' AS wn, t0 - 14400 AS a, t0 - 7200 AS b FROM both2h
  UNION ALL SELECT event_id, grp, t0, flow, 'pre', t0 - 7200, t0 FROM both2h UNION ALL SELECT event_id, grp, t0, flow, 'post', t0, t0 + 7200 FROM both2h""", "both2h")
cte("m2h0", """SELECT w.event_id, w.grp, w.wn, w.a, count(s.event_id) AS n, count(*) FILTER (event_type = 'click') AS T1_any, count(*) FILTER (event_type = 'view') AS T2_any,
    count(*) FILTER (event_type = 'click' AND value > 100) AS T3_any, count(*) FILTER (event_type = 'click' AND value < 40) AS T1_observed,
    count(*) FILTER (value > 300) AS big, coalesce(sum(round(value * 100)) FILTER (event_type = 'view'), 0)::BIGINT AS cents
  FROM w2h w LEFT JOIN study s ON s.t >= w.a AND s.t < w.b GROUP BY ALL""", "w2h", "study")
cte("m2h", """SELECT *, n * 60 AS aircraft_s, cents / 10000 AS pair_hours, big > 0 OR n = 0 AS bad, cents / 6000 + 1 AS expected,
    (T1_any - (cents / 6000 + 1)) / sqrt(cents / 6000 + 1) AS z FROM m2h0""", "m2h0")


def _pivot_sql():
    cols = []
    for w in ("early", "pre", "post"):
        for c in PAIR_COLS:
            cols.append(f"max({c}) FILTER (wn = '{w}') AS {w}_{c}")
        cols.append(f"bool_or(bad) FILTER (wn = '{w}') AS {w}_bad")
    return ", ".join(cols)


cte("paired0", f"""SELECT event_id, grp, {_pivot_sql()}, max(expected) FILTER (wn = 'pre') AS pre_expected, max(expected) FILTER (wn = 'post') AS post_expected,
    max(z) FILTER (wn = 'pre') AS pre_z, max(z) FILTER (wn = 'post') AS post_z, strftime(make_timestamp(max(a) FILTER (wn = 'pre') * 1000000), '%Y-%m-%d') AS day
  FROM m2h GROUP BY event_id, grp""", "m2h")
cte("paired1", """SELECT p.*, b.t0, b.flow, b.cluster_size, b.pre_contaminated, hour(make_timestamp(b.t0 * 1000000))::BIGINT AS hour, pre_bad OR post_bad AS excluded
  FROM paired0 p JOIN both2h b USING (event_id, grp)""", "paired0", "both2h")
cte("pg", "SELECT * FROM paired1 WHERE grp = 'g'", "paired1")
cte("pc", "SELECT * FROM paired1 WHERE grp = 'c'", "paired1")
