"""Catalogue: geometry, pair join, tiers and encounters (G1-G14, J1, J13, J20, P1-P8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, timefns, zones
from ..operators import adequacy, encounters as en, pairs as pr
from ..settings import Spec, VOLUME
from . import views
from .registry import cte, query, statement
from .tidy import r, rounded
from .views import AIRPORT

RWY = AIRPORT.runways
WIDE = zones.widest_setting()
SPEC = Spec(ceiling_ft=4000.0)

cte("rwy", "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{n}', {x}::DOUBLE, {y}::DOUBLE, {b}::DOUBLE)" for k, (n, x, y, b) in enumerate(RWY)
) + ") v(k, runway, tx, ty, bearing)")


def delta_sql(a, b):
    return f"abs((({a}) - ({b}) + 180) - 360 * floor((({a}) - ({b}) + 180) / 360) - 180)"


cte("frame", f"""SELECT g.day, g.t, g.leg, g.h, g.vrate, k, runway,
    -((x - tx) * sin(radians(bearing)) + (y - ty) * cos(radians(bearing))) AS along,
    (x - tx) * cos(radians(bearing)) - (y - ty) * sin(radians(bearing)) AS cross_nm,
    {delta_sql('track', 'bearing')} AS turn FROM grid g CROSS JOIN rwy""", "grid", "rwy")
cte("match", """SELECT day, t, leg, arg_min(CASE WHEN vrate >= 200 THEN 101 + k ELSE 1 + k END, turn + 20 * abs(cross_nm)) AS phase
  FROM frame WHERE abs(cross_nm) < 0.5 AND turn < 25 AND (
    (NOT coalesce(vrate >= 200, false) AND along > -0.3 AND along < 12 AND h < 4000)
    OR (vrate >= 200 AND along < 0.5 AND along > -8)) GROUP BY ALL""", "frame")
cte("pres", """SELECT g.*, coalesce(m.phase, 0)::BIGINT AS phase FROM grid g LEFT JOIN match m USING (day, t, leg)
  WHERE h <= 12000 AND gs >= 50""", "grid", "match")


def zone_cols(h, v, tau, p):
    """Columns {p}_in / {p}_out of the analytic interval, NULL when never inside."""
    a, hb, c = "(vx*vx+vy*vy)", "(rx*vx+ry*vy)", f"(rx*rx+ry*ry-({h})*({h}))"
    disc = f"({hb}*{hb}-{a}*{c})"
    hi = [f"CASE WHEN {a} < 1e-18 THEN CASE WHEN {c} < 0 THEN {s}1e300::DOUBLE END WHEN {disc} > 0 THEN (-{hb} {o} sqrt({disc})) / {a} END"
          for s, o in (("-", "-"), ("", "+"))]
    t1, t2 = f"((-({v}) - dz) / vz)", f"((({v}) - dz) / vz)"
    vi = [f"CASE WHEN abs(vz) < 1e-9 THEN CASE WHEN abs(dz) < ({v}) THEN {s}1e300::DOUBLE END ELSE {f}({t1}, {t2}) END"
          for s, f in (("-", "least"), ("", "greatest"))]
    return (f"CASE WHEN ({hi[0]}) IS NOT NULL AND ({vi[0]}) IS NOT NULL AND greatest({hi[0]}, {vi[0]}, 0) < least({hi[1]}, {vi[1]}, {tau}) "
            f"THEN greatest({hi[0]}, {vi[0]}, 0) END AS {p}_in, "
            f"CASE WHEN ({hi[0]}) IS NOT NULL AND ({vi[0]}) IS NOT NULL AND greatest({hi[0]}, {vi[0]}, 0) < least({hi[1]}, {vi[1]}, {tau}) "
            f"THEN least({hi[1]}, {vi[1]}, {tau}) END AS {p}_out")


def cpa_cols(tau, p):
    t = f"CASE WHEN (vx*vx+vy*vy) > 1e-18 THEN least(greatest(-(rx*vx+ry*vy)/(vx*vx+vy*vy), 0), {tau}) ELSE 0 END"
    return (f"{t} AS {p}_t, sqrt(pow(rx + vx*({t}), 2) + pow(ry + vy*({t}), 2)) AS {p}_d, dz + vz*({t}) AS {p}_z")


cte("pair0", """SELECT a.day, a.t, a.leg AS a, b.leg AS b, b.x - a.x AS rx, b.y - a.y AS ry, b.vx - a.vx AS vx, b.vy - a.vy AS vy,
    CASE WHEN a.z_baro IS NOT NULL AND b.z_baro IS NOT NULL THEN b.z_baro - a.z_baro ELSE b.z_geo - a.z_geo END AS dz,
    b.vz - a.vz AS vz, (a.z_baro IS NOT NULL AND b.z_baro IS NOT NULL)::BIGINT AS zref,
    a.x AS xa, a.y AS ya, a.h AS ha, b.x AS xb, b.y AS yb, b.h AS hb, a.r AS ra, b.r AS rb, a.track AS tra, b.track AS trb,
    a.phase AS pha, b.phase AS phb, a.interpolated AS ia, b.interpolated AS ib
  FROM pres a JOIN pres b ON a.day = b.day AND a.t = b.t AND a.leg < b.leg WHERE a.r <= 10 AND b.r <= 10""", "pres")
cte("pairs", f"""SELECT * EXCLUDE (z_in, z_out) FROM (SELECT *, {zone_cols('3.75', '1250', '180', 'z')} FROM pair0)
  WHERE z_in IS NOT NULL""", "pair0")
cte("tiers", "SELECT * FROM (VALUES ('T1', 3.0::DOUBLE, 1000.0::DOUBLE), ('T2', 0.5::DOUBLE, 500.0::DOUBLE), "
    "('T3', 500.0::DOUBLE / 6076.12::DOUBLE, 100.0::DOUBLE)) v(tier, h_lim, v_lim)")


def _norm(d, z):
    return f"greatest({d} / h_lim, abs({z}) / v_lim)"


def ev_cte(name, src, look="120", where="ra <= 10 AND rb <= 10 AND ha <= 6000 AND hb <= 6000", *deps):
    cte(name + "_z", f"""SELECT p.*, {zone_cols('h_lim', 'v_lim', '1', 'obs')}, {zone_cols('h_lim', 'v_lim', look, 'pred')},
      {cpa_cols('1', 'st')}, {cpa_cols(look, 'cp')} FROM {src} p WHERE {where}""", *deps)
    cte(name, f"""SELECT *, obs_in IS NOT NULL AS observed, (pred_in IS NOT NULL AND obs_in IS NULL) AS predicted,
      {_norm('sqrt(rx*rx+ry*ry)', 'dz')} AS s_now, {_norm('st_d', 'st_z')} AS s_step, {_norm('cp_d', 'cp_z')} AS s_cpa,
      CASE WHEN pred_in IS NOT NULL AND obs_in IS NULL THEN pred_in END AS t_entry FROM {name}_z""", name + "_z")


cte("pair_tier", "SELECT * FROM pairs CROSS JOIN tiers", "pairs", "tiers")
ev_cte("ev", "pair_tier", "120", "ra <= 10 AND rb <= 10 AND ha <= 6000 AND hb <= 6000", "pair_tier")
KEEP = "day, t, a, b, tier, h_lim, xa, ya, ha, xb, yb, hb, tra, trb, pha, phb, zref, ia, ib"
cte("kinds", f"""
SELECT {KEEP}, 'observed' AS kind, s_step AS s, st_d AS d_h, st_z AS dz_at, NULL::DOUBLE AS t_entry_s FROM ev WHERE observed
UNION ALL SELECT {KEEP}, 'predicted', s_cpa, cp_d, cp_z, t_entry FROM ev WHERE predicted
UNION ALL SELECT {KEEP}, 'any', CASE WHEN observed THEN s_step ELSE s_cpa END, CASE WHEN observed THEN st_d ELSE cp_d END,
  CASE WHEN observed THEN st_z ELSE cp_z END, NULL FROM ev WHERE observed OR predicted""", "ev")
cte("epi0", """SELECT *, sum(CASE WHEN t - pt > 11 THEN 1 ELSE 0 END) OVER (PARTITION BY day, a, b, tier, kind ORDER BY t) AS ep
  FROM (SELECT *, lag(t) OVER (PARTITION BY day, a, b, tier, kind ORDER BY t) AS pt FROM kinds)""", "kinds")
cte("epi1", """SELECT *, min(t) OVER g AS t_start, max(t) OVER g AS t_end,
    row_number() OVER (PARTITION BY day, a, b, tier, kind, ep ORDER BY round(s + 1e-6 * d_h / h_lim, 9), t) AS rn
  FROM epi0 WINDOW g AS (PARTITION BY day, a, b, tier, kind, ep)""", "epi0")


def idx_sql(p):
    return f"(CASE WHEN {p} = 0 THEN -1 WHEN {p} > 100 THEN {p} - 101 ELSE {p} - 1 END)"


def label_sql(p):
    return (f"CASE WHEN {p} = 0 THEN 'other' WHEN {p} > 100 THEN 'departure_' ELSE 'arrival_' END || "
            f"CASE WHEN {p} = 0 THEN '' ELSE (SELECT runway FROM rwy WHERE k = {idx_sql(p)}) END")


def near_sql(x, y):
    return "least(" + ", ".join(f"sqrt(pow({x} - ({tx}), 2) + pow({y} - ({ty}), 2))" for _, tx, ty, _ in RWY) + ")"


BRG = "[" + ", ".join(f"{b}::DOUBLE" for *_, b in RWY) + "]"
CLASS_SQL = f"""CASE WHEN {near_sql('xa', 'ya')} <= 1 AND {near_sql('xb', 'yb')} <= 1 AND ha < 500 AND hb < 500 THEN 'runway_area'
  WHEN pha > 0 AND phb > 0 AND {idx_sql('pha')} = {idx_sql('phb')} AND {delta_sql('tra', 'trb')} < 30 THEN 'in_trail_same_runway'
  WHEN pha > 0 AND phb > 0 AND {idx_sql('pha')} <> {idx_sql('phb')}
    AND {delta_sql(f'{BRG}[{idx_sql("pha")} + 1]', f'{BRG}[{idx_sql("phb")} + 1]')} <= 15 THEN 'parallel_runways'
  WHEN {delta_sql('tra', 'trb')} BETWEEN 30 AND 150 THEN 'crossing'
  WHEN {delta_sql('tra', 'trb')} > 150 THEN 'head_on' ELSE 'other' END"""
cte("enc", f"""SELECT day, a, b, tier, kind, t_start, t_end, t_end - t_start + 1 AS duration_s, t AS t_min, d_h AS d_h_min_nm,
    dz_at AS dz_at_min_ft, s AS s_min, t_entry_s, xa, ya, ha, xb, yb, hb, greatest(ha, hb) AS h_max_ft,
    greatest(ha, hb) <= 4000 AS inside_ceiling, CASE WHEN zref = 1 THEN 'baro' ELSE 'geo' END AS zref,
    {label_sql('pha')} AS phase_a, {label_sql('phb')} AS phase_b, {CLASS_SQL} AS geometry_class, ia OR ib AS interpolated
  FROM epi1 WHERE rn = 1""", "epi1", "rwy")
ENC_ID = "day, a, b, tier, kind, t_start, t_end, duration_s, t_min"


# ------------------------------------------------------------ builders ----

def presence(spark, d):
    return pr.presence(views.grid(spark, d), RWY, WIDE["ceiling_ft"])


def pairs(spark, d):
    return pr.flagged_pairs(presence(spark, d), WIDE)


def enc(spark, d, spec=SPEC):
    return en.encounters(pairs(spark, d), spec, RWY)


# ------------------------------------------------------------ geometry ----

@query("g1_runway_frame_plane", statement(
    f"SELECT day, t, leg, runway, {r('along', 'cross_nm AS cross')} FROM frame", "frame"))
def g1(spark, d):
    g = views.grid(spark, d)
    cols = []
    for name, tx, ty, b in RWY:
        along, cross = geo.runway_frame(F.col("x") - tx, F.col("y") - ty, b)
        cols.append(F.struct(F.lit(name).alias("runway"), along.alias("along"), cross.alias("cross")))
    out = g.select("day", "t", "leg", F.explode(F.array(*cols)).alias("f")).select("day", "t", "leg", "f.*")
    return rounded(out)


@query("g1_runway_frame_degrees", statement(f"""SELECT event_id, {r('-(dx * sin(radians(50)) + dy * cos(radians(50))) AS along',
    'dx * cos(radians(50)) - dy * sin(radians(50)) AS cross')} FROM (
  SELECT event_id, (longitude - (-86.7)) * 60 * cos(radians(36.13)) AS dx, (latitude - 36.13) * 60 AS dy FROM reports)""", "reports"))
def g1_deg(spark, d):
    dx, dy = geo.flat_offset(F.col("latitude"), F.col("longitude"), 36.13, -86.7)
    along, cross = geo.runway_frame(dx, dy, 50.0)
    return rounded(views.reports(spark, d).select("event_id", along.alias("along"), cross.alias("cross")))


@query("g2_track_delta", statement(f"SELECT day, t, leg, {r(delta_sql('track', '350') + ' AS turn')} FROM grid", "grid"))
def g2(spark, d):
    return rounded(views.grid(spark, d).select("day", "t", "leg", geo.track_delta(F.col("track"), 350.0).alias("turn")))


@query("g3_flight_phase", statement("SELECT day, t, leg, phase FROM pres", "pres"))
def g3(spark, d):
    return rounded(presence(spark, d).select("day", "t", "leg", "phase"))


@query("g4_phase_labels", statement(f"""SELECT label, grp, k, count(*) AS n FROM (
  SELECT {label_sql('phase')} AS label, {idx_sql('phase')} AS k,
    CASE WHEN phase = 0 THEN 'other' WHEN phase > 100 THEN 'departure' ELSE 'arrival' END AS grp FROM pres) GROUP BY ALL""",
    "pres", "rwy"))
def g4(spark, d):
    p = F.col("phase")
    out = presence(spark, d).groupBy(
        geo.phase_label(p, RWY).alias("label"), geo.phase_group(p).alias("grp"), geo.phase_runway_index(p).alias("k")
    ).agg(F.count(F.lit(1)).alias("n"))
    return rounded(out)


@query("g5_nearest_threshold", statement(f"SELECT day, t, leg, {r(near_sql('x', 'y') + ' AS d')} FROM grid", "grid"))
def g5(spark, d):
    return rounded(views.grid(spark, d).select("day", "t", "leg", geo.nearest_threshold(F.col("x"), F.col("y"), RWY).alias("d")))


@query("g6_geometry_class", statement(f"SELECT day, t, a, b, {CLASS_SQL} AS geometry_class FROM pairs", "pairs", "rwy"))
def g6(spark, d):
    return geo.with_geometry_class(pairs(spark, d), RWY).select("day", "t", "a", "b", "geometry_class")


@query("g7_parallel_spacing", statement(f"""WITH s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 360 AS brg, s_acctbal / 1000 AS x,
    s_acctbal / 700 AS y FROM supplier)
SELECT s_nationkey::BIGINT AS s_nationkey, {r('min(gap) AS spacing_nm')} FROM (
  SELECT a.s_nationkey, abs((b.x - a.x) * cos(radians(a.brg)) - (b.y - a.y) * sin(radians(a.brg))) AS gap
  FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND {delta_sql('a.brg', 'b.brg')} <= 10)
WHERE gap > 0.01 GROUP BY 1"""))
def g7(spark, d):
    """Smallest spacing of parallel runways, one airport per nation."""
    from ..sources.profiles import parallel_spacing

    s = views.load(spark, d, "supplier").select(
        F.col("s_nationkey").alias("airport"), F.col("s_suppkey").alias("runway"), (F.col("s_suppkey") % 360).cast("double").alias("bearing"),
        (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_acctbal") / 700).alias("y"))
    return rounded(parallel_spacing(s).select(F.col("airport").alias("s_nationkey"), "spacing_nm"))


@query("g8_zone_intervals", statement(f"""SELECT day, t, a, b, {r('z_in AS t_in', 'z_out AS t_out')} FROM (
  SELECT *, {zone_cols('3', '1000', '120', 'z')} FROM pair0) WHERE z_in IS NOT NULL""", "pair0"))
def g8(spark, d):
    p = pr.flagged_pairs(presence(spark, d), {**WIDE, "h_limit": 3.0, "v_limit": 1000.0, "lookahead_s": 120.0})
    t_in, t_out = zones.zone_interval(*[F.col(c) for c in pr.STATE], 3.0, 1000.0, 120.0)
    return rounded(p.select("day", "t", "a", "b", t_in.alias("t_in"), t_out.alias("t_out")))


@query("g9_closest_approach", statement(f"""SELECT day, t, a, b, {r('c_t AS t_cpa', 'c_d AS d_cpa', 'c_z AS dz_cpa')}
  FROM (SELECT *, {cpa_cols('120', 'c')} FROM pairs)""", "pairs"))
def g9(spark, d):
    t, dist, dz = zones.closest_approach(*[F.col(c) for c in pr.STATE], 120.0)
    return rounded(pairs(spark, d).select("day", "t", "a", "b", t.alias("t_cpa"), dist.alias("d_cpa"), dz.alias("dz_cpa")))


@query("g10_prune_radius", statement("""SELECT day, a, b, count(*) AS n FROM pair0
  WHERE sqrt(rx * rx + ry * ry) <= 3 + 2 * 350 / 3600.0 * 10 AND dz IS NOT NULL GROUP BY ALL""", "pair0"))
def g10(spark, d):
    """Pairs within the prune radius of a 10 s lookahead, found through grid cells."""
    radius = zones.prune_radius(3.0, 10.0)
    every = {"h_limit": radius, "v_limit": 1e9, "lookahead_s": 10.0, "radius_nm": 10.0}
    p = pr.flagged_pairs(presence(spark, d), every, cells=True).filter(F.hypot("rx", "ry") <= radius)
    return p.groupBy("day", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("g11_widest_settings", statement(f"""SELECT 3.0::DOUBLE * 1.25 AS h_limit, 1000.0::DOUBLE * 1.25 AS v_limit, 180.0::DOUBLE AS lookahead_s,
  10.0::DOUBLE AS radius_nm, 12000.0::DOUBLE AS ceiling_ft, count(*) AS rows_covered FROM grid WHERE r <= 10 AND h <= 12000""", "grid"))
def g11(spark, d):
    """Widest settings and the grid rows they cover."""
    g = views.grid(spark, d).filter((F.col("r") <= WIDE["radius_nm"]) & (F.col("h") <= WIDE["ceiling_ft"]))
    return g.agg(F.count(F.lit(1)).alias("rows_covered")).select(
        *[F.lit(float(WIDE[k])).alias(k) for k in ("h_limit", "v_limit", "lookahead_s", "radius_nm", "ceiling_ft")], "rows_covered")


@query("g12_flat_distance", statement(f"""SELECT event_id, {r('sqrt(pow((longitude + 86.6782) * 60 * cos(radians(36.1245)), 2) + pow((latitude - 36.1245) * 60, 2)) AS d')}
  FROM reports""", "reports"))
def g12(spark, d):
    dist = geo.flat_distance(F.col("latitude"), F.col("longitude"), AIRPORT.latitude, AIRPORT.longitude)
    return rounded(views.reports(spark, d).select("event_id", dist.alias("d")))


@query("g13_dataset_names", statement(r"""WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'k' || lang || 'x_' || source
    WHEN 1 THEN 'K' || upper(lang) || 'X-2025 ' || source WHEN 2 THEN source || '/' || lang ELSE 'K' || lang || 'X' END AS folder,
    'kz' || lang || '_20250101.parquet' AS file FROM documents)
SELECT doc_id, upper(coalesce(nullif(regexp_extract(folder, '^([A-Za-z][A-Za-z0-9]{3})(?:[\s_\-.]+(.*))?$', 1), ''),
    nullif(regexp_extract(file, '^([A-Za-z][A-Za-z0-9]{3})[_\-]?(?:19|20)\d{6}', 1), ''))) AS code,
  coalesce(nullif(trim(regexp_replace(lower(CASE WHEN regexp_matches(folder, '^([A-Za-z][A-Za-z0-9]{3})(?:[\s_\-.]+(.*))?$')
    THEN regexp_extract(folder, '^([A-Za-z][A-Za-z0-9]{3})(?:[\s_\-.]+(.*))?$', 2) ELSE folder END), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'all') AS label
FROM n"""))
def g13(spark, d):
    docs = views.load(spark, d, "documents").select("doc_id", "lang", "source")
    k = F.col("doc_id") % 4
    folder = (
        F.when(k == 0, F.concat(F.lit("k"), "lang", F.lit("x_"), "source"))
        .when(k == 1, F.concat(F.lit("K"), F.upper("lang"), F.lit("X-2025 "), "source"))
        .when(k == 2, F.concat("source", F.lit("/"), "lang"))
        .otherwise(F.concat(F.lit("K"), "lang", F.lit("X")))
    )
    file = F.concat(F.lit("kz"), "lang", F.lit("_20250101.parquet"))
    return docs.select("doc_id", text.airport_code(folder, file).alias("code"), text.dataset_label(folder).alias("label"))


@query("g14_calendar", statement("""SELECT event_id, hour(lt)::BIGINT AS local_hour,
    CASE WHEN dayofweek(lt) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS daytype,
    strftime(make_timestamp(t * 1000000), '%Y-%m') AS month, strftime(make_timestamp(t * 1000000), '%G-W%V') AS week
  FROM (SELECT event_id, t, make_timestamp(t * 1000000) - INTERVAL 6 HOUR AS lt FROM study)""", "study"))
def g14(spark, d):
    """January is standard time in Chicago, six hours behind UTC."""
    t = F.col("t")
    return rounded(views.study(spark, d).select(
        "event_id", timefns.local_hour(t, AIRPORT.timezone).alias("local_hour"),
        timefns.daytype(t, AIRPORT.timezone).alias("daytype"), timefns.month_utc(t).alias("month"),
        timefns.iso_week(t).alias("week")))


# ---------------------------------------------------------- pair join -----

@query("j1_pair_seconds", statement(f"""SELECT day, t, a, b, {r('rx', 'ry', 'vx', 'vy', 'dz', 'vz')}, zref, pha, phb, ia, ib
  FROM pairs""", "pairs"))
def j1(spark, d):
    return rounded(pairs(spark, d).select("day", "t", "a", "b", "rx", "ry", "vx", "vy", "dz", "vz", "zref", "pha", "phb", "ia", "ib"))


@query("p1_tier_evaluation", statement(f"""SELECT day, t, a, b, tier, observed, predicted, {r('s_now', 's_step', 's_cpa', 't_entry', 'cp_t AS t_cpa')}
  FROM ev WHERE observed OR predicted""", "ev"))
def p1(spark, d):
    p = pr.within_volume(pairs(spark, d), SPEC.radius_nm, SPEC.extended_ceiling_ft)
    out = pr.evaluate_tiers(p, SPEC).filter(F.col("observed") | F.col("predicted"))
    return rounded(out.select("day", "t", "a", "b", "tier", "observed", "predicted", "s_now", "s_step", "s_cpa", "t_entry", "t_cpa"))


@query("p2_volume_filter", statement("SELECT day, t, a, b FROM pairs WHERE ra <= 5 AND rb <= 5 AND ha <= 3000 AND hb <= 3000", "pairs"))
def p2(spark, d):
    return pr.within_volume(pairs(spark, d), 5.0, 3000.0).select("day", "t", "a", "b")


@query("p3_observed_episodes", statement(f"SELECT {ENC_ID}, {r('s_min')} FROM enc WHERE kind = 'observed' AND tier = 'T1'", "enc"))
def p3(spark, d):
    p = pr.within_volume(pairs(spark, d), SPEC.radius_nm, SPEC.extended_ceiling_ft)
    ev = pr.evaluate_tiers(p, Spec(tiers=SPEC.tiers[:1]))
    flagged = en.by_kind(ev).filter(F.col("kind") == "observed")
    out = en.episodes(flagged, RWY, SPEC.ceiling_ft)
    return rounded(out.select(*ENC_ID.split(", "), "s_min"))


@query("p4_encounters", statement(f"""SELECT {ENC_ID}, {r('d_h_min_nm', 'dz_at_min_ft', 's_min', 't_entry_s')}, inside_ceiling, zref,
   phase_a, phase_b, geometry_class, interpolated FROM enc WHERE kind <> 'any'""", "enc"))
def p4(spark, d):
    out = enc(spark, d).filter(F.col("kind") != "any")
    return rounded(out.select(*ENC_ID.split(", "), "d_h_min_nm", "dz_at_min_ft", "s_min", "t_entry_s", "inside_ceiling", "zref",
                              "phase_a", "phase_b", "geometry_class", "interpolated"))


@query("p5_day_encounters", statement(f"""SELECT {ENC_ID}, {r('s_min', 'h_max_ft')}, geometry_class, 'ac' || lpad((a % 12)::VARCHAR, 2, '0') AS icao24_a,
   'ac' || lpad((b % 12)::VARCHAR, 2, '0') AS icao24_b FROM enc""", "enc"))
def p5(spark, d):
    legs = views.grid(spark, d).groupBy("day", "leg").agg(F.min("icao24").alias("icao24"))
    out = en.with_identity(enc(spark, d), legs, AIRPORT)
    return rounded(out.select(*ENC_ID.split(", "), "s_min", "h_max_ft", "geometry_class", "icao24_a", "icao24_b"))


@query("p6_tier_scaling", statement(f"""SELECT which, f AS factor, count(*) AS n_observed FROM (
  SELECT which, f, {zone_cols("3 * CASE WHEN which = 'H' THEN f ELSE 1 END", "1000 * CASE WHEN which = 'V' THEN f ELSE 1 END", '1', 'z')}
  FROM pairs CROSS JOIN (SELECT 'H' AS which, 0.75::DOUBLE AS f UNION ALL SELECT 'H', 1.25 UNION ALL SELECT 'V', 0.75 UNION ALL SELECT 'V', 1.25)
  WHERE ra <= 10 AND rb <= 10 AND ha <= 6000 AND hb <= 6000) WHERE z_in IS NOT NULL GROUP BY ALL""", "pairs"))
def p6(spark, d):
    p = pr.within_volume(pairs(spark, d), SPEC.radius_nm, SPEC.extended_ceiling_ft)
    variants = []
    for which in ("H", "V"):
        for f in (0.75, 1.25):
            _, h, v = SPEC.scaled("T1", which, f).tiers[0]
            variants.append(F.struct(F.lit(which).alias("which"), F.lit(f).alias("factor"), F.lit(h).alias("h_lim"), F.lit(v).alias("v_lim")))
    q = p.withColumn("_v", F.explode(F.array(*variants))).select(*p.columns, "_v.*")
    out = pr.evaluate(q, SPEC.lookahead_s).filter("observed")
    return out.groupBy("which", "factor").agg(F.count(F.lit(1)).alias("n_observed"))


cte("tall", "SELECT min_agl_ft * 30 AS h FROM approaches WHERE outcome = 'ga_ambiguous'", "approaches")
cte("reach", """SELECT 2500.0::DOUBLE AS charted,
  (SELECT quantile_cont(min_agl_ft * 12, 0.95) FROM approaches WHERE outcome IN ('go_around', 'touch_and_go')) AS p95,
  (SELECT avg((h > 2500)::INT) FROM tall) AS spill0""", "approaches", "tall")
cte("first_try", """SELECT *, p95 <= charted AS contained,
  CASE WHEN p95 <= charted THEN charted ELSE least(greatest(charted, ceil(p95 / 500) * 500), 10000) END AS c0 FROM reach""", "reach")
cte("steps", """SELECT c0 + 500 * i AS c, (SELECT avg((h > c0 + 500 * i)::INT) FROM tall) AS s
  FROM first_try, generate_series(0, 20) g(i) WHERE c0 + 500 * i <= 10000""", "first_try", "tall")


@query("p7_ceiling_adequacy", statement("""SELECT round(p95, 6) AS p95_height_ft, contained, round(spill0, 6) AS spill_charted,
  CASE WHEN contained AND spill0 <= 0.10 THEN charted
       ELSE greatest(charted, coalesce((SELECT min(c) FROM steps WHERE s <= 0.10), (SELECT max(c) FROM steps), c0)) END AS effective_ft
  FROM first_try""", "first_try", "steps"))
def p7(spark, d):
    """Ceiling check on whole event and encounter height tables."""
    ap = views.approaches(spark, d)
    heights = ap.filter(F.col("outcome").isin("go_around", "touch_and_go")).select((F.col("min_agl_ft") * 12).alias("h"))
    t1 = ap.filter(F.col("outcome") == "ga_ambiguous").select((F.col("min_agl_ft") * 30).alias("h"))
    return rounded(adequacy.ceiling_check(heights, t1, 2500.0).select("p95_height_ft", "contained", "spill_charted", "effective_ft"))


@query("p8_pair_minimum", statement(f"""SELECT day, a, b, {r('min(sqrt(rx*rx+ry*ry)) AS d_min_nm')} FROM pairs
  WHERE NOT ia AND NOT ib AND abs(dz) < 1000 GROUP BY ALL HAVING min(sqrt(rx*rx+ry*ry)) < 3""", "pairs"))
def p8(spark, d):
    return rounded(pr.pair_minimum(pairs(spark, d), 3.0, 1000.0))


cte("lg", "SELECT day, leg, min(icao24) AS icao24 FROM grid GROUP BY ALL", "grid")


@query("j13_identity_lookup", statement("""SELECT e.day, e.a, e.b, t_min, tier, kind, la.icao24 AS icao24_a, lb.icao24 AS icao24_b
  FROM enc e LEFT JOIN lg la ON la.day = e.day AND la.leg = e.a LEFT JOIN lg lb ON lb.day = e.day AND lb.leg = e.b""", "enc", "lg"))
def j13(spark, d):
    legs = views.grid(spark, d).groupBy("day", "leg").agg(F.min("icao24").alias("icao24"))
    return en.with_identity(enc(spark, d), legs, AIRPORT).select("day", "a", "b", "t_min", "tier", "kind", "icao24_a", "icao24_b")


cte("min_now", "SELECT day, a, b, min(sqrt(rx*rx+ry*ry)) AS dl FROM pairs WHERE NOT ia AND NOT ib AND abs(dz) < 1000 GROUP BY ALL HAVING min(sqrt(rx*rx+ry*ry)) < 3", "pairs")
cte("min_step", f"SELECT day, a, b, min(c_d) AS dr FROM (SELECT *, {cpa_cols('1', 'c')} FROM pairs WHERE abs(dz) < 1000) GROUP BY ALL HAVING min(c_d) < 3", "pairs")


@query("j20_compare_minima", statement(f"""SELECT coalesce(l.day, r.day) AS day, coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, {r('dl AS d_left', 'dr AS d_right')},
   CASE WHEN dr IS NULL THEN 'only_left' WHEN dl IS NULL THEN 'only_right' ELSE 'both' END AS status, coalesce(abs(dl - dr) <= 0.05, false) AS agree
   FROM min_now l FULL JOIN min_step r ON l.day = r.day AND l.a = r.a AND l.b = r.b""", "min_now", "min_step"))
def j20(spark, d):
    """Sample-time minimum against the analytic minimum within each step."""
    p = pairs(spark, d)
    _, dist, _ = zones.closest_approach(*[F.col(c) for c in pr.STATE], 1.0)
    second = (
        p.filter(F.abs("dz") < 1000).groupBy("day", "a", "b").agg(F.min(dist).alias("d_min_nm")).filter("d_min_nm < 3"))
    return rounded(pr.compare_minima(pr.pair_minimum(p, 3.0, 1000.0), second))
