"""Catalogue: count baseline and its validation (B1-B19, ST1, D7, M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dist import count_quantile, count_terms, norm_ppf, wilson
from ..functions.plan import cut_lineage
from ..operators import baseline as bl, bootstrap as bs, glm, matching as mt
from ..operators.glm import CountModel
from ..settings import BASELINE
from . import views
from .q_stats import SEED, boot_cte, ci
from .registry import cte, query, statement
from .tidy import r, rounded

# hourly windows of the event log: clicks as encounters, viewed value as exposure
cte("bw0", """SELECT day || '_' || lpad((t // 3600 % 24)::VARCHAR, 2, '0') AS window_id, day, t // 3600 * 3600 AS t_start, (t // 3600 % 24) AS local_hour,
   count(*) FILTER (event_type = 'click') AS T1_any, count(*) FILTER (event_type = 'purchase' AND value > 150) AS T2_any, count(DISTINCT user_id) AS n_aircraft,
   coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'view'), 0)::BIGINT AS cents,
   count(*) FILTER (event_type = 'purchase') >= count(*) FILTER (event_type = 'signup') AS north FROM study GROUP BY ALL""", "study")
cte("bwin", """SELECT window_id, day, t_start, local_hour, T1_any, T2_any, n_aircraft, cents / 10000 AS pair_hours, CASE WHEN north THEN 'north' ELSE 'south' END AS flow,
   CASE WHEN dayofweek(day::DATE) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS daytype, substr(day, 1, 7) AS month FROM bw0""", "bw0")
cte("bex", "SELECT * FROM bwin WHERE pair_hours > 0", "bwin")


def windows(spark, d):
    s = views.study(spark, d)
    k = F.col("event_type")
    w = s.groupBy("day", F.floor(F.col("t") / 3600).alias("h")).agg(
        F.count_if(k == "click").alias("T1_any"), F.count_if((k == "purchase") & (F.col("value") > 150)).alias("T2_any"),
        F.count_distinct("user_id").alias("n_aircraft"),
        F.sum(F.when(k == "view", F.round(F.col("value") * 100)).otherwise(0)).cast("bigint").alias("cents"),
        (F.count_if(k == "purchase") >= F.count_if(k == "signup")).alias("north"))
    hour = F.col("h") % 24
    return cut_lineage(w.select(
        F.concat_ws("_", "day", F.lpad(hour.cast("string"), 2, "0")).alias("window_id"), "day", (F.col("h") * 3600).alias("t_start"), hour.alias("local_hour"),
        "T1_any", "T2_any", "n_aircraft", (F.col("cents") / 10000).alias("pair_hours"), F.when(F.col("north"), "north").otherwise("south").alias("flow"),
        F.when(F.dayofweek(F.to_date("day")).isin(1, 7), "weekend").otherwise("weekday").alias("daytype"), F.substring("day", 1, 7).alias("month")))


def exposed(spark, d):
    return windows(spark, d).filter(F.col("pair_hours") > 0)


def pooled_model(w, metric="T1_any"):
    t = w.agg(F.sum(metric).alias("y"), F.sum("pair_hours").alias("e"), F.count(F.lit(1)).alias("n")).first()
    return CountModel(metric, "pooled", {}, 0.0, t["y"] / t["e"], t["n"], t["y"])


LEVELS = " UNION ALL ".join(f"SELECT '{f}' AS factor, {c}::VARCHAR AS level, T1_any AS y FROM bex" for f, c in (
    ("hour_block", "local_hour"), ("daytype", "daytype"), ("month", "month"), ("flow", "flow")))


@query("b1_design_levels", statement(f"""SELECT factor, level, n, events, CASE WHEN rn = 1 THEN 'reference' WHEN n < 10 OR events <= 0 THEN 'merged' ELSE 'term' END AS role FROM (
   SELECT factor, level, count(*) AS n, sum(y)::BIGINT AS events, row_number() OVER (PARTITION BY factor ORDER BY count(*) DESC, level) AS rn FROM ({LEVELS}) GROUP BY factor, level)""", "bex"))
def b1(spark, d):
    w = exposed(spark, d).withColumn("hour_block", F.col("local_hour"))
    return glm.design_levels(glm.level_table(w, ["hour_block", "daytype", "month", "flow"], "T1_any"))


@query("b2_design_terms", statement(f"""SELECT count(*) AS n, sum((daytype = 'weekend')::INT)::BIGINT AS weekend, sum((flow = 'north')::INT)::BIGINT AS north,
   {r('sum(ln(greatest(n_aircraft, 1))) AS log_n')} FROM bex""", "bex"))
def b2(spark, d):
    """Column sums of the treatment-coded design."""
    w = glm.prepare(exposed(spark, d))
    x = glm._design(w, [("daytype", "weekend"), ("flow", "north")], ["log_n"], "T1_any", F.log("pair_hours"), F.lit(1.0))
    out = x.agg(*[F.sum(F.get("x", F.lit(i))).alias(n) for i, n in enumerate(("n", "weekend", "north", "log_n"))])
    return rounded(out.select(*[F.col(c).cast("bigint").alias(c) for c in ("n", "weekend", "north")], "log_n"))


def _nb_pmf(k):
    """Probability of count k with dispersion 0.5 (shape 2), written with factorials."""
    return f"(({k}) + 1) * pow(1 / (1 + 0.5 * mu), 2) * pow(0.5 * mu / (1 + 0.5 * mu), ({k}))"


cte("mus", "SELECT event_id, least(value, 120) / 20 AS mu, user_id % 12 AS y FROM study", "study")
cte("cdfs", f"""SELECT event_id, list_sum([exp(-mu + i * ln(mu) - lgamma(i + 1)) for i in range(0, y + 1)]) AS pc, exp(-mu + y * ln(mu) - lgamma(y + 1)) AS pp,
   list_sum([(i + 1) * pow(1 / (1 + 0.5 * mu), 2) * pow(0.5 * mu / (1 + 0.5 * mu), i) for i in range(0, y + 1)]) AS nc, {_nb_pmf('y')} AS np FROM mus""", "mus")


@query("b3_count_distributions", statement(f"SELECT event_id, {r('pc AS pois_cdf', 'pp AS pois_pmf', 'nc AS nb_cdf', 'np AS nb_pmf')} FROM cdfs", "cdfs"))
def b3(spark, d):
    m = views.study(spark, d).select("event_id", (F.least("value", F.lit(120.0)) / 20).alias("mu"), (F.col("user_id") % 12).alias("y"))
    p = count_terms(F.col("y").cast("double"), F.col("mu"), F.lit(0.0))
    q = count_terms(F.col("y").cast("double"), F.col("mu"), F.lit(0.5))
    m = m.withColumns({"p": p, "q": q})
    return rounded(m.select("event_id", F.col("p.cdf").alias("pois_cdf"), F.col("p.pmf").alias("pois_pmf"), F.col("q.cdf").alias("nb_cdf"), F.col("q.pmf").alias("nb_pmf")))


@query("b3_count_quantiles", statement("""SELECT event_id, min(k)::DOUBLE AS q95 FROM (SELECT event_id, k, sum(exp(-mu + k * ln(mu) - lgamma(k + 1))) OVER (PARTITION BY event_id ORDER BY k) AS c
   FROM mus, generate_series(0, 40) g(k)) WHERE c >= 0.95 GROUP BY 1""", "mus"))
def b3_quantile(spark, d):
    m = views.study(spark, d).select("event_id", (F.least("value", F.lit(120.0)) / 20).alias("mu"))
    return m.select("event_id", count_quantile(0.95, F.col("mu"), F.lit(0.0)).alias("q95"))


@query("b4_fit_count_model")
def b4(spark, d):
    """Iterative fit; the tests recover known effects from simulated counts."""
    model = glm.fit_count_model(windows(spark, d), "T1_any")
    return rounded(model.params(spark).select("metric", "kind", "alpha", "pooled_rate", "n_windows", "n_events", F.explode_outer("coef").alias("term", "value")), 4)


@query("b4_pooled_rate", statement(f"SELECT {r('sum(T2_any) / sum(pair_hours) AS pooled_rate')}, count(*) AS n_windows, sum(T2_any)::BIGINT AS n_events FROM bex", "bex"))
def b4_pooled(spark, d):
    m = pooled_model(exposed(spark, d), "T2_any")
    return rounded(m.params(spark).select("pooled_rate", "n_windows", "n_events"))


cte("brate", "SELECT sum(T1_any) / sum(pair_hours) AS rate FROM bex", "bex")


@query("b5_expected_counts", statement(f"SELECT window_id, {r('rate * pair_hours AS mu')} FROM bwin, brate", "bwin", "brate"))
def b5(spark, d):
    w = windows(spark, d)
    return rounded(w.select("window_id", bl.expected(w, pooled_model(w.filter("pair_hours > 0"))).alias("mu")))


cte("bsc", """SELECT window_id, T1_any AS y, mu, list_sum([exp(-mu + i * ln(mu) - lgamma(i + 1)) for i in range(0, y + 1)]) - exp(-mu + y * ln(mu) - lgamma(y + 1)) AS below,
   exp(-mu + y * ln(mu) - lgamma(y + 1)) AS pmf FROM (SELECT window_id, T1_any, T1_any AS y, rate * pair_hours AS mu FROM bex, brate)""", "bex", "brate")


@query("b6_score_windows", statement(f"""SELECT window_id, {r('mu AS expected', 'y / mu AS oe', '1 - below - 0.5 * pmf AS p_upper', digits=5)}, 1 - below - 0.5 * pmf < 0.05 AS exceed95,
   round(greatest(least(below + ((('0x' || substr(md5('{SEED}|' || window_id), 1, 8))::BIGINT + 0.5) / 4294967296) * pmf, 1 - 1e-10), 1e-10), 5) AS pit FROM bsc""", "bsc"))
def b6(spark, d):
    w = exposed(spark, d)
    s = bl.score(w, pooled_model(w), seed=SEED)
    return rounded(s.select("window_id", F.col("T1_any_expected").alias("expected"), F.col("T1_any_oe").alias("oe"), F.col("T1_any_p_upper").alias("p_upper"),
                            F.col("T1_any_exceed95").alias("exceed95"), F.col("T1_any_pit").alias("pit")), 5)


@query("b7_phase1_removed")
def b7(spark, d):
    model, removed = bl.phase1(windows(spark, d), "T1_any")
    base = model.params(spark).select("metric", "kind", "n_windows")
    return base.withColumn("n_removed", F.lit(0 if removed is None else removed.count()))


cte("bcut", "SELECT quantile_cont(pair_hours, 1/3.0::DOUBLE) AS q1, quantile_cont(pair_hours, 2/3.0::DOUBLE) AS q2 FROM bex", "bex")
cte("bstr", "SELECT b.*, 'h' || (local_hour // 6) || '|t' || ((pair_hours >= q1)::INT + (pair_hours >= q2)::INT) || '|' || flow AS stratum FROM bex b, bcut", "bex", "bcut")


@query("b8_strata", statement("SELECT window_id, stratum FROM bstr", "bstr"))
def b8(spark, d):
    w = exposed(spark, d)
    return w.select("window_id", bl.stratum(bl.exposure_terciles(w)).alias("stratum"))


@query("b9_continuous_scores", statement(f"""SELECT q.window_id, {r('(count(*) FILTER (f.n_aircraft < q.n_aircraft) + 0.5 * count(*) FILTER (f.n_aircraft = q.n_aircraft) + 0.5) / (count(*) + 1) AS pct')}, count(*) AS ref_n
   FROM (SELECT b.*, count(*) OVER (PARTITION BY stratum) AS ns FROM bstr b) q JOIN bstr f ON f.stratum = q.stratum OR q.ns < 30 GROUP BY 1""", "bstr"))
def b9(spark, d):
    w = exposed(spark, d)
    return rounded(bl.continuous_score(w, w, "n_aircraft", bl.exposure_terciles(w)).select("window_id", "pct", "ref_n"))


@query("b10_crosscheck", statement(f"""SELECT stratum, count(*) AS n_windows, {r('quantile_cont(T1_any, 0.95) AS empirical_limit95', 'avg(lim) AS model_limit95_mean')},
   abs(quantile_cont(T1_any, 0.95) - avg(lim)) <= greatest(1, 0.25 * greatest(quantile_cont(T1_any, 0.95), avg(lim))) AS agree FROM (
   SELECT stratum, T1_any, (SELECT min(k) FROM (SELECT k, sum(exp(-mu + k * ln(mu) - lgamma(k + 1))) OVER (ORDER BY k) AS c FROM generate_series(0, 200) g(k)) WHERE c >= 0.95) AS lim
   FROM (SELECT *, rate * pair_hours AS mu FROM bstr, brate)) GROUP BY 1 HAVING count(*) >= 30""", "bstr", "brate"))
def b10(spark, d):
    w = exposed(spark, d)
    return rounded(bl.crosscheck(w, pooled_model(w), bl.exposure_terciles(w)))


@query("b11_wilson", statement(f"""SELECT day, {r('(k/n + 1.96*1.96/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n) AS lo', '(k/n + 1.96*1.96/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n) AS hi')}
   FROM (SELECT day, count(*)::DOUBLE AS n, count(*) FILTER (event_type = 'click') AS k FROM study GROUP BY 1)""", "study"))
def b11(spark, d):
    per = views.study(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rounded(per.select("day", lo.alias("lo"), hi.alias("hi")))


@query("b12_fold_labels", statement("SELECT strftime(make_timestamp(t_start * 1000000), '%G-W%V') AS fold, 'week' AS fold_kind, count(*) AS n FROM bex GROUP BY ALL", "bex"))
def b12(spark, d):
    return bl.with_folds(exposed(spark, d)).groupBy("fold", "fold_kind").agg(F.count(F.lit(1)).alias("n"))


@query("b13_out_of_sample")
def b13(spark, d):
    w = bl.with_folds(exposed(spark, d))
    return rounded(bl.out_of_sample(bl.score_by_fold(w, w, "T1_any", seed=SEED), "T1_any"), 4)


@query("b14_held_out_scores", statement(f"""SELECT window_id, {r('pair_hours * (SELECT sum(T2_any) / sum(pair_hours) FROM bex x WHERE strftime(make_timestamp(x.t_start * 1000000), chr(37) || $$G-W$$ || chr(37) || $$V$$) <> strftime(make_timestamp(b.t_start * 1000000), chr(37) || $$G-W$$ || chr(37) || $$V$$)) AS expected')}
   FROM bex b""", "bex"))
def b14(spark, d):
    """A rare metric, so that each fold's model is the pooled rate of the other folds."""
    import dataclasses as dc

    w = bl.with_folds(exposed(spark, d))
    out = bl.score_by_fold(w, w, "T2_any", seed=SEED, cfg=dc.replace(BASELINE, min_events=10**12))
    return rounded(out.select("window_id", F.col("T2_any_expected").alias("expected")))


@query("b15_stability_curve", statement(f"""SELECT fraction, n_days, {r('avg(rate) AS rate_mean', 'quantile_cont(rate, 0.025) AS rate_lo', 'quantile_cont(rate, 0.975) AS rate_hi')} FROM (
   SELECT fraction, greatest(2, round_even(fraction * n, 0))::BIGINT AS n_days, rep, sum(y) / sum(e) AS rate FROM (
     SELECT *, row_number() OVER (PARTITION BY rep ORDER BY h, day) AS rk, count(*) OVER (PARTITION BY rep) AS n FROM (
       SELECT day, rep, y, e, ('0x' || substr(md5('{SEED}|' || rep || '|' || day), 1, 8))::BIGINT AS h FROM (SELECT day, sum(T1_any) AS y, sum(pair_hours) AS e FROM bex GROUP BY 1), generate_series(0, 9) g(rep))),
     (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS fraction) WHERE rk <= greatest(2, round_even(fraction * n, 0)) GROUP BY ALL) GROUP BY ALL""", "bex"))
def b15(spark, d):
    return rounded(bl.stability(exposed(spark, d), "T1_any", seed=SEED).select("fraction", "n_days", "rate_mean", "rate_lo", "rate_hi"))


@query("b16_sufficiency", statement(f"SELECT stratum, count(*) AS n_windows, sum(T1_any)::BIGINT AS n_events, {r('sum(pair_hours) AS pair_hours')}, count(*) < 30 AS flagged FROM bstr GROUP BY 1", "bstr"))
def b16(spark, d):
    w = exposed(spark, d)
    return rounded(bl.sufficiency(w, "T1_any", bl.exposure_terciles(w)))


cte("bday", "SELECT 1 AS k, day, sum(T1_any) AS a, sum(pair_hours) AS b FROM bex GROUP BY ALL", "bex")
boot_cte("bboot", "bday", "k", ["a", "b"], ["bday"])


@query("b17_bootstrap_rate", statement(f"SELECT round((SELECT sum(a) / sum(b) FROM bday), 6) AS rate, round(q_lo, 6) AS rate_lo, round(q_hi, 6) AS rate_hi FROM (SELECT {ci('a / b', 'q')} FROM bboot)", "bday", "bboot"))
def b17(spark, d):
    return rounded(bs.ratio_bootstrap(exposed(spark, d), "T1_any", "pair_hours", reps=BASELINE.bootstrap_reps, seed=SEED, name="rate"))


@query("b19_ks_uniform", statement(f"""SELECT count(*) AS n, {r('max(greatest(rn / n::DOUBLE - u, u - (rn - 1) / n::DOUBLE)) AS d')} FROM (
   SELECT u, row_number() OVER (ORDER BY u) AS rn, count(*) OVER () AS n FROM (SELECT 1 - exp(-value / 50) AS u FROM study))""", "study"))
def b19(spark, d):
    u = views.study(spark, d).select((1 - F.exp(-F.col("value") / 50)).alias("u"))
    return rounded(bs.ks_uniform(u, "u").select("n", "d"))


@query("st1_score_event_windows", statement(f"SELECT w.event_id, w.wn AS \"window\", {r('rate * w.pair_hours AS expected')} FROM m2h w, brate WHERE grp = 'g' AND wn IN ('pre', 'post')", "m2h", "brate"))
def st1(spark, d):
    ev, _ = views.event_frames(spark, d)
    m = views.window_metrics(spark, d, ev, ("pre", "post")).drop("T1_any_expected", "T1_any_z", "T1_any_exceed95")
    m = m.withColumn("wid", F.concat_ws("_", "event_id", "window"))
    s = bl.score(m, pooled_model(exposed(spark, d)), seed=SEED, id_col="wid")
    return rounded(s.select("event_id", "window", F.col("T1_any_expected").alias("expected")))


@query("d7_rate_multipliers")
def d7(spark, d):
    return rounded(bl.multipliers(spark, glm.fit_count_model(windows(spark, d), "T1_any", factors=("daytype", "flow"))), 4)


@query("m9_regression_check")
def m9(spark, d):
    g, c = views.paired(spark, d, bands=False)
    return rounded(mt.did_regression(g, c, "T1_any"), 4)
