"""Control-chart baseline: scoring, strata, validation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dist import count_quantile, count_terms, hash_uniform, norm_ppf, wilson
from ..functions.plan import cut_lineage, pin
from ..functions.timefns import iso_week
from ..settings import BASELINE, Baseline
from .bootstrap import ks_uniform
from .glm import CountModel, fit_count_model
from .quantiles import grouped_quantiles
from .scan import running_sum


def expected(df: DataFrame, model: CountModel) -> Column:
    """Expected count of each window; levels the model does not know count as reference."""
    exposure = F.greatest(F.col("pair_hours"), F.lit(0.0))
    if model.kind == "pooled":
        return model.pooled_rate * exposure
    coef = F.create_map(*[x for k, v in model.coef.items() for x in (F.lit(k), F.lit(v))])

    def term(f, col):
        return F.coalesce(F.try_element_at(coef, F.concat(F.lit(f"{f}="), col.cast("string"))), F.lit(0.0))

    hour = F.floor(F.col("local_hour") / model.hour_block_h)
    log_n = F.log(F.greatest(F.col("n_aircraft").cast("double"), F.lit(1.0)))
    eta = (
        F.lit(model.coef["intercept"]) + term("hour_block", hour) + term("daytype", F.col("daytype"))
        + term("month", F.col("month")) + term("flow", F.col("flow")) + F.lit(model.coef.get("log_n", 0.0)) * log_n
    )
    return F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))) * exposure


def score(df: DataFrame, model: CountModel, *, seed=0, id_col: str = "window_id", cfg: Baseline = BASELINE) -> DataFrame:
    """Expected count, O/E, mid-p tail, randomised and mid quantile z, limits and exceedance flags."""
    m, alpha = model.metric, F.lit(float(model.alpha))
    df = pin(df, {"_mu": expected(df, model).cast("double")})
    df = pin(df, {"_t": count_terms(F.col(m).cast("double"), F.col("_mu"), alpha)})
    below = F.greatest(F.col("_t.cdf") - F.col("_t.pmf"), F.lit(0.0))
    df = df.withColumns({"_b": below, "_p": F.col("_t.pmf")})
    ok = F.col("_mu") > 0

    def clip(v):
        return F.least(F.greatest(v, F.lit(1e-10)), F.lit(1 - 1e-10))

    u = clip(F.col("_b") + hash_uniform(seed, F.col(id_col)) * F.col("_p"))
    p_mid = 1 - F.col("_b") - 0.5 * F.col("_p")
    df = pin(df, {"_u": u, "_m": clip(F.col("_b") + 0.5 * F.col("_p")), "_pm": p_mid})
    return df.withColumns({
        f"{m}_expected": F.col("_mu"), f"{m}_oe": F.when(ok, F.col(m) / F.col("_mu")), f"{m}_p_upper": F.when(ok, F.col("_pm")),
        f"{m}_z": F.when(ok, norm_ppf(F.col("_u"))), f"{m}_zmid": F.when(ok, norm_ppf(F.col("_m"))), f"{m}_pit": F.when(ok, F.col("_u")),
        f"{m}_exceed95": ok & (F.col("_pm") < 1 - cfg.warning), f"{m}_exceed99": ok & (F.col("_pm") < 1 - cfg.action),
        f"{m}_limit95": count_quantile(cfg.warning, F.col("_mu"), alpha), f"{m}_limit99": count_quantile(cfg.action, F.col("_mu"), alpha),
    }).drop("_mu", "_t", "_b", "_p", "_u", "_m", "_pm")


def phase1(df: DataFrame, metric: str, *, id_col: str = "window_id", cfg: Baseline = BASELINE):
    """(model, removed windows): refit without windows beyond the 99.9 % limit, within a budget."""
    budget = int(cfg.phase1_share * df.count())
    model, work, removed = fit_count_model(df, metric, cfg), df, None
    for it in range(cfg.phase1_iter):
        if budget <= 0:
            break
        sub = work.filter(F.col("pair_hours") > 0)
        t = count_terms(F.col(metric).cast("double"), F.col("expected"), F.lit(float(model.alpha)))
        sub = pin(pin(sub, {"expected": expected(sub, model)}), {"_t": t})
        tail = sub.withColumn("p_upper", F.greatest(1 - F.col("_t.cdf") + F.col("_t.pmf"), F.lit(0.0))).drop("_t")
        # at most one percent of the windows, most extreme first
        worst = tail.filter(F.col("p_upper") < 1 - cfg.phase1_q).orderBy("p_upper", id_col).limit(budget).withColumn("phase1_iteration", F.lit(it + 1))
        k = worst.count()
        if k == 0:
            break
        removed = worst if removed is None else removed.unionByName(worst)
        budget -= k
        work = work.join(worst.select(id_col), id_col, "left_anti")
        model = fit_count_model(work, metric, cfg)
    return model, removed


# --------------------------------------------------------------- strata ----

def exposure_terciles(df: DataFrame) -> list:
    row = grouped_quantiles(df.filter(F.col("pair_hours") > 0).select("pair_hours"), ["pair_hours"], [1 / 3, 2 / 3]).first()
    return list((row and row["pair_hours"]) or [0.0, 0.0])


def stratum(terciles, cfg: Baseline = BASELINE) -> Column:
    t = (F.col("pair_hours") >= terciles[0]).cast("int") + (F.col("pair_hours") >= terciles[1]).cast("int")
    return F.concat(F.lit("h"), F.floor(F.col("local_hour") / cfg.strata_hour_h).cast("string"), F.lit("|t"), t.cast("string"), F.lit("|"), F.col("flow"))


def continuous_score(df: DataFrame, reference: DataFrame, value: str, terciles, *, higher_is_worse=True, id_col="window_id",
                     cfg: Baseline = BASELINE) -> DataFrame:
    """Mid-rank position of each window among the reference windows of its stratum.

    Strata with too few references use all of them. Ranks come from running
    counts over (pool, value), in two levels.
    """
    ref = reference.filter(F.col("pair_hours") > 0).select(F.col(value).cast("double").alias("v"), stratum(terciles, cfg).alias("s")).filter("v IS NOT NULL")
    ref = ref.select("v", F.explode(F.array("s", F.lit("*"))).alias("pool"))
    sizes = ref.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    q = df.withColumn("v", F.col(value).cast("double")).withColumn("s", stratum(terciles, cfg)).filter("v IS NOT NULL")
    q = q.join(sizes.select(F.col("pool").alias("s"), F.col("n").alias("_n")), "s", "left")
    q = q.withColumn("pool", F.when(F.coalesce("_n", F.lit(0)) >= cfg.strata_min, F.col("s")).otherwise("*")).select(id_col, "v", "pool")
    counts = ref.groupBy("pool", "v").agg(F.count(F.lit(1)).alias("c")).unionByName(
        q.select("pool", "v").distinct().withColumn("c", F.lit(0).cast("bigint"))).groupBy("pool", "v").agg(F.sum("c").alias("c"))
    run = running_sum(counts.withColumn("_b", F.floor(F.col("v") / 8)), ["pool"], "_b", ["v"], F.col("c"), "upto")
    out = q.join(run.select("pool", "v", "c", "upto"), ["pool", "v"]).join(sizes, "pool")
    frac = (F.col("upto") - F.col("c") + 0.5 * F.col("c") + 0.5) / (F.col("n") + 1)
    worse = F.least(F.greatest(frac if higher_is_worse else 1 - frac, F.lit(1e-6)), F.lit(1 - 1e-6))
    return out.select(id_col, worse.alias("pct"), norm_ppf(worse).alias("z"), (worse > cfg.warning).alias("exceed95"),
                      (worse > cfg.action).alias("exceed99"), F.col("n").alias("ref_n"))


def crosscheck(df: DataFrame, model: CountModel, terciles, cfg: Baseline = BASELINE) -> DataFrame:
    """Empirical 95th percentile against the mean model limit per stratum."""
    d = df.filter(F.col("pair_hours") > 0)
    d = pin(d, {"_mu": expected(d, model)}).withColumn("_lim", count_quantile(cfg.warning, F.col("_mu"), F.lit(float(model.alpha))))
    d = cut_lineage(d.select(stratum(terciles, cfg).alias("stratum"), F.col(model.metric).cast("double").alias("y"), "_lim"))
    limit = grouped_quantiles(d, ["y"], [cfg.warning], ["stratum"]).select("stratum", F.get("y", F.lit(0)).alias("empirical_limit95"))
    out = d.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("_lim").alias("model_limit95_mean")).filter(
        F.col("n_windows") >= cfg.strata_min).join(limit, "stratum")
    diff = F.abs(F.col("empirical_limit95") - F.col("model_limit95_mean"))
    tol = F.greatest(F.lit(1.0), cfg.crosscheck_rel * F.greatest("empirical_limit95", "model_limit95_mean"))
    return out.withColumn("agree", diff <= tol)


def sufficiency(df: DataFrame, metric: str, terciles, cfg: Baseline = BASELINE) -> DataFrame:
    d = df.filter(F.col("pair_hours") > 0)
    out = d.groupBy(stratum(terciles, cfg).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum(metric).alias("n_events"), F.sum("pair_hours").alias("pair_hours"))
    return out.withColumn("flagged", F.col("n_windows") < cfg.strata_min)


# ----------------------------------------------------------- validation ----

def with_folds(df: DataFrame, cfg: Baseline = BASELINE) -> DataFrame:
    """Fold label: month with three months or more, else ISO week, else day."""
    week = iso_week(F.col("t_start"))
    n = df.agg(F.count_distinct("month").alias("m"), F.count_distinct(week).alias("w")).first()  # two numbers
    fold, kind = (F.col("month"), "month") if n["m"] >= cfg.min_months else (week, "week") if n["w"] >= 2 else (F.col("day"), "day")
    return df.withColumns({"fold": fold, "fold_kind": F.lit(kind)})


def score_by_fold(train: DataFrame, test: DataFrame, metric: str, *, seed=0, id_col="window_id", cfg: Baseline = BASELINE) -> DataFrame:
    """Every test window scored by the model that did not see its fold (a dozen folds at most)."""
    folds = sorted(r["fold"] for r in test.select("fold").distinct().collect())
    out = None
    for f in folds:
        model = fit_count_model(train.filter(F.col("fold") != f), metric, cfg)
        one = score(test.filter(F.col("fold") == f), model, seed=seed, id_col=id_col, cfg=cfg)
        out = one if out is None else out.unionByName(one)
    return out


def out_of_sample(scored: DataFrame, metric: str, cfg: Baseline = BASELINE) -> DataFrame:
    """Held-out exceedance rates with intervals, pass flags and uniformity of the PIT."""
    ok = scored.filter(F.col(f"{metric}_z").isNotNull()).withColumn("k", F.lit(1))
    out = ok.groupBy("k").agg(
        F.count_distinct("fold").alias("n_folds"), F.count(F.lit(1)).alias("n"),
        F.count_if(f"{metric}_exceed95").alias("k95"), F.count_if(f"{metric}_exceed99").alias("k99"))
    for s, band in (("95", cfg.pass95), ("99", cfg.pass99)):
        lo, hi = wilson(F.col(f"k{s}"), F.col("n"))
        rate = F.col(f"k{s}") / F.col("n")
        out = out.withColumns({f"exceed{s}_rate": rate, f"exceed{s}_lo": lo, f"exceed{s}_hi": hi, f"pass{s}": rate.between(*band)})
    ks = ks_uniform(ok, f"{metric}_pit", ("k",)).select("k", F.col("p_value").alias("pit_ks_p"))
    return out.join(ks, "k").drop("k", "k95", "k99")


def stability(df: DataFrame, metric: str, *, seed=0, cfg: Baseline = BASELINE) -> DataFrame:
    """Pooled rate on growing random subsets of days and the first stable size.

    Days are ranked by hash in every replicate; one grouped sum per
    (fraction, replicate) serves all subsets.
    """
    from ..functions.dist import hash_int

    per = df.filter(F.col("pair_hours") > 0).groupBy("day").agg(F.sum(metric).alias("y"), F.sum("pair_hours").alias("e"))
    reps = per.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(cfg.stability_reps - 1))))
    reps = reps.withColumn("_h", hash_int(seed, F.col("rep"), F.col("day")))
    w = W.partitionBy("rep")
    reps = reps.withColumns({"_r": F.row_number().over(w.orderBy("_h", "day")), "_n": F.count(F.lit(1)).over(w)})
    fr = F.explode(F.array(*[F.lit(f) for f in cfg.stability_fractions]))
    rows = reps.withColumn("fraction", fr).withColumn("n_days", F.greatest(F.lit(2), F.bround(F.col("fraction") * F.col("_n")).cast("int")))
    one = rows.filter(F.col("_r") <= F.col("n_days")).groupBy("fraction", "n_days", "rep").agg((F.sum("y") / F.sum("e")).alias("rate"))
    out = one.groupBy("fraction", "n_days").agg(
        F.avg("rate").alias("rate_mean"), F.percentile("rate", F.lit(0.025)).alias("rate_lo"), F.percentile("rate", F.lit(0.975)).alias("rate_hi"))
    all_ = W.partitionBy(F.lit(0))  # ten rows
    full = F.max(F.when(F.col("fraction") == 1.0, F.col("rate_mean"))).over(all_)
    out = out.withColumn("within", F.abs(F.col("rate_mean") - full) <= cfg.plateau_tol * full)
    later = F.min(F.col("within").cast("int")).over(all_.orderBy(F.desc("fraction")).rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("stable_from_here", later == 1)


def baseline_warnings(*, n_days: int, out_of_sample: DataFrame | None, crosscheck: DataFrame | None, stability: DataFrame | None,
                      sufficiency: DataFrame | None, cfg: Baseline = BASELINE) -> list[str]:
    """What speaks against trusting a baseline, one sentence each; every table has a few rows.

    Checked are the days behind it, both exceedance rates, strata that disagree with the model, a stable size of the
    day sample, and strata with too few windows.
    """
    said = []
    if n_days < cfg.min_days:
        said.append(f"{n_days} days are fewer than {cfg.min_days}")
    if out_of_sample is not None:
        row = out_of_sample.first()
        said += [f"the {s} % exceedance rate is outside its band" for s in ("95", "99") if row is not None and not row[f"pass{s}"]]
    if crosscheck is not None:
        share = crosscheck.agg(F.avg((~F.col("agree")).cast("double"))).first()[0]
        if share is not None and share > cfg.max_disagreeing:
            said.append(f"{100 * share:.0f} % of the strata disagree with the model")
    if stability is not None and not stability.filter(F.col("stable_from_here") & (F.col("fraction") < 1)).count():
        said.append("the rate has not settled with the number of days")
    if sufficiency is not None:
        thin = sufficiency.filter("flagged").count()
        if thin:
            said.append(f"{thin} strata have too few windows")
    return said


def verdict(has_model: bool, out_of_sample: DataFrame | None, warnings: list[str]) -> str:
    """NOT VALID without a model or if both exceedance rates are outside their bands, else by the warnings."""
    row = out_of_sample.first() if out_of_sample is not None else None
    if not has_model or (row is not None and not row["pass95"] and not row["pass99"]):
        return "NOT VALID"
    return "VALID WITH WARNINGS" if warnings else "VALID"


def multipliers(spark, model: CountModel) -> DataFrame:
    """Rate multiplier of each model condition; log traffic as the effect of doubling."""
    rows = [(k, float(v)) for k, v in model.coef.items()] or [("intercept", 0.0)]
    return spark.createDataFrame(rows, "term string, coef double").withColumn(
        "multiplier", F.when(F.col("term") == "log_n", F.pow(F.lit(2.0), "coef")).otherwise(F.exp("coef")))


def build_baseline(windows: DataFrame, metrics, *, seed=0, primary: str = "T1_any", validate: bool = True, cfg: Baseline = BASELINE) -> dict:
    """Models, removed windows and validation tables for every metric, the warnings and the verdict."""
    out = {"models": {}, "removed": {}, "tables": {}}
    terciles = exposure_terciles(windows)
    for m in metrics:
        model, removed = phase1(windows, m, cfg=cfg)
        out["models"][m], out["removed"][m] = model, removed
        if model.kind != "pooled":
            out["tables"][f"crosscheck_{m}"] = crosscheck(windows, model, terciles, cfg)
    oos = None
    if validate and primary in out["models"] and out["models"][primary].kind != "pooled":
        folded = with_folds(windows.filter(F.col("pair_hours") > 0), cfg)
        oos = out["tables"]["out_of_sample"] = out_of_sample(score_by_fold(folded, folded, primary, seed=seed, cfg=cfg), primary, cfg)
    out["tables"]["sufficiency"] = sufficiency(windows, primary, terciles, cfg)
    out["tables"]["stability"] = stability(windows, primary, seed=seed, cfg=cfg)
    out["warnings"] = baseline_warnings(
        n_days=windows.select("day").distinct().count(), out_of_sample=oos, crosscheck=out["tables"].get(f"crosscheck_{primary}"),
        stability=out["tables"]["stability"] if validate and primary in out["models"] else None, sufficiency=out["tables"]["sufficiency"], cfg=cfg)
    out["verdict"] = verdict(primary in out["models"], oos, out["warnings"])
    return out
