"""Before/after statistics of events against the baseline."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dist import norm_cdf, wilson
from ..functions.plan import cut_lineage
from ..settings import BASELINE, DAY_S, WINDOWS, Baseline, Windows
from .bootstrap import day_counts, holm, ks_uniform, ratio_bootstrap, signed_rank
from .quantiles import grouped_quantiles

SUFFIXES = ("expected", "oe", "z", "zmid", "p_upper", "exceed95", "exceed99", "pct")
STATE = ("n_aircraft", "pair_hours", "quality", "flow", "local_hour", "partial_coverage")


def risk_table(scored: DataFrame, events: DataFrame, metrics) -> DataFrame:
    """Pre and post rows of each event on one row, with differences and exclusion.

    An event without a pre or post row counts as partially covered.
    """
    names = [c for c in STATE if c in scored.columns]
    for m in metrics:
        names += [c for c in (m, *[f"{m}_{s}" for s in SUFFIXES]) if c in scored.columns]
    per = scored.groupBy("event_id").agg(*[
        F.max(F.when(F.col("window") == w, F.col(c))).alias(f"{w}_{c}") for w in ("pre", "post") for c in names])
    out = events.join(per, "event_id", "left")
    extra = {}
    for m in metrics:
        if m in names:
            extra[f"diff_{m}"] = F.col(f"post_{m}") - F.col(f"pre_{m}")
        if f"{m}_z" in names:
            extra[f"diff_{m}_z"] = F.col(f"post_{m}_z") - F.col(f"pre_{m}_z")
        if f"{m}_exceed95" in names:
            extra |= {f"{w}_{m}_in_control": ~F.col(f"{w}_{m}_exceed95") for w in ("pre", "post")}
    bad = F.coalesce(F.col("pre_quality") == "bad", F.lit(False)) | F.coalesce(F.col("post_quality") == "bad", F.lit(False))
    part = F.coalesce("pre_partial_coverage", F.lit(True)) | F.coalesce("post_partial_coverage", F.lit(True))
    return out.withColumns({**extra, "window_bad": bad, "excluded": bad | part})


def event_sets(risk: DataFrame, metric: str = "T1_any", types=("go_around", "touch_and_go")) -> DataFrame:
    """One row per event and set it belongs to: all, in_control_pre, <type>_only."""
    sets = F.array_compact(F.array(
        F.lit("all"), F.when(F.coalesce(F.col(f"pre_{metric}_in_control"), F.lit(False)), "in_control_pre"),
        *[F.when(F.col("outcome") == t, f"{t}_only") for t in types]))
    return risk.withColumn("event_set", F.explode(sets))


# ------------------------------------------------------------ rate ratio ----

#: Replicates times groups whose rate ratios take their steps together.
CELLS = 2_000_000
_WIDE = 512


def _likelihood(rows: DataFrame, theta: np.ndarray, days: list[int], reps: int, seed) -> np.ndarray:
    """Sums over events for every (group, replicate): with counts of days as weights, the score and information at theta.

    A task weights its own events with the day counts of all replicates and sends one row per group and replicate, whatever its number of events.
    """

    def add(batches):
        total = np.zeros((len(days), reps + 1, 6))
        for batch in batches:
            g, i, a, b, e1, e2, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_i", "_a", "_b", "_e1", "_e2", "_x"))
            for k in np.unique(g):
                mine = np.flatnonzero(g == k)
                drawn = day_counts(seed, 0, reps, days[k]) if days[k] >= 2 and reps else np.zeros((reps, days[k]))
                for at in np.array_split(mine, -(-len(mine) // _WIDE)):
                    m = np.vstack((drawn[:, i[at]], np.ones((1, len(at)))))  # the point value comes last
                    odds = np.exp(theta[k])[:, None] * x[at]
                    q, n = odds / (1 + odds), a[at] + b[at]
                    total[k, :, 0] += (m * (b[at] - n * q)).sum(axis=1)
                    total[k, :, 1] += (m * n * q * (1 - q)).sum(axis=1)
                    total[k, :, 2:] += m @ np.column_stack((a[at], b[at], e1[at], e2[at]))
        k, r = (v.ravel() for v in np.indices(total.shape[:2]))
        some = total[k, r, 4] > 0
        yield pa.RecordBatch.from_arrays([pa.array(k[some].astype(np.int32)), pa.array(r[some].astype(np.int32)), *[pa.array(total[k[some], r[some], c]) for c in range(6)]],
                                         names=["g", "r", *"uvwxyz"])

    out = np.zeros((len(days), reps + 1, 6))
    for row in rows.mapInArrow(add, "g int, r int, u double, v double, w double, x double, y double, z double").groupBy("g", "r").agg(*[F.sum(c).alias(c) for c in "uvwxyz"]).collect():
        out[row["g"], row["r"]] = row[2:]  # CELLS rows at most
    return out


def irr(df: DataFrame, *, reps: int, seed, group=(), rounds: int = 6, day: str = "day",
        cols=("pre", "post", "e_pre", "e_post")) -> DataFrame:
    """Post/pre rate ratio by conditional likelihood, with a day-cluster interval.

    Given an event's total, its post count is binomial with odds
    theta * e_post / e_pre. Every replicate, and the point value, has its own
    theta; all thetas take Newton steps together, one job per step. Events stay
    where they are: a task weights its own with the day counts of all
    replicates and sends the sums. Groups are taken in batches of ``CELLS``
    thetas. ``irr_converged`` tells whether the point value's last step was
    below 1e-6; values of larger last steps are null.
    """
    group = list(group)
    spark = df.sparkSession
    pre, post, e1, e2 = (F.col(c).cast("double") for c in cols)
    ok = df.filter(pre.isNotNull() & post.isNotNull() & (e1 > 0) & (e2 > 0) & (pre + post > 0))
    ok = ok.select(*group, F.col(day).alias("_day"), pre.alias("_a"), post.alias("_b"), e1.alias("_e1"), e2.alias("_e2"))
    # equal exposure ratios on one day enter the likelihood only through their totals
    ok = cut_lineage(ok.groupBy(*group, "_day", (F.col("_e2") / F.col("_e1")).alias("_x")).agg(
        *[F.sum(c).alias(c) for c in ("_a", "_b", "_e1", "_e2")]))
    key = [F.col(c) for c in group] or [F.lit(0)]
    days = ok.select(*group, "_day").distinct().withColumn("_i", F.row_number().over(W.partitionBy(*key).orderBy("_day")) - 1)
    placed = ok.join(days, [*group, "_day"])
    listed = days.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    batches = max(1, -(-listed.count() * (reps + 1) // CELLS))
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = "".join(f"`{c}` {kind[c]}, " for c in group)
    results = []
    for b in range(batches):
        here = (F.pmod(F.xxhash64(*key), F.lit(batches)) == b) if batches > 1 else F.lit(True)
        groups = listed.filter(here).collect()  # CELLS thetas at most, on average
        names = spark.createDataFrame([(*r[:-1], k) for k, r in enumerate(groups)], f"{columns}_g int")
        rows = (placed.join(F.broadcast(names), group) if group else placed.withColumn("_g", F.lit(0))).select("_g", "_i", "_a", "_b", "_e1", "_e2", "_x")
        rows = cut_lineage(rows)
        sizes = [r["_n"] for r in groups]
        theta = np.zeros((len(groups), reps + 1))
        last = np.zeros_like(theta)
        sums = _likelihood(rows, theta, sizes, reps, seed)
        a, b_, x1, x2 = (sums[..., c] for c in (2, 3, 4, 5))
        fit = (a > 0) & (b_ > 0)
        theta[fit] = np.log(b_[fit] * x1[fit] / (a[fit] * x2[fit]))
        for _ in range(rounds if fit.any() else 0):
            sums = _likelihood(rows, theta, sizes, reps, seed)
            with np.errstate(divide="ignore", invalid="ignore"):
                last = np.where(fit, np.clip(sums[..., 0] / sums[..., 1], -2.0, 2.0), 0.0)
            theta = np.where(fit & np.isfinite(last), theta + last, theta)
        value = np.where(b_ == 0, 0.0, np.where(a == 0, np.inf, np.where(np.abs(last) < 1e-6, np.exp(theta), np.nan)))
        value[x1 <= 0] = np.nan  # no day was drawn: fewer than two days
        for k, r in enumerate(groups):
            point, boot = value[k, -1], value[k, :-1][np.isfinite(value[k, :-1])]
            lo, hi = np.quantile(boot, (0.025, 0.975)).tolist() if len(boot) and np.isfinite(point) else (None, None)
            results.append((*r[:-1], None if np.isnan(point) else float(point), bool(not np.isnan(point)), lo, hi))
    if not group and not results:
        results = [(None, None, None, None)]
    return spark.createDataFrame(results, f"{columns}irr double, irr_converged boolean, irr_lo double, irr_hi double")


def long_metrics(risk: DataFrame, metrics, keep=("event_id", "day")) -> DataFrame:
    """Usable events, one row per (event, endpoint)."""
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("endpoint"), *[F.col(f"{w}_{m}").cast("double").alias(w) for w in ("pre", "post")],
            *[F.col(f"{w}_{m}_{s}").cast("double").alias(f"{w}_{s}") for w in ("pre", "post") for s in ("expected", "z")],
        ) for m in metrics])
    return risk.filter(~F.col("excluded")).select(
        *keep, F.col("pre_pair_hours").alias("e_pre"), F.col("post_pair_hours").alias("e_post"), F.explode(rows).alias("_m")
    ).select(*keep, "e_pre", "e_post", "_m.*")


def continuous_results(risk: DataFrame, metrics, group) -> DataFrame:
    """Medians and rank tests of continuous endpoints, one row per (group, endpoint); a metric without scores has no tests against the baseline."""
    score = lambda w, m: (F.col(f"{w}_{m}_z") if f"{w}_{m}_z" in risk.columns else F.lit(None)).cast("double").alias(f"{w}_z")
    rows = F.array(*[F.struct(F.lit(m).alias("endpoint"), *[F.col(f"{w}_{m}").cast("double").alias(w) for w in ("pre", "post")], *[score(w, m) for w in ("pre", "post")]) for m in metrics])
    key = [*group, "endpoint"]
    long = cut_lineage(risk.filter(~F.col("excluded")).select(*group, F.explode(rows).alias("_m")).select(*group, "_m.*"))
    half = grouped_quantiles(long, ["pre", "post"], [0.5], key).select(*key, *[F.get(w, F.lit(0)).alias(f"median_{w}") for w in ("pre", "post")])
    out = long.groupBy(*key).agg(F.count(F.lit(1)).alias("n_events")).join(half, key)
    for name, value in (("paired", F.col("post") - F.col("pre")), ("pre", F.col("pre_z")), ("post", F.col("post_z"))):
        out = out.join(signed_rank(long.withColumn("_d", value), "_d", key).select(*key, F.col("p_value").alias(f"wilcoxon_{name}_p")), key, "left")
    return out.withColumn("kind", F.lit("continuous"))


def primary_results(risk: DataFrame, metrics, *, reps: int, seed, group=("event_set",), primary: str = "T1_any",
                    alphas: DataFrame | None = None, continuous=(), cfg: Baseline = BASELINE) -> DataFrame:
    """All endpoints of all event sets: counts in one grouped pass, continuous ones in another, as rows of one table.

    Rate ratio, standardised ratios before and after, rank tests, detectable
    effects; medians of continuous endpoints; the Holm correction runs over the
    secondary endpoints of both kinds.
    """
    key = [*group, "endpoint"]
    rows = cut_lineage(long_metrics(risk, metrics, ("event_id", "day", *group)))
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"), *[F.sum(c).alias(f"sum_{c}") for c in ("pre", "post")],
        F.sum("e_pre").alias("exposure_pre_h"), F.sum("e_post").alias("exposure_post_h"),
        F.sum("pre_expected").alias("sum_expected_pre"), F.sum("post_expected").alias("sum_expected_post"))
    out = out.join(irr(rows, reps=reps, seed=seed, group=key), key, "left")
    for w in ("pre", "post"):
        out = out.join(ratio_bootstrap(rows, w, f"{w}_expected", reps=reps, seed=seed, group=key, name=f"sir_{w}"), key, "left")
        t = signed_rank(rows, f"{w}_z", key).select(*key, F.col("p_value").alias(f"wilcoxon_{w}_p"))
        out = out.join(t, key, "left")
    paired = signed_rank(rows.withColumn("dz", F.col("post_z") - F.col("pre_z")), "dz", key)
    out = out.join(paired.select(*key, F.col("p_value").alias("wilcoxon_paired_p")), key, "left")
    if alphas is not None:
        out = out.join(alphas.select("endpoint", "alpha"), "endpoint", "left")
    alpha = F.coalesce("alpha", F.lit(0.0)) if alphas is not None else F.lit(0.0)
    d_irr, d_sir = minimum_detectable(F.col("sum_pre"), F.col("sum_expected_post"), F.col("n_events"), alpha, cfg)
    out = out.withColumns({"mde_irr": d_irr, "mde_sir": d_sir, "kind": F.lit("count")})
    if continuous:
        out = out.unionByName(continuous_results(risk, list(continuous), list(group)), allowMissingColumns=True)
    out = out.withColumn("primary", F.col("endpoint") == primary)
    for c in ("wilcoxon_paired_p", "wilcoxon_post_p"):
        out = holm(out, c, f"{c}_holm", [*group, "primary"])
        out = out.withColumn(f"{c}_holm", F.when(~F.col("primary"), F.col(f"{c}_holm")))
    return out


def minimum_detectable(sum_pre: Column, sum_expected: Column, n: Column, alpha: Column, cfg: Baseline = BASELINE):
    """Smallest rate ratio and standardised ratio found with the target power."""
    nd = NormalDist()
    z = nd.inv_cdf(1 - cfg.power_alpha / 2) + nd.inv_cdf(cfg.power_target)
    ok = (n > 0) & (sum_pre > 0) & (sum_expected > 0)
    extra = alpha / n
    return (
        F.when(ok, F.exp(z * F.sqrt(2.0 / sum_pre + 2 * extra))),
        F.when(ok, F.exp(z * F.sqrt(1.0 / sum_expected + extra))),
    )


def equilibrium(risk: DataFrame, metric: str = "T1_any", *, reps: int, seed, cfg: Baseline = BASELINE) -> DataFrame:
    """Are the before-windows inside the baseline? One row with three checks and a verdict."""
    r = risk.filter(~F.col("excluded")).withColumns({"z": F.col(f"pre_{metric}_z"), "k": F.lit(1)})
    known = r.filter(F.col("z").isNotNull())
    # one row without usable events too; a share of none of them is NaN
    base = known.agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col(f"pre_{metric}_in_control")).alias("in_control"),
        F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_sd")).withColumn("k", F.lit(1))
    shares = (F.try_divide("in_control", "n_events"), *wilson(F.col("in_control"), F.col("n_events")))
    base = base.withColumns({f"in_control_{e}": F.coalesce(c, F.lit(float("nan"))) for e, c in zip(("share", "lo", "hi"), shares)})
    sir = ratio_bootstrap(r, f"pre_{metric}", f"pre_{metric}_expected", reps=reps, seed=seed, group=("k",), name="sir_pre")
    ks = ks_uniform(known.withColumn("u", norm_cdf(F.col("z"))), "u", ("k",)).select("k", F.col("p_value").alias("ks_p"), F.col("d").alias("ks_d"))
    out = base.join(sir, "k", "left").join(ks, "k", "left").drop("k")
    ok = (
        F.coalesce((F.col("sir_pre_lo") <= 1) & (F.col("sir_pre_hi") >= 1), F.lit(True))
        & F.coalesce(F.col("ks_p") >= 0.05, F.lit(True)) & F.coalesce(F.col("in_control_hi") >= cfg.warning, F.lit(True))
    )
    return out.withColumn("verdict", F.when(F.col("n_events") == 0, "NOT ASSESSED").when(ok, "PASS").otherwise("FAIL"))


def continuous_endpoint(risk: DataFrame, metric: str) -> DataFrame:
    """Medians before and after, paired and one-sample rank tests."""
    r = risk.filter(~F.col("excluded")).withColumns({
        "k": F.lit(1), "p": F.col(f"pre_{metric}"), "q": F.col(f"post_{metric}")}).withColumn("d", F.col("q") - F.col("p"))
    half = grouped_quantiles(r, ["p", "q"], [0.5], ["k"]).select("k", F.get("p", F.lit(0)).alias("median_pre"), F.get("q", F.lit(0)).alias("median_post"))
    # one row without usable events too
    out = r.agg(F.count(F.lit(1)).alias("n_events"), *[F.avg(f"{w}_{metric}_z").alias(f"z_mean_{w}") for w in ("pre", "post")]).withColumn("k", F.lit(1)).join(half, "k", "left")
    for name, col in (("paired", "d"), ("pre", f"pre_{metric}_z"), ("post", f"post_{metric}_z")):
        t = signed_rank(r, col, ("k",)).select("k", F.col("p_value").alias(f"wilcoxon_{name}_p"))
        out = out.join(t, "k", "left")
    return out.drop("k")


def epoch_sums(points: DataFrame, events: DataFrame, values, cfg: Windows = WINDOWS, block_s: int = DAY_S) -> DataFrame:
    """Rows (day, minute, n, values): what the minutes around the events of a day hold together, n being the number of those events.

    ``points`` has one row per second with integer values, ``events`` has day and t0. Events of one second share their minutes, and a minute
    begins where the one before ends: a second is looked up once per edge in the running sums, not twice per event and minute.
    """
    values = list(values)
    edge = F.explode(F.sequence(F.lit(-cfg.epoch_half_min), F.lit(cfg.epoch_half_min)))
    # a few bytes a second become an edge a minute, so the number of tasks must not follow the bytes
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = events.select("day", "t0").repartition(parts, "day", "t0").groupBy("day", "t0").agg(F.count(F.lit(1)).alias("n")).select("day", "n", "t0", edge.alias("minute"))
    asked = shared.select("day", "n", "minute", (F.col("t0") + F.col("minute") * cfg.epoch_step_s).alias("_t"))
    marks = asked.select("_t").distinct().select("_t", F.lit(0).alias("_k"), *[F.lit(0).cast("bigint").alias(v) for v in values])
    both = marks.unionByName(points.select(F.col("t").alias("_t"), F.lit(1).alias("_k"), *[F.col(v).cast("bigint").alias(v) for v in values])).withColumn("_blk", F.floor(F.col("_t") / block_s))
    carry = both.groupBy("_blk").agg(*[F.sum(v).alias(v) for v in values]).select("_blk", *[
        F.coalesce(F.sum(v).over(W.partitionBy(F.lit(0)).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_c_{v}") for v in values])  # one row per block
    order = W.partitionBy("_blk").orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, 0)
    upto = both.select("_blk", "_t", "_k", *[F.sum(v).over(order).alias(v) for v in values]).filter("_k = 0").join(F.broadcast(carry), "_blk")
    upto = upto.select("_t", *[(F.col(v) + F.col(f"_c_{v}")).alias(v) for v in values])
    at = asked.join(upto, "_t").groupBy("day", "minute").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(v)).alias(v) for v in values])
    # an edge ends the minute before it and begins its own
    sides = F.array(F.struct(F.col("minute").alias("m"), F.lit(-1).alias("sign")), F.struct((F.col("minute") - 1).alias("m"), F.lit(1).alias("sign")))
    both = at.withColumn("_s", F.explode(sides)).filter(F.col("_s.m").between(-cfg.epoch_half_min, cfg.epoch_half_min - 1))
    return both.groupBy("day", F.col("_s.m").alias("minute")).agg(F.max("n").alias("n"), *[F.sum(F.col("_s.sign") * F.col(v)).alias(v) for v in values])


def epoch_curve(per: DataFrame, *, reps: int, seed) -> DataFrame:
    """Observed over expected per minute around the events, pooled, with day bands.

    ``per`` has one row per minute and day with the sums a (observed) and b (expected); every day takes part in every minute's resample.
    """
    from .bootstrap import day_bootstrap, safe_ratio

    band = day_bootstrap(per, ["a", "b"], {"oe": lambda s: safe_ratio(s["a"], s["b"])}, reps=reps, seed=seed, group=["minute"])
    tot = per.groupBy("minute").agg(F.sum("a").alias("observed"), F.sum("b").alias("expected"))
    return tot.join(band, "minute")


def involvement(windows: DataFrame, involved: DataFrame, risk: DataFrame, tiers=("T1", "T2"), *, reps: int, seed) -> DataFrame:
    """Encounters of the event aircraft against those of an average other aircraft.

    ``windows`` and ``involved`` have one row per (event_id, window); the first
    with the airspace counts, the second with the event aircraft's own.
    """
    keep = risk.filter(~F.col("excluded")).select("event_id")
    own = involved.select("event_id", "window", "own_present_s", *[F.col(f"{t}_any").alias(f"own_{t}") for t in tiers])
    j = windows.join(keep, "event_id", "left_semi").join(own, ["event_id", "window"])
    rows = j.select("event_id", "window", "day", "aircraft_s", "own_present_s", "t_start", "t_end", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tier"), F.col(f"{t}_any").cast("double").alias("tot"), F.col(f"own_{t}").cast("double").alias("own")) for t in tiers
    ])).alias("_t")).select("*", "_t.*").drop("_t")
    rest = F.col("aircraft_s") - F.col("own_present_s")
    rate = F.when(rest > 0, (2 * F.col("tot") - F.col("own")) / rest).otherwise(0.0)
    rows = rows.withColumn("exp", F.col("own_present_s") * rate)
    key = ["tier", "window"]
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("own").alias("observed"), F.sum("exp").alias("expected"),
        (F.sum("own_present_s") / F.greatest(F.sum(F.col("t_end") - F.col("t_start")), F.lit(1))).alias("share_of_window_in_area"))
    return out.join(ratio_bootstrap(rows, "own", "exp", reps=reps, seed=seed, group=key), key)
