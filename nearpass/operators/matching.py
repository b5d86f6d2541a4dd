"""Events compared with ordinary landings of the same strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.dist import hash_int, norm_cdf, wilson
from ..functions.plan import cut_lineage
from ..functions.timefns import day_text, local_hour
from .bootstrap import day_bootstrap, safe_ratio, signed_rank
from .intervals import interval_sums
from .quantiles import grouped_quantiles
from .scan import number_rows, running_sum

MEASURES = {
    "aircraft_time": "aircraft_s", "pair_time": "pair_hours", "T1_any": "T1_any", "T2_any": "T2_any", "T3_any": "T3_any",
}
MIN_ENCOUNTERS = 10
EXTRA = ("T1_any_expected", "T1_any_z", "T1_any_zmid", "T1_any_in_control", "T1_any_exceed95")


def paired_windows(win: DataFrame, events: DataFrame, cols, windows=("pre", "post"), tz: str = "UTC") -> DataFrame:
    """One row per event with <window>_<col>, exclusion flags, day, hour and flow.

    A missing window counts as bad; ``day`` is the UTC day on which the before-window starts.
    """
    w = F.col("window")
    agg = []
    for n in windows:
        names = list(cols) + ([c for c in EXTRA if c in win.columns] if n == "pre" else [])
        agg += [F.max(F.when(w == n, F.col(c))).alias(f"{n}_{c}") for c in names]
        agg.append(F.max(F.when(w == n, (F.col("quality") == "bad") | F.coalesce("partial_coverage", F.lit(True)))).alias(f"{n}_bad"))
    agg.append(F.max(F.when(w == "pre", F.col("flow"))).alias("flow"))
    per = win.groupBy("event_id").agg(*agg)
    keep = [c for c in ("callsign", "runway", "icao24", "outcome", "cluster_size", "pre_contaminated") if c in events.columns]
    out = events.select("event_id", "t0", "t_pre_start", *keep).join(per, "event_id", "left")
    out = out.withColumns({f"{n}_bad": F.coalesce(f"{n}_bad", F.lit(True)) for n in windows})
    out = out.withColumns({
        "excluded": F.col("pre_bad") | F.col("post_bad"), "hour": local_hour(F.col("t0"), tz), "day": day_text(F.col("t_pre_start")),
    })
    return out if "early" in windows else out.withColumn("early_bad", F.lit(True))


def add_traffic_band(g: DataFrame, c: DataFrame):
    """(events, controls) with the tercile band of the controls' before-window traffic."""
    used = cut_lineage(c.filter(~F.col("excluded")).select("pre_pair_hours"))
    cuts = grouped_quantiles(used, ["pre_pair_hours"], [1 / 3, 2 / 3]).first()
    v = F.col("pre_pair_hours")
    if not cuts or (cuts["n_pre_pair_hours"] or 0) < 3:
        band = F.lit("all")
    else:
        low, high = cuts["pre_pair_hours"]
        band = F.when(v <= low, "low").when(v <= high, "mid").otherwise("high")
    return g.withColumn("pre_traffic_band", band), c.withColumn("pre_traffic_band", band)


def match_weights(g: DataFrame, c: DataFrame, keys=("hour",)):
    """(events whose stratum has controls, controls with weight n_g / n_c)."""
    keys = list(keys)
    ng = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ng"))
    nc = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nc"))
    kept = g.join(nc.select(*keys), keys, "left_semi")
    weights = nc.join(ng, keys, "left").select(*keys, (F.coalesce("_ng", F.lit(0)) / F.col("_nc")).alias("w"))
    return kept, c.join(weights, keys)


def usable(df: DataFrame, frm: str = "pre", to: str = "post") -> DataFrame:
    return df.filter(~F.col(f"{frm}_bad") & ~F.col(f"{to}_bad"))


def _long(df, measures, frm, to, weight, group):
    rows = F.array(*[
        F.struct(F.lit(k).alias("measure"), F.col(f"{frm}_{c}").cast("double").alias("v0"), F.col(f"{to}_{c}").cast("double").alias("v1"))
        for k, c in measures.items()])
    return df.select(*group, "event_id", "day", weight.alias("w"), F.explode(rows).alias("_m")).select(*group, "event_id", "day", "w", "_m.*")


RATIOS = {
    "ratio": lambda s: safe_ratio(s["ga"], s["gp"]),
    "normal_ratio": lambda s: safe_ratio(s["ca"], s["cp"]),
    "vs_normal": lambda s: safe_ratio(safe_ratio(s["ga"], s["gp"]), safe_ratio(s["ca"], s["cp"])),
}


def change_summary(g: DataFrame, c: DataFrame, *, reps: int, seed, keys=("hour",), frm="pre", to="post", measures=None, group=()) -> DataFrame:
    """Change around events, the same around weighted controls, and the ratio of the two.

    All measures in one pass; the three ratios of a measure share the same day resamples. With ``group`` the rows of both
    frames belong to analyses of their own (columns of both), which are matched, resampled and tested side by side.
    """
    measures, group = MEASURES if measures is None else measures, list(group)
    keys, row = [*group, *keys], [*group, "measure"]
    g0, c0 = usable(g, frm, to), usable(c, frm, to)
    kept, weighted = match_weights(g0, c0, keys)
    weighted = weighted.filter("w > 0")
    gl = _long(kept, measures, frm, to, F.lit(1.0), group).withColumn("is_g", F.lit(True))
    cl = _long(weighted, measures, frm, to, F.col("w"), group).withColumn("is_g", F.lit(False))
    both = gl.unionByName(cl)
    is_g, v0, v1 = F.col("is_g"), F.coalesce("v0", F.lit(0.0)), F.coalesce("v1", F.lit(0.0))
    per_day = both.groupBy(*row, "day").agg(
        F.sum(F.when(is_g, v0).otherwise(0.0)).alias("gp"), F.sum(F.when(is_g, v1).otherwise(0.0)).alias("ga"),
        F.sum(F.when(~is_g, v0 * F.col("w")).otherwise(0.0)).alias("cp"), F.sum(F.when(~is_g, v1 * F.col("w")).otherwise(0.0)).alias("ca"))
    ci = day_bootstrap(per_day, ["gp", "ga", "cp", "ca"], RATIOS, reps=reps, seed=seed, group=row)
    wsum = F.sum(F.when(~is_g, F.col("w")))
    out = both.groupBy(*row).agg(
        F.count_if(is_g).alias("n_events"), F.count_if(~is_g).alias("n_controls"),
        F.sum(F.when(is_g, F.col("v0"))).alias("before_total"), F.sum(F.when(is_g, F.col("v1"))).alias("after_total"),
        F.avg(F.when(is_g, F.col("v0"))).alias("ga_mean_before"), F.avg(F.when(is_g, F.col("v1"))).alias("ga_mean_after"),
        (F.sum(F.when(~is_g, F.col("v0") * F.col("w"))) / wsum).alias("normal_mean_before"),
        (F.sum(F.when(~is_g, F.col("v1") * F.col("w"))) / wsum).alias("normal_mean_after"))
    lost = g0.join(c0.select(*keys).distinct(), keys, "left_anti").groupBy(*group).agg(F.count(F.lit(1)).alias("n_unmatched"))
    test = signed_rank(gl.withColumn("d", F.col("v1") - F.col("v0")), "d", row).select(*row, F.col("p_value").alias("paired_p"))
    few = F.col("measure").endswith("_any") & (F.col("before_total") + F.col("after_total") < MIN_ENCOUNTERS)
    done = out.join(ci, row).join(test, row, "left")
    done = done.join(lost, group, "left") if group else done.crossJoin(F.broadcast(lost))  # one row
    return done.withColumn("n_unmatched", F.coalesce("n_unmatched", F.lit(0).cast("bigint"))).withColumn("too_few", few)


def placebo(g: DataFrame, c: DataFrame, col: str, *, n_sets: int, seed, keys=("hour",)) -> DataFrame:
    """Event ratio against sets of random controls, one per event and set from its stratum.

    Controls are numbered inside their stratum (two-level, so a stratum may be
    large); event x set rows draw a number by hash and meet it in one equality join.
    """
    keys = list(keys)
    g, c = usable(g), usable(c)
    kept, _ = match_weights(g, c, keys)
    nc = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nc"))
    pool = number_rows(c.withColumn("_b", F.pmod(F.xxhash64("event_id"), F.lit(64))), keys, "_b", ["event_id"], "_k").select(
        *keys, "_k", F.coalesce(f"pre_{col}", F.lit(0)).alias("p0"), F.coalesce(f"post_{col}", F.lit(0)).alias("p1"))
    sets = kept.join(nc, keys).select("event_id", *keys, "_nc", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))).alias("set"))
    sets = sets.withColumn("_k", hash_int(seed, F.col("event_id"), F.col("set")) % F.col("_nc") + 1)
    ratio = sets.join(pool, [*keys, "_k"]).groupBy("set").agg(safe_ratio(F.sum("p1"), F.sum("p0")).alias("r")).filter(F.col("r").isNotNull())
    real = kept.agg(F.count(F.lit(1)).alias("n_events"), safe_ratio(F.sum(f"post_{col}"), F.sum(f"pre_{col}")).alias("ga_ratio"))
    row = real.first()  # two numbers
    ge = F.count_if(F.col("r") >= (row["ga_ratio"] if row["ga_ratio"] is not None else float("nan")))
    out = ratio.agg(
        F.count(F.lit(1)).alias("n_sets"), F.percentile("r", F.lit(0.5)).alias("placebo_median"), F.percentile("r", F.lit(0.025)).alias("placebo_lo"),
        F.percentile("r", F.lit(0.975)).alias("placebo_hi"), ge.alias("_ge"))
    return out.select(
        F.lit(col).alias("measure"), F.lit(row["n_events"]).alias("n_events"), "n_sets", F.lit(row["ga_ratio"]).alias("ga_ratio"),
        "placebo_median", "placebo_lo", "placebo_hi", F.try_divide("_ge", "n_sets").alias("share_at_least_as_large"),
        ((F.col("_ge") + 1) / (F.col("n_sets") + 1)).alias("p_value"))


def before_checks(g: DataFrame, c: DataFrame, *, reps: int, seed, keys=("hour",)) -> DataFrame:
    """Was the airspace normal before, for both groups? One row per group plus the traffic ratio."""
    g, c = g.filter(~F.col("pre_bad")), c.filter(~F.col("pre_bad"))
    kept, weighted = match_weights(g, c, keys)
    cols = ["event_id", "day", "pre_pair_hours", "pre_T1_any", "pre_T1_any_expected", "pre_T1_any_in_control"]
    both = kept.select(*cols, F.lit(1.0).alias("w"), F.lit("events").alias("group")).unionByName(
        weighted.filter("w > 0").select(*cols, "w", F.lit("landings").alias("group")))
    known = F.col("pre_T1_any_expected") > 0
    inside = F.when(known & F.col("pre_T1_any_in_control"), F.col("w")).otherwise(0.0)
    traffic = F.coalesce("pre_pair_hours", F.lit(0.0)) * F.col("w")
    out = both.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("_n"),
        F.try_divide(F.sum(inside), F.sum(F.when(known, F.col("w")).otherwise(0.0))).alias("in_normal_range"),
        (F.sum(traffic) / F.sum("w")).alias("traffic_before_h"))
    lo, hi = wilson(F.bround(F.col("in_normal_range") * F.col("_n")), F.col("_n"))
    out = out.withColumns({"in_normal_range_lo": lo, "in_normal_range_hi": hi}).drop("_n")
    # one day list for both groups, so that every group is resampled on the same days
    per = both.groupBy("day").agg(*[
        F.sum(F.when(F.col("group") == n, v * F.col("w")).otherwise(0.0)).alias(f"{p}{k}")
        for n, p in (("events", "e"), ("landings", "l"))
        for k, v in (("o", F.coalesce("pre_T1_any", F.lit(0.0))), ("x", F.coalesce("pre_T1_any_expected", F.lit(0.0))),
                     ("t", F.coalesce("pre_pair_hours", F.lit(0.0))), ("n", F.lit(1.0)))])
    ci = day_bootstrap(per, ["eo", "ex", "et", "en", "lo", "lx", "lt", "ln"], {
        "oe_e": lambda s: safe_ratio(s["eo"], s["ex"]), "oe_l": lambda s: safe_ratio(s["lo"], s["lx"]),
        "tr": lambda s: safe_ratio(safe_ratio(s["et"], s["en"]), safe_ratio(s["lt"], s["ln"])),
    }, reps=reps, seed=seed)
    ends = ("", "_lo", "_hi")
    side = ci.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("group"), *[F.col(f"oe_{p}{e}").alias(f"oe_before{e}") for e in ends],
                 *[(F.col(f"tr{e}") if n == "ratio" else F.lit(None).cast("double")).alias(f"traffic_ratio{e}") for e in ends])
        if n != "ratio" else
        F.struct(F.lit(n).alias("group"), *[F.lit(None).cast("double").alias(f"oe_before{e}") for e in ends],
                 *[F.col(f"tr{e}").alias(f"traffic_ratio{e}") for e in ends])
        for n, p in (("events", "e"), ("landings", "l"), ("ratio", ""))])).alias("s")).select("s.*")
    return side.join(out, "group", "left")


def leave_one_out(g: DataFrame, c: DataFrame, col: str, keys=("hour",)) -> DataFrame:
    """Ratio against normal with each event left out in turn, in closed form.

    Dropping an event lowers its stratum's control weight by one event and
    leaves all other strata as they are, so totals minus one stratum step are
    enough; no loop and no pairwise rows.
    """
    keys = list(keys)
    g, c = usable(g), usable(c)
    p0, p1 = f"pre_{col}", f"post_{col}"
    sc = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("nc"), F.sum(p0).alias("c0"), F.sum(p1).alias("c1"))
    sg = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("ng"), F.sum(p0).alias("g0"), F.sum(p1).alias("g1"))
    st = sg.join(sc, keys)
    tot = st.agg(
        F.sum("g0").alias("G0"), F.sum("g1").alias("G1"),
        F.sum(F.col("ng") * F.col("c0") / F.col("nc")).alias("C0"), F.sum(F.col("ng") * F.col("c1") / F.col("nc")).alias("C1"))
    row = tot.first()  # four numbers
    rows = g.join(st.select(*keys, "nc", "c0", "c1"), keys, "left")
    has = F.col("nc").isNotNull()

    def less(total, part):
        return F.lit(float(row[total] or 0.0)) - F.when(has, part).otherwise(0.0)

    a, b = less("G0", F.col(p0)), less("G1", F.col(p1))
    x, y = less("C0", F.col("c0") / F.col("nc")), less("C1", F.col("c1") / F.col("nc"))
    return rows.select("event_id", F.col(p0).alias("before"), F.col(p1).alias("after"),
                       safe_ratio(safe_ratio(b, a), safe_ratio(y, x)).alias("vs_normal_without"))


def robustness(g: DataFrame, c: DataFrame, col: str, *, reps: int, seed, extra=()) -> DataFrame:
    """The ratio against normal under every variation of events, controls and matching.

    A row belongs to each variation whose condition it meets, with that variation's stratum; all variations are one grouped comparison.
    ``extra`` lists further (label, events, controls) with the columns of the first two frames.
    """
    always, hour = F.lit(True), F.col("hour").cast("string")
    both = lambda cond: (cond, cond)
    # label -> conditions on events and on controls, stratum, value
    variations = {"main": (*both(always), hour, col), "hour_and_flow": (*both(always), F.concat_ws("|", hour, F.coalesce("flow", F.lit("?"))), col)}
    if "pre_traffic_band" in g.columns:
        variations["hour_and_traffic"] = (*both(always), F.concat_ws("|", hour, F.coalesce("pre_traffic_band", F.lit("?"))), col)
    loo = leave_one_out(g, c, col).filter(F.col("vs_normal_without").isNotNull())
    top = loo.agg(F.min_by("event_id", F.struct(F.round("vs_normal_without", 9), F.col("event_id"))).alias("e")).first()["e"]
    if top is not None:
        variations["without_most_influential"] = (F.col("event_id") != top, always, hour, col)
    if "cluster_size" in g.columns:
        variations["isolated_only"] = (F.col("cluster_size") == 1, always, hour, col)
    if "pre_contaminated" in g.columns:
        variations["uncontaminated"] = (~F.col("pre_contaminated"), always, hour, col)
    busy = g.groupBy("day").count().agg(F.min_by("day", F.struct(-F.col("count"), F.col("day"))).alias("d")).first()["d"]
    if busy is not None:
        variations["without_busiest_day"] = (*both(F.col("day") != busy), hour, col)
    if "pre_T1_any_in_control" in g.columns and "pre_T1_any_in_control" in c.columns:
        variations["normal_before_only"] = (*both(F.coalesce("pre_T1_any_in_control", F.lit(False))), hour, col)
    if col == "T1_any" and "pre_T1_observed" in g.columns:
        variations["observed_only"] = (*both(always), hour, "T1_observed")

    def tagged(df, side, chosen):
        rows = [F.when(v[side], F.struct(F.lit(k).alias("variation"), v[2].alias("stratum"), *[F.col(f"{w}_{v[3]}").cast("double").alias(w) for w in ("from", "to")]))
                for k, v in chosen.items()]
        named = df.withColumns({f"{a}_{m}": F.col(f"{b}_{m}") for m in {v[3] for v in chosen.values()} for a, b in (("from", "pre"), ("to", "post"))})
        out = named.select("event_id", "day", "pre_bad", "post_bad", F.explode(F.array_compact(F.array(*rows))).alias("_v"))
        return out.select("event_id", "day", "_v.variation", "_v.stratum", "pre_bad", "post_bad", F.col("_v.from").alias(f"pre_{col}"), F.col("_v.to").alias(f"post_{col}"))

    gs, cs = tagged(g, 0, variations), tagged(c, 1, variations)
    for label, gg, cc in extra:
        one = {label: (*both(always), hour, col)}
        gs, cs = gs.unionByName(tagged(gg, 0, one)), cs.unionByName(tagged(cc, 1, one))
    return change_summary(gs, cs, reps=reps, seed=seed, keys=("stratum",), measures={col: col}, group=("variation",))


def epoch_by_group(g: DataFrame, c: DataFrame, per_second: DataFrame, values, *, reps: int, seed, keys=("hour",), minutes: int = 30,
                   step_s: int = 60) -> DataFrame:
    """Weighted mean of per-second values per minute around both groups, with day bands."""
    kept, weighted = match_weights(usable(g), usable(c), keys)
    both = kept.select("event_id", "day", "t0", F.lit(1.0).alias("w"), F.lit("events").alias("group")).unionByName(
        weighted.filter("w > 0").select("event_id", "day", "t0", "w", F.lit("landings").alias("group")))
    bins = both.select("*", F.explode(F.sequence(F.lit(-minutes), F.lit(minutes - 1))).alias("minute"))
    start = F.col("t0") + F.col("minute") * step_s
    spans = bins.select("group", "event_id", "minute", start.alias("t_start"), (start + step_s).alias("t_end"))
    sums = interval_sums(per_second, spans, values, ids=("group", "event_id", "minute"))
    j = bins.join(sums, ["group", "event_id", "minute"])
    per = j.groupBy("group", "minute", "day").agg(F.sum("w").alias("w"), *[F.sum(F.col(v) * F.col("w")).alias(v) for v in values])
    stats = {f"{v}_mean": (lambda s, v=v: safe_ratio(s[v], s["w"])) for v in values}
    return day_bootstrap(per, ["w", *values], stats, reps=reps, seed=seed, group=["group", "minute"])


def similar_landings(g: DataFrame, c: DataFrame, k: int = 10) -> DataFrame:
    """The k usable landings most like each event: same hour, same flow if k exist, nearest traffic; any hour if the hour has none.

    Landings are counted per (hour, flow) first, which decides the pool; only
    then events meet landings, and each keeps its k nearest in a top-k array
    that is combined before the shuffle.
    """
    c = c.filter(~F.col("excluded")).select(F.col("event_id").alias("ctl_id"), "hour", F.col("flow").alias("ctl_flow"),
                                           F.log1p("pre_pair_hours").alias("cx"))
    n_hour = c.groupBy("hour").agg(F.count(F.lit(1)).alias("n_hour"))
    n_flow = c.groupBy("hour", F.col("ctl_flow").alias("flow")).agg(F.count(F.lit(1)).alias("n_flow"))
    ev = g.select("event_id", "hour", "flow", F.log1p("pre_pair_hours").alias("gx")).join(n_hour, "hour", "left").join(n_flow, ["hour", "flow"], "left")
    ev = ev.withColumn("by_flow", F.coalesce(F.col("n_flow") >= k, F.lit(False)))
    # neighbours by traffic: rank landings inside each pool and look k ranks to both sides
    hour = F.col("hour").cast("long")
    pools = c.select("ctl_id", "cx", hour.alias("hour"), F.explode(F.array(F.col("ctl_flow"), F.lit("*"))).alias("pool")).unionByName(
        c.select("ctl_id", "cx", F.lit(-1).cast("long").alias("hour"), F.lit("**").alias("pool")))
    key = ["hour", "pool"]
    # equal traffic: the smaller id is nearer on both sides, so each side has its own order
    ranked = number_rows(pools.withColumn("_b", F.floor(F.col("cx") * 4)), key, "_b", ["cx", "ctl_id"], "up")
    ranked = number_rows(ranked, key, "_b", ["cx", F.desc("ctl_id")], "down").drop("_b")
    none = F.col("n_hour").isNull()
    marks = ev.select("event_id", F.when(none, -1).otherwise(hour).alias("hour"),
                      F.when(none, "**").when(F.col("by_flow"), F.col("flow")).otherwise("*").alias("pool"), "gx")
    mixed = ranked.select("hour", "pool", F.col("cx").alias("x"), F.lit(None).cast("string").alias("event_id"), F.lit(1).alias("is_c")).unionByName(
        marks.select("hour", "pool", F.col("gx").alias("x"), "event_id", F.lit(0).alias("is_c")))
    mixed = mixed.withColumn("_b", F.floor(F.col("x") * 4))
    at = running_sum(mixed, key, "_b", ["x", "is_c"], F.col("is_c"), "below").filter("is_c = 0").select("event_id", "hour", "pool", F.col("x").alias("gx"), "below")
    low = at.withColumn("down", F.explode(F.sequence(F.col("below") - k + 1, F.col("below")))).join(
        ranked.drop("up"), [*key, "down"]).select("event_id", "gx", "ctl_id", "cx")
    high = at.withColumn("up", F.explode(F.sequence(F.col("below") + 1, F.col("below") + k))).join(
        ranked.drop("down"), [*key, "up"]).select("event_id", "gx", "ctl_id", "cx")
    cand = low.unionByName(high)
    # candidates per event are at most 2k, so this rank is over a bounded group
    near = W.partitionBy("event_id").orderBy(F.round(F.abs(F.col("cx") - F.col("gx")), 9), "ctl_id")
    return cand.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k).select("event_id", "ctl_id", "place")


def did_regression(g: DataFrame, c: DataFrame, col: str, keys=("hour",)) -> DataFrame:
    """Weighted Poisson regression: count ~ after * event + hour + flow, clustered by day."""
    from .glm import cluster_poisson

    kept, weighted = match_weights(usable(g), usable(c), keys)
    parts = []
    for df, ga, w in ((kept, 1.0, F.lit(1.0)), (weighted.filter("w > 0"), 0.0, F.col("w"))):
        for post, side in ((0.0, "pre"), (1.0, "post")):
            parts.append(df.select(
                F.col(f"{side}_{col}").cast("double").alias("y"), w.cast("double").alias("w"), "day", F.col("hour").cast("string").alias("hour"),
                "flow", F.lit(post).alias("post"), F.lit(ga).alias("ga")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = long.filter(F.col("y").isNotNull()).withColumn("post_x_ga", F.col("post") * F.col("ga"))
    coef = cluster_poisson(long, "y", ["post", "ga", "post_x_ga"], ["hour", "flow"], weight="w", cluster="day")
    b, se = F.col("coef"), F.col("se")
    return coef.filter(F.col("term") == "post_x_ga").select(
        F.lit(col).alias("measure"), F.exp(b).alias("ratio"), F.exp(b - 1.96 * se).alias("ratio_lo"), F.exp(b + 1.96 * se).alias("ratio_hi"),
        F.when(se > 0, 2 * norm_cdf(-F.abs(b / se))).alias("p_value"))
