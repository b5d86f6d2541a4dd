"""Many analysis settings evaluated side by side, from pair-seconds to results.

Settings share most of their work. A zone (tier limits and lookahead) is tested once per pair-second whatever the number of variants that use it;
episodes are built once per zone and volume; windows, matching, resampling and rate ratios carry the variant as a grouping key.
"""

from __future__ import annotations

import dataclasses as dc

from pyspark.sql import DataFrame, functions as F

from ..functions.plan import cut_lineage
from ..functions.timefns import day_text, local_hour
from ..settings import (BASELINE, CONTROL_OUTCOMES, DAY_S, ENCOUNTER, EVENT_OUTCOMES, EVENT_OUTCOMES_AMBIGUOUS, VOLUME, WINDOWS, Spec)
from .bootstrap import ratio_bootstrap
from .encounters import by_kind, episodes
from .events import anchor, event_table
from .eventstats import irr
from .intervals import interval_join, interval_sums
from .matching import change_summary
from .pairs import evaluate


@dc.dataclass(frozen=True)
class Variant:
    """One analysis: encounter setting, window length, events and how far the baseline keeps from them."""

    parameter: str
    value: str
    spec: Spec
    window_min: float
    exclusion_min: float
    outcomes: tuple = EVENT_OUTCOMES
    isolated: bool = False


def settings_grid(base: Spec) -> list:
    """(parameter, value, Spec) of the one-at-a-time encounter settings, base first."""
    out = [("base", "base", base), ("radius_nm", f"{VOLUME.radius_sensitivity_nm:g}", dc.replace(base, radius_nm=VOLUME.radius_sensitivity_nm))]
    out += [("ceiling_ft", f"{c:g}", dc.replace(base, ceiling_ft=c)) for c in VOLUME.ceiling_sensitivity_ft if c != base.ceiling_ft]
    out += [("lookahead_s", f"{s:g}", dc.replace(base, lookahead_s=s)) for s in ENCOUNTER.lookahead_sensitivity_s]
    out += [(f"{t}_{w}", f"x{f:g}", base.scaled(t, w, f)) for t, _, _ in base.tiers for w in ("H", "V") for f in ENCOUNTER.tier_factors]
    return out


def analysis_grid(base: Spec, window_min: float = WINDOWS.window_min, windows=WINDOWS.window_sensitivity_min, exclusion_min: float = WINDOWS.exclusion_min,
                  exclusions=WINDOWS.exclusion_sensitivity_min) -> list[Variant]:
    """All one-at-a-time analyses, base first: encounter settings, window lengths, event sets, baseline exclusion."""
    one = Variant("base", "base", base, window_min, exclusion_min)
    out = [dc.replace(one, parameter=p, value=v, spec=s) for p, v, s in settings_grid(base)]
    out += [dc.replace(one, parameter="window_min", value=f"{w:g}", window_min=w) for w in windows]
    out += [dc.replace(one, parameter="event_set", value=f"{o}_only", outcomes=(o,)) for o in EVENT_OUTCOMES]
    out += [dc.replace(one, parameter="event_set", value="include_ambiguous", outcomes=EVENT_OUTCOMES_AMBIGUOUS),
            dc.replace(one, parameter="event_set", value="no_clusters", isolated=True)]
    return out + [dc.replace(one, parameter="exclusion_min", value=f"{x:g}", exclusion_min=x) for x in exclusions]


def _pick(values: list, at):
    """The entry of a short list of literals whose place is in a column."""
    return F.element_at(F.array(*values), at + 1)


def sweep_encounters(pairs: DataFrame, variants, runways, keys=("day",)) -> DataFrame:
    """Encounters of every (parameter, value, Spec), with the columns parameter and value."""
    zones, settings, used = {}, {}, {}
    for i, (_, _, s) in enumerate(variants):
        for tier, h, v in s.tiers:
            zone = zones.setdefault((tier, float(h), float(v), float(s.lookahead_s)), len(zones))
            setting = settings.setdefault((zone, float(s.radius_nm), float(s.ceiling_ft)), len(settings))
            used.setdefault(setting, []).append(i)
    number = lambda xs, kind: F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")
    listed = F.array(*[F.struct(F.lit(k).alias("_zone"), F.lit(t).alias("tier"), F.lit(h).alias("h_lim"), F.lit(v).alias("v_lim"), F.lit(look).alias("_l"))
                       for (t, h, v, look), k in zones.items()])
    widest, highest = max(r for _, r, _ in settings), max(c for *_, c in settings) + VOLUME.ceiling_buffer_ft
    r, h = F.greatest("ra", "rb"), F.greatest("ha", "hb")
    near = pairs.filter((r <= widest) & (h <= highest))
    q = evaluate(near.withColumn("_z", F.explode(listed)).select(*pairs.columns, "_z.*"), "_l").filter(F.col("observed") | F.col("predicted"))
    within = F.array(*[F.array(*[F.struct(F.lit(n).alias("n"), F.lit(rad).alias("r"), F.lit(c + VOLUME.ceiling_buffer_ft).alias("top"))
                                 for (z, rad, c), n in settings.items() if z == k]) for k in zones.values()])
    fitting = F.transform(F.filter(F.element_at(within, F.col("_zone") + 1), lambda s: (r <= s["r"]) & (h <= s["top"])), lambda s: s["n"])
    q = q.withColumn("_setting", F.explode(fitting)).drop("_zone", "_l")
    one = episodes(by_kind(q), runways, F.lit(None).cast("double"), keys=(*keys, "_setting"))
    ceiling = _pick([F.lit(c) for _, _, c in settings], F.col("_setting"))
    one = one.withColumn("inside_ceiling", F.col("h_max_ft") <= ceiling)
    every = one.withColumn("_i", F.explode(_pick([number(used[k], "int") for k in settings.values()], F.col("_setting"))))
    return every.withColumns({"parameter": _pick([F.lit(p) for p, _, _ in variants], F.col("_i")), "value": _pick([F.lit(v) for _, v, _ in variants], F.col("_i"))}).drop("_i", "_setting")


def _distance(points: DataFrame, spans: DataFrame, ids, reach_s: int) -> DataFrame:
    """Seconds from each span to the nearest point, null beyond ``reach_s``."""
    wide = spans.select(*ids, "t_start", "t_end", (F.col("t_start") - reach_s).alias("_a"), (F.col("t_end") + reach_s).alias("_b"))
    hit = interval_join(points, wide, lo="_a", hi="_b", closed=True, bin_s=max(600, reach_s))
    away = F.greatest(F.col("t_start") - F.col("t"), F.col("t") - F.col("t_end"), F.lit(0))
    return spans.join(hit.groupBy(*ids).agg(F.min(away).alias("away_s")), list(ids), "left")


def sweep_results(pairs: DataFrame, presence: DataFrame, approaches: DataFrame, days: DataFrame, variants: list[Variant], runways, *, reps: int = BASELINE.sweep_reps,
                  seed=BASELINE.seed, tz: str = "UTC", metric_tier: str = "T1") -> DataFrame:
    """The main result of every variant in one row: change around events, against normal, per traffic, and against the baseline.

    ``days`` lists the days with data (day, day_no). The baseline of a variant is the pooled rate of its clock windows that keep the exclusion.
    """
    n = range(len(variants))
    each = lambda make: F.array(*[make(i, variants[i]) for i in n])
    seconds = lambda minutes: int(round(minutes * 60))
    reach = max(seconds(v.exclusion_min) for v in variants)
    # what is counted: encounters per variant and second, pair-seconds per volume and second
    names = {(v.parameter, v.value): i for i, v in enumerate(variants)}
    encounters = sweep_encounters(pairs, [(v.parameter, v.value, v.spec) for v in variants], runways)
    mine = F.coalesce(*[F.when((F.col("parameter") == p) & (F.col("value") == x), i) for (p, x), i in names.items()])
    counts = encounters.filter((F.col("tier") == metric_tier) & (F.col("kind") == "any") & F.col("inside_ceiling")).groupBy(mine.alias("variant"), F.col("t_min").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    volumes = {vol: k for k, vol in enumerate(dict.fromkeys((v.spec.radius_nm, v.spec.ceiling_ft) for v in variants))}
    inside = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(r)).alias("r"), F.lit(float(c)).alias("c")) for (r, c), k in volumes.items()]),
                      lambda s: (F.col("r") <= s["r"]) & (F.col("h") <= s["c"]))
    traffic = presence.select("t", F.explode(F.transform(inside, lambda s: s["k"])).alias("volume")).groupBy("volume", "t").agg(
        (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("bigint").alias("pair_s"))
    counts, traffic = cut_lineage(counts), cut_lineage(traffic)
    # where: windows around events and landings, clock windows of every length
    timed = cut_lineage(anchor(approaches).select("approach_id", "t0", "t_low", "outcome"))
    around = timed.filter(F.col("outcome").isin(*EVENT_OUTCOMES_AMBIGUOUS)).select(F.col("t0").alias("t")).distinct()
    base = variants[0]
    sizes = event_table(approaches, base.window_min, base.outcomes).select("approach_id", "cluster_size")
    happened = timed.filter(F.col("outcome").isin(*EVENT_OUTCOMES_AMBIGUOUS)).join(sizes, "approach_id", "left").select(
        F.lit(True).alias("is_g"), F.col("approach_id").cast("string").alias("id"), "t0", "outcome", "cluster_size", F.lit(None).cast("bigint").alias("away_s"))
    landed = timed.filter(F.col("outcome").isin(*CONTROL_OUTCOMES) & F.col("t_low").isNotNull()).select(
        F.col("approach_id").cast("string").alias("id"), F.col("t_low").alias("t0"), "outcome", F.col("t_low").alias("t_start"), F.col("t_low").alias("t_end"))
    landed = _distance(around, landed, ("id",), reach).select(F.lit(False).alias("is_g"), "id", "t0", "outcome", F.lit(None).cast("bigint").alias("cluster_size"), "away_s")
    far = lambda v: F.coalesce(F.col("away_s") > seconds(v.exclusion_min), F.lit(True))
    fits = lambda v: F.when(F.col("is_g"), F.col("outcome").isin(*v.outcomes) & (F.lit(not v.isolated) | (F.col("cluster_size") == 1))).otherwise(far(v))
    place = lambda i, v: F.when(fits(v), F.struct(F.lit(i).alias("variant"), F.lit(volumes[v.spec.radius_nm, v.spec.ceiling_ft]).alias("volume"), F.lit(seconds(v.window_min)).alias("w")))
    centres = cut_lineage(happened.unionByName(landed).withColumn("_v", F.explode(F.array_compact(each(place)))).select("is_g", "id", "t0", "_v.*"))
    two = F.array(F.struct(F.lit("pre").alias("window"), (F.col("t0") - F.col("w")).alias("t_start"), F.col("t0").alias("t_end")),
                  F.struct(F.lit("post").alias("window"), F.col("t0").alias("t_start"), (F.col("t0") + F.col("w")).alias("t_end")))
    spans = centres.withColumn("_s", F.explode(two)).select("variant", "volume", "is_g", "id", "_s.*")
    clocks = None
    for length in dict.fromkeys(v.window_min for v in variants):
        tiles = days.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(DAY_S // seconds(length) - 1)))).select(
            F.concat_ws("_", "day", "_k").alias("id"), (F.col("day_no") * DAY_S + F.col("_k") * seconds(length)).alias("t_start"), F.lit(seconds(length)).alias("w"))
        tiles = tiles.withColumn("t_end", F.col("t_start") + F.col("w"))
        clocks = tiles if clocks is None else clocks.unionByName(tiles)
    clocks = _distance(around, clocks, ("id", "w"), reach)
    tile = lambda i, v: F.when((F.col("w") == seconds(v.window_min)) & far(v), F.struct(F.lit(i).alias("variant"), F.lit(volumes[v.spec.radius_nm, v.spec.ceiling_ft]).alias("volume")))
    clocks = clocks.withColumn("_v", F.explode(F.array_compact(each(tile)))).select("_v.variant", "_v.volume", F.lit(None).cast("boolean").alias("is_g"), "id", F.lit("clock").alias("window"), "t_start", "t_end")
    spans = cut_lineage(spans.unionByName(clocks))
    ids = ("variant", "kind", "id", "window")
    spans = spans.withColumn("kind", F.when(F.col("is_g"), "event").when(~F.col("is_g"), "landing").otherwise("clock")).drop("is_g")
    number = interval_sums(counts, spans, ["n"], keys=("variant",), ids=ids[1:] + ("variant",))
    hours = interval_sums(traffic, spans, ["pair_s"], keys=("volume",), ids=ids)
    cell = spans.select(*ids).join(number, list(ids), "left").join(hours, list(ids), "left").fillna(0, ["n", "pair_s"])
    cell = cut_lineage(cell.select(*ids, F.col("n").cast("double").alias("n"), (F.col("pair_s") / 3600.0).alias("h")))
    rate = cell.filter("kind = 'clock'").groupBy("variant").agg(F.try_divide(F.sum("n"), F.sum("h")).alias("rate"))
    of = lambda w, c: F.max(F.when(F.col("window") == w, F.col(c)))
    wide = cell.filter("kind <> 'clock'").groupBy("variant", "kind", "id").agg(*[of(w, c).alias(f"{w}_{c}") for w in ("pre", "post") for c in ("n", "h")])
    rows = wide.join(centres.select("variant", F.when(F.col("is_g"), "event").otherwise("landing").alias("kind"), "id", "t0", "w"), ["variant", "kind", "id"]).join(F.broadcast(rate), "variant", "left")
    rows = cut_lineage(rows.select("variant", "kind", F.col("id").alias("event_id"), F.col("pre_n").alias("pre_T1_any"), F.col("post_n").alias("post_T1_any"), F.col("pre_h").alias("e_pre"), F.col("post_h").alias("e_post"),
                                   (F.col("rate") * F.col("pre_h")).alias("pre_expected"), (F.col("rate") * F.col("post_h")).alias("post_expected"),
                                   day_text(F.col("t0") - F.col("w")).alias("day"), local_hour(F.col("t0"), tz).alias("hour"), F.lit(False).alias("pre_bad"), F.lit(False).alias("post_bad")))
    g, c = rows.filter("kind = 'event'"), rows.filter("kind = 'landing'")
    change = change_summary(g, c, reps=reps, seed=seed, measures={"T1_any": "T1_any"}, group=("variant",)).select(
        "variant", "n_controls", *[F.col(f"vs_normal{e}") for e in ("", "_lo", "_hi")])
    out = g.groupBy("variant").agg(F.count(F.lit(1)).alias("n_events"), F.sum("pre_T1_any").alias("sum_pre"), F.sum("post_T1_any").alias("sum_post"))
    parts = [ratio_bootstrap(g, "post_T1_any", "pre_T1_any", reps=reps, seed=seed, group=("variant",), name="total_ratio"), change,
             irr(g, reps=reps, seed=seed, group=("variant",), cols=("pre_T1_any", "post_T1_any", "e_pre", "e_post")).drop("irr_converged"),
             *[ratio_bootstrap(g, f"{w}_T1_any", f"{w}_expected", reps=reps, seed=seed, group=("variant",), name=f"sir_{w}") for w in ("pre", "post")]]
    for p in parts:
        out = out.join(p, "variant", "left")
    named = {"parameter": _pick([F.lit(v.parameter) for v in variants], F.col("variant")), "value": _pick([F.lit(v.value) for v in variants], F.col("variant")),
             "is_base": F.col("variant") == 0, "baseline_model": F.lit("pooled")}
    return out.withColumns(named).drop("variant")
