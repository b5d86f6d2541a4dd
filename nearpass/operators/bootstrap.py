"""Day-block bootstrap, rank tests and multiplicity correction."""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions.dist import norm_cdf
from .scan import running_sum


#: Replicates that a task draws at once.
BLOCK = 125


@lru_cache(maxsize=64)
def day_counts(seed, first: int, last: int, n: int) -> np.ndarray:
    """How often replicates first to last - 1 draw each of n days: (replicates, days). Kept while the worker lives."""
    out = np.empty((last - first, n))
    for rep in range(first, last):
        drawn = [int(md5(f"{seed}|{rep}|{slot}".encode()).hexdigest()[:8], 16) % n for slot in range(n)]
        out[rep - first] = np.bincount(drawn, minlength=n)
    return out


def _resampled_sums(reps: int, seed):
    """Function of (first replicate, arrays of day values): the value sums of every replicate of the block."""

    @pandas_udf("array<array<double>>")
    def sums(first: pd.Series, *days: pd.Series) -> pd.Series:
        out = []
        for i, begin in enumerate(first):
            per_day = np.column_stack([d.iloc[i] for d in days])
            out.append((day_counts(seed, int(begin), min(int(begin) + BLOCK, reps), len(per_day)) @ per_day).tolist())
        return pd.Series(out)

    return sums


def day_bootstrap(per_day: DataFrame, values, stats: dict, *, reps: int, seed, group=(), day: str = "day",
                  lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Point value and percentile interval of functions of sums over resampled days.

    ``per_day`` has one row per (group, day); ``stats`` maps a name to a
    function of {value name: summed column}. All stats of a group share the
    same day draws. The replicates are cut into blocks: a block's matrix of day
    counts, drawn by hash where it is used, is multiplied with the day sums, so
    a group's days travel once per block, not once per replicate.
    """
    group, values = list(group), list(values)
    days = F.array_sort(F.collect_list(F.struct(F.col(day), *[F.col(v).cast("double").alias(v) for v in values])))
    base = per_day.groupBy(*group).agg(days.alias("_days")) if group else per_day.agg(days.alias("_days"))
    base = base.withColumn("_n", F.size("_days"))
    def plus(v):
        return lambda acc, x: acc + x[v]

    total = {v: F.aggregate(F.col("_days"), F.lit(0.0), plus(v)) for v in values}
    base = base.withColumns({f"_t_{v}": c for v, c in total.items()})
    base = base.withColumns({n: fn({v: F.col(f"_t_{v}") for v in values}) for n, fn in stats.items()})
    def of(v):
        return lambda x: F.coalesce(x[v], F.lit(0.0))

    each = [F.transform("_days", of(v)).alias(f"_d_{v}") for v in values]
    # a group without days has one row too, with no value
    blocks = base.select(*group, *stats, "_n", *each, F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(BLOCK))).alias("_first"))
    sums = _resampled_sums(reps, seed)("_first", *[f"_d_{v}" for v in values])
    rep = blocks.repartition(-(-reps // BLOCK)).select(*group, *stats, "_n", F.explode(F.when(F.col("_n") > 0, sums).otherwise(F.array(F.array(*[F.lit(0.0)] * len(values))))).alias("_s"))
    rep = rep.select(*group, *stats, "_n", *[fn({v: F.get("_s", F.lit(i)) for i, v in enumerate(values)}).alias(f"_b_{n}") for n, fn in stats.items()])
    agg = []
    for n in stats:
        ok = F.col("_n") >= 2
        agg += [
            F.first(n).alias(n),
            F.percentile(F.when(ok, F.col(f"_b_{n}")), F.lit(lo)).alias(f"{n}_lo"),
            F.percentile(F.when(ok, F.col(f"_b_{n}")), F.lit(hi)).alias(f"{n}_hi"),
        ]
    out = rep.groupBy(*group).agg(*agg) if group else rep.agg(*agg)
    # an undefined point value has no interval
    return out.withColumns({f"{n}_{e}": F.when(F.col(n).isNotNull(), F.col(f"{n}_{e}")) for n in stats for e in ("lo", "hi")})


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def ratio_bootstrap(df: DataFrame, num: str, den: str, *, reps: int, seed, group=(), day: str = "day", name: str = "ratio"):
    """Ratio of sums with a day-block interval; rows with a missing side are left out."""
    ok = df.filter(F.col(num).isNotNull() & F.col(den).isNotNull())
    per = ok.groupBy(*group, day).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    return day_bootstrap(per, ["a", "b"], {name: lambda s: safe_ratio(s["a"], s["b"])}, reps=reps, seed=seed, group=group, day=day)


# ------------------------------------------------------------ rank tests ----

@pandas_udf(T.DoubleType())
def _signed_rank_exact(n: pd.Series, w: pd.Series) -> pd.Series:
    """Two-sided exact probability of the signed-rank sum for tie-free samples."""
    out = []
    for k, s in zip(n, w):
        ways = np.zeros(int(k) * (int(k) + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, int(k) + 1):
            ways[r:] = ways[r:] + ways[:-r]
        tail = ways[: int(math.floor(s)) + 1].sum() / ways.sum()
        out.append(min(1.0, 2.0 * tail))
    return pd.Series(out, dtype="float64")


def signed_rank(df: DataFrame, value: str, group=(), exact: bool = False) -> DataFrame:
    """Wilcoxon signed-rank test per group: n, w (smaller rank sum) and two-sided p.

    Equal magnitudes are counted first; ranks come from a two-level running
    count over magnitude blocks, so a large group is not sorted in one task.
    p comes from the normal approximation with tie correction at every size. With
    ``exact`` it comes from the exact law, which only samples without ties and
    zeros have; p is null for the others. It is null below six values as well.
    """
    if not group:  # one row without values too
        found = signed_rank(df.withColumn("_g", F.lit(0)), value, ["_g"], exact)
        one = df.sparkSession.range(1).select(F.lit(0).alias("_g"))
        return one.join(found, "_g", "left").drop("_g").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    group = list(group)
    v = F.col(value)
    rows = df.filter(v.isNotNull() & ~F.isnan(v))
    mags = rows.groupBy(*group, F.abs(v).alias("m")).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(v > 0).alias("pos"), F.count_if(v < 0).alias("neg"))
    nz = mags.filter(F.col("m") > 0).withColumn("_blk", F.floor(F.log2("m") * 4))
    ranked = running_sum(nz, group, "_blk", ["m"], F.col("c"), "_upto")
    rank = F.col("_upto") - (F.col("c") - 1) / 2.0
    sums = ranked.groupBy(*group).agg(
        F.sum(rank * F.col("pos")).alias("w_pos"), F.sum(rank * F.col("neg")).alias("w_neg"),
        F.sum("c").alias("n"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    zeros = mags.groupBy(*group).agg(F.sum("c").alias("n_all"))
    out = zeros.join(sums, group, "left")
    n = F.col("n").cast("double")
    w = F.least("w_pos", "w_neg")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (w - n * (n + 1) / 4) / F.sqrt(var)
    out = out.withColumns({"w": w, "_z": F.when(var > 0, z)})
    p = F.least(F.lit(1.0), 2 * norm_cdf(-F.abs("_z")))
    if exact:
        plain = (F.col("ties") == 0) & (F.col("n") == F.col("n_all"))
        p = F.when(plain, _signed_rank_exact(F.when(plain, F.col("n")).otherwise(1), F.when(plain, F.col("w")).otherwise(0.0)))
    return out.select(*group, F.coalesce("n", F.lit(0)).alias("n"), "w", F.when((F.col("n_all") >= 6) & (F.col("n") > 0), p).alias("p_value"))


def ks_uniform(df: DataFrame, u: str, group=()) -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance of a column in (0, 1) from uniform."""
    if not group:
        return ks_uniform(df.withColumn("_g", F.lit(0)), u, ["_g"]).drop("_g")
    group = list(group)
    rows = df.filter(F.col(u).isNotNull()).withColumn("_blk", F.floor(F.col(u) * 1024)).groupBy(*group, "_blk", u).agg(
        F.count(F.lit(1)).alias("_c"))
    num = running_sum(rows, group, "_blk", [u], F.col("_c"), "_i")
    j = num.join(rows.groupBy(*group).agg(F.sum("_c").alias("n")), group)
    d = F.greatest(F.col("_i") / F.col("n") - F.col(u), F.col(u) - (F.col("_i") - F.col("_c")) / F.col("n"))
    out = j.groupBy(*group).agg(F.max(d).alias("d"), F.first("n").alias("n"))
    return out.withColumn("p_value", ks_tail(F.col("d"), F.col("n")))


def ks_tail(d: Column, n: Column) -> Column:
    """Asymptotic two-sided tail with the finite-sample correction."""
    root = F.sqrt(n.cast("double"))
    t = (root + 0.12 + 0.11 / root) * d
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t))
    return F.when(t < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))


def holm(df: DataFrame, p: str, out: str, group=()) -> DataFrame:
    """Step-down adjusted p-values; nulls stay null. Rows are test results, a short table."""
    key = [*group, F.col(p).isNotNull()]
    w = W.partitionBy(*key).orderBy(p)
    m = F.count(p).over(W.partitionBy(*key))
    df = df.withColumn("_a", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    adj = F.max("_a").over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, F.when(F.col(p).isNotNull(), adj)).drop("_a")
