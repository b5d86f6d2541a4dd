"""Poisson and negative-binomial regression by distributed scoring steps.

Each step sums X'WX, X'Wz and the likelihood over the partitions (numpy inside
tasks, one small row per partition); only matrices of the size of the design
reach the driver, where the step is solved.
"""

from __future__ import annotations

import dataclasses as dc
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.dist import chi2_sf1
from ..functions.plan import cut_lineage
from ..settings import BASELINE, Baseline

FACTORS = ("hour_block", "daytype", "month", "flow")
DROP_ORDER = ("month", "flow", "daytype", "hour_block")


@dc.dataclass
class CountModel:
    metric: str
    kind: str
    coef: dict
    alpha: float
    pooled_rate: float
    n_windows: int
    n_events: int
    hour_block_h: int = 1
    dispersion_p: float | None = None
    notes: list = dc.field(default_factory=list)

    def params(self, spark) -> DataFrame:
        """One-row parameter table of the model."""
        schema = ("metric string, kind string, alpha double, pooled_rate double, n_windows bigint, n_events bigint, "
                  "hour_block_h int, dispersion_p double, coef map<string,double>, notes string")
        row = (self.metric, self.kind, float(self.alpha), float(self.pooled_rate), int(self.n_windows), int(self.n_events),
               int(self.hour_block_h), self.dispersion_p, self.coef, json.dumps(self.notes))
        return spark.createDataFrame([row], schema)


def level_table(df: DataFrame, factors, y: str) -> DataFrame:
    """Windows and events per factor level, long form, one pass."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors]))
    return df.select(rows.alias("_l"), F.col(y).alias("_y")).groupBy("_l.factor", "_l.level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("events"))


def design_levels(levels: DataFrame, cfg: Baseline = BASELINE) -> DataFrame:
    """Role of every level: reference (most frequent), merged into it, or own term."""
    from pyspark.sql import Window as W

    w = W.partitionBy("factor").orderBy(F.desc("n"), "level")
    rank = F.row_number().over(w)
    return levels.withColumn("_r", rank).withColumn(
        "role", F.when(F.col("_r") == 1, "reference")
        .when((F.col("n") < cfg.min_level_windows) | (F.col("events") <= 0), "merged").otherwise("term")).drop("_r")


def _terms(df, factors, y, cfg):
    rows = design_levels(level_table(df, factors, y), cfg).collect()  # some tens of levels
    return [(r["factor"], r["level"]) for r in sorted(rows, key=lambda r: (factors.index(r["factor"]), r["level"])) if r["role"] == "term"]


def _design(df: DataFrame, terms, numeric, y, offset, weight, cluster=None) -> DataFrame:
    x = [F.lit(1.0)] + [(F.col(f).cast("string") == lev).cast("double") for f, lev in terms] + [F.col(c).cast("double") for c in numeric]
    cols = [F.array(*x).alias("x"), F.col(y).cast("double").alias("y"), offset.alias("o"), weight.alias("w")]
    if cluster:
        cols.append(F.col(cluster).cast("string").alias("cluster"))
    return df.select(*cols)


def _sum_parts(data: DataFrame, fn, size: int) -> np.ndarray:
    """Element-wise sum over partitions of the vector fn(batch) returns."""
    def part(batches):
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += fn(b)
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    rows = data.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _nb_loglik(y, mu, a):
    """Log likelihood up to a term that does not depend on mu or the dispersion."""
    if a <= 0:
        return float(np.sum(y * np.log(mu) - mu))
    top = int(y.max()) if len(y) else 0
    steps = np.concatenate([[0.0], np.cumsum(np.log1p(a * np.arange(top)))])
    return float(np.sum(steps[y.astype(int)] + y * np.log(mu) - (y + 1 / a) * np.log1p(a * mu)))


def _iterate(data: DataFrame, p: int, start: np.ndarray, cfg: Baseline, nb: bool, max_rounds: int = 30, tol: float = 1e-8):
    """Scoring steps for the coefficients; for nb the dispersion moves on a shrinking grid in the same passes."""
    beta = start.copy()
    lo, hi = np.log(cfg.alpha_lo), np.log(cfg.alpha_hi)
    alpha, grid = (np.exp((lo + hi) / 2) if nb else 0.0), (np.linspace(lo, hi, 17) if nb else np.array([]))
    width, ll = hi - lo, 0.0
    for rnd in range(max_rounds):
        b0, a0, g = beta.copy(), float(alpha), grid.copy()

        def fn(batch):
            x = np.vstack(batch["x"].to_numpy())
            y, o, w = (batch[c].to_numpy(float) for c in ("y", "o", "w"))
            eta = np.clip(x @ b0, -30, 30)
            mu = np.exp(eta + o)
            wt = w * mu / (1 + a0 * mu)
            z = eta + (y - mu) / mu
            return np.concatenate([
                ((x * wt[:, None]).T @ x).ravel(), (x * wt[:, None]).T @ z,
                [_nb_loglik(y, mu, float(np.exp(v))) for v in g], [_nb_loglik(y, mu, a0)]])

        v = _sum_parts(data, fn, p * p + p + len(g) + 1)
        xtx, xtz = v[: p * p].reshape(p, p), v[p * p: p * p + p]
        ll = v[-1]
        new = np.linalg.lstsq(xtx + 1e-10 * np.eye(p), xtz, rcond=None)[0]
        move = float(np.max(np.abs(new - beta)))
        beta = new
        if nb and rnd >= 2:
            best = g[int(np.argmax(v[p * p + p: -1]))]
            alpha = np.exp(best)
            width = max(width * 0.45, 2e-4)
            grid = np.clip(np.linspace(best - width / 2, best + width / 2, 17), lo, hi)
        if move < tol and (not nb or width <= 2e-4):
            break
    return beta, float(alpha), float(ll)


def prepare(df: DataFrame) -> DataFrame:
    """Columns the design reads: hour blocks of one and three hours and log traffic."""
    return df.withColumns({
        "hour_1": F.floor("local_hour"), "hour_3": F.floor(F.col("local_hour") / 3),
        "log_n": F.log(F.greatest(F.col("n_aircraft").cast("double"), F.lit(1.0))),
    })


def fit_count_model(df: DataFrame, metric: str, cfg: Baseline = BASELINE, factors=FACTORS) -> CountModel:
    """Risk-adjusted count model of one metric on windows with exposure.

    Pooled rate for rare metrics; otherwise Poisson, or negative binomial when
    the boundary likelihood-ratio test finds over-dispersion. Aliased factors
    are dropped least important first; an implausible or failed fit falls back
    to fewer factors and at last to the pooled rate.
    """
    d = df.filter(F.col("pair_hours") > 0)
    tot = d.agg(F.count(F.lit(1)).alias("n"), F.sum(metric).alias("y"), F.sum("pair_hours").alias("e")).first()
    n, y, e = int(tot["n"]), int(tot["y"] or 0), float(tot["e"] or 0.0)
    rate = y / e if e > 0 else 0.0
    pooled = CountModel(metric, "pooled", {}, 0.0, rate, n, y)
    if y < cfg.min_events or n < cfg.min_windows:
        pooled.notes.append("pooled rate: too few events")
        return pooled
    d = prepare(d)
    empty = d.groupBy("hour_1").agg(F.sum(metric).alias("y")).filter("y <= 0").limit(1).count()
    hb = cfg.hour_block_fallback_h if empty else cfg.hour_block_h
    d = cut_lineage(d.withColumn("hour_block", F.col(f"hour_{hb}")))
    notes = [] if not empty else [f"hour blocks of {hb} h: an hour without events"]
    factors = [f for f in FACTORS if f in factors]
    tried = [list(factors)] + [[f for f in factors if f not in drop] for drop in (("month",), ("month", "flow"), ("month", "flow", "daytype"))]
    for use in tried:
        left = list(use)
        terms = _terms(d, left, metric, cfg)
        data = _design(d, terms, ["log_n"], metric, F.log("pair_hours"), F.lit(1.0))
        for drop in (None, *DROP_ORDER):
            if drop in left:
                left.remove(drop)
                terms = [t for t in terms if t[0] in left]
                data = _design(d, terms, ["log_n"], metric, F.log("pair_hours"), F.lit(1.0))
            p = len(terms) + 2
            gram = _sum_parts(data, lambda b: (lambda x: (x.T @ x).ravel())(np.vstack(b["x"].to_numpy())), p * p).reshape(p, p)
            if np.linalg.matrix_rank(gram) == p:
                break
        start = np.zeros(p)
        start[0] = np.log(max(rate, 1e-12))
        beta, _, ll0 = _iterate(data, p, start, cfg, nb=False)
        nb_beta, alpha, ll1 = _iterate(data, p, beta, cfg, nb=True)
        pval = 0.5 * chi2_sf1(max(0.0, 2 * (ll1 - ll0)))
        kind = "nb" if pval < cfg.dispersion_p else "poisson"
        b = nb_beta if kind == "nb" else beta
        if np.all(np.isfinite(b)) and np.max(np.abs(b[1:]), initial=0.0) <= cfg.max_coef:
            names = ["intercept"] + [f"{f}={lev}" for f, lev in terms] + ["log_n"]
            return CountModel(metric, kind, {k: float(v) for k, v in zip(names, b)}, alpha if kind == "nb" else 0.0,
                              rate, n, y, hb, float(pval), notes)
        notes.append(f"implausible fit with {use}")
    pooled.notes = notes + ["regression failed; pooled rate"]
    return pooled


def cluster_poisson(df: DataFrame, y: str, numeric, factors, *, weight: str, cluster: str, cfg: Baseline = BASELINE) -> DataFrame:
    """Weighted Poisson regression with a sandwich covariance clustered by one column; without rows the coefficients are null."""
    df = cut_lineage(df)
    if df.isEmpty():
        return df.sparkSession.createDataFrame([(n, None, None) for n in ("intercept", *numeric)], "term string, coef double, se double")
    lev = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("l")) for f in factors])).alias("x")).select("x.*").distinct().collect()
    terms = []
    for f in factors:
        terms += [(f, v) for v in sorted(r["l"] for r in lev if r["f"] == f)[1:]]
    data = _design(df, terms, numeric, y, F.lit(0.0), F.col(weight), cluster)
    p = 1 + len(terms) + len(numeric)
    t = df.agg(F.sum(F.col(weight) * F.col(y)).alias("a"), F.sum(weight).alias("b")).first()
    start = np.zeros(p)
    start[0] = np.log(max(float(t["a"]) / max(float(t["b"]), 1e-12), 1e-6))
    beta, _, _ = _iterate(data, p, start, cfg, nb=False, max_rounds=60, tol=1e-9)

    def bread_fn(b):
        x = np.vstack(b["x"].to_numpy())
        mu = np.exp(np.clip(x @ beta, -30, 30))
        return ((x * (b["w"].to_numpy(float) * mu)[:, None]).T @ x).ravel()

    bread = np.linalg.pinv(_sum_parts(data, bread_fn, p * p).reshape(p, p))

    def scores(batches):
        for b in batches:
            if len(b):
                x = np.vstack(b["x"].to_numpy())
                s = x * (b["w"].to_numpy(float) * (b["y"].to_numpy(float) - np.exp(np.clip(x @ beta, -30, 30))))[:, None]
                yield pd.DataFrame({"cluster": np.repeat(b["cluster"].to_numpy(), p), "i": np.tile(np.arange(p), len(b)), "s": s.ravel()})

    per = data.mapInPandas(scores, "cluster string, i int, s double").groupBy("cluster", "i").agg(F.sum("s").alias("s"))
    vec = per.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v")).select(F.transform("v", lambda q: q["s"]).alias("v"))

    def meat_fn(b):
        s = np.vstack(b["v"].to_numpy())
        return np.append((s.T @ s).ravel(), len(s))

    m = _sum_parts(vec, meat_fn, p * p + 1)
    k = m[-1]
    cov = bread @ (m[:-1].reshape(p, p) * (k / max(k - 1, 1))) @ bread
    names = ["intercept"] + [f"{f}={v}" for f, v in terms] + list(numeric)
    rows = [(n, float(b), float(np.sqrt(max(cov[i, i], 0.0)))) for i, (n, b) in enumerate(zip(names, beta))]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double")
