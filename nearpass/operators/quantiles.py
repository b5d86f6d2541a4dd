"""Exact quantiles by distributed selection.

An exact percentile that collects a group's values holds all of them in one task. Here every wanted rank keeps a range of values and the
number of values below it. A pass counts the values of a range in equal buckets, and the range shrinks to the bucket with the rank, cut to the
values in it. When a range holds a single value, or few enough to be sorted by one task, the rank is answered. Counts are summed per task before they are
shuffled, so that a pass moves as many rows as there are buckets, whatever the number of values.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.plan import cut_lineage

#: Values that one task may sort, and buckets of a pass.
GATHERED, BUCKETS = 10_000, 1024
#: Ranks whose ranges are sent to all tasks; more are joined by group.
BROADCAST_RANKS = 100_000


def grouped_quantiles(df: DataFrame, values, qs, group=(), *, gathered: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per group: (group, n_<value>, <value>) with an array of the quantiles ``qs`` of each value, linear between ranks.

    Nulls and NaN are left out; a value without others has null. ``df`` is read once per pass, so it should be cheap or stored.
    """
    group, values, qs = list(group), list(values), [float(q) for q in qs]
    gathered, buckets = gathered or GATHERED, buckets or BUCKETS
    rows = df.select(*group, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(v).cast("double").alias("_v")) for i, v in enumerate(values)])).alias("_x")).select(*group, "_x.*")
    key, v = [*group, "_c"], F.col("_v")
    known = rows.filter(v.isNotNull() & ~F.isnan(v))
    sizes = rows.groupBy(*key).agg(F.count(F.when(~F.isnan(v), v)).alias("_n"), F.min(F.when(~F.isnan(v), v)).alias("_lo"), F.max(F.when(~F.isnan(v), v)).alias("_hi"))
    sizes = cut_lineage(sizes)
    place = [F.lit(q) * (F.col("_n") - 1) for q in qs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in place])))
    ranges = sizes.filter("_n > 0").select(*key, F.explode(ranks).alias("_k"), F.lit(0).cast("long").alias("_base"), "_lo", "_hi", F.col("_n").alias("_size"))
    found = _selected(known, ranges, key, gathered, buckets)
    held = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_at"))).alias("_m"))
    every = _null_safe(sizes, held, key)

    def at(p):
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        a, b = F.try_element_at("_m", low), F.try_element_at("_m", high)
        return F.when(low == high, a).otherwise(a * (high - p) + b * (p - low))

    line = every.select(*group, "_c", "_n", F.when(F.col("_n") > 0, F.array(*[at(p) for p in place])).alias("_q"))
    cells = [x for i, name in enumerate(values) for x in (
        F.max(F.when(F.col("_c") == i, F.col("_n"))).alias(f"n_{name}"), F.max_by("_q", F.when((F.col("_c") == i) & (F.col("_n") > 0), 1)).alias(name))]
    return line.groupBy(*group).agg(*cells)


def _selected(known: DataFrame, ranges: DataFrame, key, gathered: int, buckets: int) -> DataFrame:
    """The value ``_at`` of every rank ``_k`` that a range holds."""
    done = None
    while True:
        ranges = cut_lineage(ranges)
        small = (F.col("_size") <= gathered) | (F.col("_lo") == F.col("_hi"))
        ready, open_ = ranges.filter(small), ranges.filter(~small)
        done = ready if done is None else done.unionByName(ready)
        if open_.isEmpty():
            break
        ranges = _narrowed(_inside(known, open_, key), key, buckets)
    single = done.filter("_lo = _hi").select(*key, "_k", F.col("_lo").alias("_at"))
    few = _inside(known, cut_lineage(done.filter("_lo < _hi")), key).groupBy(*key, "_k", "_base").agg(F.sort_array(F.collect_list("_v")).alias("_l"))
    return single.unionByName(few.select(*key, "_k", F.get("_l", (F.col("_k") - F.col("_base")).cast("int")).alias("_at")))


def guides(sample: DataFrame, values, q: float, group) -> DataFrame:
    """One row per group: an interval (_a<i>, _b<i>) around the quantile ``q`` of each value, null where the sample is too small for one."""
    # five standard deviations of a rank in a sample of m values, and the sketch's own error
    widths = [w for w in (0.002, 0.004, 0.008, 0.016, 0.03, 0.06, 0.12, 0.25) if w < min(q, 1 - q)]
    at = [q - w for w in widths] + [q + w for w in widths]
    some = sample.groupBy(*group).agg(
        *[x for i, v in enumerate(values) for x in (F.count(v).alias(f"_m{i}"), F.percentile_approx(v, at, 2000).alias(f"_p{i}"))])
    edges = []
    for i in range(len(values)):
        need = F.try_divide(F.lit(5 * math.sqrt(q * (1 - q))), F.sqrt(f"_m{i}")) + 0.001
        low = high = None
        for k, w in enumerate(widths):
            a, b = F.get(f"_p{i}", F.lit(k)), F.get(f"_p{i}", F.lit(len(widths) + k))
            low, high = (F.when(need <= w, a), F.when(need <= w, b)) if low is None else (low.when(need <= w, a), high.when(need <= w, b))
        edges += [F.lit(None).cast("double").alias(f"_a{i}") if low is None else low.alias(f"_a{i}"), F.lit(None).cast("double").alias(f"_b{i}") if high is None else high.alias(f"_b{i}")]
    return cut_lineage(some.select(*group, *edges))


def guided_quantile(df: DataFrame, values, q: float, group, *, by, part: int = 64, gathered: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per group: (group, n, <value>) with the exact quantile ``q`` of each value, linear between ranks; for few groups of very many rows.

    Null and NaN values are left out, ``n`` counts all rows. A sample (one row in ``part`` by the hash of the columns ``by``) only says where to look:
    it gives an interval around each quantile, all rows are counted against it, and the rank is selected among the values inside. A group whose
    rank lies outside after all goes the whole way of ``grouped_quantiles``. ``df`` is read three times and not stored.
    """
    group, values = list(group), list(values)
    df = df.withColumns({v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")) for v in values})
    guide = guides(df.filter(F.pmod(F.xxhash64(*by), F.lit(part)) == 0), values, q, group)
    infinite = F.lit(float("inf"))
    rows = _null_safe(df.select(*group, *values), F.broadcast(guide), group)
    rows = rows.withColumns({f"_{e}{i}": F.coalesce(f"_{e}{i}", w) for i in range(len(values)) for e, w in (("a", -infinite), ("b", infinite))})
    within = [(F.col(v) > F.col(f"_a{i}")) & (F.col(v) < F.col(f"_b{i}")) for i, v in enumerate(values)]
    total = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[x for i, v in enumerate(values) for x in (
        F.count(v).alias(f"_n{i}"), F.count_if(F.col(v) < F.col(f"_a{i}")).alias(f"_under{i}"), F.count_if(F.col(v) == F.col(f"_a{i}")).alias(f"_low{i}"),
        F.count_if(within[i]).alias(f"_mid{i}"), F.count_if((F.col(v) == F.col(f"_b{i}")) & (F.col(f"_a{i}") < F.col(f"_b{i}"))).alias(f"_high{i}"),
        F.first(f"_a{i}").alias(f"_a{i}"), F.first(f"_b{i}").alias(f"_b{i}"))])
    total = cut_lineage(total)
    middle = rows.filter(reduce(operator.or_, within)).select(*group, F.explode(F.array_compact(F.array(*[
        F.when(w, F.struct(F.lit(i).alias("_c"), F.col(v).alias("_v"))) for i, (v, w) in enumerate(zip(values, within))]))).alias("_x")).select(*group, "_x.*")
    middle = cut_lineage(middle)
    out, missed = ranked(total, middle, values, q, group, gathered=gathered, buckets=buckets)
    if missed.isEmpty():
        return out
    again = grouped_quantiles(_null_safe(df, F.broadcast(missed), group, "left_semi"), values, [q], group, gathered=gathered, buckets=buckets)
    again = _null_safe(total.select(*group, "n"), again, group, "inner").select(*group, "n", *[F.get(v, F.lit(0)).alias(v) for v in values])
    return _null_safe(out, missed, group, "left_anti").unionByName(again)


def ranked(total: DataFrame, middle: DataFrame, values, q: float, group, *, gathered: int | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Quantiles (group, n, <value>) read off counts and the values inside the intervals, and the groups whose rank lies outside.

    ``total`` has for each value its number _n<i>, the interval (_a<i>, _b<i>) and how many values lie below it, on its ends and inside
    (_under<i>, _low<i>, _mid<i>, _high<i>); ``middle`` has those inside (group, _c, _v), _c being the value's place. The groups are few: the driver
    finds the part of the counts that holds a rank.
    """
    spark, kinds = total.sparkSession, ", ".join(f"`{c}` {total.schema[c].dataType.simpleString()}" for c in group)
    lines, wanted, known, missed = total.collect(), [], {}, []
    for r in lines:
        name, out = tuple(r[c] for c in group), False
        for i in range(len(values)):
            n, under, low, mid, high, a, b = (r[f"_{c}{i}"] for c in ("n", "under", "low", "mid", "high", "a", "b"))
            place = q * (n - 1)
            for k in {math.floor(place), math.ceil(place)} if n else ():
                if under <= k < under + low:
                    known[name, i, k] = a
                elif under + low <= k < under + low + mid:
                    wanted.append((*name, i, k, under + low, a, b, mid))
                elif under + low + mid <= k < under + low + mid + high:
                    known[name, i, k] = b
                else:
                    out = True
        if out:
            missed.append(name)
    key = [*group, "_c"]
    if wanted:
        ranges = spark.createDataFrame(wanted, (f"{kinds}, " if kinds else "") + "_c int, _k long, _base long, _lo double, _hi double, _size long")
        for r in _selected(middle, ranges, key, gathered or GATHERED, buckets or BUCKETS).collect():
            known[tuple(r[c] for c in group), r["_c"], r["_k"]] = r["_at"]

    def at(name, i, n):
        if not n or name in missed:
            return None
        place = q * (n - 1)
        low, part = math.floor(place), place - math.floor(place)
        return known[name, i, low] if part == 0 else known[name, i, low] * (1 - part) + known[name, i, math.ceil(place)] * part

    rows = [(*(name := tuple(r[c] for c in group)), r["n"], *[at(name, i, r[f"_n{i}"]) for i in range(len(values))]) for r in lines]
    out = spark.createDataFrame(rows, (f"{kinds}, " if kinds else "") + ", ".join(["n long", *[f"`{v}` double" for v in values]]))
    return out, total.select(*group).limit(0) if not missed else spark.createDataFrame(missed, kinds)


def _null_safe(left: DataFrame, right: DataFrame, key, how: str = "left") -> DataFrame:
    """Equality join in which null keys are equal."""
    r = right.select(*[F.col(c).alias(f"_r{c}") for c in key], *[c for c in right.columns if c not in key])
    cond = F.lit(True)
    for c in key:
        cond &= F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return left.join(r, cond, how).drop(*[f"_r{c}" for c in key])


def _inside(rows: DataFrame, ranges: DataFrame, key) -> DataFrame:
    """Values with every range of their group that holds them."""
    if ranges.count() <= BROADCAST_RANKS:
        ranges = F.broadcast(ranges)
    return _null_safe(rows, ranges, key, "inner").filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrowed(inside: DataFrame, key, buckets: int) -> DataFrame:
    """The ranges, each cut to the bucket that has its rank."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    # halves keep the width of any two finite values finite; an infinite end is a bucket of its own
    part = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    infinite = F.lit(float("inf"))
    bucket = F.when(v == lo, -1000).when(v == hi, buckets + 1000).when((lo == -infinite) | (hi == infinite), F.signum(v) * F.floor(F.log2(1 + F.abs(v)) / 4) + buckets / 2)
    bucket = bucket.otherwise(1 + F.least(F.floor(part * buckets), F.lit(buckets - 1)))
    mine = [*key, "_k", "_base"]
    counts = inside.groupBy(*mine, bucket.cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = F.sum("_size").over(W.partitionBy(*mine).orderBy("_b").rowsBetween(W.unboundedPreceding, 0))  # buckets of one range
    hit = counts.withColumn("_below", F.col("_base") + upto - F.col("_size"))
    hit = hit.filter((F.col("_k") >= F.col("_below")) & (F.col("_k") < F.col("_below") + F.col("_size")))
    return hit.select(*key, "_k", F.col("_below").alias("_base"), "_lo", "_hi", "_size")
