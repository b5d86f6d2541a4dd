"""Grouped summaries of the approach table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..settings import GO_AROUND_OUTCOMES, NON_ATTEMPTS


def _per_1000(n, total):
    return F.round(F.try_divide(1000 * n, total), 2)


def is_attempt():
    return ~F.col("outcome").isin(*NON_ATTEMPTS)


def outcome_shares(apps: DataFrame) -> DataFrame:
    """Count per outcome, share of all segments and of attempts (the outcomes are a fixed short list)."""
    per = apps.groupBy("outcome").agg(F.count(F.lit(1)).alias("count"))
    rows = per.agg(F.collect_list(F.struct("outcome", "count")).alias("r"), F.sum("count").alias("n_all"),
                   F.sum(F.when(is_attempt(), F.col("count"))).alias("n_att"))
    out = rows.select("n_all", "n_att", F.explode("r").alias("r")).select("r.*", "n_all", "n_att")
    return out.select(
        "outcome", "count", F.round(100 * F.col("count") / F.col("n_all"), 3).alias("pct_of_segments"),
        F.when(is_attempt(), F.round(100 * F.col("count") / F.col("n_att"), 3)).alias("pct_of_attempts"))


def by_runway(apps: DataFrame) -> DataFrame:
    o = F.col("outcome")
    rows = apps.filter(is_attempt() & (F.col("runway") != ""))
    out = rows.groupBy("runway").agg(
        F.count(F.lit(1)).alias("attempts"),
        *[F.count_if(o == n).alias(n) for n in ("go_around", "ga_ambiguous", "touch_and_go", "low_approach", "full_stop")])
    return out.withColumn("ga_per_1000", _per_1000(F.col("go_around"), F.col("attempts")))


def by_month(apps: DataFrame, month) -> DataFrame:
    o = F.col("outcome")
    out = apps.filter(is_attempt()).groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(o == "go_around").alias("go_around"),
        F.count_if(o == "ga_ambiguous").alias("ga_ambiguous"))
    return out.withColumn("ga_per_1000", _per_1000(F.col("go_around"), F.col("attempts")))


def headline(apps: DataFrame) -> DataFrame:
    out = apps.agg(F.count(F.lit(1)).alias("segments"), F.count_if(is_attempt()).alias("attempts"),
                   F.count_if(F.col("outcome") == "go_around").alias("go_arounds"))
    return out.withColumn("per_1000", _per_1000(F.col("go_arounds"), F.col("attempts")))


def by_local_hour(apps: DataFrame, hour) -> DataFrame:
    """Attempts and go-arounds per local hour, all 24 hours present."""
    per = apps.filter(is_attempt()).groupBy(hour.cast("bigint").alias("hour")).agg(
        F.count(F.lit(1)).alias("approaches"), F.count_if(F.col("outcome").isin(*GO_AROUND_OUTCOMES)).alias("ga"))
    hours = apps.sparkSession.range(24).withColumnRenamed("id", "hour")
    return hours.join(per, "hour", "left").fillna(0)


def runway_ranking(apps: DataFrame, minimum: int = 200) -> DataFrame:
    """Go-around rate of every runway; ``enough`` tells which have the attempts that a ranking needs."""
    per = apps.filter(is_attempt() & (F.col("runway") != "")).groupBy("runway").agg(
        F.count(F.lit(1)).alias("approaches"), F.count_if(F.col("outcome").isin(*GO_AROUND_OUTCOMES)).alias("ga"))
    return per.withColumns({"rate": 1000 * F.col("ga") / F.col("approaches"), "enough": F.col("approaches") >= minimum})


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, deviation and quartiles per column, long form, one pass."""
    aggs = []
    for c in cols:
        aggs.append(F.struct(
            F.lit(c).alias("metric"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("min"),
            F.percentile(c, F.lit(0.25)).alias("q25"), F.percentile(c, F.lit(0.5)).alias("q50"),
            F.percentile(c, F.lit(0.75)).alias("q75"), F.max(c).alias("max")))
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def next_actions(apps: DataFrame) -> DataFrame:
    return apps.filter(F.col("outcome").isin(*GO_AROUND_OUTCOMES)).groupBy("next_action").agg(F.count(F.lit(1)).alias("n"))


def plateau_histogram(apps: DataFrame, width: int = 3, top: float = 87.0,
                      outcomes=("go_around", "ga_ambiguous", "low_approach", "touch_and_go")) -> DataFrame:
    """Level durations per outcome in 3 s bins; the last bin is closed on the right."""
    bin_ = F.least(F.floor(F.least("level_s", F.lit(top)) / width), F.lit(int(top // width) - 1))
    return apps.filter(F.col("outcome").isin(*outcomes)).groupBy("outcome", (bin_ * width).alias("bin_s")).agg(F.count(F.lit(1)).alias("n"))
