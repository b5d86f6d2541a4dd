"""Does the study ceiling contain the climb-outs and their encounters?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..settings import VOLUME, Volume


def ceiling_check(heights: DataFrame, encounter_heights: DataFrame, charted_ft: float, *, mode: str = "auto",
                  cfg: Volume = VOLUME) -> DataFrame:
    """One row: 95th percentile of event heights, spill shares and effective ceiling.

    Both inputs have one column ``h``. Every ceiling that can be reached (the
    charted one or a full step, then in steps up to the cap) is counted in one
    pass; the decision is then array logic on a single row.
    """
    step, cap, charted = cfg.ceiling_step_ft, cfg.ceiling_cap_ft, float(charted_ft)
    top = max(cap, charted)
    options = sorted({charted + step * i for i in range(int((top - charted) // step) + 1)}
                     | {step * i for i in range(int(top // step) + 1) if step * i >= charted} | {charted, cap})
    event, tall = F.when(F.col("src") == 0, F.col("h")), F.when(F.col("src") == 1, F.col("h"))
    both = heights.select("h", F.lit(0).alias("src")).unionByName(encounter_heights.select("h", F.lit(1).alias("src")))
    row = both.agg(
        F.percentile(event, F.lit(0.95)).alias("p95"), F.count(event).alias("n_events"), F.count(tall).alias("n_encounters"),
        *[F.count_if((F.col("src") == 1) & (F.col("h") > c)).alias(f"_n{i}") for i, c in enumerate(options)],
    )
    n = F.greatest(F.col("n_encounters"), F.lit(1)).cast("double")
    spills = F.array(*[F.struct(F.lit(float(c)).alias("c"), (F.col(f"_n{i}") / n).alias("s")) for i, c in enumerate(options)])

    def spill(c):
        return F.filter(spills, lambda o: o["c"] == c)[0]["s"]

    row = row.withColumn("contained", (F.col("n_events") == 0) | (F.col("p95") <= charted))
    row = row.withColumns({
        "spill_charted": spill(F.lit(charted)),
        "start_ft": F.when(F.col("contained"), F.lit(charted)).otherwise(
            F.least(F.greatest(F.lit(charted), F.ceil(F.col("p95") / step) * step), F.lit(float(cap)))),
    })
    grid = F.filter(spills, lambda o: (o["c"] >= F.col("start_ft")) & (o["c"] <= cap)
                    & (F.pmod(o["c"] - F.col("start_ft"), F.lit(float(step))) == 0))
    good = F.filter(grid, lambda o: o["s"] <= cfg.ceiling_spill_max)
    reached = F.coalesce(F.get(good, F.lit(0))["c"], F.element_at(grid, -1)["c"], F.col("start_ft"))
    raised = F.greatest(F.lit(charted), reached)
    fine = F.col("contained") & (F.col("spill_charted") <= cfg.ceiling_spill_max)
    if mode == "fixed":
        raised = F.lit(charted)
    row = row.withColumn("effective_ft", F.when(fine, F.lit(charted)).otherwise(raised))
    row = row.withColumns({
        "spill_effective": spill(F.col("effective_ft")), "raised": F.col("effective_ft") > charted,
        "reason": F.when(fine, "charted ceiling used").when(F.lit(mode == "fixed"), "fixed: charted ceiling kept")
        .when(F.col("contained"), "raised until spill within limit").otherwise("raised to contain climb-outs"),
    })
    return row.select("p95", "n_events", "n_encounters", "contained", "spill_charted", "spill_effective",
                      "effective_ft", "raised", "reason").withColumnRenamed("p95", "p95_height_ft")
