"""Result tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..settings import GO_AROUND_OUTCOMES


def write_days(df: DataFrame, path: str, files_per_day: int = 8) -> None:
    """Parquet partitioned by day; only the days in ``df`` are replaced. A day is written by up to ``files_per_day`` tasks."""
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c != "day"]), F.lit(files_per_day))
    (df.repartition(F.col("day"), part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def write_tables(tables: dict, folder: str, fmt: str = "parquet") -> None:
    """One folder per named result table."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.option("header", "true").csv(f"{folder}/{name}") if fmt == "csv" else w.parquet(f"{folder}/{name}")


def write_approaches(apps: DataFrame, folder: str) -> None:
    """All approaches, and the go-arounds among them, per day."""
    write_days(apps, f"{folder}/all_approaches")
    write_days(apps.filter(F.col("outcome").isin(*GO_AROUND_OUTCOMES)), f"{folder}/go_around_events")


def write_baseline(spark: SparkSession, result: dict, windows: DataFrame, folder: str) -> None:
    """Model parameters, windows, removed windows and validation tables."""
    models = None
    for m in result["models"].values():
        row = m.params(spark)
        models = row if models is None else models.unionByName(row)
    tables = {"models": models, "windows": windows, **result["tables"]}
    tables |= {f"phase1_removed_{k}": v for k, v in result["removed"].items() if v is not None}
    write_tables(tables, folder)


def load_models(spark: SparkSession, folder: str) -> dict:
    """Stored models by metric (a handful of parameter rows)."""
    import json

    from ..operators.glm import CountModel

    return {
        r["metric"]: CountModel(r["metric"], r["kind"], dict(r["coef"] or {}), r["alpha"], r["pooled_rate"], r["n_windows"], r["n_events"],
                                r["hour_block_h"], r["dispersion_p"], json.loads(r["notes"]))
        for r in spark.read.parquet(f"{folder}/models").collect()
    }
