"""Daily report files and stored tables."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import file_stem, file_suffix
from ..settings import POSITION_TIME_COLUMNS, RAW_COLUMNS

NUMERIC = ("latitude", "longitude", "altitude", "geoaltitude", "vertical_rate", "groundspeed", "track")


def daily_files(spark: SparkSession, folder: str) -> DataFrame:
    """Daily files (path, stem, suffix) below a folder; Parquet wins over CSV of the same day.

    Hidden path parts are skipped; two files of one kind for one day raise.
    Only paths are read, never contents.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
        .withColumns({"stem": file_stem(F.col("path")), "suffix": file_suffix(F.col("path"))})
        .filter(F.col("suffix").isin("csv", "parquet"))
    )
    root = folder.rstrip("/").removeprefix("file:")
    inner = F.regexp_replace("path", "^.*?" + re.escape(root) + "/", "")
    files = files.filter(~F.regexp_like(inner, F.lit(r"(^|/)\.")))
    twice = files.groupBy("stem", "suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two daily files named {twice[0]['stem']}.{twice[0]['suffix']}; keep only one")
    pick = files.groupBy("stem").agg(F.max_by(F.struct("path", "suffix"), "suffix").alias("f"))
    return pick.select("stem", "f.path", "f.suffix")


def missing_columns(columns) -> list:
    return [c for c in RAW_COLUMNS if c not in columns]


def _layouts(spark: SparkSession, files: DataFrame) -> list[tuple]:
    """(file row, columns with types) of every daily file, from headers and footers only, several files at a time."""
    rows = files.orderBy("stem").collect()  # file names only
    if any(f["suffix"] == "parquet" for f in rows):
        # files written by pandas hold nanosecond timestamps, which Spark reads only as integers, and only by this setting
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    with ThreadPoolExecutor(16) as pool:
        return list(zip(rows, pool.map(lambda f: tuple(_open(spark, [f["path"]], f["suffix"]).dtypes), rows)))


def schema_audit(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row per file with its missing columns; a bad file is reported, not raised."""
    rows = []
    for f, columns in _layouts(spark, files):
        gone = missing_columns([c for c, _ in columns])
        rows.append((f["stem"], f["path"], f["suffix"], not gone, ", ".join(gone)))
    return spark.createDataFrame(rows, "stem string, path string, suffix string, ok boolean, missing string")


def _open(spark, paths, suffix) -> DataFrame:
    return spark.read.option("header", "true").csv(paths) if suffix == "csv" else spark.read.parquet(*paths)


def typed_reports(df: DataFrame) -> DataFrame:
    """Raw columns with their types; bad numbers and NaN become null, rows without position go.

    ``position_time`` (epoch seconds) is the first of the known position-time columns that has a value in the row.
    """
    gone = missing_columns(df.columns)
    if gone:
        raise ValueError(f"missing required columns {gone}")
    cols = {c: F.col(c).try_cast("double") for c in NUMERIC}
    cols = {c: F.when(~F.isnan(v), v) for c, v in cols.items()}
    kinds = dict(df.dtypes)
    if kinds["timestamp"] == "bigint":
        ts = F.timestamp_micros(F.floor(F.col("timestamp") / 1000))
    else:
        ts = F.col("timestamp").try_cast("timestamp")
    out = {"timestamp": ts, "icao24": F.col("icao24").cast("string"), "callsign": F.col("callsign").cast("string"), **cols,
           "onground": F.coalesce(F.col("onground").try_cast("boolean"), F.lit(False))}
    known = []
    for name in POSITION_TIME_COLUMNS:
        if name in df.columns:
            pt = F.col(name).try_cast("double")
            if kinds[name].startswith("timestamp"):
                pt = F.unix_micros(F.col(name).cast("timestamp")) / 1e6
            elif kinds[name] == "bigint":
                pt = F.when(pt > 1e14, pt / 1e9).otherwise(pt)
            known.append(F.when(~F.isnan(pt), pt))
    if known:
        out["position_time"] = F.coalesce(*known)
    keep = ["day"] if "day" in df.columns else []
    return df.select(*keep, *[c.alias(n) for n, c in out.items()]).dropna(subset=["latitude", "longitude"])


def load_reports(spark: SparkSession, files: DataFrame) -> DataFrame:
    """All daily files as one table partitioned by ``day`` (the file stem).

    Files are read in groups of one layout (column names, order and types), each with its own columns, so files that order
    their columns differently or name the position time differently keep their values. A file without a required column raises.
    """
    groups: dict[tuple, list[str]] = {}
    for f, columns in _layouts(spark, files):
        gone = missing_columns([c for c, _ in columns])
        if gone:
            raise ValueError(f"{f['path']}: missing required columns {gone}")
        groups.setdefault((f["suffix"], columns), []).append(f["path"])
    if not groups:
        raise FileNotFoundError("no daily .parquet or .csv files")
    parts = [typed_reports(_open(spark, paths, suffix).withColumn("day", file_stem(F.col("_metadata.file_path")))) for (suffix, _), paths in groups.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


APPROACH_SCHEMA = (
    "day string, leg_id string, icao24 string, callsign string, runway string, approach_start_utc timestamp, approach_end_utc timestamp, outcome string, "
    "touchdown boolean, coverage_truncated boolean, min_agl_ft double, t_low_utc timestamp, climb_start_utc timestamp, next_action string, next_gap_s double"
)


def read_approaches(spark: SparkSession, path: str, outcomes=None) -> DataFrame:
    """Stored approach table; empty text for unknown callsign or runway."""
    df = spark.read.schema(APPROACH_SCHEMA).option("header", "true").csv(path).fillna("", ["callsign", "runway"])
    return df.filter(F.col("outcome").isin(*outcomes)) if outcomes else df


def day_table(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """A stored per-day table, pruned to one day partition when asked."""
    df = spark.read.parquet(path)
    return df.filter(F.col("day") == day) if day else df
