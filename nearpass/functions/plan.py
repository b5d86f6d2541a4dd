"""Plan shaping helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F


def pin(df: DataFrame, cols: dict) -> DataFrame:
    """Add long expressions as columns that are computed exactly once.

    The optimizer copies a projected expression into every later filter or
    aggregate that reads it. For expressions of some hundred nodes the copies
    exceed the size limit of one generated method and the stage falls back to
    interpreted evaluation. A one-element explode is a boundary it does not
    copy across; it costs one array per row.
    """
    drop = [c for c in cols if c in df.columns]
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.withColumn("_pin", one).drop(*drop).select("*", "_pin.*").drop("_pin")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a small intermediate result to the checkpoint folder and continue from there.

    Iterative steps and tables that many later branches read would otherwise
    repeat their whole plan in every branch. The folder is the one the session
    names in spark.checkpoint.dir; only where none is set (tests, one machine)
    a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)
