"""Small helpers shared by the catalogue modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers widened to bigint, so that both engines agree."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)


def r(*names: str, digits: int = 6) -> str:
    """The same rounding for a list of SQL columns: 'expr' or 'expr AS name'."""
    out = []
    for n in names:
        expr, _, alias = n.partition(" AS ")
        out.append(f"round({expr}, {digits}) + 0.0 AS {alias or expr}")
    return ", ".join(out)
