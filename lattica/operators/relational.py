"""Projection, equi-join and aggregation as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MAX": F.max, "MIN": F.min}


def projected(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields that exist, in their order; if none does, the table as it is."""
    there = [f for f in fields if f in df.columns]
    return df.select(*[F.col(f"`{f}`") for f in there]) if there else df


def joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, kind: str = "INNER") -> DataFrame:
    """Equi-join on one pair of keys; null keys match nothing.

    Keys of one name give one column (for RIGHT the right side's value); other names that both sides have get the
    suffix ``_right`` on the right side's copy.  No side is counted or forced to broadcast: its size decides at run time.
    """
    for df, key, side in ((left, left_key, "left"), (right, right_key, "right")):
        if key not in df.columns:
            raise ValueError(f"no {side} join key '{key}' among {df.columns}")
    taken, renamed = set(left.columns), {}
    for c in right.columns:
        if c in taken and not (c == right_key == left_key):
            new = f"{c}_right"
            while new in taken or new in right.columns:
                new += "_right"
            renamed[c] = new
            taken.add(new)
    right = right.withColumnsRenamed(renamed)
    if left_key == right_key:
        return left.join(right, left_key, kind.lower())
    return left.join(right, left[left_key] == right[renamed.get(right_key, right_key)], kind.lower())


def aggregated(df: DataFrame, group_by: Sequence[str], functions: Sequence[dict]) -> DataFrame:
    """Group keys and aggregates, each named by its alias or FUNC_column; without keys one row."""
    found = []
    for f in functions:
        name, column = f["func"].upper(), f["column"]
        if name not in AGGREGATES:
            raise ValueError(f"unknown aggregate '{name}'")
        if column == "*" and name != "COUNT":
            raise ValueError(f"{name}(*) has no meaning")
        if column != "*" and column not in df.columns:
            raise ValueError(f"no column '{column}' to aggregate among {df.columns}")
        found.append(AGGREGATES[name](F.lit(1) if column == "*" else F.col(f"`{column}`")).alias(f.get("alias") or f"{name}_{'all' if column == '*' else column}"))
    missing = [k for k in group_by if k not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} to group by among {df.columns}")
    return df.groupBy(*group_by).agg(*found) if group_by else df.agg(*found)
