"""Reusable checks between and within DataFrames: uniqueness, references, agreement, containment, limits and reconciliation.

All are joins and aggregates on the keys given; a partition column is just one more key. Comparisons are null-safe. Where
an aggregate meets its dimension the aggregate is taken first, so what is shuffled and joined is as small as the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """rows with ``occurrence``: 1 for the first of its key."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def duplicates(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Every occurrence of a key after the first."""
    return occurrence(rows, keys, order).filter("occurrence > 1")


def first_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return occurrence(rows, keys, order).filter("occurrence = 1").drop("occurrence")


def orphans(rows: DataFrame, referenced: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is missing from the referenced side."""
    return rows.join(referenced.select(*keys).distinct(), keys, "left_anti")


def disagreements(rows: DataFrame, referenced: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Rows joined to their reference with ``<column>_differs`` for each pair (column of rows, column of the reference), where any differs."""
    joined = rows.join(referenced, keys)
    for a, b in columns.items():
        joined = joined.withColumn(f"{a}_differs", ~F.col(a).eqNullSafe(F.col(b)))
    bad = F.lit(False)
    for a in columns:
        bad = bad | F.col(f"{a}_differs")
    return joined.filter(bad)


def outside(value: Column, low: Column, high: Column, closed: bool = True) -> Column:
    """The value is known and not in [low, high], or [low, high) if not closed; an unknown bound is open."""
    over = (value > high) if closed else (value >= high)
    return F.coalesce(value < low, F.lit(False)) | F.coalesce(over, F.lit(False))


def above_limit(rows: DataFrame, keys: list[str], dimension: DataFrame, limit: str) -> DataFrame:
    """Keys with more rows than their dimension's limit allows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(dimension, keys).filter(F.col("n") > F.col(limit))


def reconcile(declared: DataFrame, actual: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Keys whose declared value isn't the actual one, ``declared`` and ``actual`` side by side. A side without the key counts as null, so a declared zero differs from nothing."""
    d = declared.select(*keys, F.col(value).alias("declared"))
    a = actual.select(*keys, F.col(value).alias("actual"))
    return d.join(a, keys, "full_outer").filter(~F.col("declared").eqNullSafe(F.col("actual")))


def nonzero_sums(rows: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """Sums by key without zeros: what a declared count map must equal."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("n")).filter("n <> 0")


def incomplete(members: DataFrame, key: str, member: str, required: list[str]) -> DataFrame:
    """Keys whose set of members isn't exactly the required one."""
    have = members.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("have"))
    return have.filter(F.col("have") != F.array(*map(F.lit, sorted(required))))
