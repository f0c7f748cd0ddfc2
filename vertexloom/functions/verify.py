"""Comparisons of two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mismatches(a: DataFrame, b: DataFrame, value: str, key: str = "id") -> DataFrame:
    """(key, left, right): rows whose values differ, or that only one side has."""
    left, right = a.select(key, F.col(value).alias("left")), b.select(key, F.col(value).alias("right"))
    return left.join(right, key, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def verify_exact(a: DataFrame, b: DataFrame, value: str, key: str = "id") -> DataFrame:
    """One row: n_mismatch."""
    return mismatches(a, b, value, key).agg(F.count("*").alias("n_mismatch"))


def verify_tolerance(a: DataFrame, b: DataFrame, value: str = "rank", tol: float = 0.005, key: str = "id") -> DataFrame:
    """One row: n_mismatch, rows that differ by more than tol; NaN and missing values count as differing."""
    left, right = a.select(key, F.col(value).alias("left")), b.select(key, F.col(value).alias("right"))
    near = F.abs(F.col("left") - F.col("right")) <= tol
    bad = ~F.coalesce(near, F.lit(False)) | F.isnan("left") | F.isnan("right")
    return left.join(right, key, "full").where(bad).agg(F.count("*").alias("n_mismatch"))
