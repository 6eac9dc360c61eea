"""Ranking by seven signals. Only the signals' names are given; weights and thresholds are parameters, and ours."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.relational import numbered_by_range

SIGNALS = ("entrypoint_exposure", "downstream_impact", "structural_centrality", "external_side_effects", "documentation_gap", "test_coverage_signal", "git_churn_recency")


def composite(weights: dict[str, float]) -> Column:
    """The weighted sum as decimal(6,3)."""
    return reduce(add, [F.col(s).cast("decimal(6,3)") * F.lit(w).cast("decimal(4,2)") for s, w in weights.items()]).cast("decimal(6,3)")


def reasons(threshold: float, signals: tuple[str, ...] = SIGNALS) -> Column:
    """The names of the signals that reach the threshold."""
    return F.filter(F.array(*[F.when(F.col(s) >= threshold, F.lit(s)) for s in signals]), lambda r: r.isNotNull())


def rank(df: DataFrame, score: str, ident: str, partition: str | None = None) -> DataFrame:
    """rank by falling score, ties by ident, in each partition or over all rows; neither is gathered in one task."""
    return numbered_by_range(df, [partition] if partition else [], F.desc(score), F.asc(ident), name="rank")


def rank_by_role(scores: DataFrame, roles: DataFrame, ident: str) -> DataFrame:
    """scores ranked for each role by score * weight; roles (role, kind, weight) is small and joined by kind."""
    weighted = scores.join(roles, "kind").withColumn("role_score", (F.col("score") * F.col("weight")).cast("decimal(12,3)"))
    return rank(weighted, "role_score", ident, "role")
