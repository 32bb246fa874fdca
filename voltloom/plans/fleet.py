"""The batch fleet run: telemetry rows to one report per battery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from voltloom.operators import guardian, scores, usage


def behaviour(telemetry: DataFrame, rated_ah: float | Column = usage.RATED_AH) -> DataFrame:
    return usage.with_stress(usage.with_flags(telemetry, rated_ah))


def scored(summary: DataFrame, on_null: str = "raise", scope: str = "fleet") -> DataFrame:
    """Risk, health and ageing-factor life; both scores add columns to one summary row."""
    both = scores.risk_assessment(scores.health_index(summary, on_null), on_null)
    return scores.ageing_factor_life(both, scope)


def report(telemetry: DataFrame, rated_ah: float | Column = usage.RATED_AH,
           reference: str = "fleet", on_null: str = "raise") -> DataFrame:
    summary = usage.summarize_batteries(behaviour(telemetry, rated_ah))
    return guardian.guardian_report(scored(summary, on_null), reference)
