"""Membership ramps of the rule language, as Columns and as SQL text.

A comparison `x >= t` with softness `s` is 1 from `t` on, 0 below `t - s`, and linear between; softness 0
is the crisp comparison. NULL (an absent metric) has membership 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def member_at_least(x: Column, threshold: float, soft: float = 0.0) -> Column:
    ramp = F.lit(0.0) if soft <= 0 else F.when(x >= threshold - soft, (x - (threshold - soft)) / soft).otherwise(0.0)
    return F.coalesce(F.when(x >= threshold, 1.0).otherwise(ramp), F.lit(0.0))


def member_at_most(x: Column, threshold: float, soft: float = 0.0) -> Column:
    ramp = F.lit(0.0) if soft <= 0 else F.when(x <= threshold + soft, (threshold + soft - x) / soft).otherwise(0.0)
    return F.coalesce(F.when(x <= threshold, 1.0).otherwise(ramp), F.lit(0.0))


def member_sql(x: str, threshold: float, soft: float = 0.0) -> str:
    if soft <= 0:
        return f"(CASE WHEN {x} >= {threshold} THEN 1.0 ELSE 0.0 END)"
    low = threshold - soft
    return f"(CASE WHEN {x} >= {threshold} THEN 1.0 WHEN {x} >= {low} THEN ({x} - {low}) / {soft} ELSE 0.0 END)"
