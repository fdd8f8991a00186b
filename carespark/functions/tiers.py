"""Alert tiers shared by batch and streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import cascade

# Clinical thresholds.
SPO2_LIMITS = {"CRITICAL": 85.0, "URGENT": 90.0, "WARNING": 94.0}
PULSE_HIGH = {"CRITICAL": 150.0, "URGENT": 130.0, "WARNING": 110.0}
PULSE_LOW = {"CRITICAL": 40.0, "URGENT": 45.0, "WARNING": 50.0}
TIERS = ["CRITICAL", "URGENT", "WARNING"]
HIGH_RISK_CODES = ["13645005", "84114007", "195967001", "233604007", "59621000"]


def tier_rank(tier: Column) -> Column:
    """Severity order; plain alphabetical order is wrong for some tier sets."""
    return cascade([(tier == t, i + 1) for i, t in enumerate(TIERS)], 4)


def spo2_tier(low: Column) -> Column:
    """Tier of the lowest saturation; null when nothing is breached."""
    return cascade([(low < SPO2_LIMITS[t], t) for t in TIERS], F.lit(None))


def spo2_threshold(tier: Column) -> Column:
    return cascade([(tier == t, SPO2_LIMITS[t]) for t in TIERS[:2]], SPO2_LIMITS["WARNING"])


def pulse_tier(low: Column, high: Column) -> Column:
    """Tier of a pulse range; null when nothing is breached."""
    return cascade(
        [((high > PULSE_HIGH[t]) | (low < PULSE_LOW[t]), t) for t in TIERS], F.lit(None)
    )


def pulse_threshold(tier: Column, is_high: Column) -> Column:
    side = lambda t: F.when(is_high, F.lit(PULSE_HIGH[t])).otherwise(F.lit(PULSE_LOW[t]))
    return cascade([(tier == t, side(t)) for t in TIERS[:2]], side("WARNING"))


def worst(a: Column, b: Column) -> Column:
    """Higher of two tiers, WARNING as the floor."""
    return cascade([((a == t) | (b == t), t) for t in TIERS[:2]], "WARNING")


def escalate(tier: Column, high_risk: Column) -> Column:
    """One step up for patients with a qualifying condition."""
    return (
        F.when(high_risk & (tier == "URGENT"), F.lit("CRITICAL"))
        .when(high_risk & (tier == "WARNING"), F.lit("URGENT"))
        .otherwise(tier)
    )
