"""Target profiles: branches, colour match and constraint penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What branches A (softer) and C (deeper) add to each feature, and the ranges features stay in.
DELTAS = {
    "A": {"meanLightness": 0.08, "meanChroma": -0.02, "contrast": -0.08, "visualWeight": -0.08, "neutralRatio": 0.08, "darkRatio": -0.07},
    "B": {},
    "C": {"meanLightness": -0.08, "meanChroma": 0.015, "contrast": 0.10, "visualWeight": 0.08, "darkRatio": 0.07},
}
TEMPERATURE_FACTOR = {"A": 0.75, "B": 1.0, "C": 1.0}
RANGES = {"meanLightness": (0.0, 1.0), "meanChroma": (0.0, 0.33), "temperature": (-1.0, 1.0), "contrast": (0.0, 1.0), "visualWeight": (0.0, 1.0), "neutralRatio": (0.0, 1.0), "darkRatio": (0.0, 1.0)}


def branches(profiles: DataFrame) -> DataFrame:
    """Three rows (branch A, B, C) for each profile: the features it has, moved and kept in range."""
    have = [f for f in RANGES if f in profiles.columns]

    def moved(code: str) -> list[Column]:
        out = []
        for f in have:
            v = F.col(f) * TEMPERATURE_FACTOR[code] if f == "temperature" else F.col(f) + DELTAS[code].get(f, 0.0)
            low, high = RANGES[f]
            out.append(F.least(F.greatest(v, F.lit(low)), F.lit(high)).alias(f))
        return out

    one = F.explode(F.array(*(F.struct(F.lit(code).alias("branch"), *moved(code)) for code in DELTAS))).alias("b")
    return profiles.select(*(c for c in profiles.columns if c not in have), one).select(*(c for c in profiles.columns if c not in have), "b.*")


def colour_match(targets: dict[str, tuple[float, float, float]], neutral: float = 0.62) -> Column:
    """Weighted mean of 1 - min(1, |value - target| / tolerance) over the features a row has; targets: (target, weight, tolerance)."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for f, (target, weight, tolerance) in targets.items():
        known = F.col(f).isNotNull()
        total = total + F.when(known, (1 - F.least(F.lit(1.0), F.abs(F.col(f) - target) / tolerance)) * weight).otherwise(0.0)
        weights = weights + F.when(known, weight).otherwise(0.0)
    return F.when(weights > 0, total / weights).otherwise(neutral)


def constraint_penalty(limits: list[tuple[str, str, float, float, float]]) -> Column:
    """Weighted mean violation in 0..1; limits: (feature, maximum or minimum, threshold, tolerance, weight)."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for f, mode, threshold, tolerance, weight in limits:
        over = (F.col(f) - threshold) if mode == "maximum" else (threshold - F.col(f))
        part = F.least(F.greatest(over / max(1e-4, tolerance), F.lit(0.0)), F.lit(1.0))
        total = total + F.coalesce(part, F.lit(0.0)) * max(0.1, weight)
        weights = weights + F.when(F.col(f).isNotNull(), max(0.1, weight)).otherwise(0.0)
    return F.when(weights > 0, total / weights).otherwise(0.0)


def clamp_to(target: Column, mode: str, threshold: float) -> Column:
    """A target moved inside one constraint."""
    return F.least(target, F.lit(threshold)) if mode == "maximum" else F.greatest(target, F.lit(threshold))


# The hint a branch gives for a feature that rises or falls by this much or more, and what it weighs.
HINT_STEP = 0.05
HINTS = [("meanLightness", "soft light", "low key", 0.85), ("contrast", "dramatic contrast", "soft contrast", 0.80), ("visualWeight", "moody atmosphere", "airy atmosphere", 0.75)]


def branch_hints(most: int = 2) -> Column:
    """Up to two hints, as structs (term, weight), from columns delta_<feature>."""
    one = [F.when(F.col(f"delta_{f}") >= HINT_STEP, F.struct(F.lit(up).alias("term"), F.lit(w).alias("weight"))).when(F.col(f"delta_{f}") <= -HINT_STEP, F.struct(F.lit(down).alias("term"), F.lit(w).alias("weight"))) for f, up, down, w in HINTS]
    return F.slice(F.array_compact(F.array(*one)), 1, most)
