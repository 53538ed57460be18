"""Per-image figures from weighted pixels or swatches with OKLCH columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.functions import color as c
from huestrata.functions.stats import nearest_rank


def image_metrics(pixels: DataFrame, key: str, weight: str) -> DataFrame:
    """Weighted lightness and chroma, ratios, nearest-rank contrast, hue vector, temperature and visual weight of each image."""
    w, C, H, L = F.col(weight), F.col("C"), F.col("H"), F.col("L")
    share = lambda test: F.sum(F.when(test, w).otherwise(0.0)) / F.sum(w)
    hued = (C >= 0.018) & H.isNotNull()
    hue_weight = F.sum(F.when(hued, C * w).otherwise(0.0))
    vector = lambda f: F.when(hue_weight > 0, F.sum(F.when(hued, f * C * w).otherwise(0.0)) / hue_weight).otherwise(0.0)
    m = pixels.groupBy(key).agg(
        (F.sum(L * w) / F.sum(w)).alias("mean_lightness"), (F.sum(C * w) / F.sum(w)).alias("mean_chroma"), share(C < 0.04).alias("neutral_ratio"), share(L < 0.32).alias("dark_ratio"), share(C > 0.14).alias("high_chroma_ratio"),
        vector(F.cos(F.radians(H))).alias("hue_x"), vector(F.sin(F.radians(H))).alias("hue_y"), vector(F.cos(F.radians(H - 60))).alias("temperature"),
    )
    hi, lo = nearest_rank(pixels, [key], "L", 0.9, name="hi"), nearest_rank(pixels, [key], "L", 0.1, name="lo")
    m = m.join(hi, key).join(lo, key).withColumn("contrast", c.clamp(F.col("hi") - F.col("lo"))).drop("hi", "lo")
    return m.withColumn("visual_weight", c.clamp((1 - F.col("mean_lightness")) * 0.5 + F.col("dark_ratio") * 0.34 + c.clamp(F.col("mean_chroma") / 0.22) * 0.16))


def palette_metrics(colours: DataFrame, key: str) -> DataFrame:
    """Per palette (key, id, L, a, bb, C, ratio): dominant, significant, entropy, spread and accent."""
    from huestrata.operators.relations import all_pairs

    share = F.col("ratio")
    accent = (share <= 0.28) & ((F.col("C") > 0.11) | (F.abs(F.col("L") - 0.5) > 0.24))
    e = colours.groupBy(key).agg(
        F.max("ratio").alias("dominant"), F.count_if(share >= 0.08).alias("significant"), c.clamp(-F.sum(share * F.ln(share)) / F.ln(F.greatest(F.lit(2), F.count(F.lit(1))).cast("double"))).alias("entropy"), F.sum(F.when(accent, share).otherwise(0.0)).alias("accent"),
    )
    p = all_pairs(colours, ["id", "L", "a", "bb", "ratio"], [key]).withColumn("_w", F.sqrt(F.col("ratio_1") * F.col("ratio_2")))
    d = c.delta_e(*(F.col(f"{x}_{k}") for k in (1, 2) for x in ("L", "a", "bb")))
    spread = p.groupBy(F.col(f"{key}_1").alias(key)).agg((F.sum(F.col("_w") * d) / F.sum("_w")).alias("spread"))
    return e.join(spread, key, "left").withColumn("spread", c.clamp(F.coalesce("spread", F.lit(0.0))))


def palette_quality(dominant, significant, entropy, spread, accent, contrast, concentration):
    """Score and penalties of a palette as a reference: dict of columns."""
    score = c.clamp(
        c.clamp((significant - 1) / 3) * 0.24 + entropy * 0.24 + c.clamp(spread / 0.11) * 0.2 + c.clamp((0.82 - dominant) / 0.42) * 0.14
        + c.clamp(accent / 0.22) * 0.1 + c.clamp(contrast / 0.4) * 0.08 + F.when(significant >= 3, 0.08).otherwise(0.0)
    )
    monotone = F.when((dominant >= 0.72) & (significant <= 2), c.clamp((dominant - 0.72) / 0.18 + (2 - significant) * 0.18)).otherwise(0.0)
    near = (dominant >= 0.76) & (spread < 0.07) & (accent < 0.12) & (concentration > 0.72)
    closeup = F.when(near, c.clamp(0.35 + c.clamp((dominant - 0.76) / 0.18, 0.0, 0.35) + c.clamp((0.07 - spread) / 0.07, 0.0, 0.2))).otherwise(0.0)
    usability = c.clamp(monotone * 0.6 + closeup * 0.4 + F.greatest(F.lit(0.0), 0.42 - score) * 0.55)
    return {"reference_score": score, "monotone_penalty": monotone, "closeup_penalty": closeup, "usability_penalty": usability}
