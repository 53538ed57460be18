"""Support, classes and stability of colour modes: what a mode rests on, and what merging at wider thresholds changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a tier, a scope and a role ask for; the baseline threshold and those that are compared with it.
CORE = {"coverage": 0.75, "support": 0.20, "mass": 0.70}
CROSS_FAMILY = {"coverage": 0.50, "support": 0.10}
FAMILY_SPECIFIC = {"images": 2, "support": 0.25, "mass": 0.70}
GLOBAL_SCOPE, CROSS_SCOPE = {"coverage": 0.75, "entropy": 0.65}, 0.50
ACCENT, NEUTRAL, DARK, LIGHT = {"chroma": 0.75, "mass": 0.60}, 0.25, 0.25, 0.75
THRESHOLDS = [0.045, 0.055, 0.065]
TIERS = ["rare", "secondary", "core"]


def percentile_of(value: Column, keys: list[Column | str]) -> Column:
    """Mid-rank percentile of a value among its keys, values within 1e-12 tied; 1.0 for a single row."""
    q = F.floor(value * 1e12 + 0.5)
    part = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(part)
    before, ties = F.rank().over(part.orderBy(q)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys, q))
    return F.when(n == 1, 1.0).otherwise((before + (ties - 1) / 2) / (n - 1))


def support(members: DataFrame, images: DataFrame, keys: list[str], families: int) -> tuple[DataFrame, DataFrame]:
    """What modes rest on, as (one row a mode, one row a mode and family).

    members: keys (the last names the mode, those before it the run it belongs to), image,
    family, weight. images: run keys, image, family, reliability. An image counts once for a
    mode, by its reliability. `families` is how many families a run has.
    """
    run = keys[:-1]
    weights = images.groupBy(*run, "family").agg(F.sum("reliability").alias("family_weight"))
    whole = images.groupBy(*run).agg(F.sum("reliability").alias("run_weight")) if run else images.agg(F.sum("reliability").alias("run_weight"))
    once = members.groupBy(*keys, "family", "image").agg(F.sum("weight").alias("mass")).join(images.select(*run, "image", "reliability"), [*run, "image"])
    per = once.groupBy(*keys, "family").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("images"), F.sum("reliability").alias("weighted_support"))
    per = per.join(F.broadcast(weights) if not run else weights, [*run, "family"]).withColumn("within_ratio", F.when(F.col("family_weight") > 0, F.col("weighted_support") / F.col("family_weight")).otherwise(0.0)).drop("family_weight")
    total = F.sum("mass").over(Window.partitionBy(*keys))
    p = F.when(F.col("mass") > 0, F.col("mass") / total)
    modes = per.withColumns({"_p": p, "_all": total}).groupBy(*keys).agg(
        F.sum("mass").alias("mass"), F.sum("images").alias("image_support"), F.sum("weighted_support").alias("weighted_support"), F.count(F.lit(1)).alias("family_support"),
        F.sum(-F.col("_p") * F.ln("_p")).alias("_h"), F.min(F.struct((-F.col("mass")).alias("m"), "family")).alias("_s"), F.max("_all").alias("_all"),
    )
    modes = modes.join(whole, run) if run else modes.join(F.broadcast(whole), F.lit(True))
    entropy = F.when((F.col("_all") <= 1e-12) | F.lit(families <= 1), 0.0).otherwise(F.coalesce("_h", F.lit(0.0)) / F.ln(F.lit(float(max(2, families)))))
    modes = modes.select(
        *keys, "mass", (F.col("mass") / F.col("run_weight")).alias("normalized_mass"), "image_support", "weighted_support", (F.col("weighted_support") / F.col("run_weight")).alias("support_ratio"),
        "family_support", (F.col("family_support") / families).alias("coverage"), entropy.alias("entropy"), F.col("_s.family").alias("strongest_family"), F.when(F.col("mass") > 0, -F.col("_s.m") / F.col("mass")).otherwise(0.0).alias("strongest_share"),
    )
    return modes, per


def classify(modes: DataFrame, per_family: DataFrame, keys: list[str]) -> DataFrame:
    """modes with tier, scope and roles. modes also has columns L and C; per_family is support()'s second table."""
    run = keys[:-1]
    f = per_family.where("mass > 1e-12").withColumn("_m", percentile_of(F.col("mass"), [*run, "family"]))
    own = f.groupBy(*keys).agg(F.bool_or((F.col("images") >= FAMILY_SPECIFIC["images"]) & (F.col("within_ratio") >= FAMILY_SPECIFIC["support"]) & (F.col("_m") >= FAMILY_SPECIFIC["mass"])).alias("own_family"))
    out = modes.join(own, keys, "left")
    out = out.withColumns({"mass_percentile": percentile_of(F.col("mass"), run or [F.lit(0)]), "chroma_percentile": percentile_of(F.col("C"), run or [F.lit(0)]), "lightness_percentile": percentile_of(F.col("L"), run or [F.lit(0)])})
    cover, ratio, mass = F.col("coverage"), F.col("support_ratio"), F.col("mass_percentile")
    core = (cover >= CORE["coverage"]) & (ratio >= CORE["support"]) & (mass >= CORE["mass"])
    second = ((cover >= CROSS_FAMILY["coverage"]) & (ratio >= CROSS_FAMILY["support"])) | F.coalesce("own_family", F.lit(False))
    scope = F.when((cover >= GLOBAL_SCOPE["coverage"]) & (F.col("entropy") >= GLOBAL_SCOPE["entropy"]), "global").when(cover >= CROSS_SCOPE, "cross_family").otherwise("family_specific")
    chroma, light = F.col("chroma_percentile"), F.col("lightness_percentile")
    roles = F.array_compact(F.array(F.when((chroma >= ACCENT["chroma"]) & (mass <= ACCENT["mass"]), "accent"), F.when(chroma <= NEUTRAL, "neutral"), F.when(light <= DARK, "dark"), F.when(light >= LIGHT, "light")))
    return out.withColumns({"tier": F.when(core, "core").when(second, "secondary").otherwise("rare"), "scope": scope, "roles": roles}).drop("own_family")


def lineage(assigned: DataFrame, classes: DataFrame, run: list[str], baseline: float = THRESHOLDS[0]) -> DataFrame:
    """What each baseline mode becomes at each wider threshold: run keys, mode, threshold, descendant, sources, and what flipped.

    assigned: run keys, threshold, id, cluster for every member; classes: run keys, threshold,
    cluster, tier, scope, roles, coverage. Clusters of wider thresholds hold whole clusters of
    narrower ones, so any one member finds the descendant; a mode whose members part is an error.
    """
    base = assigned.where(F.col("threshold") == baseline).select(*run, "id", F.col("cluster").alias("mode"))
    moved = assigned.where(F.col("threshold") > baseline).join(base, [*run, "id"])
    down = moved.groupBy(*run, "mode", "threshold").agg(F.min("cluster").alias("descendant"), F.max("cluster").alias("_other"))
    whole = F.when(F.col("descendant") != F.col("_other"), F.raise_error(F.lit("a baseline mode has two descendants")).cast("boolean")).otherwise(True)
    down = down.where(whole).drop("_other").withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy(*run, "threshold", "descendant")))
    fields = ["tier", "scope", "roles", "coverage"]
    before = classes.where(F.col("threshold") == baseline).select(*run, F.col("cluster").alias("mode"), *(F.col(x).alias(f"base_{x}") for x in fields))
    after = classes.select(*run, "threshold", F.col("cluster").alias("descendant"), *fields)
    both = down.join(before, [*run, "mode"]).join(after, [*run, "threshold", "descendant"])
    tier, scope = F.col("tier") != F.col("base_tier"), F.col("scope") != F.col("base_scope")
    rank = lambda c: F.array_position(F.array(*map(F.lit, TIERS)), F.col(c))
    out = both.withColumns({
        "merged": F.col("sources") > 1, "evidence_flip": tier, "scope_flip": scope, "class_flip": tier | scope, "role_flip": F.col("roles") != F.col("base_roles"),
        "coverage_flip": F.abs(F.col("coverage") - F.col("base_coverage")) > 1e-12, "promoted": rank("tier") > rank("base_tier"),
    })
    any_flip = F.col("class_flip") | F.col("role_flip")
    return out.withColumns({"merge_sensitive": F.col("merged") & (any_flip | F.col("coverage_flip")), "pool_sensitive": ~F.col("merged") & any_flip, "merge_promotion": F.col("merged") & F.col("promoted")})


def stability(flips: DataFrame, run: list[str]) -> DataFrame:
    """Per baseline mode: its grade (C if its class flips at the first wider threshold, B at the next, else A), first flips and causes."""
    at = lambda k: F.bool_or(F.when(F.col("threshold") == THRESHOLDS[k], F.col("class_flip")))
    first = lambda c: F.min(F.when(F.col(c), F.col("threshold")))
    return flips.groupBy(*run, "mode").agg(
        F.when(at(1), "C").when(at(2), "B").otherwise("A").alias("grade"), first("class_flip").alias("first_class_flip"), first("evidence_flip").alias("first_evidence_flip"), first("scope_flip").alias("first_scope_flip"),
        first("role_flip").alias("first_role_flip"), F.bool_or("merge_sensitive").alias("merge_sensitive"), F.bool_or("pool_sensitive").alias("pool_sensitive"), F.bool_or("merge_promotion").alias("merge_promotion"), F.bool_or("coverage_flip").alias("coverage_sensitive"),
    )
