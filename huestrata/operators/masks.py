"""Masks over pixels: figures, containment, roles, near-duplicates and region relations. Masks are rows (image, mask, x, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Areas, border sides, children and unique coverage from which a mask has a role.
GLOBAL_AREA, LARGE_AREA, UMBRELLA_CHILDREN, UMBRELLA_SIDES, LOCAL_UNIQUE = 0.80, 0.50, 3, 3, 0.10
# Margins below which a choice is ambiguous.
AMBIGUITY = [(0.01, "VERY_HIGH_AMBIGUITY"), (0.02, "HIGH_AMBIGUITY"), (0.05, "MODERATE_AMBIGUITY")]
# Areas that a mask may have, coverage that nests it, overlaps that make it a duplicate.
LEAST_AREA, MOST_AREA, NESTED, SAME_IOU, SAME_MUTUAL = 0.0005, 0.995, 0.95, 0.985, 0.995


def areas(masks: DataFrame, pixels_per_image: int) -> DataFrame:
    """image, mask, n (pixels), area (share of the image)."""
    n = F.count(F.lit(1))
    return masks.groupBy("image", "mask").agg(n.alias("n"), (n / pixels_per_image).alias("area"))


def stacks(masks: DataFrame) -> DataFrame:
    """image, x, y, on: the masks on every pixel in order. Masks that are parted by image need no shuffle."""
    return masks.groupBy("image", "x", "y").agg(F.array_sort(F.collect_list("mask")).alias("on"))


def pair_figures(masks: DataFrame) -> DataFrame:
    """Pairs a < b of one image that share pixels: both sizes, intersection, iou and each one's share in the other.

    Pairs come from the masks on each pixel and sizes from windows, so nothing is joined.
    """
    each = stacks(masks).select("image", F.posexplode("on").alias("_at", "a"), "on")
    each = each.select("image", "a", F.posexplode(F.slice("on", F.col("_at") + 1, F.size("on"))).alias("_at", "b"))  # the first is a itself
    both = each.groupBy("image", "a", "b").agg(F.count_if(F.col("_at") == 0).alias("_n"), F.count_if(F.col("_at") > 0).alias("both"))
    for m in ("a", "b"):
        both = both.withColumn(f"n_{m}", F.max(F.when(F.col("a") == F.col("b"), F.col("_n"))).over(Window.partitionBy("image", m)))
    share = lambda n: F.col("both") / F.col(n)
    return both.where("a < b").select("image", "a", "b", "n_a", "n_b", "both", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("iou"), share("n_a").alias("a_in_b"), share("n_b").alias("b_in_a"))


def nesting(pairs: DataFrame, least: float = NESTED) -> DataFrame:
    """image, child, parent, coverage, iou: the smaller of two masks that lies within the other."""
    inside = (F.col("a_in_b") >= least) & (F.col("n_a") < F.col("n_b"))
    around = (F.col("b_in_a") >= least) & (F.col("n_b") < F.col("n_a"))
    pick = lambda x, y: F.when(inside, F.col(x)).otherwise(F.col(y))
    return pairs.where(inside | around).select("image", pick("a", "b").alias("child"), pick("b", "a").alias("parent"), pick("a_in_b", "b_in_a").alias("coverage"), "iou")


def depths(masks: DataFrame, relations: DataFrame) -> DataFrame:
    """image, mask, depth: the longest way up through parents. Children are smaller than parents, so ways end.

    An image keeps a bounded number of masks, so the relations of one image fit a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        children: dict[int, list[int]] = {}
        depth = dict.fromkeys(pdf.loc[pdf["parent"].isna(), "child"], 0)
        tied = pdf[pdf["parent"].notna()].astype({"parent": "int64"})
        open_parents = tied["child"].value_counts().to_dict()
        for child, parent in zip(tied["child"], tied["parent"], strict=True):
            children.setdefault(parent, []).append(child)
        ready = [m for m in depth if m not in open_parents]
        while ready:
            m = ready.pop()
            for child in children.get(m, ()):
                depth[child] = max(depth[child], depth[m] + 1)
                open_parents[child] -= 1
                if not open_parents[child]:
                    ready.append(child)
        return pd.DataFrame({"image": pdf["image"].iloc[0], "mask": list(depth), "depth": list(depth.values())})

    every = masks.select("image", F.col("mask").alias("child"), F.lit(None).cast("long").alias("parent")).distinct()
    return every.unionByName(relations.select("image", "child", "parent")).groupBy("image").applyInPandas(run, "image long, mask long, depth int")


def multiplicity(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Per image, over all pixels: p50, p95 and largest number of masks on a pixel, and the shares with any, several and five or more."""
    k = pixels.select("image", "x", "y").join(masks.groupBy("image", "x", "y").agg(F.count(F.lit(1)).alias("k")), ["image", "x", "y"], "left").select("image", F.coalesce("k", F.lit(0)).alias("k"))
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return k.groupBy("image").agg(
        F.percentile("k", F.lit(0.5)).alias("p50"), F.percentile("k", F.lit(0.95)).alias("p95"), F.max("k").alias("most"),
        share(F.col("k") > 0).alias("covered"), share(F.col("k") > 1).alias("several"), share(F.col("k") >= 5).alias("five"),
    )


def borders(masks: DataFrame, width: int, height: int) -> DataFrame:
    """image, mask, touch_sides, border_coverage: sides that a mask touches, and its share of the four edges, corners twice."""
    at = [F.col("y") == 0, F.col("y") == height - 1, F.col("x") == 0, F.col("x") == width - 1]
    on = [F.count_if(side) for side in at]
    sides = sum((F.when(n > 0, 1).otherwise(0) for n in on), F.lit(0))
    return masks.groupBy("image", "mask").agg(sides.alias("touch_sides"), (sum(on[1:], on[0]) / (2 * width + 2 * height)).alias("border_coverage"))


def unique_share(masks: DataFrame) -> DataFrame:
    """image, mask, unique: the share of a mask's pixels that no other mask covers."""
    alone = stacks(masks).select("image", F.explode("on").alias("mask"), F.when(F.size("on") == 1, 1.0).otherwise(0.0).alias("_alone"))
    return alone.groupBy("image", "mask").agg(F.avg("_alone").alias("unique"))


def kin(nestings: DataFrame) -> DataFrame:
    """image, mask, children, parents: how many masks lie within each mask of a nesting and around it."""
    side = lambda m, child: F.struct(F.col(m).alias("mask"), F.lit(child).alias("child"))
    each = nestings.select("image", F.explode(F.array(side("child", True), side("parent", False))).alias("s"))
    return each.groupBy("image", "s.mask").agg(F.count_if(~F.col("s.child")).alias("children"), F.count_if("s.child").alias("parents"))


def roles(area: Column, sides: Column, children: Column, parents: Column, unique: Column) -> Column:
    """The roles a mask may have: several make it ambiguous as well, none makes it ambiguous alone."""
    large = area >= LARGE_AREA
    umbrella = large & (children >= UMBRELLA_CHILDREN) & (sides >= UMBRELLA_SIDES)
    found = F.array_compact(F.array(
        F.when((area >= GLOBAL_AREA) | umbrella, "GLOBAL_CONTEXT_CANDIDATE"), F.when(large & (sides >= 2), "BACKGROUND_PLANE_CANDIDATE"),
        F.when((parents > 0) & ~large, "NESTED_COMPONENT_CANDIDATE"), F.when(~large & (unique >= LOCAL_UNIQUE), "LOCAL_COMPONENT_CANDIDATE"),
    ))
    return F.when(F.size(found) == 1, found).otherwise(F.concat(found, F.array(F.lit("AMBIGUOUS"))))


def blocks_local(area: Column, sides: Column, children: Column) -> Column:
    """Whether a mask is too much of a whole to help recover a part."""
    return (area >= GLOBAL_AREA) | ((area >= LARGE_AREA) & (children >= UMBRELLA_CHILDREN) & (sides >= UMBRELLA_SIDES))


def ambiguity(margin: Column) -> Column:
    """The band of a margin between the best two; UNAVAILABLE without one."""
    out = F.when(margin.isNull(), "UNAVAILABLE")
    for bound, name in AMBIGUITY:
        out = out.when(margin < bound, name)
    return out.otherwise("LOWER_AMBIGUITY")


def deduplicate(masks: DataFrame, score: DataFrame, pixels_per_image: int, components) -> DataFrame:
    """image, mask, component, kept: of near-duplicates, directly or through others, the mask of the best score, area and name stays.

    components(nodes, edges) gives the least node that each leads to, for nodes (image, mask) as one struct.
    """
    node = lambda m: F.struct("image", F.col(m).alias("mask"))
    size = areas(masks, pixels_per_image)
    p = pair_figures(masks).where((F.col("iou") >= SAME_IOU) | (F.least("a_in_b", "b_in_a") >= SAME_MUTUAL))
    edges = p.select(node("a").alias("l"), node("b").alias("r")).unionByName(p.select(node("b").alias("l"), node("a").alias("r")))
    found = components(size.select(node("mask").alias("node")), edges).select("node.image", "node.mask", F.col("component.mask").alias("component"))
    ranked = found.join(size.hint("merge"), ["image", "mask"]).join(score.hint("merge"), ["image", "mask"])  # sizes of exploded rows are estimated far too low
    best = F.row_number().over(Window.partitionBy("image", "component").orderBy(F.desc("score"), F.desc("area"), "mask"))
    return ranked.select("image", "mask", "component", (best == 1).alias("kept"))


# --- two colours of a mask ----------------------------------------------------------------------


def two_means(points: np.ndarray, k: int = 2, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """k-means that starts at the point of median lightness and goes on with the furthest ones: (centres, labels)."""
    k = max(1, min(k, len(points)))
    centres = [points[np.argmin(np.abs(points[:, 0] - np.median(points[:, 0])))]]
    while len(centres) < k:
        centres.append(points[np.argmax(np.min([((points - c) ** 2).sum(1) for c in centres], axis=0))])
    c, label = np.array(centres, float), np.zeros(len(points), int)
    for turn in range(rounds):
        now = ((points[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if turn and (now == label).all():
            break
        label = now
        for j in range(k):
            if (label == j).any():
                c[j] = points[label == j].mean(0)
    return c, label


def two_colours(pixels: DataFrame, most: int = 2200) -> DataFrame:
    """Per mask (rows image, mask, place, L, a, bb) the shares of its two colours, their contrast and how bimodal it is.

    An image has a bounded number of pixels, of which at most twice `most`, evenly picked in
    order of place, are looked at; masks are spread over tasks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("place")[["L", "a", "bb"]].to_numpy(float)
        x = x[:: max(1, len(x) // most)]
        c, label = two_means(x)
        share = np.bincount(label, minlength=len(c)) / len(x)
        order = np.argsort(-share, kind="stable")
        contrast = float(np.linalg.norm(c[order[0]] - c[order[1]])) if len(c) > 1 else 0.0
        even = 1 - abs(share[order[0]] - share[order[1]]) if len(c) > 1 else 0.0
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "mask": [pdf["mask"].iloc[0]], "first_share": [share[order[0]]], "contrast": [contrast], "bimodal": [min(1.0, max(0.0, contrast / 0.22 * even))]})

    return pixels.select("image", "mask", "place", "L", "a", "bb").groupBy("image", "mask").applyInPandas(run, "image long, mask long, first_share double, contrast double, bimodal double")


# --- regions that touch -------------------------------------------------------------------------


def region_edges(edges: DataFrame) -> DataFrame:
    """Adds evidence, contradictions and an action to pairs of regions with delta, support, scale, perturb and combined_area."""
    impact = F.least(F.greatest(F.col("combined_area") * F.least(F.lit(1.0), F.col("delta") / 0.20), F.lit(0.0)), F.lit(1.0))
    alike = F.exp(-F.col("delta") / 0.08)
    out = edges.withColumns({"palette_impact": impact, "color_similarity": alike})
    against = F.array_compact(F.array(
        F.when(F.col("support") > 0.35, "BOUNDARY_EVIDENCE_AGAINST_GROUPING"), F.when(F.col("delta") > 0.14, "COLOR_MODEL_CONTRADICTION"),
        F.when(F.least("scale", "perturb") < 0.45, "STABILITY_CONTRADICTION"), F.when(F.col("palette_impact") > 0.20, "HIGH_PALETTE_IMPACT"),
    ))
    out = out.withColumn("contradictions", against)
    strong = (F.col("color_similarity") > 0.80) & (F.size("contradictions") == 0)
    action = F.when(strong, "LINK_SIMILAR_COLOR_STRONG_GROUPING_CANDIDATE").when(F.col("color_similarity") > 0.65, "KEEP_SEPARATE_BUT_LINK_SIMILAR_COLOR").otherwise("KEEP_SEPARATE_SPATIAL_LINK")
    return out.withColumn("action", action)
