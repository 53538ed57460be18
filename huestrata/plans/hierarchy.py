"""Queries over colour modes: summary blocks, support, ranking, classes, merging and stability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from huestrata.functions import color as c
from huestrata.functions import stats as st
from huestrata.operators import clustering as cl
from huestrata.operators import hierarchy as hi
from huestrata.operators.ranking import global_rank
from huestrata.plans.registry import query
from huestrata.sources.staging import staged
from huestrata.sources.tables import SWATCHES_SQL, swatches, table

R = lambda x, n=6: F.round(x, n)
FAMILIES = 4

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
_AT = "min(CASE WHEN cum+1e-12 >= {q}*total THEN C END)"


@query("ag05_summary_block", f"""WITH {SWATCHES_SQL}, k AS (SELECT *, sum(w) OVER (PARTITION BY family ORDER BY C, id ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY family) AS total FROM swatches)
    SELECT family, count(*) AS n, round(sum(w),6) AS weight, round(sum(C*w)/sum(w),6) AS mean, round(sqrt(greatest(0,sum(C*C*w)/sum(w)-(sum(C*w)/sum(w))*(sum(C*w)/sum(w)))),6) AS std, round(min(C),6) AS low, round(max(C),6) AS high,
    {', '.join(f'round({_AT.format(q=q)},6) AS q{round(q * 100):02d}' for q in QUANTILES)}, round({_AT.format(q=0.75)}-{_AT.format(q=0.25)},6) AS iqr FROM k GROUP BY family""")
def ag05(spark, sf):
    s = swatches(spark, sf)
    m = st.weighted_moments(s, ["family"], "C", "w").join(st.weighted_quantiles(s, ["family"], "C", "w", list(QUANTILES)), "family")
    m = m.join(s.groupBy("family").agg(F.min("C").alias("low"), F.max("C").alias("high")), "family").withColumn("iqr", F.col("q75") - F.col("q25"))
    return m.select("family", "n", *(R(x).alias(x) for x in ("weight", "mean", "std", "low", "high", "q10", "q25", "q50", "q75", "q90", "iqr")))


# --- support ----------------------------------------------------------------------------------


def members(spark, sf):
    """Modes are parts and images suppliers: a line says that an image shows a mode. Some modes see few images or families only."""
    m, s = F.col("l_partkey"), F.col("l_suppkey")
    image = F.when(m % 3 == 0, s).when(m % 3 == 1, s - s % 2).otherwise(s - s % 4)
    return table(spark, sf, "lineitem").select(m.alias("mode_id"), image.alias("image"), (image % FAMILIES).alias("family"), F.col("l_quantity").alias("weight"))


def images(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("image"), (k % FAMILIES).alias("family"), (0.85 + k % 4 * 0.05).alias("reliability"))


SUPPORT_SQL = f"""mem AS (SELECT l_partkey AS mode_id, CASE l_partkey%3 WHEN 0 THEN l_suppkey WHEN 1 THEN l_suppkey-l_suppkey%2 ELSE l_suppkey-l_suppkey%4 END AS image, l_quantity AS weight FROM lineitem),
    img AS (SELECT s_suppkey AS image, s_suppkey%{FAMILIES} AS family, (0.85+s_suppkey%4*0.05)::DOUBLE AS rel FROM supplier), once AS (SELECT mode_id, image, sum(weight) AS mass FROM mem GROUP BY 1,2),
    per AS (SELECT mode_id, family, sum(mass) AS mass, count(*) AS images, sum(rel) AS ws FROM once JOIN img USING (image) GROUP BY 1,2), fw AS (SELECT family, sum(rel) AS fw FROM img GROUP BY 1), per2 AS (SELECT *, ws/fw AS within_ratio, mass/sum(mass) OVER (PARTITION BY mode_id) AS p FROM per JOIN fw USING (family)),
    sup AS (SELECT mode_id, sum(mass) AS mass, sum(mass)/(SELECT sum(rel) FROM img) AS normalized_mass, sum(images)::BIGINT AS image_support, sum(ws) AS weighted_support, sum(ws)/(SELECT sum(rel) FROM img) AS support_ratio, count(*) AS family_support, count(*)/{FAMILIES}.0::DOUBLE AS coverage,
      sum(-p*ln(p))/ln({FAMILIES}.0) AS entropy, arg_min(family, (-mass, family)) AS strongest_family, max(mass)/sum(mass) AS strongest_share FROM per2 GROUP BY 1)"""
FIGURES = ["mass", "normalized_mass", "weighted_support", "support_ratio", "coverage", "entropy", "strongest_share"]


@query("ag15_mode_support", f"WITH {SUPPORT_SQL} SELECT mode_id, image_support, family_support, strongest_family, {', '.join(f'round({x},6) AS {x}' for x in FIGURES)} FROM sup")
def ag15(spark, sf):
    modes, _ = hi.support(members(spark, sf), images(spark, sf), ["mode_id"], FAMILIES)
    return modes.withColumns({x: R(x) for x in FIGURES})


@query("ag15_family_breakdown", f"WITH {SUPPORT_SQL} SELECT mode_id, family, round(mass,6) AS mass, images, round(ws,6) AS weighted_support, round(within_ratio,6) AS within_ratio FROM per2")
def ag15_families(spark, sf):
    _, per = hi.support(members(spark, sf), images(spark, sf), ["mode_id"], FAMILIES)
    return per.withColumns({x: R(x) for x in ("mass", "weighted_support", "within_ratio")})


@query("wn05_mode_rank", f"WITH {SUPPORT_SQL}, {SWATCHES_SQL} SELECT mode_id, 'mode_' || CASE WHEN r < 10 THEN '0' ELSE '' END || r AS name FROM (SELECT mode_id, row_number() OVER (ORDER BY floor(mass*1e12+0.5) DESC, image_support DESC, printf('%02X%02X%02X', r, g, b), mode_id) AS r FROM sup JOIN swatches ON id = mode_id)")
def wn05(spark, sf):
    """Modes by mass, then support, then colour; equal in all of these by id."""
    modes, _ = hi.support(members(spark, sf), images(spark, sf), ["mode_id"], FAMILIES)
    m = modes.join(swatches(spark, sf).select(F.col("id").alias("mode_id"), c.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex")), "mode_id").select("mode_id", F.floor(F.col("mass") * 1e12 + 0.5).alias("q"), "image_support", "hex")
    r = global_rank(m, [F.desc("q"), F.desc("image_support"), F.asc("hex"), F.asc("mode_id")], "r").withColumn("r", F.col("r").cast("string"))
    return r.select("mode_id", F.concat(F.lit("mode_"), F.when(F.length("r") < 2, F.lpad("r", 2, "0")).otherwise(F.col("r"))).alias("name"))


# --- classes ----------------------------------------------------------------------------------

#: Runs are sets of modes that are ranked together: one for every hundred parts.
RUN = 100
MID = "CASE WHEN count(*) OVER ({p}) = 1 THEN 1.0 ELSE (rank() OVER ({p} ORDER BY floor({x}*1e12+0.5))-1+(count(*) OVER ({p}, floor({x}*1e12+0.5))-1)/2.0)/(count(*) OVER ({p})-1) END"


def _mid(x, part):
    return MID.format(p=f"PARTITION BY {part}", x=x)


CLASS_SQL = SUPPORT_SQL + ", " + SWATCHES_SQL + f""", fam AS (SELECT *, {_mid('mass', f'mode_id//{RUN}, family')} AS m FROM per2 WHERE mass > 1e-12), own AS (SELECT mode_id, bool_or(images >= 2 AND within_ratio >= 0.25 AND m >= 0.70) AS own FROM fam GROUP BY 1),
    pct AS (SELECT mode_id, coverage, entropy, support_ratio, own, {_mid('mass', f'mode_id//{RUN}')} AS mp, {_mid('C', f'mode_id//{RUN}')} AS cp, {_mid('L', f'mode_id//{RUN}')} AS lp FROM sup JOIN swatches ON id = mode_id LEFT JOIN own USING (mode_id)),
    classes AS (SELECT mode_id, CASE WHEN coverage >= 0.75 AND support_ratio >= 0.20 AND mp >= 0.70 THEN 'core' WHEN (coverage >= 0.50 AND support_ratio >= 0.10) OR own THEN 'secondary' ELSE 'rare' END AS tier,
      CASE WHEN coverage >= 0.75 AND entropy >= 0.65 THEN 'global' WHEN coverage >= 0.50 THEN 'cross_family' ELSE 'family_specific' END AS scope,
      list_filter([CASE WHEN cp >= 0.75 AND mp <= 0.60 THEN 'accent' END, CASE WHEN cp <= 0.25 THEN 'neutral' END, CASE WHEN lp <= 0.25 THEN 'dark' END, CASE WHEN lp >= 0.75 THEN 'light' END], lambda x: x IS NOT NULL) AS roles FROM pct)"""


@query("cl08_hierarchy", f"WITH {CLASS_SQL} SELECT mode_id, tier, scope, roles FROM classes")
def cl08(spark, sf):
    modes, per = hi.support(members(spark, sf), images(spark, sf), ["mode_id"], FAMILIES)
    run = F.floor(F.col("mode_id") / RUN)
    colours = swatches(spark, sf).select(F.col("id").alias("mode_id"), "L", "C")
    out = hi.classify(modes.join(colours, "mode_id").withColumn("run", run), per.withColumn("run", run), ["run", "mode_id"])
    return out.select("mode_id", "tier", "scope", "roles")


# --- merging ----------------------------------------------------------------------------------

#: A style has this many swatches, so merging them fits a task; styles grow in number with the table.
STYLE, STYLE_IMAGES = 40, 8


def style_swatches(spark, sf):
    """Swatches of styles: id, style, image and family within it, reliability, mass and colour; colours of a style lie close together."""
    k = F.col("id")
    near = lambda x: 0.25 * F.col(x)
    return swatches(spark, sf).select("id", F.floor(k / STYLE).alias("style"), (k % STYLE_IMAGES).alias("image"), (k % STYLE_IMAGES % FAMILIES).alias("family"), (0.85 + k % STYLE_IMAGES % 4 * 0.05).alias("reliability"), F.col("w").alias("mass"), near("L").alias("L"), near("a").alias("a"), near("bb").alias("bb"))


def style_runs(spark, sf):
    """(assigned, classes): the cluster of every swatch at every threshold, and the class of every cluster."""
    s = style_swatches(spark, sf).repartition("style")  # the file of parts is small and would be read by few tasks
    assigned = staged(cl.clusters_at(s, ["style"], hi.THRESHOLDS))  # read at each threshold
    keys = ["style", "threshold", "cluster"]
    rows = assigned.join(s, ["style", "id"])
    images_of = s.select("style", "image", "family", "reliability").distinct().withColumn("threshold", F.explode(F.array(*map(F.lit, hi.THRESHOLDS))))
    modes, per = hi.support(rows.select(*keys, "image", "family", F.col("mass").alias("weight")), images_of, keys, FAMILIES)
    mean = lambda x: F.sum(F.col(x) * F.col("mass")) / F.sum("mass")
    colours = rows.groupBy(*keys).agg(mean("L").alias("L"), c.chroma(mean("a"), mean("bb")).alias("C"))
    return assigned, staged(hi.classify(modes.join(colours, keys), per, keys))


@query("cl07_threshold_sweep")
def cl07(spark, sf):
    assigned, classes = style_runs(spark, sf)
    return hi.lineage(assigned, classes, ["style"])


@query("cl08_stability")
def cl08_stability(spark, sf):
    return hi.stability(cl07(spark, sf), ["style"])


@query("fn17_labels", f"""WITH {SWATCHES_SQL}, l AS (SELECT id, CASE WHEN L >= 0.72 THEN '高明度' WHEN L >= 0.48 THEN '中等明度' ELSE '低明度' END AS brightness, CASE WHEN C < 0.055 THEN '低彩度' WHEN C < 0.13 THEN '柔和彩度' ELSE '高彩度' END AS chroma,
    CASE WHEN w-1 < 0.28 THEN '低對比' WHEN w-1 < 0.5 THEN '中等對比' ELSE '高對比' END AS contrast, CASE WHEN id%10/10.0 >= 0.7 OR abs(w-1) < 0.16 THEN '中性' WHEN w-1 > 0 THEN '暖色' ELSE '冷色' END AS temperature, CASE WHEN id%11/10.0 < 0.4 THEN '輕盈視覺' WHEN id%11/10.0 < 0.65 THEN '中等視覺重量' ELSE '厚重視覺' END AS weight,
    CASE WHEN C < 0.045 OR id%10/10.0 > 0.72 OR C < 0.08 THEN 'neutral' WHEN H >= 345 OR H < 20 THEN 'red' WHEN H < 55 THEN 'orange' WHEN H < 100 THEN 'yellow' WHEN H < 165 THEN 'green' WHEN H < 205 THEN 'cyan' WHEN H < 265 THEN 'blue' WHEN H < 325 THEN 'purple' ELSE 'pink' END AS family FROM swatches)
    SELECT *, CASE WHEN chroma = '高彩度' AND brightness <> '低明度' THEN CASE WHEN family IN ('blue','cyan') THEN '鮮明現代' ELSE '活力亮彩' END ELSE CASE family WHEN 'neutral' THEN CASE WHEN brightness = '高明度' THEN '柔和明亮' WHEN weight = '厚重視覺' THEN '經典深沉' ELSE '自然沉穩' END
      WHEN 'red' THEN CASE WHEN brightness = '高明度' THEN '柔和雅緻' ELSE '經典成熟' END WHEN 'orange' THEN CASE WHEN brightness = '低明度' THEN '經典暖調' ELSE '自然暖調' END WHEN 'yellow' THEN CASE WHEN brightness = '高明度' THEN '清新暖陽' ELSE '沉靜金調' END
      WHEN 'green' THEN CASE WHEN brightness = '高明度' THEN '清新自然' WHEN weight = '厚重視覺' THEN '森林沉穩' ELSE '自然沉穩' END WHEN 'cyan' THEN CASE WHEN brightness = '高明度' THEN '清透冷調' ELSE '安靜青灰' END WHEN 'blue' THEN CASE WHEN brightness = '高明度' THEN '清透冷調' ELSE '專業冷靜' END
      WHEN 'purple' THEN CASE WHEN brightness = '高明度' THEN '優雅霧紫' ELSE '深邃高級' END WHEN 'pink' THEN CASE WHEN brightness = '高明度' THEN '柔和浪漫' ELSE '成熟柔霧' END END END AS direction FROM l""")
def fn17(spark, sf):
    x, neutral, heavy, h = F.col("w") - 1, F.col("id") % 10 / 10.0, F.col("id") % 11 / 10.0, F.radians("H")
    s = swatches(spark, sf).select("id", c.brightness_label(F.col("L")).alias("brightness"), c.chroma_label(F.col("C")).alias("chroma"), c.contrast_label(x).alias("contrast"), c.temperature_label(x, neutral).alias("temperature"), c.visual_weight_label(heavy).alias("weight"),
        c.vector_hue_family(F.col("C") * F.cos(h), F.col("C") * F.sin(h), F.col("C"), neutral).alias("family"))
    return s.withColumn("direction", c.direction_name(F.col("family"), F.col("brightness"), F.col("chroma"), F.col("weight")))


@query("wn03_run_mid_rank", f"WITH {CLASS_SQL} SELECT mode_id, family, round(m,6) AS percentile FROM fam")
def wn03_runs(spark, sf):
    """Mass percentile of a mode within a run and family, among the modes that the family shows."""
    _, per = hi.support(members(spark, sf), images(spark, sf), ["mode_id"], FAMILIES)
    m = hi.percentile_of(F.col("mass"), [F.floor(F.col("mode_id") / RUN), "family"])
    return per.where("mass > 1e-12").select("mode_id", "family", R(m).alias("percentile"))
