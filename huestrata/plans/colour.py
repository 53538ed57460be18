"""Queries over colour functions and pair relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from huestrata.functions import color as c
from huestrata.operators import relations as rel
from huestrata.plans.registry import query
from huestrata.sources.tables import MODES_SQL, SWATCHES_SQL, modes, swatches

R = lambda x, n=6: F.round(x, n)


@query("fn01_srgb_linear", """
    SELECT p_partkey AS id, round(CASE WHEN v <= 0.04045 THEN v/12.92 ELSE pow((v+0.055)/1.055, 2.4) END, 8) AS linear,
           round(v*255)::BIGINT AS back
    FROM (SELECT p_partkey::BIGINT AS p_partkey, ((p_partkey*37)%256)/255.0::DOUBLE AS v FROM part)""")
def fn01(spark, sf):
    s = swatches(spark, sf)
    lin = c.srgb_to_linear(F.col("r"))
    return s.select("id", R(lin, 8).alias("linear"), F.floor(c.linear_to_srgb(lin) * 255 + 0.5).alias("back"))


@query("fn02_oklab", f"WITH {SWATCHES_SQL} SELECT id, round(L,6) AS l, round(a,6) AS a, round(bb,6) AS b, round(C,6) AS c, round(H,4) AS h FROM swatches")
def fn02(spark, sf):
    return swatches(spark, sf).select("id", R("L").alias("l"), R("a").alias("a"), R("bb").alias("b"), R("C").alias("c"), R("H", 4).alias("h"))


@query("fn04_hex_round_trip", f"WITH {SWATCHES_SQL} SELECT id, printf('#%02X%02X%02X', r, g, b) AS hex, true AS gamut FROM swatches")
def fn04(spark, sf):
    lab = [F.col(x) for x in ("L", "a", "bb")]
    return swatches(spark, sf).select("id", c.oklab_to_hex(*lab).alias("hex"), c.in_gamut(*lab, slack=1e-4).alias("gamut"))


@query("fn06_pixel_weight", f"""WITH {SWATCHES_SQL} SELECT id, round((CASE WHEN L < 0.045 OR L > 0.985 THEN 0.12 WHEN L < 0.1 THEN 0.38 WHEN L > 0.95 THEN 0.42 ELSE 1.0 END)
    * (CASE WHEN C > 0.12 THEN 1.3 WHEN C < 0.015 THEN 0.82 ELSE 1.0 END)::DOUBLE, 6) AS weight FROM swatches""")
def fn06(spark, sf):
    return swatches(spark, sf).select("id", R(c.pixel_weight(F.col("L"), F.col("C"))).alias("weight"))


@query("fn15_bands", f"""WITH {SWATCHES_SQL} SELECT id,
    CASE WHEN L < 0.25 THEN 'near_black' WHEN L < 0.42 THEN 'dark' WHEN L < 0.62 THEN 'mid' WHEN L < 0.78 THEN 'light' ELSE 'very_light' END AS lightness,
    CASE WHEN C < 0.02 THEN 'achromatic' WHEN C < 0.05 THEN 'muted' WHEN C < 0.10 THEN 'soft' WHEN C < 0.17 THEN 'chromatic' ELSE 'vivid' END AS chroma,
    CASE WHEN C < 0.02 THEN 'achromatic' WHEN C < 0.045 THEN 'near_neutral' WHEN C < 0.08 THEN 'weak_chromatic' ELSE 'chromatic' END AS neutrality,
    CASE WHEN C < 0.025 THEN 'neutral' WHEN H >= 345 OR H < 20 THEN 'red' WHEN H < 55 THEN 'orange_brown' WHEN H < 90 THEN 'yellow' WHEN H < 150 THEN 'green'
         WHEN H < 205 THEN 'cyan' WHEN H < 255 THEN 'blue' WHEN H < 300 THEN 'purple' ELSE 'magenta' END AS hue_family,
    CASE WHEN C < 0.025 THEN 'neutral' WHEN H >= 320 OR H < 100 THEN 'warm' WHEN H >= 180 AND H < 300 THEN 'cool' ELSE 'mixed' END AS temperature
    FROM swatches""")
def fn15(spark, sf):
    L, C, H = F.col("L"), F.col("C"), F.col("H")
    return swatches(spark, sf).select("id", c.lightness_band(L).alias("lightness"), c.chroma_band(C).alias("chroma"), c.neutrality_class(C).alias("neutrality"), c.hue_family(H, C).alias("hue_family"), c.temperature_family(H, C).alias("temperature"))


@query("fn18_contrast", f"""WITH {SWATCHES_SQL}, y AS (SELECT id, 0.2126*lr+0.7152*lg+0.0722*lb AS y FROM swatches_1)
    SELECT id, round(1.05/(y+0.05), 4) AS on_white, 1.05/(y+0.05) >= 4.5 AS aa, 1.05/(y+0.05) >= 7 AS aaa, 1.05/(y+0.05) >= 3 AS large_aa,
           CASE WHEN 1.05/(y+0.05) >= (y+0.05)/0.05 THEN '#FFFFFF' ELSE '#000000' END AS readable FROM y""")
def fn18(spark, sf):
    y = c.luminance(F.col("r"), F.col("g"), F.col("b"))
    ratio = c.contrast_ratio(F.lit(1.0), y)
    return swatches(spark, sf).select("id", R(ratio, 4).alias("on_white"), (ratio >= 4.5).alias("aa"), (ratio >= 7).alias("aaa"), (ratio >= 3).alias("large_aa"), c.readable_text(y).alias("readable"))


PAIRS_SQL = f"""{MODES_SQL}, pairs AS (SELECT x.id AS id_1, y.id AS id_2, x.L AS l1, y.L AS l2, x.C AS c1, y.C AS c2, x.family AS f1, y.family AS f2,
    abs(x.L-y.L) AS dl, abs(x.C-y.C) AS dc, CASE WHEN abs(x.H-y.H)%360 > 180 THEN 360-abs(x.H-y.H)%360 ELSE abs(x.H-y.H)%360 END AS dh, least(x.C,y.C) AS minc,
    sqrt((x.L-y.L)*(x.L-y.L)+(x.a-y.a)*(x.a-y.a)+(x.bb-y.bb)*(x.bb-y.bb)) AS de FROM modes x JOIN modes y ON x.style = y.style AND x.id < y.id),
    t AS (SELECT *, greatest(0,least(1,(c1-0.005)/0.035)) AS t1, greatest(0,least(1,(c2-0.005)/0.035)) AS t2 FROM pairs),
    rel AS (SELECT *, sqrt((t1*t1*(3-2*t1))*(t2*t2*(3-2*t2))) AS reliab, CASE WHEN c1+c2 <= 1e-12 THEN 1 ELSE 1-abs(c1-c2)/(c1+c2) END AS csim FROM t)"""
COLUMNS = ["id", "L", "a", "bb", "C", "H", "family", "mass"]


def graph(spark, sf):
    """The relation graph of every style: all pairs of its modes."""
    return rel.perceptual(rel.physical(rel.all_pairs(modes(spark, sf), COLUMNS, ["style"])))


@query("cl09_relation_graph", f"""WITH {PAIRS_SQL} SELECT id_1, id_2, round(dl,6) AS delta_l, round(dc,6) AS delta_c, round(dh,4) AS delta_h, round(de,6) AS delta_e,
    round(coalesce(2*sqrt(c1*c2)*sin(radians(dh)/2),0),6) AS hue_chord, round(csim,6) AS chroma_similarity, round(sqrt((1-dl)*csim),6) AS tone_similarity,
    round(reliab,6) AS hue_reliability, round(coalesce(reliab*(2*(1-dh/180)-1),0),6) AS hue_evidence FROM rel""")
def cl09(spark, sf):
    g = graph(spark, sf)
    return g.select("id_1", "id_2", R("delta_L").alias("delta_l"), R("delta_C").alias("delta_c"), R("delta_H", 4).alias("delta_h"), R("delta_E").alias("delta_e"), *(R(x).alias(x) for x in ("hue_chord", "chroma_similarity", "tone_similarity", "hue_reliability", "hue_evidence")))


@query("fn12_rule_classes", f"""WITH {PAIRS_SQL} SELECT id_1, id_2, CASE WHEN minc < 0.03 THEN 'low_chroma' ELSE 'reliable' END AS hue_applicability,
    CASE WHEN minc < 0.03 OR dh IS NULL THEN 'not_applicable' WHEN dh <= 40 THEN 'same_or_adjacent' ELSE 'different' END AS hue_relation,
    CASE WHEN dl <= 0.06 AND dc <= 0.033 THEN 'similar' WHEN dl+4*sqrt(dl*dc) >= 0.54 THEN 'different' ELSE 'similar_or_partial' END AS tone_relation,
    round(dl+4*sqrt(dl*dc),6) AS tone_score FROM rel""")
def fn12(spark, sf):
    k = c.rule_classes(F.col("delta_L"), F.col("delta_C"), F.col("delta_H"), F.col("min_C"))
    k["tone_score"] = R(k["tone_score"])
    return graph(spark, sf).select("id_1", "id_2", *(v.alias(n) for n, v in k.items()))


@query("fn13_tone_rules", f"""WITH {PAIRS_SQL}, k AS (SELECT id_1, id_2, CASE WHEN dl <= 0.1 THEN 'similar' WHEN dl >= 0.25 THEN 'different' ELSE 'similar_or_partial' END AS light,
    CASE WHEN dc <= 0.03 THEN 'similar' WHEN dc >= 0.09 THEN 'different' ELSE 'similar_or_partial' END AS chroma FROM rel)
    SELECT *, CASE WHEN light='different' AND chroma='different' THEN 'different' WHEN light='similar' AND chroma='similar' THEN 'similar' ELSE 'similar_or_partial' END AS consensus,
    CASE WHEN light='different' OR chroma='different' THEN 'different' WHEN light='similar' AND chroma='similar' THEN 'similar' ELSE 'similar_or_partial' END AS conservative,
    CASE WHEN light='different' THEN 'different' WHEN light='similar' AND chroma='similar' THEN 'similar' ELSE 'similar_or_partial' END AS lightness_dominant,
    CASE WHEN chroma='different' THEN 'different' WHEN light='similar' AND chroma='similar' THEN 'similar' ELSE 'similar_or_partial' END AS chroma_dominant FROM k""")
def fn13(spark, sf):
    g = graph(spark, sf).select("id_1", "id_2", c.three_way(F.col("delta_L"), 0.1, 0.25).alias("light"), c.three_way(F.col("delta_C"), 0.03, 0.09).alias("chroma"))
    rules = {"consensus": "CONSENSUS_AXES", "conservative": "CONSERVATIVE_DIFFERENT", "lightness_dominant": "LIGHTNESS_DOMINANT", "chroma_dominant": "CHROMA_DOMINANT"}
    return g.withColumns({n: c.combine_tone(F.col("light"), F.col("chroma"), r) for n, r in rules.items()})


@query("fn14_baseline_classes", f"""WITH {PAIRS_SQL}, k AS (SELECT *, sqrt((1-dl)*csim) AS tone FROM rel) SELECT id_1, id_2, CASE WHEN reliab < 0.15 THEN 'low_chroma' ELSE 'reliable' END AS hue_applicability,
    CASE WHEN reliab < 0.15 THEN 'not_applicable' WHEN dh <= 60 THEN 'same_or_adjacent' WHEN dh >= 90 THEN 'different' ELSE 'review' END AS hue_relation,
    CASE WHEN tone >= 0.65 THEN 'similar' WHEN tone >= 0.45 THEN 'similar_or_partial' ELSE 'different' END AS tone_relation FROM k""")
def fn14(spark, sf):
    k = c.baseline_classes(F.col("hue_reliability"), F.col("delta_H"), F.col("tone_similarity"))
    return graph(spark, sf).select("id_1", "id_2", *(v.alias(n) for n, v in k.items()))


@query("fn16_affinity", f"""WITH {PAIRS_SQL}, k AS (SELECT *, least(greatest(0,least(1,(c1-0.015)/0.065)), greatest(0,least(1,(c2-0.015)/0.065))) AS rl,
    exp(-0.5*pow(dl/0.16,2)) AS gl, exp(-0.5*pow(dc/0.075,2)) AS gc, exp(-0.5*pow(dh/38,2)) AS gh, exp(-0.5*pow(de/0.14,2)) AS ge FROM rel)
    SELECT id_1, id_2, round(0.44*(0.68*gl+0.32*gc)+0.40*(rl*gh+(1-rl)*0.5)+0.16*ge, 6) AS affinity,
    CASE WHEN c1 < 0.045 AND c2 < 0.045 THEN 'hue_weak_neutral' WHEN rl < 0.30 THEN 'hue_uncertain_low_chroma' WHEN dh <= 25 THEN 'same_or_very_close' WHEN dh <= 60 THEN 'adjacent' ELSE 'different' END AS hue_relation FROM k""")
def fn16(spark, sf):
    g = graph(spark, sf)
    rl = F.least(*(c.clamp((F.col(x) - 0.015) / 0.065) for x in ("C_1", "C_2")))
    kind = F.when((F.col("C_1") < 0.045) & (F.col("C_2") < 0.045), "hue_weak_neutral").when(rl < 0.30, "hue_uncertain_low_chroma").when(F.col("delta_H") <= 25, "same_or_very_close").when(F.col("delta_H") <= 60, "adjacent").otherwise("different")
    return g.select("id_1", "id_2", R(c.affinity(*(F.col(x) for x in ("delta_L", "delta_C", "delta_H", "delta_E", "C_1", "C_2")))).alias("affinity"), kind.alias("hue_relation"))


@query("jn08_group_pairs", f"""WITH {PAIRS_SQL} SELECT f1 AS family, count(*) AS pairs, round(avg(sqrt((1-dl)*csim)),6) AS cohesion,
    CASE WHEN avg(sqrt((1-dl)*csim)) >= 0.6 THEN 'STABLE' WHEN avg(sqrt((1-dl)*csim)) >= 0.45 THEN 'REVIEW' ELSE 'UNSTABLE' END AS state FROM rel WHERE f1 = f2 GROUP BY f1""")
def jn08(spark, sf):
    g = rel.perceptual(rel.physical(rel.all_pairs(modes(spark, sf), [x for x in COLUMNS if x != "family"], ["style", "family"])))
    out = g.groupBy(F.col("family_1").alias("family")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("tone_similarity").alias("m"))
    return out.select("family", "pairs", R("m").alias("cohesion"), F.when(F.col("m") >= 0.6, "STABLE").when(F.col("m") >= 0.45, "REVIEW").otherwise("UNSTABLE").alias("state"))


VERDICT_SQL = PAIRS_SQL + """, k AS (SELECT *, least(greatest(0,least(1,(c1-0.015)/0.065)), greatest(0,least(1,(c2-0.015)/0.065))) AS rl, greatest(0,least(1,0.68*exp(-0.5*pow(dl/0.16,2))+0.32*exp(-0.5*pow(dc/0.075,2)))) AS tone, exp(-0.5*pow(dh/38,2)) AS gh, exp(-0.5*pow(de/0.14,2)) AS ge FROM rel),
    v AS (SELECT *, 0.44*tone+0.40*(rl*gh+(1-rl)*0.5)+0.16*ge AS sim, CASE WHEN c1 < 0.045 AND c2 < 0.045 THEN CASE WHEN tone >= 0.84 THEN 'SAME' WHEN tone >= 0.64 THEN 'RELATED' ELSE 'DIFFERENT' END WHEN dh <= 25 AND tone >= 0.76 THEN 'SAME' WHEN dh <= 60 AND tone >= 0.62 THEN 'RELATED' WHEN dh > 60 AND tone >= 0.72 THEN 'RELATED' WHEN dh > 85 AND tone < 0.72 THEN 'DIFFERENT' WHEN (c1 < 0.045 OR c2 < 0.045) AND tone >= 0.70 THEN 'RELATED' ELSE 'REVIEW' END AS verdict,
      list_filter([CASE WHEN dh > 60 AND tone >= 0.72 AND rl >= 0.35 THEN 'TONE_SIMILAR_HUE_CONFLICT' END, CASE WHEN rl < 0.30 THEN 'LOW_CHROMA_HUE_UNCERTAIN' END, CASE WHEN dl < 0.08 AND dh > 75 AND rl >= 0.35 THEN 'SIMILAR_LIGHTNESS_DIFFERENT_HUE' END], lambda x: x IS NOT NULL) AS warnings FROM k)"""


def verdicts(spark, sf):
    g = graph(spark, sf)
    v = c.verdict(*(F.col(x) for x in ("delta_L", "delta_C", "delta_H", "delta_E", "C_1", "C_2")))
    return g.select("id_1", "id_2", "style_1", "family_1", "family_2", *(x.alias(n) for n, x in v.items()))


@query("fn16_verdict", f"WITH {VERDICT_SQL} SELECT id_1, id_2, round(sim,6) AS similarity, verdict, warnings FROM v")
def fn16_verdict(spark, sf):
    return verdicts(spark, sf).select("id_1", "id_2", R("similarity").alias("similarity"), "verdict", "warnings")


@query("ag29_cohesion", f"""WITH {VERDICT_SQL}, n AS (SELECT style, family, count(*) AS members FROM modes GROUP BY 1,2), a AS (SELECT m.style, f1 AS family, count(*) AS pairs, avg(sim) AS cohesion, sum(len(warnings)) AS warns, count(*) FILTER (WHERE verdict='DIFFERENT') AS diff, count(*) FILTER (WHERE verdict='REVIEW') AS rev, count(*) FILTER (WHERE list_contains(warnings,'TONE_SIMILAR_HUE_CONFLICT')) AS conflict FROM v JOIN modes m ON m.id = id_1 WHERE f1 = f2 GROUP BY 1,2)
    SELECT n.style, n.family, members, round(coalesce(cohesion,1),6)::DOUBLE AS cohesion, coalesce(warns,0)::BIGINT AS warnings, CASE WHEN a.pairs IS NULL THEN 'STABLE' WHEN diff >= ceil(a.pairs/2.0) THEN 'UNSTABLE' WHEN diff > 0 OR conflict > 0 OR rev > 0 THEN 'REVIEW' ELSE 'STABLE' END AS status FROM n LEFT JOIN a ON a.style=n.style AND a.family=n.family""")
def ag29(spark, sf):
    """Per style and family the mean similarity of its pairs, and whether it holds together by the verdicts; one colour alone does."""
    n = modes(spark, sf).groupBy("style", "family").agg(F.count(F.lit(1)).alias("members"))
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    a = verdicts(spark, sf).where("family_1 = family_2").groupBy(F.col("style_1").alias("style"), F.col("family_1").alias("family")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("similarity").alias("mean"), F.sum(F.size("warnings")).alias("warns"), is_("DIFFERENT").alias("diff"), is_("REVIEW").alias("rev"), F.count_if(F.array_contains("warnings", "TONE_SIMILAR_HUE_CONFLICT")).alias("conflict"))
    status = F.when(F.col("pairs").isNull(), "STABLE").when(F.col("diff") >= F.ceil(F.col("pairs") / 2), "UNSTABLE").when((F.col("diff") > 0) | (F.col("conflict") > 0) | (F.col("rev") > 0), "REVIEW").otherwise("STABLE")
    return n.join(a, ["style", "family"], "left").select("style", "family", "members", R(F.coalesce("mean", F.lit(1.0))).alias("cohesion"), F.coalesce("warns", F.lit(0)).alias("warnings"), status.alias("status"))


_PIXEL_SQL = f"""r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY L)-1 AS rn, count(*) OVER (PARTITION BY image_id) AS n FROM swatches), pc AS (SELECT image_id, greatest(0,least(1,max(CASE WHEN rn = floor((n-1)*0.9+0.5) THEN L END)-max(CASE WHEN rn = floor((n-1)*0.1+0.5) THEN L END))) AS contrast FROM r GROUP BY image_id),
    px AS (SELECT image_id, sum(L*w)/sum(w) AS ml, sum(C*w)/sum(w) AS mc, sum(CASE WHEN C < 0.04 THEN w ELSE 0 END)/sum(w) AS nr, sum(CASE WHEN L < 0.32 THEN w ELSE 0 END)/sum(w) AS dr, sum(CASE WHEN C > 0.14 THEN w ELSE 0 END)/sum(w) AS hr, sum(CASE WHEN C >= 0.018 THEN cos(radians(H))*C*w ELSE 0 END)/sum(CASE WHEN C >= 0.018 THEN C*w ELSE 0 END) AS hx,
      sum(CASE WHEN C >= 0.018 THEN sin(radians(H))*C*w ELSE 0 END)/sum(CASE WHEN C >= 0.018 THEN C*w ELSE 0 END) AS hy, sum(CASE WHEN C >= 0.018 THEN cos(radians(H-60))*C*w ELSE 0 END)/sum(CASE WHEN C >= 0.018 THEN C*w ELSE 0 END) AS temp FROM swatches GROUP BY image_id),
    pp AS (SELECT *, mass/sum(mass) OVER (PARTITION BY image_id) AS ratio FROM modes), pe AS (SELECT image_id, max(ratio) AS dominant, count(*) FILTER (WHERE ratio >= 0.08) AS significant, greatest(0,least(1,-sum(ratio*ln(ratio))/ln(greatest(2,count(*))))) AS entropy, sum(CASE WHEN ratio <= 0.28 AND (C > 0.11 OR abs(L-0.5) > 0.24) THEN ratio ELSE 0 END) AS accent FROM pp GROUP BY 1),
    ps AS (SELECT x.image_id, sum(sqrt(x.ratio*y.ratio)*sqrt((x.L-y.L)*(x.L-y.L)+(x.a-y.a)*(x.a-y.a)+(x.bb-y.bb)*(x.bb-y.bb)))/sum(sqrt(x.ratio*y.ratio)) AS spread FROM pp x JOIN pp y ON x.image_id=y.image_id AND x.id<y.id GROUP BY 1),
    f AS (SELECT px.image_id, ml, mc, nr, dr, hr, hx, hy, sqrt(hx*hx+hy*hy) AS conc, temp, contrast, greatest(0,least(1,(1-ml)*0.5+dr*0.34+greatest(0,least(1,mc/0.22))*0.16)) AS vw, dominant, significant, entropy, accent, greatest(0,least(1,coalesce(spread,0))) AS spread FROM px JOIN pc USING (image_id) JOIN pe USING (image_id) LEFT JOIN ps USING (image_id)),
    q AS (SELECT *, greatest(0,least(1, greatest(0,least(1,(significant-1)/3.0))*0.24+entropy*0.24+greatest(0,least(1,spread/0.11))*0.2+greatest(0,least(1,(0.82-dominant)/0.42))*0.14+greatest(0,least(1,accent/0.22))*0.1+greatest(0,least(1,contrast/0.4))*0.08+CASE WHEN significant >= 3 THEN 0.08 ELSE 0 END)) AS score,
      CASE WHEN dominant >= 0.72 AND significant <= 2 THEN greatest(0,least(1,(dominant-0.72)/0.18+(2-significant)*0.18)) ELSE 0 END AS mono, CASE WHEN dominant >= 0.76 AND spread < 0.07 AND accent < 0.12 AND conc > 0.72 THEN greatest(0,least(1,0.35+greatest(0,least(0.35,(dominant-0.76)/0.18))+greatest(0,least(0.2,(0.07-spread)/0.07)))) ELSE 0 END AS closeup FROM f)"""
_FIELDS = {"mean_lightness": "ml", "mean_chroma": "mc", "temperature": "temp", "contrast": "contrast", "neutral_ratio": "nr", "dark_ratio": "dr", "high_chroma_ratio": "hr", "hue_concentration": "conc", "accent_ratio": "accent", "hue_x": "hx", "hue_y": "hy", "dominant_color_ratio": "dominant", "palette_entropy": "entropy", "palette_spread": "spread", "visual_weight": "vw", "reference_score": "score", "monotone_penalty": "mono", "closeup_penalty": "closeup"}


@query("prj07_features", f"WITH {SWATCHES_SQL}, {MODES_SQL}, {_PIXEL_SQL} SELECT image_id, significant AS significant_color_count, {', '.join(f'round({x},6)::DOUBLE AS {n}' for n, x in _FIELDS.items())}, round(greatest(0,least(1,mono*0.6+closeup*0.4+greatest(0,0.42-score)*0.55)),6)::DOUBLE AS usability_penalty FROM q")
def prj07(spark, sf):
    """The fifteen observed and five derived features of every image: pixels are swatches, palettes are modes."""
    from pyspark.sql import Window

    from huestrata.operators import images as im

    p = modes(spark, sf).withColumn("ratio", F.col("mass") / F.sum("mass").over(Window.partitionBy("image_id")))
    m = im.image_metrics(swatches(spark, sf), "image_id", "w").join(im.palette_metrics(p, "image_id"), "image_id").withColumn("hue_concentration", F.hypot("hue_x", "hue_y"))
    m = m.withColumns(im.palette_quality(*(F.col(x) for x in ("dominant", "significant", "entropy", "spread", "accent", "contrast", "hue_concentration"))))
    names = {"accent": "accent_ratio", "dominant": "dominant_color_ratio", "entropy": "palette_entropy", "spread": "palette_spread"}
    rest = [x for x in m.columns if x not in ("image_id", "significant")]
    return m.select("image_id", F.col("significant").alias("significant_color_count"), *(R(x).alias(names.get(x, x)) for x in rest))


@query("flt08_boundary_audit", f"""WITH {PAIRS_SQL} SELECT id_1, id_2, abs(minc-0.03) < 0.005 AS chroma_edge, minc >= 0.03 AND abs(dh-40) < 10 AS hue_edge, abs(dl+4*sqrt(dl*dc)-0.54) < 0.05 AS tone_edge
    FROM rel WHERE abs(minc-0.03) < 0.005 OR (minc >= 0.03 AND abs(dh-40) < 10) OR abs(dl+4*sqrt(dl*dc)-0.54) < 0.05""")
def flt08(spark, sf):
    score = F.col("delta_L") + 4 * F.sqrt(F.col("delta_L") * F.col("delta_C"))
    edges = graph(spark, sf).select("id_1", "id_2", (F.abs(F.col("min_C") - 0.03) < 0.005).alias("chroma_edge"), ((F.col("min_C") >= 0.03) & (F.abs(F.col("delta_H") - 40) < 10)).alias("hue_edge"), (F.abs(score - 0.54) < 0.05).alias("tone_edge"))
    return edges.where("chroma_edge OR hue_edge OR tone_edge")


@query("jn09_nearest_centroid", f"""WITH {SWATCHES_SQL}, c AS (SELECT id AS idx, L, a, bb FROM swatches WHERE id <= 8),
    d AS (SELECT s.id, c.idx, sqrt((s.L-c.L)*(s.L-c.L)+(s.a-c.a)*1.18*(s.a-c.a)*1.18+(s.bb-c.bb)*1.18*(s.bb-c.bb)*1.18) AS d FROM swatches s, c),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, idx) AS rn FROM d) SELECT id, idx, round(d,6) AS distance FROM k WHERE rn = 1""")
def jn09(spark, sf):
    s = swatches(spark, sf)
    cent = s.where("id <= 8").select(F.col("id").alias("idx"), *(F.col(x).alias(f"c{x}") for x in ("L", "a", "bb")))
    d = lambda k: c.delta_e(*(F.col(x) for x in ("L", "a", "bb")), *(k[x] for x in ("cL", "ca", "cbb")), chroma_weight=1.18)
    return rel.nearest(s.select("id", "L", "a", "bb"), cent, d, ["id"]).withColumn("distance", R("distance"))


@query("cl06_medoid", f"""WITH {MODES_SQL}, m AS (SELECT family, sum(mass*L)/sum(mass) AS ml, sum(mass*a)/sum(mass) AS ma, sum(mass*bb)/sum(mass) AS mb FROM modes GROUP BY family),
    k AS (SELECT o.family, o.id, row_number() OVER (PARTITION BY o.family ORDER BY round(sqrt((o.L-ml)*(o.L-ml)+(o.a-ma)*(o.a-ma)+(o.bb-mb)*(o.bb-mb)),9), o.mass DESC, o.id) AS rn, ml, ma, mb FROM modes o JOIN m ON o.family = m.family)
    SELECT family, id AS medoid, round(ml,6) AS l, round(ma,6) AS a, round(mb,6) AS b FROM k WHERE rn = 1""")
def cl06(spark, sf):
    o = modes(spark, sf)
    m = o.groupBy("family").agg(*((F.sum(F.col("mass") * F.col(x)) / F.sum("mass")).alias(f"m{x}") for x in ("L", "a", "bb")))
    d = F.round(c.delta_e(*(F.col(x) for x in ("L", "a", "bb", "mL", "ma", "mbb"))), 9)
    best = o.join(m, "family").groupBy("family", "mL", "ma", "mbb").agg(F.min(F.struct(d, -F.col("mass"), F.col("id"))).alias("m"))
    return best.select("family", F.col("m.id").alias("medoid"), R("mL").alias("l"), R("ma").alias("a"), R("mbb").alias("b"))


@query("ag12_palette_metrics", f"""WITH {MODES_SQL}, p AS (SELECT *, mass/sum(mass) OVER (PARTITION BY image_id) AS ratio FROM modes),
    e AS (SELECT image_id, max(ratio) AS dominant, count(*) FILTER (WHERE ratio >= 0.08) AS significant, -sum(ratio*ln(ratio))/ln(greatest(2,count(*))) AS entropy FROM p GROUP BY image_id),
    s AS (SELECT x.image_id, sum(sqrt(x.ratio*y.ratio)*sqrt((x.L-y.L)*(x.L-y.L)+(x.a-y.a)*(x.a-y.a)+(x.bb-y.bb)*(x.bb-y.bb)))/sum(sqrt(x.ratio*y.ratio)) AS spread
          FROM p x JOIN p y ON x.image_id = y.image_id AND x.id < y.id GROUP BY x.image_id)
    SELECT e.image_id, round(dominant,6) AS dominant, significant, round(entropy,6) AS entropy, round(coalesce(spread,0),6) AS spread FROM e LEFT JOIN s ON e.image_id = s.image_id""")
def ag12(spark, sf):
    from pyspark.sql import Window

    p = modes(spark, sf).withColumn("ratio", F.col("mass") / F.sum("mass").over(Window.partitionBy("image_id")))
    e = p.groupBy("image_id").agg(F.max("ratio").alias("dominant"), F.count(F.when(F.col("ratio") >= 0.08, 1)).alias("significant"), (-F.sum(F.col("ratio") * F.ln("ratio")) / F.ln(F.greatest(F.lit(2), F.count(F.lit(1))).cast("double"))).alias("entropy"))
    pairs = rel.physical(rel.all_pairs(p, ["id", "L", "a", "bb", "C", "H", "ratio"], ["image_id"])).withColumn("pw", F.sqrt(F.col("ratio_1") * F.col("ratio_2")))
    s = pairs.groupBy(F.col("image_id_1").alias("image_id")).agg((F.sum(F.col("pw") * F.col("delta_E")) / F.sum("pw")).alias("spread"))
    return e.join(s, "image_id", "left").select("image_id", R("dominant").alias("dominant"), "significant", R("entropy").alias("entropy"), R(F.coalesce("spread", F.lit(0.0))).alias("spread"))


@query("ag09_image_metrics", f"""WITH {SWATCHES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY L)-1 AS rn, count(*) OVER (PARTITION BY image_id) AS n FROM swatches),
    p AS (SELECT image_id, max(CASE WHEN rn = floor((n-1)*0.9+0.5) THEN L END)-max(CASE WHEN rn = floor((n-1)*0.1+0.5) THEN L END) AS contrast FROM r GROUP BY image_id),
    m AS (SELECT image_id, sum(L*w)/sum(w) AS ml, sum(C*w)/sum(w) AS mc, sum(CASE WHEN C < 0.04 THEN w ELSE 0 END)/sum(w) AS nr, sum(CASE WHEN L < 0.32 THEN w ELSE 0 END)/sum(w) AS dr,
      sum(CASE WHEN C >= 0.018 THEN cos(radians(H))*C*w ELSE 0 END)/sum(CASE WHEN C >= 0.018 THEN C*w ELSE 0 END) AS hx,
      sum(CASE WHEN C >= 0.018 THEN sin(radians(H))*C*w ELSE 0 END)/sum(CASE WHEN C >= 0.018 THEN C*w ELSE 0 END) AS hy,
      sum(CASE WHEN C >= 0.018 THEN cos(radians(H-60))*C*w ELSE 0 END)/sum(CASE WHEN C >= 0.018 THEN C*w ELSE 0 END) AS temp FROM swatches GROUP BY image_id)
    SELECT m.image_id, round(ml,6) AS mean_lightness, round(mc,6) AS mean_chroma, round(nr,6) AS neutral_ratio, round(dr,6) AS dark_ratio, round(contrast,6) AS contrast, round(hx,6) AS hue_x, round(hy,6) AS hue_y, round(temp,6) AS temperature,
      round(greatest(0,least(1,(1-ml)*0.5+dr*0.34+greatest(0,least(1,mc/0.22))*0.16)),6) AS visual_weight FROM m JOIN p ON m.image_id = p.image_id""")
def ag09(spark, sf):
    from huestrata.operators.images import image_metrics

    m = image_metrics(swatches(spark, sf), "image_id", "w")
    return m.select("image_id", *(R(x).alias(x) for x in m.columns if x not in ("image_id", "high_chroma_ratio")))
