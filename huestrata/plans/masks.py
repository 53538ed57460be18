"""Queries over masks, regions and their evidence. An image is 400 parts, so images grow in number with the table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from huestrata.functions import stats as st
from huestrata.operators import masks as mk
from huestrata.operators import relations as rel
from huestrata.operators.scans import percentiles
from huestrata.plans.registry import query
from huestrata.sources.staging import staged
from huestrata.sources.tables import SWATCHES_SQL, swatches, table

R = lambda x, n=6: F.round(x, n)
SIDE = 20
PIXELS = SIDE * SIDE


def pixels(spark, sf):
    """One pixel per part: image, x, y, place, alpha and its colour."""
    k = F.col("id")
    at = {"image": F.floor(k / PIXELS), "place": k % PIXELS, "x": k % SIDE, "y": F.floor(k / SIDE) % SIDE, "alpha": 1 - (k * 89 % 100) / 300.0}
    return swatches(spark, sf).withColumns(at)


PIXELS_SQL = SWATCHES_SQL + f", pixels AS (SELECT *, id//{PIXELS} AS image, id%{PIXELS} AS place, id%{SIDE} AS x, id//{SIDE}%{SIDE} AS y, 1-(id*89%100)/300.0::DOUBLE AS alpha FROM swatches)"


def masks(spark, sf):
    """Eighteen masks an image: rectangles with a few holes; 15 is the whole image, 14 nearly, 16 and 17 are 14 but for a few pixels.

    Pixels are dealt by image before there are masks of them, so that what is worked out per image needs no shuffle of masks.
    """
    m, x, y, k = F.col("mask"), F.col("x"), F.col("y"), F.col("id")
    p = pixels(spark, sf).repartition("image").withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(17).cast("long"))))
    x0, y0 = m * 3 % 11, m * 7 % 9
    box = (x >= x0) & (x < x0 + 4 + m * 5 % 17) & (y >= y0) & (y < y0 + 3 + m * 11 % 18) & ((k * 7 + m * 13) % 97 != 0)
    most = (x > 0) & (y > 0) & (F.col("place") % 211 != (m - 13) * 40)
    return p.where(F.when(m < 14, box).when(m == 15, True).otherwise(most))


MASKS_SQL = PIXELS_SQL + """, masks AS (SELECT * FROM (SELECT p.*, m.mask FROM pixels p, range(18) m(mask)) WHERE CASE WHEN mask < 14 THEN x >= mask*3%11 AND x < mask*3%11+4+mask*5%17 AND y >= mask*7%9 AND y < mask*7%9+3+mask*11%18 AND (id*7+mask*13)%97 <> 0
    WHEN mask = 15 THEN TRUE ELSE x > 0 AND y > 0 AND place%211 <> (mask-13)*40 END),
    size AS (SELECT image, mask, count(*) AS n FROM masks GROUP BY 1,2),
    pair AS (SELECT image, a, b, both_n, sa.n AS n_a, sb.n AS n_b, both_n/(sa.n+sb.n-both_n)::DOUBLE AS iou, both_n/sa.n::DOUBLE AS a_in_b, both_n/sb.n::DOUBLE AS b_in_a
      FROM (SELECT l.image, l.mask AS a, r.mask AS b, count(*) AS both_n FROM masks l JOIN masks r ON l.image=r.image AND l.x=r.x AND l.y=r.y AND l.mask < r.mask GROUP BY 1,2,3) JOIN size sa USING (image) JOIN size sb USING (image) WHERE sa.mask = a AND sb.mask = b),
    nest AS (SELECT image, CASE WHEN a_in_b >= 0.95 AND n_a < n_b THEN a ELSE b END AS child, CASE WHEN a_in_b >= 0.95 AND n_a < n_b THEN b ELSE a END AS parent, CASE WHEN a_in_b >= 0.95 AND n_a < n_b THEN a_in_b ELSE b_in_a END AS coverage, iou
      FROM pair WHERE (a_in_b >= 0.95 AND n_a < n_b) OR (b_in_a >= 0.95 AND n_b < n_a))"""
EDGES_SQL = f"""edge AS (SELECT image, mask, (max((y=0)::INT)+max((y={SIDE - 1})::INT)+max((x=0)::INT)+max((x={SIDE - 1})::INT))::INT AS touch_sides,
    (count(*) FILTER (WHERE y=0)+count(*) FILTER (WHERE y={SIDE - 1})+count(*) FILTER (WHERE x=0)+count(*) FILTER (WHERE x={SIDE - 1}))/{4 * SIDE}.0::DOUBLE AS border_coverage FROM masks GROUP BY 1,2),
    uniq AS (SELECT image, mask, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END) AS uniq FROM (SELECT *, count(*) OVER (PARTITION BY image, x, y) AS k FROM masks) GROUP BY 1,2)"""


@query("flt01_pixel_sample", f"WITH {PIXELS_SQL}, s AS (SELECT image, x, y, count(*) OVER (PARTITION BY image) AS n FROM pixels WHERE x BETWEEN 2 AND {SIDE - 3} AND y BETWEEN 2 AND {SIDE - 3} AND x%2=0 AND y%2=0 AND alpha >= 0.85) SELECT image, x, y FROM s WHERE n >= 24")
def flt01(spark, sf):
    """Every second pixel within a margin of two, opaque enough; images with fewer than 24 of them drop out."""
    inner = lambda c: F.col(c).between(2, SIDE - 3) & (F.col(c) % 2 == 0)
    s = pixels(spark, sf).where(inner("x") & inner("y") & (F.col("alpha") >= 0.85)).select("image", "x", "y")
    return s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("image"))).where("n >= 24").drop("n")


@query("flt06_mask_hygiene", "WITH a AS (SELECT l_partkey AS mask, count(*)/(SELECT count(*) FROM lineitem)::DOUBLE AS area FROM lineitem GROUP BY 1) SELECT mask, round(area,6) AS area FROM a WHERE area BETWEEN 0.0005 AND 0.995")
def flt06(spark, sf):
    i = table(spark, sf, "lineitem")
    a = i.groupBy(F.col("l_partkey").alias("mask")).agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(i.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))  # one row
    return a.withColumn("area", F.col("k") / F.col("n")).where(F.col("area").between(mk.LEAST_AREA, mk.MOST_AREA)).select("mask", R("area").alias("area"))


@query("jn12_nesting", f"WITH {MASKS_SQL} SELECT image, child, parent, round(coverage,6) AS coverage, round(iou,6) AS iou FROM nest")
def jn12_nesting(spark, sf):
    return mk.nesting(mk.pair_figures(masks(spark, sf))).withColumns({"coverage": R("coverage"), "iou": R("iou")})


@query("cl10_longest_chain", f"WITH RECURSIVE {MASKS_SQL}, up(image, mask, depth) AS (SELECT image, mask, 0 FROM size UNION SELECT n.image, n.child, up.depth+1 FROM up JOIN nest n ON n.image = up.image AND n.parent = up.mask) SELECT image, mask, max(depth) AS depth FROM up GROUP BY 1,2")
def cl10(spark, sf):
    m = masks(spark, sf)
    return mk.depths(m, mk.nesting(mk.pair_figures(m)))


@query("jn23_symmetric_dedupe", f"""WITH RECURSIVE {MASKS_SQL}, e AS (SELECT image, a AS p, b AS q FROM pair WHERE iou >= 0.985 OR least(a_in_b,b_in_a) >= 0.995 UNION ALL SELECT image, b, a FROM pair WHERE iou >= 0.985 OR least(a_in_b,b_in_a) >= 0.995),
    r(image, n, m) AS (SELECT image, mask, mask FROM size UNION SELECT e.image, e.q, r.m FROM r JOIN e ON e.image=r.image AND e.p=r.n), c AS (SELECT image, n AS mask, min(m) AS component FROM r GROUP BY 1,2)
    SELECT image, mask, component, row_number() OVER (PARTITION BY image, component ORDER BY mask*37%100 DESC, size.n DESC, mask) = 1 AS kept FROM c JOIN size USING (image, mask)""")
def jn23(spark, sf):
    m = masks(spark, sf).select("image", "mask", "x", "y")
    score = m.select("image", "mask").distinct().withColumn("score", F.col("mask") * 37 % 100)
    return mk.deduplicate(m, score, PIXELS, rel.components)


@query("ag21_mask_union", f"WITH {MASKS_SQL}, k AS (SELECT p.image, (SELECT count(*) FROM masks m WHERE m.image=p.image AND m.x=p.x AND m.y=p.y AND m.mask < 14) AS k FROM pixels p) SELECT image, quantile_cont(k,0.5)::DOUBLE AS p50, round(quantile_cont(k,0.95),6)::DOUBLE AS p95, max(k) AS most, round(avg((k>0)::INT),6) AS covered, round(avg((k>1)::INT),6) AS several, round(avg((k>=5)::INT),6) AS five FROM k GROUP BY 1")
def ag21(spark, sf):
    """Without the masks that cover all or nearly all of an image."""
    out = mk.multiplicity(pixels(spark, sf), masks(spark, sf).where("mask < 14"))
    return out.withColumns({c: R(c) for c in ("p95", "covered", "several", "five")})


@query("ag30_border", f"WITH {MASKS_SQL}, {EDGES_SQL} SELECT image, mask, touch_sides, round(border_coverage,6) AS border_coverage FROM edge")
def ag30(spark, sf):
    return mk.borders(masks(spark, sf), SIDE, SIDE).withColumn("border_coverage", R("border_coverage"))


@query("ag31_mask_metrics", f"""WITH {MASKS_SQL} SELECT image, mask, round(avg(L),6) AS mean_l, round(avg(a),6) AS mean_a, round(avg(bb),6) AS mean_b, round(exp(-(var_pop(L)+var_pop(a)+var_pop(bb))/0.006),6) AS homogeneity, round(quantile_cont(L,0.9)-quantile_cont(L,0.1),6) AS spread FROM masks GROUP BY 1,2""")
def ag31(spark, sf):
    var = F.var_pop("L") + F.var_pop("a") + F.var_pop("bb")
    return masks(spark, sf).groupBy("image", "mask").agg(R(F.avg("L")).alias("mean_l"), R(F.avg("a")).alias("mean_a"), R(F.avg("bb")).alias("mean_b"), R(F.exp(-var / 0.006)).alias("homogeneity"), R(F.percentile("L", F.lit(0.9)) - F.percentile("L", F.lit(0.1))).alias("spread"))


@query("cl02_region_split")
def cl02(spark, sf):
    """Two colours of every mask, and from them the bimodality of AG31."""
    return mk.two_colours(masks(spark, sf)).withColumns({c: R(c) for c in ("first_share", "contrast", "bimodal")})


ROLES_SQL = f"""roles AS (SELECT s.image, s.mask, s.n/{PIXELS}.0::DOUBLE AS area, e.touch_sides AS sides, (SELECT count(*) FROM nest WHERE nest.image=s.image AND parent=s.mask) AS children, (SELECT count(*) FROM nest WHERE nest.image=s.image AND child=s.mask) AS parents, u.uniq FROM size s JOIN edge e USING (image, mask) JOIN uniq u USING (image, mask)),
    found AS (SELECT *, list_filter([CASE WHEN area >= 0.80 OR (area >= 0.50 AND children >= 3 AND sides >= 3) THEN 'GLOBAL_CONTEXT_CANDIDATE' END, CASE WHEN area >= 0.50 AND sides >= 2 THEN 'BACKGROUND_PLANE_CANDIDATE' END,
      CASE WHEN parents > 0 AND area < 0.50 THEN 'NESTED_COMPONENT_CANDIDATE' END, CASE WHEN area < 0.50 AND uniq >= 0.10 THEN 'LOCAL_COMPONENT_CANDIDATE' END], lambda x: x IS NOT NULL) AS r FROM roles)"""


@query("cl21_roles", f"WITH {MASKS_SQL}, {EDGES_SQL}, {ROLES_SQL} SELECT image, mask, CASE WHEN len(r) = 1 THEN r ELSE r || ['AMBIGUOUS'] END AS roles, NOT (area >= 0.80 OR (area >= 0.50 AND children >= 3 AND sides >= 3)) AS local_allowed FROM found")
def cl21(spark, sf):
    return role_rows(spark, sf).drop("area")


def role_rows(spark, sf):
    m, key = masks(spark, sf).select("image", "mask", "x", "y"), ["image", "mask"]
    j = mk.areas(m, PIXELS)
    for more in (mk.borders(m, SIDE, SIDE), mk.unique_share(m), mk.kin(mk.nesting(mk.pair_figures(m)))):
        j = j.join(more.hint("merge"), key, "left")  # never by broadcast: the sizes of exploded rows are estimated far too low
    j = j.fillna(0, ["children", "parents"])
    a, s, c = F.col("area"), F.col("touch_sides"), F.col("children")
    return j.select(*key, "area", mk.roles(a, s, c, F.col("parents"), F.col("unique")).alias("roles"), (~mk.blocks_local(a, s, c)).alias("local_allowed"))


# --- regions ----------------------------------------------------------------------------------

REGIONS_SQL = PIXELS_SQL + f""", g AS (SELECT *, x//5+y//5*4 AS label FROM pixels), reg AS (SELECT image, label, avg(L) AS L, avg(a) AS a, avg(bb) AS bb, count(*)/{PIXELS}.0::DOUBLE AS area, (image*31+label*17)%100/100.0::DOUBLE AS scale, (image*13+label*29)%100/100.0::DOUBLE AS perturb FROM g GROUP BY image, label),
    near AS (SELECT p.image, least(p.label,q.label) AS one, greatest(p.label,q.label) AS two, avg(CASE WHEN abs(p.L-q.L) > 0.35 THEN 1.0 ELSE 0.0 END) AS support FROM g p JOIN g q ON p.image=q.image AND ((q.x=p.x+1 AND q.y=p.y) OR (q.x=p.x AND q.y=p.y+1)) WHERE p.label <> q.label GROUP BY 1,2,3),
    rel AS (SELECT n.*, sqrt((s.L-t.L)*(s.L-t.L)+(s.a-t.a)*(s.a-t.a)+(s.bb-t.bb)*(s.bb-t.bb)) AS delta, (s.scale+t.scale)/2 AS scale, (s.perturb+t.perturb)/2 AS perturb, s.area+t.area AS area FROM near n JOIN reg s ON s.image=n.image AND s.label=n.one JOIN reg t ON t.image=n.image AND t.label=n.two),
    ev AS (SELECT *, exp(-delta/0.08) AS sim, least(1,greatest(0,area*least(1,delta/0.20))) AS impact FROM rel),
    ed AS (SELECT *, list_filter([CASE WHEN support > 0.35 THEN 'BOUNDARY_EVIDENCE_AGAINST_GROUPING' END, CASE WHEN delta > 0.14 THEN 'COLOR_MODEL_CONTRADICTION' END, CASE WHEN least(scale,perturb) < 0.45 THEN 'STABILITY_CONTRADICTION' END, CASE WHEN impact > 0.20 THEN 'HIGH_PALETTE_IMPACT' END], lambda x: x IS NOT NULL) AS contradictions FROM ev)"""


def region_relations(spark, sf):
    """Blocks of five by five pixels as regions, and the pairs of an image that touch."""
    g = pixels(spark, sf).withColumn("label", F.floor(F.col("x") / 5) + F.floor(F.col("y") / 5) * 4)
    part = lambda a, b: (F.col("image") * a + F.col("label") * b) % 100 / 100.0
    reg = g.groupBy("image", "label").agg(*(F.avg(c).alias(c) for c in ("L", "a", "bb")), (F.count(F.lit(1)) / PIXELS).alias("area")).withColumns({"scale": part(31, 17), "perturb": part(13, 29)})
    moved = [g.select("image", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("label").alias("other"), F.col("L").alias("L2")) for dx, dy in ((1, 0), (0, 1))]
    near = g.select("image", "x", "y", "label", "L").join(moved[0].unionByName(moved[1]), ["image", "x", "y"]).where("label <> other")
    near = near.groupBy("image", F.least("label", "other").alias("one"), F.greatest("label", "other").alias("two")).agg(F.avg(F.when(F.abs(F.col("L") - F.col("L2")) > 0.35, 1.0).otherwise(0.0)).alias("support"))
    for side in ("one", "two"):
        near = near.join(reg.select("image", F.col("label").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("L", "a", "bb", "area", "scale", "perturb"))), ["image", side])
    mean = lambda c: (F.col(f"{c}_one") + F.col(f"{c}_two")) / 2
    d = F.sqrt(sum(((F.col(f"{c}_one") - F.col(f"{c}_two")) * (F.col(f"{c}_one") - F.col(f"{c}_two")) for c in ("L", "a", "bb")), F.lit(0.0)))
    return mk.region_edges(near.select("image", "one", "two", "support", d.alias("delta"), mean("scale").alias("scale"), mean("perturb").alias("perturb"), (F.col("area_one") + F.col("area_two")).alias("combined_area")))


@query("cl17_region_edges", f"""WITH {REGIONS_SQL} SELECT image, one, two, round(support,6) AS support, round(delta,6) AS delta, round(sim,6) AS color_similarity, round(impact,6) AS palette_impact, contradictions,
    CASE WHEN sim > 0.80 AND len(contradictions) = 0 THEN 'LINK_SIMILAR_COLOR_STRONG_GROUPING_CANDIDATE' WHEN sim > 0.65 THEN 'KEEP_SEPARATE_BUT_LINK_SIMILAR_COLOR' ELSE 'KEEP_SEPARATE_SPATIAL_LINK' END AS action FROM ed""")
def cl17(spark, sf):
    return region_relations(spark, sf).select("image", "one", "two", *(R(c).alias(c) for c in ("support", "delta", "color_similarity", "palette_impact")), "contradictions", "action")


@query("gv13_flag_histogram", f"WITH {REGIONS_SQL} SELECT flag, count(*) AS n FROM (SELECT unnest(contradictions) AS flag FROM ed) GROUP BY 1")
def gv13(spark, sf):
    return region_relations(spark, sf).select(F.explode("contradictions").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("gv13_image_rollup", f"""WITH {REGIONS_SQL} SELECT r.image, count(*) AS regions, count(*) FILTER (WHERE scale < 0.45) AS scale_sensitive, count(*) FILTER (WHERE perturb < 0.45) AS perturbation_sensitive, count(*) FILTER (WHERE scale < 0.1 OR perturb < 0.1) AS extreme,
    (SELECT count(*) FROM ed WHERE ed.image = r.image) AS edges, (SELECT count(*) FROM ed WHERE ed.image = r.image AND len(contradictions) > 0) AS contradicted, (SELECT count(*) FROM ed WHERE ed.image = r.image AND impact > 0.20) AS high_impact FROM reg r GROUP BY 1""")
def gv13_images(spark, sf):
    g = pixels(spark, sf).select("image", (F.floor(F.col("x") / 5) + F.floor(F.col("y") / 5) * 4).alias("label")).distinct()
    scale, perturb = (F.col("image") * 31 + F.col("label") * 17) % 100 / 100.0, (F.col("image") * 13 + F.col("label") * 29) % 100 / 100.0
    reg = g.groupBy("image").agg(F.count(F.lit(1)).alias("regions"), F.count_if(scale < 0.45).alias("scale_sensitive"), F.count_if(perturb < 0.45).alias("perturbation_sensitive"), F.count_if((scale < 0.1) | (perturb < 0.1)).alias("extreme"))
    e = region_relations(spark, sf).groupBy("image").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.size("contradictions") > 0).alias("contradicted"), F.count_if(F.col("palette_impact") > 0.20).alias("high_impact"))
    return reg.join(e, "image", "left").fillna(0)


# --- evidence ---------------------------------------------------------------------------------


@query("ag20_numeric_stats", """WITH v AS (SELECT event_type AS kind, value-50 AS v, event_id%7/7.0::DOUBLE AS w FROM events) SELECT kind, count(*) AS n, round(min(v),6) AS low, round(quantile_cont(v,0.05),6) AS p05, round(quantile_cont(v,0.25),6) AS p25, round(quantile_cont(v,0.5),6) AS median, round(quantile_cont(v,0.75),6) AS p75,
    round(quantile_cont(v,0.95),6) AS p95, round(max(v),6) AS high, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(avg((v>0)::INT),6) AS positive_ratio, round(avg((v<0)::INT),6) AS negative_ratio, round(avg((v=0)::INT),6) AS zero_ratio,
    round(sum(CASE WHEN w>0 THEN v*w END)/sum(CASE WHEN w>0 THEN w END),6) AS weighted_mean, round(sum(CASE WHEN w>0 THEN greatest(v,0)*w END)/sum(CASE WHEN w>0 THEN w END),6) AS weighted_gain, round(sum(CASE WHEN w>0 THEN w END),6) AS weight FROM v GROUP BY 1""")
def ag20(spark, sf):
    v, w = F.col("value") - 50, F.col("event_id") % 7 / 7.0
    share = lambda test: R(F.avg(F.when(test, 1.0).otherwise(0.0)))
    held = lambda x: F.sum(F.when(w > 0, x))
    events = table(spark, sf, "events").withColumnRenamed("event_type", "kind")
    places = percentiles(events.select("kind", v.alias("v")), ["kind"], "v", {"p05": ("linear", 0.05), "p25": ("linear", 0.25), "median": ("linear", 0.5), "p75": ("linear", 0.75), "p95": ("linear", 0.95)})
    places = places.select("kind", *(R(x).alias(x) for x in ("p05", "p25", "median", "p75", "p95")))
    sums = events.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), R(F.min(v)).alias("low"), R(F.max(v)).alias("high"),
        R(F.avg(v)).alias("mean"), R(F.stddev_pop(v)).alias("std"), share(v > 0).alias("positive_ratio"), share(v < 0).alias("negative_ratio"), share(v == 0).alias("zero_ratio"),
        R(held(v * w) / held(w)).alias("weighted_mean"), R(held(F.greatest(v, F.lit(0.0)) * w) / held(w)).alias("weighted_gain"), R(held(w)).alias("weight"))
    return sums.join(places, "kind", "left")


@query("fn23_softmax_entropy", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, list_transform(v, lambda s: exp(s-list_max(v))) AS q FROM e)
    SELECT vec_id, round(list_sum(list_transform(q, lambda s: -(s/list_sum(q))*ln(s/list_sum(q))))/ln(len(q)),6) AS entropy FROM x""")
def fn23_softmax(spark, sf):
    scores = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", R(st.softmax_entropy(scores)).alias("entropy"))


@query("fn24_ambiguity", """WITH e AS (SELECT vec_id, list_sort(embedding::DOUBLE[], 'DESC') AS v FROM embeddings), m AS (SELECT vec_id, CASE WHEN vec_id%9 = 0 THEN NULL ELSE v[1]-v[2] END AS margin FROM e)
    SELECT vec_id, CASE WHEN margin IS NULL THEN 'UNAVAILABLE' WHEN margin < 0.01 THEN 'VERY_HIGH_AMBIGUITY' WHEN margin < 0.02 THEN 'HIGH_AMBIGUITY' WHEN margin < 0.05 THEN 'MODERATE_AMBIGUITY' ELSE 'LOWER_AMBIGUITY' END AS band FROM m""")
def fn24(spark, sf):
    v = F.sort_array(F.col("embedding").cast("array<double>"), asc=False)
    margin = F.when(F.col("vec_id") % 9 != 0, F.element_at(v, 1) - F.element_at(v, 2))
    return table(spark, sf, "embeddings").select("vec_id", mk.ambiguity(margin).alias("band"))


@query("tk12_extremes", """WITH k AS (SELECT l_suppkey AS key, l_orderkey*10+l_linenumber AS mask, l_discount*10 AS iou, l_quantity AS area, l_quantity*l_tax AS uniq FROM lineitem), w AS (SELECT key, mask, row_number() OVER (PARTITION BY key ORDER BY iou, mask) AS rn FROM k)
    SELECT key, list(mask ORDER BY rn) FILTER (WHERE rn <= 8) AS worst, any_value(b.largest) AS largest, any_value(b.most_unique) AS most_unique FROM w JOIN (SELECT key, arg_min(mask, (-area, mask)) FILTER (WHERE iou < 0.9) AS largest, arg_min(mask, (-uniq, mask)) FILTER (WHERE iou < 0.9) AS most_unique FROM k GROUP BY 1) b USING (key) GROUP BY key""")
def tk12(spark, sf):
    """The eight masks of least overlap, and of the unstable ones the largest and that of most unique coverage; ties by name."""
    q = F.col
    k = table(spark, sf, "lineitem").select(q("l_suppkey").alias("key"), (q("l_orderkey") * 10 + q("l_linenumber")).alias("mask"), (q("l_discount") * 10).alias("iou"), q("l_quantity").alias("area"), (q("l_quantity") * q("l_tax")).alias("uniq"))
    worst = k.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("iou", "mask"))).where("rn <= 8")
    worst = worst.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "mask"))), lambda s: s["mask"]).alias("worst"))
    best = lambda c: F.min(F.when(q("iou") < 0.9, F.struct(-q(c), "mask")))["mask"]
    return worst.join(k.groupBy("key").agg(best("area").alias("largest"), best("uniq").alias("most_unique")), "key")


@query("cl20_go_no_go", f"""WITH {MASKS_SQL}, {EDGES_SQL}, {ROLES_SQL}, l AS (SELECT image, mask, NOT (area >= 0.80 OR (area >= 0.50 AND children >= 3 AND sides >= 3)) AS ok, area FROM roles), cov AS (SELECT count(DISTINCT (m.image, m.x, m.y)) AS raw, count(DISTINCT (m.image, m.x, m.y)) FILTER (WHERE ok) AS loc FROM masks m JOIN l USING (image, mask)),
    c AS (SELECT unnest([('GLOBAL_MASK_LOCAL_RECOVERY_BLOCKED', (SELECT loc < raw FROM cov)), ('LOCAL_SPLIT_RETAINED', (SELECT count(*) FILTER (WHERE ok) > 0 FROM l)), ('MIXED_EVIDENCE_RETAINED', (SELECT count(*) FILTER (WHERE value > 50) > 0 AND count(*) FILTER (WHERE value < 50) > 0 FROM events)),
      ('MEANINGFUL_TAIL_EXPOSED', (SELECT count(*) FILTER (WHERE mask*37%100/100.0 < 0.5 AND area >= 0.01) > 0 FROM l)), ('AMBIGUITY_NOT_TRUTH', (SELECT count(*) FILTER (WHERE len(r) <> 1) > 0 FROM found)), ('ENVIRONMENT_CERTIFIED', (SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('F','O','P')) = 0 FROM orders))]) AS k)
    SELECT count(*) FILTER (WHERE k[2]) AS passed, count(*) AS total, coalesce(list_sort(list(k[1]) FILTER (WHERE NOT k[2])), []) AS hold_reasons, CASE WHEN bool_and(k[2]) THEN 'VALIDATED' ELSE 'HOLD' END AS decision FROM c""")
def cl20(spark, sf):
    """Six checks over aggregates: all must hold."""
    roles = staged(role_rows(spark, sf))
    allowed = roles.groupBy("image").agg(F.collect_list(F.when(F.col("local_allowed"), F.col("mask"))).alias("allowed"))  # a list of an image's masks
    spots = mk.stacks(masks(spark, sf)).join(allowed.hint("merge"), "image")
    small = roles.agg((F.count_if((F.col("mask") * 37 % 100 / 100.0 < 0.5) & (F.col("area") >= 0.01)) > 0).alias("ok"))
    v = table(spark, sf, "events")
    checks = [
        ("GLOBAL_MASK_LOCAL_RECOVERY_BLOCKED", spots.agg((F.count_if(F.arrays_overlap("on", "allowed")) < F.count(F.lit(1))).alias("ok"))),
        ("LOCAL_SPLIT_RETAINED", roles.agg((F.count_if("local_allowed") > 0).alias("ok"))),
        ("MIXED_EVIDENCE_RETAINED", v.agg(((F.count_if(F.col("value") > 50) > 0) & (F.count_if(F.col("value") < 50) > 0)).alias("ok"))),
        ("MEANINGFUL_TAIL_EXPOSED", small),
        ("AMBIGUITY_NOT_TRUTH", roles.agg((F.count_if(F.array_contains("roles", "AMBIGUOUS")) > 0).alias("ok"))),
        ("ENVIRONMENT_CERTIFIED", table(spark, sf, "orders").agg((F.count_if(~F.col("o_orderstatus").isin("F", "O", "P")) == 0).alias("ok"))),
    ]
    rows = None
    for name, df in checks:
        row = df.select(F.lit(name).alias("check"), "ok")
        rows = row if rows is None else rows.unionByName(row)
    return rows.agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"), F.array_sort(F.array_agg(F.when(~F.col("ok"), F.col("check")))).alias("hold_reasons"), F.when(F.bool_and("ok"), "VALIDATED").otherwise("HOLD").alias("decision"))
