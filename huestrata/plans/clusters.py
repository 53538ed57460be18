"""Queries over clustering, hierarchy, calibration and iterative operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from huestrata.functions import stats as st
from huestrata.operators import clustering as cl
from huestrata.plans.hierarchy import style_swatches
from huestrata.plans.registry import query
from huestrata.sources.tables import MODES_SQL, SWATCHES_SQL, modes, swatches, table

R = lambda x, n=6: F.round(x, n)


@query("cl01_palette")
def cl01(spark, sf):
    return cl.palettes(swatches(spark, sf), "image_id").withColumns({x: R(x) for x in ("L", "a", "bb", "ratio")})


@query("cl04_merge_trace")
def cl04(spark, sf):
    return cl.merge_trace(style_swatches(spark, sf), ["style"]).withColumn("distance", R("distance"))


def cases(spark, sf):
    """Calibration cases: one per nation, a value and one of three labels."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.cast("long").alias("case_id"), (k * 37 % 100 / 100.0).alias("v"), F.when(k * 37 % 100 < 35, "similar").when(k * 37 % 100 > 70, "different").otherwise("similar_or_partial").alias("label"))


@query("cl12_threshold_fit")
def cl12(spark, sf):
    return cl.threshold_fit(cases(spark, sf), "v", "label")


@query("cl14_palette_match")
def cl14(spark, sf):
    p = cl.palettes(swatches(spark, sf), "image_id")
    q = cl.palettes(modes(spark, sf).withColumn("w", F.col("mass")), "image_id")
    return cl.palette_match(p, q, "image_id").withColumn("cost", R("cost"))


@query("cl18_best_iou", """WITH l AS (SELECT DISTINCT l_suppkey%20 AS l, l_orderkey AS x FROM lineitem), r AS (SELECT DISTINCT l_partkey%15 AS r, l_orderkey AS x FROM lineitem), nl AS (SELECT l, count(*) AS n FROM l GROUP BY 1), nr AS (SELECT r, count(*) AS n FROM r GROUP BY 1),
    b AS (SELECT l, r, count(*) AS i FROM l JOIN r USING (x) GROUP BY 1,2) SELECT b.l, round(max(i/(nl.n+nr.n-i)),6) AS best FROM b JOIN nl ON b.l=nl.l JOIN nr ON b.r=nr.r GROUP BY b.l""")
def cl18(spark, sf):
    from huestrata.operators.relations import overlaps

    items = table(spark, sf, "lineitem")
    l = items.select((F.col("l_suppkey") % 20).alias("l"), F.col("l_orderkey").alias("x")).distinct()
    r = items.select((F.col("l_partkey") % 15).alias("r"), F.col("l_orderkey").alias("x")).distinct()
    return overlaps(l, r, ["x"]).groupBy("l").agg(R(F.max("iou")).alias("best"))


@query("jn22_ownership")
def jn22(spark, sf):
    """The owner of each photo after its scored events in order: replaced by its own branch or a score more than 0.03 higher."""
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 50).alias("photo"), F.col("event_id"), F.col("event_type").alias("branch"), (F.col("value") / 100).alias("score"), (F.col("event_id") % 2 == 0).alias("own"))
    ordered = e.groupBy("photo").agg(F.sort_array(F.collect_list(F.struct("event_id", "branch", "score", "own"))).alias("seq"))
    start = F.struct(F.lit("").alias("branch"), F.lit(-1.0).alias("score"))
    wins = lambda s, x: (x["score"] > s["score"] + 0.03) | (x["own"] & (x["branch"] == s["branch"]))
    last = F.aggregate("seq", start, lambda s, x: F.when(wins(s, x), F.struct(x["branch"].alias("branch"), x["score"].alias("score"))).otherwise(s))
    return ordered.select("photo", last.alias("o")).select("photo", F.col("o.branch").alias("owner"), R("o.score").alias("score"))


@query("fn19_gradient_hash")
def fn19(spark, sf):
    """8 x 8 gradient hashes over 9 x 8 grids of part prices."""
    k = F.col("p_partkey") - 1
    g = table(spark, sf, "part").select(F.floor(k / 72).alias("image"), (k % 72 % 9).alias("x"), F.floor(k % 72 / 9).alias("y"), F.col("p_retailprice").alias("v"))
    right = g.select("image", (F.col("x") - 1).alias("x"), "y", F.col("v").alias("next"))
    bits = g.join(right, ["image", "x", "y"]).withColumn("bit", F.when(F.col("v") > F.col("next"), F.expr("shiftleft(1L, CAST(63 - (y * 8 + x) AS INT))")).otherwise(F.lit(0).cast("long")))
    return bits.groupBy("image").agg(F.lower(F.lpad(F.hex(F.bit_or("bit")), 16, "0")).alias("hash"), F.count(F.lit(1)).alias("n")).where("n = 64").select("image", "hash")


@query("prj08_swatch_explode", f"""WITH {SWATCHES_SQL} SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY id))::BIGINT AS place, round(w*0.85,6) AS weight FROM swatches""")
def prj08(spark, sf):
    p = swatches(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("palette"))
    return p.select("image_id", F.posexplode("palette").alias("at", "s")).select("image_id", (F.col("at") + 1).cast("long").alias("place"), R(F.col("s.w") * 0.85).alias("weight"))


@query("sm10_shadow_diff", "SELECT l_suppkey AS k, CASE WHEN max(abs(l_discount-l_tax)) = 0 THEN 'PASS_STRICT' WHEN max(abs(l_discount-l_tax)) <= 0.05 THEN 'PASS_NUMERICAL' WHEN max(abs(l_discount-l_tax)) <= 0.0999 THEN 'WARN' ELSE 'FAIL' END AS state FROM lineitem GROUP BY 1")
def sm10(spark, sf):
    d = F.max(F.abs(F.col("l_discount") - F.col("l_tax")))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(d.alias("d"))
    return g.select("k", F.when(F.col("d") == 0, "PASS_STRICT").when(F.col("d") <= 0.05, "PASS_NUMERICAL").when(F.col("d") <= 0.0999, "WARN").otherwise("FAIL").alias("state"))
