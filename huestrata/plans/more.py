"""Further queries: single functions of the colour graph, gates, selections, lifecycles and governance checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from huestrata.functions import color as c
from huestrata.functions import stats as st
from huestrata.functions import text as tx
from huestrata.operators import clustering as cl
from huestrata.operators import ranking as rk
from huestrata.operators import relations as rel
from huestrata.operators import sets as so
from huestrata.operators.palettes import direction_palettes
from huestrata.operators.scans import percentiles, segmented_scan
from huestrata.plans.colour import COLUMNS, PAIRS_SQL, graph
from huestrata.plans.registry import query
from huestrata.plans.search import PHOTOS, photos, scored
from huestrata.sources import landing as ld
from huestrata.sources.tables import MODES_SQL, STYLE_MODES, SWATCHES_SQL, modes, swatches, table

R = lambda x, n=6: F.round(x, n)


def edge(name, sql, column):
    """A query of one figure of every edge of the relation graph."""

    @query(name, f"WITH {PAIRS_SQL} SELECT id_1, id_2, round({sql}, 6) AS value FROM rel")
    def run(spark, sf):
        return graph(spark, sf).select("id_1", "id_2", R(column()).alias("value"))

    return run


edge("fn05_delta_e", "de", lambda: F.col("delta_E"))
edge("fn07_hue_difference", "dh", lambda: F.col("delta_H"))
edge("fn08_hue_reliability", "reliab", lambda: c.pair_hue_reliability(F.col("C_1"), F.col("C_2")))
edge("fn09_hue_chord", "coalesce(2*sqrt(c1*c2)*sin(radians(dh)/2),0)", lambda: F.col("hue_chord"))
edge("fn10_chroma_similarity", "csim", lambda: F.col("chroma_similarity"))
edge("fn11_tone_and_evidence", "sqrt((1-dl)*csim) + coalesce(reliab*(2*(1-dh/180)-1),0)", lambda: F.col("tone_similarity") + F.col("hue_evidence"))


@query("fn03_oklch", f"WITH {SWATCHES_SQL} SELECT id, round(C,6) AS c, round(H,4) AS h FROM swatches")
def fn03(spark, sf):
    return swatches(spark, sf).select("id", R("C").alias("c"), R("H", 4).alias("h"))


@query("fn21_rank_score", "SELECT l_orderkey AS id, l_linenumber AS place, round(1/sqrt(l_linenumber),6) AS score FROM lineitem")
def fn21(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), R(1 / F.sqrt("l_linenumber")).alias("score"))


@query("fn26_clamp", "SELECT c_custkey AS id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal/5000)) AS value FROM customer")
def fn26(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), c.clamp(F.col("c_acctbal") / 5000).alias("value"))


@query("fn30_hash_score", "SELECT c_custkey AS id, round(('0x' || substr(sha256('seed' || c_name),1,12))::BIGINT / 281474976710655.0::DOUBLE, 9) AS score FROM customer")
def fn30(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), R(tx.hash_score("seed", F.col("c_name")), 9).alias("score"))


@query("fn34_constraint_clamp", "SELECT c_custkey AS id, greatest(0.2::DOUBLE, least(0.7::DOUBLE, (c_custkey*37%100)/100.0::DOUBLE)) AS target FROM customer")
def fn34(spark, sf):
    from huestrata.operators.profiles import clamp_to

    t = F.col("c_custkey") * 37 % 100 / 100.0
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), clamp_to(clamp_to(t, "maximum", 0.7), "minimum", 0.2).alias("target"))


@query("fn36_constraint_penalty", f"WITH {PHOTOS} SELECT id, round(greatest(0,least(1,(overlap-0.5)/0.25)),6) AS penalty FROM photos")
def fn36(spark, sf):
    from huestrata.operators.profiles import constraint_penalty

    return photos(spark, sf).select("id", R(constraint_penalty([("overlap", "maximum", 0.5, 0.25, 1.0)])).alias("penalty"))


@query("fn38_dates", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_ms(o_orderdate) AS ms FROM orders")
def fn38(spark, sf):
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.unix_millis(at).alias("ms"))


@query("ag08_weighted_centroid", f"WITH {MODES_SQL} SELECT family, round(sum(mass*L)/sum(mass),6) AS l, round(sum(mass*a)/sum(mass),6) AS a, round(sum(mass*bb)/sum(mass),6) AS b FROM modes GROUP BY family")
def ag08(spark, sf):
    return modes(spark, sf).groupBy("family").agg(*(R(F.sum(F.col("mass") * F.col(x)) / F.sum("mass")).alias(n) for x, n in (("L", "l"), ("a", "a"), ("bb", "b"))))


@query("ag11_percentiles", "SELECT l_returnflag AS flag, quantile_disc(l_extendedprice, 0.95) AS p95, round(quantile_cont(l_extendedprice, 0.95),4) AS p95_linear FROM lineitem GROUP BY 1")
def ag11(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    out = percentiles(d, ["flag"], "v", {"p95": ("ceil", 0.95), "p95_linear": ("linear", 0.95)})
    return out.select("flag", "p95", R("p95_linear", 4).alias("p95_linear"))


@query("ag13_accent_ratio", f"WITH {MODES_SQL}, p AS (SELECT *, mass/sum(mass) OVER (PARTITION BY image_id) AS ratio FROM modes) SELECT image_id, round(sum(CASE WHEN ratio <= 0.28 AND (C > 0.11 OR abs(L-0.5) > 0.24) THEN ratio ELSE 0 END),6) AS accent FROM p GROUP BY image_id")
def ag13(spark, sf):
    p = modes(spark, sf).withColumn("ratio", F.col("mass") / F.sum("mass").over(Window.partitionBy("image_id")))
    hit = (F.col("ratio") <= 0.28) & ((F.col("C") > 0.11) | (F.abs(F.col("L") - 0.5) > 0.24))
    return p.groupBy("image_id").agg(R(F.sum(F.when(hit, F.col("ratio")).otherwise(0.0))).alias("accent"))


@query("ag19_evidence", "SELECT l_partkey AS photo, min(l_linenumber) AS best_rank, max(l_discount) AS best_facet, count(DISTINCT l_suppkey%4) AS families, bool_or(l_returnflag='R') AS theme FROM lineitem GROUP BY 1")
def ag19(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("photo")).agg(F.min("l_linenumber").alias("best_rank"), F.max("l_discount").alias("best_facet"), F.countDistinct(F.col("l_suppkey") % 4).alias("families"), F.bool_or(F.col("l_returnflag") == "R").alias("theme"))


@query("ag28_flip_rates", "SELECT l_suppkey AS mode_id, count(*) FILTER (WHERE l_discount > l_tax) AS flips, round(sum(CASE WHEN l_discount > l_tax THEN l_quantity ELSE 0 END)/sum(l_quantity),6) AS mass_rate FROM lineitem GROUP BY 1")
def ag28(spark, sf):
    flip = F.col("l_discount") > F.col("l_tax")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("mode_id")).agg(F.count_if(flip).alias("flips"), R(F.sum(F.when(flip, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("mass_rate"))


GRID = "g AS (SELECT p_partkey%40 AS x, p_partkey//40 AS y, p_size%6 AS label FROM part)"


def grid(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select((k % 40).alias("x"), F.floor(k / 40).alias("y"), (F.col("p_size") % 6).alias("label"))


@query("wn04_cumulative_weight", f"WITH {MODES_SQL} SELECT id, round(sum(mass) OVER (PARTITION BY family ORDER BY L, id ROWS UNBOUNDED PRECEDING),6) AS cum FROM modes")
def wn04(spark, sf):
    return segmented_scan(modes(spark, sf).select("id", "family", "L", "mass"), ["family"], ["L", "id"], {"cum": "mass"}).select("id", R("cum").alias("cum"))


@query("wn06_provider_rank", f"WITH {PHOTOS} SELECT id, provider, row_number() OVER (PARTITION BY provider, search ORDER BY id) AS place FROM photos")
def wn06(spark, sf):
    return photos(spark, sf).select("id", "provider", F.row_number().over(Window.partitionBy("provider", "search").orderBy("id")).alias("place"))


@query("tk08_area_round_robin", "WITH t AS (SELECT p_partkey AS id, p_size//10 AS bin, row_number() OVER (PARTITION BY p_size//10 ORDER BY p_partkey) AS turn FROM part) SELECT id, bin::BIGINT AS bin FROM t ORDER BY turn, bin LIMIT 96")
def tk08(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_size") / 10).alias("bin"))
    return rk.round_robin(p, ["bin"], ["id"], 96)


@query("tk11_palette_top", f"WITH {MODES_SQL}, t AS (SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY mass DESC, id) AS place FROM modes) SELECT * FROM t WHERE place <= 6")
def tk11(spark, sf):
    w = Window.partitionBy("image_id").orderBy(F.desc("mass"), "id")
    return modes(spark, sf).select("image_id", "id", F.row_number().over(w).alias("place")).where("place <= 6")


@query("tk11_distinct_palettes")
def tk11_distinct(spark, sf):
    """Five colours for each direction of a style, from its candidates and away from what earlier directions took. A direction is a dozen modes."""
    m = modes(spark, sf).withColumn("direction", F.floor((F.col("id") - F.col("style") * STYLE_MODES) / 14))
    shares = m.withColumn("ratio", F.col("mass") / F.sum("mass").over(Window.partitionBy("style", "direction")))
    out = direction_palettes(shares, ["style"], "direction", "id")
    return out.withColumns({x: R(x) for x in ("L", "a", "bb", "ratio")})


@query("tk14_queue_order", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place FROM orders")
def tk14(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).alias("place"))


@query("st01_union_merge", "WITH u AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT k, count(*) AS n FROM u GROUP BY 1")
def st01(spark, sf):
    u = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))
    return u.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("st04_distinct", "SELECT DISTINCT p_brand AS family, p_size AS size FROM part")
def st04(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("family"), F.col("p_size").alias("size")).distinct()


@query("jn03_node_evidence", f"WITH {MODES_SQL} SELECT m.id, sum(l_quantity) AS evidence FROM modes m LEFT JOIN lineitem ON l_suppkey = m.id AND l_returnflag = 'R' GROUP BY 1")
def jn03(spark, sf):
    ev = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("evidence"))
    return modes(spark, sf).select("id").join(ev, "id", "left")


@query("jn05_mask_roles", "SELECT l_suppkey AS mask, l_orderkey AS image, s_name AS role FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def jn05(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("l_suppkey").alias("mask"), F.col("l_orderkey").alias("image"), F.col("s_name").alias("role"))


@query("jn06_plan_lookup", "SELECT l_orderkey*10+l_linenumber AS hit, p_type AS plan FROM lineitem JOIN part ON l_partkey = p_partkey")
def jn06(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hit"), F.col("p_type").alias("plan"))


@query("jn07_complete_graph", f"WITH {MODES_SQL} SELECT x.id AS id_1, y.id AS id_2 FROM modes x JOIN modes y ON x.style = y.style AND x.id < y.id")
def jn07(spark, sf):
    return rel.all_pairs(modes(spark, sf), ["id"], ["style"]).select("id_1", "id_2")


def whole_masks(spark, sf):
    """One mask a supplier, over the orders it is in: every row of lineitem, no key folded."""
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("m"), F.col("l_orderkey").alias("x")).where("m IS NOT NULL AND x IS NOT NULL").distinct()


SETS = "s AS (SELECT DISTINCT l_suppkey AS m, l_orderkey AS x FROM lineitem), n AS (SELECT m, count(*) AS n FROM s GROUP BY 1), b AS (SELECT a.m AS l, b.m AS r, count(*) AS k FROM s a JOIN s b ON a.x=b.x AND a.m<>b.m GROUP BY 1,2)"


def contained(spark, sf):
    return rel.covered(whole_masks(spark, sf), 0.95).where("n_l < n_r").select(F.col("l").alias("inner_m"), F.col("r").alias("outer_m"))


def gains(spark, sf):
    s = whole_masks(spark, sf)
    g = rel.largest_coverage(s, rel.tasks_for(table(spark, sf, "lineitem")))
    return g.select(F.col("m").alias("mask"), R("coverage").alias("gain"))


query("jn12_containment", f"WITH {SETS} SELECT l AS inner_m, r AS outer_m FROM b JOIN n i ON i.m=l JOIN n o ON o.m=r WHERE k/i.n >= 0.95 AND i.n < o.n")(contained)
query("cl19_recovery_gain", f"WITH {SETS} SELECT l AS mask, round(max(k/n.n),6) AS gain FROM b JOIN n ON n.m=l GROUP BY 1")(gains)


@query("jn23_near_duplicate_masks", f"""WITH RECURSIVE {SETS}, e AS (SELECT l, r FROM b JOIN n p ON p.m=l JOIN n q ON q.m=r WHERE k/(p.n+q.n-k) >= 0.985 OR k/greatest(p.n,q.n) >= 0.995), c(node, low) AS (SELECT m, m FROM n UNION SELECT e.r, c.low FROM c JOIN e ON e.l=c.node) SELECT node AS mask, min(low) AS component FROM c GROUP BY 1""")
def jn23_masks(spark, sf):
    """JN23 as the survey names it: components of masks whose IoU is 0.985 or whose mutual containment is 0.995 at least."""
    s = whole_masks(spark, sf)
    return rel.components(s.select(F.col("m").alias("node")).distinct(), rel.near_duplicates(s)).select(F.col("node").alias("mask"), "component")


@query("flt07_gamut", f"WITH {SWATCHES_SQL}, q AS (SELECT id, pow(L+0.3963377774*a*2+0.2158037573*bb*2,3) AS x, pow(L-0.1055613458*a*2-0.0638541728*bb*2,3) AS y, pow(L-0.0894841775*a*2-1.2914855480*bb*2,3) AS z FROM swatches) SELECT id, (4.0767416621*x-3.3077115913*y+0.2309699292*z) BETWEEN -1e-7 AND 1+1e-7 AND (-1.2684380046*x+2.6097574011*y-0.3413193965*z) BETWEEN -1e-7 AND 1+1e-7 AND (-0.0041960863*x-0.7034186147*y+1.7076147010*z) BETWEEN -1e-7 AND 1+1e-7 AS inside FROM q")
def flt07(spark, sf):
    return swatches(spark, sf).select("id", c.in_gamut(F.col("L"), F.col("a") * 2, F.col("bb") * 2).alias("inside"))


@query("prj09_result_nodes", f"WITH {SWATCHES_SQL} SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY id) AS place FROM swatches WHERE C > 0.05")
def prj09(spark, sf):
    return swatches(spark, sf).where("C > 0.05").select("image_id", "id", F.row_number().over(Window.partitionBy("image_id").orderBy("id")).alias("place"))


@query("prj10_window_slice", f"WITH {PHOTOS}, r AS (SELECT id, search, row_number() OVER (PARTITION BY search ORDER BY id) AS place FROM photos) SELECT id, search FROM r WHERE place BETWEEN 11 AND 20")
def prj10(spark, sf):
    r = photos(spark, sf).select("id", "search", F.row_number().over(Window.partitionBy("search").orderBy("id")).alias("place"))
    return r.where(F.col("place").between(11, 20)).select("id", "search")


@query("prj11_multi_view", f"WITH {MODES_SQL} SELECT id, 'hue' AS view, round(H,4) AS value FROM modes UNION ALL SELECT id, 'tone', round(L,4) FROM modes UNION ALL SELECT id, 'evidence', round(mass,4) FROM modes UNION ALL SELECT id, 'family', family::DOUBLE FROM modes")
def prj11(spark, sf):
    m = modes(spark, sf)
    views = F.array(*(F.struct(F.lit(n).alias("view"), F.round(F.col(x).cast("double"), 4).alias("value")) for n, x in (("hue", "H"), ("tone", "L"), ("evidence", "mass"), ("family", "family"))))
    return m.select("id", F.explode(views).alias("v")).select("id", "v.*")


@query("prj12_profile_packet", f"WITH {MODES_SQL} SELECT id, round(L,6) AS l, round(C,6) AS c FROM modes")
def prj12(spark, sf):
    return ld.allowlisted(modes(spark, sf).select("id", R("L").alias("l"), R("C").alias("c"), F.array("family").alias("semantic")), ["id", "l", "c", "semantic"])


@query("cl05_greedy_merge")
def cl05(spark, sf):
    """Colours of every style merged in falling mass."""
    from huestrata.plans.hierarchy import style_swatches

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = rk.ordered_merge(zip(pdf["mass"], pdf["L"], pdf["a"], pdf["bb"], strict=True), 0.045)
        return pd.DataFrame([(pdf["style"].iloc[0], i + 1, round(m[0], 6)) for i, m in enumerate(out)], columns=["style", "place", "mass"])

    return style_swatches(spark, sf).select("style", "id", "mass", "L", "a", "bb").groupBy("style").applyInPandas(lambda pdf: run(pdf.sort_values("id")), "style long, place int, mass double")


@query("pl03_rotation", "SELECT n_nationkey AS id, ['a','b','c'][(n_nationkey%3)+1:3] || ['a','b','c'][1:n_nationkey%3] AS turned FROM nation")
def pl03(spark, sf):
    k, items = (F.col("n_nationkey") % 3).cast("int"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.slice(items, k + 1, 3), F.slice(items, F.lit(1), k)).alias("turned"))


@query("src10_image_signature", "SELECT p_partkey AS id, CASE p_partkey%3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' END AS kind FROM part")
def src10(spark, sf):
    k = F.col("p_partkey") % 3
    head = F.unhex(F.concat(F.when(k == 0, "FFD8FFE0").when(k == 1, "89504E470D0A1A0A").otherwise("3C68746D6C3E"), F.lit("00000000000000000000")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ld.image_kind(head).alias("kind"))


@query("gv12_drift", "WITH o AS (SELECT n_name AS k, n_regionkey AS v FROM nation WHERE n_nationkey%4<>0), n AS (SELECT n_name AS k, n_regionkey*(n_nationkey%2) AS v FROM nation) SELECT coalesce(o.k,n.k) AS package FROM o FULL JOIN n ON o.k=n.k WHERE o.v IS DISTINCT FROM n.v")
def gv12(spark, sf):
    n = table(spark, sf, "nation")
    d = rel.diff(n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("k"), F.col("n_regionkey").alias("v")), n.select(F.col("n_name").alias("k"), (F.col("n_regionkey") * (F.col("n_nationkey") % 2)).alias("v")), "k", "v")
    return d.where("NOT old_value <=> new_value").select(F.col("k").alias("package"))


@query("src05_enabled_sources", "SELECT 'pexels:' || p_partkey AS id, 'pexels' AS provider FROM part WHERE p_partkey%2=0 UNION ALL SELECT 'pixabay:' || p_partkey, 'pixabay' FROM part WHERE p_partkey%2=1")
def src05(spark, sf):
    k = F.col("p_partkey")
    page = lambda n: table(spark, sf, "part").where(k % 2 == n).select(F.to_json(F.struct(k.alias("id"))).alias("body"))
    keyed = {"enabled": True, "key": "k"}
    return ld.enabled_sources({"pexels": page(0), "pixabay": page(1), "unsplash": page(0)}, {"pexels": keyed, "pixabay": keyed, "unsplash": {"enabled": False}}).select("id", "provider")
