"""Queries over weighted statistics, windows and percentiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from huestrata.functions import stats as st
from huestrata.operators.scans import percentiles
from huestrata.plans.registry import query
from huestrata.sources.tables import MODES_SQL, SWATCHES_SQL, modes, swatches, table

R = lambda x, n=6: F.round(x, n)


@query("ag01_distribution", "SELECT c_mktsegment AS segment, count(*) AS n, round(count(*)/sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def ag01(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    total = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("total"))
    return g.join(F.broadcast(total), F.lit(True)).select("segment", "n", R(F.col("n") / F.col("total")).alias("share"))


@query("ag02_weighted_rank_merge", """SELECT l_partkey AS photo_id, count(*) AS hits, round(sum((1.0/(1+l_suppkey%3))*(1-0.1*(l_linenumber%2))/sqrt(l_linenumber)),6) AS score,
    min(l_linenumber)::BIGINT AS best_rank, count(DISTINCT l_suppkey) AS queries FROM lineitem GROUP BY 1""")
def ag02(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("photo_id"), F.col("l_suppkey").alias("query"), F.col("l_linenumber").alias("rank"))
    weight = 1.0 / (1 + F.col("query") % 3) * (1 - 0.1 * (F.col("rank") % 2))
    return hits.groupBy("photo_id").agg(F.count(F.lit(1)).alias("hits"), R(F.sum(weight / F.sqrt("rank"))).alias("score"), F.min("rank").cast("long").alias("best_rank"), F.countDistinct("query").alias("queries"))


@query("ag03_weighted_moments", """SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity),2) AS weight, round(sum(l_discount*l_quantity)/sum(l_quantity),6) AS mean,
    round(sqrt(greatest(0,sum(l_discount*l_discount*l_quantity)/sum(l_quantity)-pow(sum(l_discount*l_quantity)/sum(l_quantity),2))),6) AS std FROM lineitem GROUP BY 1""")
def ag03(spark, sf):
    m = st.weighted_moments(table(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")
    return m.select(F.col("l_returnflag").alias("flag"), "n", R("weight", 2).alias("weight"), R("mean").alias("mean"), R("std").alias("std"))


Q = "min(CASE WHEN cum+1e-12 >= {q}*total THEN L END)"


@query("ag04_weighted_quantile", f"""WITH {SWATCHES_SQL}, k AS (SELECT *, sum(w) OVER (PARTITION BY family ORDER BY L, id ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY family) AS total FROM swatches)
    SELECT family, {', '.join(f'round({Q.format(q=q)},6) AS q{round(q * 100):02d}' for q in (.1, .25, .5, .75, .9))} FROM k GROUP BY family""")
def ag04(spark, sf):
    out = st.weighted_quantiles(swatches(spark, sf), ["family"], "L", "w", [0.1, 0.25, 0.5, 0.75, 0.9])
    return out.select("family", *(R(x).alias(x) for x in out.columns if x != "family"))


@query("ag06_micro_family_macro", f"""WITH {MODES_SQL}, f AS (SELECT family, sum(L*mass)/sum(mass) AS m FROM modes GROUP BY family)
    SELECT 'micro' AS level, -1::BIGINT AS family, round(sum(L*mass)/sum(mass),6) AS mean FROM modes UNION ALL SELECT 'family', family, round(m,6) FROM f UNION ALL SELECT 'macro', -1, round(avg(m),6) FROM f""")
def ag06(spark, sf):
    m = modes(spark, sf)
    both = m.rollup("family").agg((F.sum(F.col("L") * F.col("mass")) / F.sum("mass")).alias("m"), F.grouping("family").alias("g"))
    macro = both.where("g = 0").agg(F.avg("m").alias("m")).select(F.lit("macro").alias("level"), F.lit(-1).cast("long").alias("family"), "m")
    rows = both.select(F.when(F.col("g") == 1, "micro").otherwise("family").alias("level"), F.coalesce("family", F.lit(-1).cast("long")).alias("family"), "m").unionByName(macro)
    return rows.select("level", "family", R("m").alias("mean"))


@query("ag07_circular_mean", f"""WITH {MODES_SQL}, v AS (SELECT family, sum(cos(radians(H))*mass)/sum(mass) AS x, sum(sin(radians(H))*mass)/sum(mass) AS y FROM modes WHERE H IS NOT NULL GROUP BY family)
    SELECT family, round(sqrt(x*x+y*y),6) AS concentration, round(CASE WHEN sqrt(x*x+y*y) > 1e-12 THEN CASE WHEN degrees(atan2(y,x)) < 0 THEN degrees(atan2(y,x))+360 ELSE degrees(atan2(y,x)) END END,4) AS hue FROM v""")
def ag07(spark, sf):
    m = modes(spark, sf).where("H IS NOT NULL")
    v = m.groupBy("family").agg(*((F.sum(f(F.radians("H")) * F.col("mass")) / F.sum("mass")).alias(n) for f, n in ((F.cos, "x"), (F.sin, "y"))))
    k = st.circular_mean(F.col("x"), F.col("y"))
    return v.select("family", R(k["concentration"]).alias("concentration"), R(k["hue"], 4).alias("hue"))


@query("ag10_nearest_rank", """WITH r AS (SELECT c_mktsegment AS segment, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal)-1 AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT segment, max(CASE WHEN rn = floor((n-1)*0.9+0.5) THEN v END) AS rounded, max(CASE WHEN rn = ceil(n*0.95)-1 THEN v END) AS ceiled, max(CASE WHEN rn = floor((n-1)*0.5) THEN v END) AS floored, round(quantile_cont(v, 0.25),4) AS linear FROM r GROUP BY segment""")
def ag10(spark, sf):
    """Four definitions of a percentile, each from the range of values that holds its place."""
    d = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("v"))
    out = percentiles(d, ["segment"], "v", {"rounded": ("round", 0.9), "ceiled": ("ceil", 0.95), "floored": ("floor", 0.5), "linear": ("linear", 0.25)})
    return out.select("segment", "rounded", "ceiled", "floored", R("linear", 4).alias("linear"))


@query("ag14_bucket_count", f"WITH {SWATCHES_SQL} SELECT image_id, count(DISTINCT (r//8)*1024+(g//8)*32+(b//8)) AS buckets FROM swatches GROUP BY 1")
def ag14(spark, sf):
    key = F.shiftright("r", 3) * 1024 + F.shiftright("g", 3) * 32 + F.shiftright("b", 3)
    return swatches(spark, sf).groupBy("image_id").agg(F.countDistinct(key).alias("buckets"))


@query("ag16_mass_conservation", "SELECT abs(sum(l_quantity) - (SELECT sum(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey))) <= 1e-7 AS conserved FROM lineitem")
def ag16(spark, sf):
    items = table(spark, sf, "lineitem")
    whole, parts = items.agg(F.sum("l_quantity").alias("a")), items.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).agg(F.sum("q").alias("b"))
    return whole.join(parts, F.lit(True)).select((F.abs(F.col("a") - F.col("b")) <= 1e-7).alias("conserved"))


@query("ag17_distinct_lists", "SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority))::VARCHAR[] AS priorities FROM orders GROUP BY 1")
def ag17(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"))


@query("ag18_target_profile", """WITH k AS (SELECT p_brand AS rule, p_size%7 AS feature, p_size/50.0::DOUBLE AS target, p_retailprice AS weight FROM part),
    f AS (SELECT feature, sum(target*weight)/sum(weight) AS target, sum(weight) AS weight FROM k GROUP BY feature)
    SELECT feature::BIGINT AS feature, round(target,6) AS target, round(weight/max(weight) OVER (),5) AS weight FROM f""")
def ag18(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 7).cast("long").alias("feature"), (F.col("p_size") / 50.0).alias("target"), F.col("p_retailprice").alias("weight"))
    f = p.groupBy("feature").agg((F.sum(F.col("target") * F.col("weight")) / F.sum("weight")).alias("target"), F.sum("weight").alias("weight"))
    top = f.agg(F.max("weight").alias("top"))  # as many rows as features
    return f.join(F.broadcast(top), F.lit(True)).select("feature", R("target").alias("target"), R(F.col("weight") / F.col("top"), 5).alias("weight"))


@query("ag23_tail_impact", """WITH t(threshold) AS (VALUES (0.9::DOUBLE),(0.8),(0.5)) SELECT threshold, round(sum(CASE WHEN l_discount*10 < threshold THEN l_quantity ELSE 0 END)/sum(l_quantity),6) AS unstable_share FROM lineitem, t GROUP BY 1""")
def ag23(spark, sf):
    items = table(spark, sf, "lineitem")
    cuts = [0.9, 0.8, 0.5]
    one = items.agg(*(R(F.sum(F.when(F.col("l_discount") * 10 < t, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias(f"t{i}") for i, t in enumerate(cuts)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("unstable_share")) for i, t in enumerate(cuts)))).alias("r")).select("r.*")


@query("ag24_role_counts", "SELECT o_custkey AS id, count(DISTINCT o_orderstatus) AS roles, bool_and(o_orderstatus='F') AS all_f, bool_or(o_orderstatus='O') AS any_o FROM orders GROUP BY 1")
def ag24(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.countDistinct(s).alias("roles"), F.bool_and(s == "F").alias("all_f"), F.bool_or(s == "O").alias("any_o"))


@query("ag25_confusion", """WITH k AS (SELECT toxic AS truth, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS said FROM labels), r AS (SELECT truth, count(*) AS n, avg(CASE WHEN truth = said THEN 1.0 ELSE 0 END) AS recall FROM k GROUP BY truth)
    SELECT sum(n)::BIGINT AS n, round(sum(n*recall)/sum(n),6) AS accuracy, round(avg(recall),6) AS macro_recall, avg(recall) >= 0.5 AS gate FROM r""")
def ag25(spark, sf):
    k = table(spark, sf, "labels").select(F.col("toxic").alias("truth"), F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0).alias("said"))
    r = k.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("truth") == F.col("said")).cast("double")).alias("recall"))
    return r.agg(F.sum("n").alias("n"), R(F.sum(F.col("n") * F.col("recall")) / F.sum("n")).alias("accuracy"), R(F.avg("recall")).alias("macro_recall"), (F.avg("recall") >= 0.5).alias("gate"))


@query("ag26_slope", "SELECT event_type AS kind, round(regr_slope(value, event_id),9) AS slope FROM events GROUP BY 1")
def ag26(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(R(F.regr_slope(F.col("value"), F.col("event_id").cast("double")), 9).alias("slope"))


@query("ag27_family_pivot", """SELECT lang AS family, count(*) FILTER (WHERE toxic=1) AS toxic, count(*) FILTER (WHERE toxic=0) AS clean, round(avg(n_chars),4) AS mean_rank FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def ag27(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return d.groupBy(F.col("lang").alias("family")).agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"), R(F.avg("n_chars"), 4).alias("mean_rank"))


@query("fn23_entropy", f"""WITH {MODES_SQL}, p AS (SELECT family, mass/sum(mass) OVER (PARTITION BY family) AS p FROM modes) SELECT family, count(*) AS n, round(CASE WHEN count(*) > 1 THEN -sum(p*ln(p))/ln(count(*)) ELSE 0 END,6) AS entropy FROM p GROUP BY family""")
def fn23(spark, sf):
    return st.normalized_entropy(modes(spark, sf), ["family"], "mass").withColumn("entropy", R("entropy"))


@query("wn01_similarity_rank", """WITH k AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, r AS rank, round(CASE WHEN n = 1 THEN 100 ELSE (1-(r-1)/(n-1)::DOUBLE)*100 END,6) AS percentile FROM k""")
def wn01(spark, sf):
    from huestrata.operators.ranking import global_rank

    d = global_rank(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], "rank")
    return d.select("doc_id", "rank", R(F.when(F.col("n") == 1, 100.0).otherwise((1 - (F.col("rank") - 1) / (F.col("n") - 1)) * 100)).alias("percentile"))


@query("wn02_mid_rank", """WITH k AS (SELECT s_suppkey AS id, s_nationkey%7 AS v FROM supplier), r AS (SELECT *, rank() OVER (ORDER BY v) AS rk, count(*) OVER (PARTITION BY v) AS ties, count(*) OVER () AS n FROM k)
    SELECT id, round(CASE WHEN n=1 THEN 1.0 ELSE (rk-1+(ties-1)/2.0)/(n-1) END,6) AS mid_rank FROM r""")
def wn02(spark, sf):
    k = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 7).cast("double").alias("v"))
    return st.mid_rank(k, "v").select("id", R("mid_rank").alias("mid_rank"))


@query("wn03_family_mid_rank", f"""WITH {MODES_SQL}, r AS (SELECT id, family, mass, rank() OVER (PARTITION BY family ORDER BY round(mass,9)) AS rk, count(*) OVER (PARTITION BY family, round(mass,9)) AS ties, count(*) OVER (PARTITION BY family) AS n FROM modes WHERE mass > 1e-12)
    SELECT id, round(CASE WHEN n=1 THEN 1.0 ELSE (rk-1+(ties-1)/2.0)/(n-1) END,6) AS mid_rank FROM r""")
def wn03(spark, sf):
    return st.mid_rank(modes(spark, sf).where("mass > 1e-12"), "mass", ["family"]).select("id", R("mid_rank").alias("mid_rank"))


@query("wn07_latest_run", "SELECT user_id AS stage, event_id AS run, lag_id AS previous FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag_id FROM events) WHERE rn = 1")
def wn07(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("rn", F.row_number().over(back)).withColumn("previous", F.lag("event_id").over(order)).where("rn = 1").select(F.col("user_id").alias("stage"), F.col("event_id").alias("run"), "previous")


@query("wn08_upstream_ready", """WITH s AS (SELECT user_id AS chain, event_id AS stage, ts, value >= 5 AS pass FROM events), k AS (SELECT *, coalesce(bool_and(pass) OVER (PARTITION BY chain ORDER BY ts, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM s)
    SELECT chain, stage, CASE WHEN pass AND up THEN 'PASS' WHEN up THEN 'READY' ELSE 'NOT_STARTED' END AS state FROM k""")
def wn08(spark, sf):
    s = table(spark, sf, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("stage"), "ts", (F.col("value") >= 5).alias("pass"))
    before = Window.partitionBy("chain").orderBy("ts", "stage").rowsBetween(Window.unboundedPreceding, -1)
    up = F.coalesce(F.bool_and("pass").over(before), F.lit(True))
    return s.select("chain", "stage", F.when(F.col("pass") & up, "PASS").when(up, "READY").otherwise("NOT_STARTED").alias("state"))


@query("wn09_first_flip", "SELECT l_orderkey AS id, min(l_discount) FILTER (WHERE l_returnflag = 'R') AS first_flip FROM lineitem GROUP BY 1")
def wn09(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))).alias("first_flip"))


@query("wn10_progress", "SELECT user_id, event_id, count(*) FILTER (WHERE value >= 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS passed FROM events")
def wn10(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("user_id", "event_id", F.count(F.when(F.col("value") >= 50, 1)).over(w).alias("passed"))


@query("wn11_rising_tail", """WITH k AS (SELECT user_id, value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
    SELECT user_id, count(*) = 4 AND bool_and(coalesce(up,false)) AS rising FROM k WHERE back <= 4 GROUP BY 1""")
def wn11(spark, sf):
    order, back = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    k = table(spark, sf, "events").select("user_id", (F.col("value") > F.lag("value").over(order)).alias("up"), F.row_number().over(back).alias("back"))
    return k.where("back <= 4").groupBy("user_id").agg(((F.count(F.lit(1)) == 4) & F.bool_and(F.coalesce("up", F.lit(False)))).alias("rising"))


@query("wn12_longest_run", """WITH k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
    r AS (SELECT user_id, event_type, island, count(*) AS n FROM k GROUP BY 1,2,3) SELECT user_id, max(n) AS longest FROM r GROUP BY 1""")
def wn12(spark, sf):
    a, b = (Window.partitionBy(*k).orderBy("ts", "event_id") for k in (["user_id"], ["user_id", "event_type"]))
    k = table(spark, sf, "events").withColumn("island", F.row_number().over(a) - F.row_number().over(b))
    return k.groupBy("user_id", "event_type", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("wn13_top_margin", """WITH k AS (SELECT l_partkey AS id, l_suppkey AS label, sum(l_quantity) AS s FROM lineitem GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS rn FROM k)
    SELECT id, max(CASE WHEN rn=1 THEN label END) AS top1, round(max(CASE WHEN rn=1 THEN s END)-max(CASE WHEN rn=2 THEN s END),4) AS margin,
    CASE WHEN max(CASE WHEN rn=1 THEN s END)-max(CASE WHEN rn=2 THEN s END) < 5 THEN 'high' WHEN max(CASE WHEN rn=1 THEN s END)-max(CASE WHEN rn=2 THEN s END) < 20 THEN 'medium' ELSE 'low' END AS ambiguity FROM r WHERE rn <= 2 GROUP BY 1""")
def wn13(spark, sf):
    k = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("label")).agg(F.sum("l_quantity").alias("s"))
    r = k.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "label"))).where("rn <= 2")
    g = r.groupBy("id").agg(F.max(F.when(F.col("rn") == 1, F.col("label"))).alias("top1"), (F.max(F.when(F.col("rn") == 1, F.col("s"))) - F.max(F.when(F.col("rn") == 2, F.col("s")))).alias("m"))
    return g.select("id", "top1", R("m", 4).alias("margin"), F.when(F.col("m") < 5, "high").when(F.col("m") < 20, "medium").otherwise("low").alias("ambiguity"))


@query("ag22_unique_coverage", """WITH k AS (SELECT DISTINCT l_suppkey AS mask, l_orderkey AS pixel FROM lineitem), c AS (SELECT *, count(*) OVER (PARTITION BY pixel) AS n FROM k) SELECT mask, round(avg(CASE WHEN n=1 THEN 1.0 ELSE 0 END),6) AS unique_share FROM c GROUP BY 1""")
def ag22(spark, sf):
    k = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mask"), F.col("l_orderkey").alias("pixel")).distinct()
    n = k.groupBy("pixel").agg(F.count(F.lit(1)).alias("n"))
    return k.join(n, "pixel").groupBy("mask").agg(R(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0))).alias("unique_share"))
