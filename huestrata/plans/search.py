"""Queries over search results: gates, ranking, joins, sets, text and planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from huestrata.functions import text as tx
from huestrata.operators import neighbours as nb
from huestrata.operators import ranking as rk
from huestrata.operators import relations as rel
from huestrata.operators import sets as so
from huestrata.operators.digests import digest_sql
from huestrata.plans.registry import query
from huestrata.sources.tables import MODES_SQL, modes, table

R = lambda x, n=6: F.round(x, n)


def photos(spark, sf):
    """Search results: one row per part, a hundred to a search, with scores in 0..1."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"), F.concat(F.lit("https://"), F.when(k % 3 == 0, F.lit("WWW.")).otherwise(F.lit("")), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit(".com/i/"), k.cast("string"), F.lit("?q=1")).alias("url"),
        F.concat(F.lit("prov"), (k % 4).cast("string")).alias("provider"), F.concat(F.lit("auth"), (k % 31).cast("string")).alias("author"), F.col("p_name").alias("alt"),
        ((k * 7919) % 1000 / 1000.0).alias("content"), ((k * 104729) % 1000 / 1000.0).alias("theme"), ((k * 1299709) % 1000 / 1000.0).alias("retrieval"), ((k * 15485863) % 1000 / 1000.0).alias("overlap"),
        F.when(k % 5 < 2, "PASS").otherwise("CANDIDATE").alias("gate"), F.floor(k / 100).cast("long").alias("search"))


PHOTOS = """photos AS (SELECT p_partkey AS id, 'https://' || CASE WHEN p_partkey%3=0 THEN 'WWW.' ELSE '' END || lower(regexp_replace(p_brand,'[^A-Za-z0-9]','','g')) || '.com/i/' || p_partkey || '?q=1' AS url,
    'prov' || (p_partkey%4) AS provider, 'auth' || (p_partkey%31) AS author, p_name AS alt, (p_partkey*7919)%1000/1000.0::DOUBLE AS content, (p_partkey*104729)%1000/1000.0::DOUBLE AS theme,
    (p_partkey*1299709)%1000/1000.0::DOUBLE AS retrieval, (p_partkey*15485863)%1000/1000.0::DOUBLE AS overlap, CASE WHEN p_partkey%5 < 2 THEN 'PASS' ELSE 'CANDIDATE' END AS gate, (p_partkey//100)::BIGINT AS search FROM part),
    scored AS (SELECT *, (0.5*content+0.2*theme+0.2*retrieval+0.1*overlap)*CASE WHEN gate='PASS' THEN 1.0 ELSE 0.94 END AS score FROM photos)"""


def scored(spark, sf):
    p = photos(spark, sf)
    return p.withColumn("score", rk.backend_score(*(F.col(x) for x in ("content", "theme", "retrieval", "overlap", "gate"))))


@query("tk01_backend_rank", f"WITH {PHOTOS} SELECT id, search, round(score,6) AS score, row_number() OVER (PARTITION BY search ORDER BY round(score,9) DESC, id) AS place FROM scored")
def tk01(spark, sf):
    place = F.row_number().over(Window.partitionBy("search").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored(spark, sf).select("id", "search", R("score").alias("score"), place.alias("place"))


@query("tk02_diverse_top")
def tk02(spark, sf):
    return rk.diverse_top(scored(spark, sf), ["search"], 12).select("search", "place", "id", "provider", "author")


@query("tk04_near_duplicate_greedy")
def tk04(spark, sf):
    p = scored(spark, sf).select("search", "id", "author", F.substring(F.md5(F.col("alt")), 1, 16).alias("hash"))
    return rk.near_duplicate_greedy(p, ["search"], "id", "hash", "author")


@query("tk05_space_filling")
def tk05(spark, sf):
    """Of each style's pairs, all of which are its pool, 24 that fill the space; one list for each style."""
    p = rel.physical(rel.all_pairs(modes(spark, sf), ["id", "L", "a", "bb", "C", "H"], ["style"]))
    p = p.select(F.col("style_1").alias("style"), "id_1", "id_2", tx.pair_key(F.col("id_1").cast("string"), F.col("id_2").cast("string")).alias("pair_key"), "delta_L", "delta_C", "hue_chord", "min_C", "max_C")
    return rk.space_filling(p, ["style"], 24, ["delta_L", "delta_C", "hue_chord", "min_C", "max_C"], "v7").select("style", "place", "pair_key")


@query("tk09_top_pairs", f"""WITH {MODES_SQL}, p AS (SELECT x.style, x.id AS id_1, y.id AS id_2, round(sqrt((x.L-y.L)*(x.L-y.L)+(x.a-y.a)*(x.a-y.a)+(x.bb-y.bb)*(x.bb-y.bb)),6) AS delta_e FROM modes x JOIN modes y ON x.style = y.style AND x.id < y.id) SELECT *, row_number() OVER (PARTITION BY style ORDER BY delta_e, id_1, id_2) AS place FROM p QUALIFY place <= 12""")
def tk09(spark, sf):
    """The twelve nearest pairs of each style."""
    p = rel.physical(rel.all_pairs(modes(spark, sf), ["id", "L", "a", "bb", "C", "H"], ["style"]))
    p = p.select(F.col("style_1").alias("style"), "id_1", "id_2", R("delta_E").alias("delta_e"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("style").orderBy("delta_e", "id_1", "id_2"))).where("place <= 12")


@query("flt05_qualify", f"WITH {PHOTOS}, r AS (SELECT *, row_number() OVER (ORDER BY round(score,9) DESC, id) AS place, count(*) OVER () AS n FROM scored) SELECT id FROM r WHERE round(score,9) >= 0.5 AND place <= greatest(12, ceil(n*0.7))")
def flt05(spark, sf):
    return rk.qualify(scored(spark, sf).withColumn("q", F.round("score", 9)), "q", "id").select("id")


@query("flt02_concept_gate", f"""WITH {PHOTOS} SELECT id, CASE WHEN contains(lower(alt),'red') THEN 'REJECT' WHEN overlap >= 0.9 THEN 'PASS' WHEN theme >= 0.55 AND (search%3 >= 1 OR retrieval >= 0.45) THEN 'PASS' ELSE 'CANDIDATE' END AS gate FROM photos""")
def flt02(spark, sf):
    strong = (F.col("theme") >= 0.55) & ((F.col("search") % 3 >= 1) | (F.col("retrieval") >= 0.45))
    gate = F.when(F.contains(F.lower("alt"), F.lit("red")), "REJECT").when(F.col("overlap") >= 0.9, "PASS").when(strong, "PASS").otherwise("CANDIDATE")
    return photos(spark, sf).select("id", gate.alias("gate"))


@query("flt04_exclusions", f"WITH {PHOTOS} SELECT id, (contains(lower(alt),'a')::INT + contains(lower(alt),'5')::INT + contains(lower(alt),'part')::INT) AS hits, least(0.75, 0.28*(contains(lower(alt),'a')::INT + contains(lower(alt),'5')::INT + contains(lower(alt),'part')::INT))::DOUBLE AS penalty FROM photos")
def flt04(spark, sf):
    hits = tx.term_hits(F.col("alt"), ["a", "5", "part"])
    return photos(spark, sf).select("id", hits.alias("hits"), F.least(F.lit(0.75), hits * 0.28).alias("penalty"))


@query("flt11_sampling_gate", "SELECT o_orderkey AS id FROM orders WHERE md5_number_lower(o_orderkey::VARCHAR) IS NOT NULL AND ('0x' || substr(sha256('gate' || o_orderkey), 1, 12))::BIGINT / 281474976710655.0 < 0.1")
def flt11(spark, sf):
    return table(spark, sf, "orders").where(tx.hash_score("gate", F.col("o_orderkey").cast("string")) < 0.1).select(F.col("o_orderkey").alias("id"))


@query("fn31_domain", f"WITH {PHOTOS} SELECT id, regexp_replace(lower(regexp_extract(url,'https?://([^/?]+)',1)),'^www\\.','') AS domain FROM photos")
def fn31(spark, sf):
    return photos(spark, sf).select("id", tx.domain(F.col("url")).alias("domain"))


@query("fn32_url_parameter", f"WITH {PHOTOS} SELECT id, url || '&utm_source=' || provider AS tagged FROM photos")
def fn32(spark, sf):
    return photos(spark, sf).select("id", tx.with_parameter(F.col("url"), "utm_source", F.col("provider")).alias("tagged"))


@query("prj02_normalize_text", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM documents")
def prj02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("plain"))


@query("prj03_search_term", r"SELECT p_partkey AS id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(trim(regexp_replace(p_name || ' & ' || p_brand || ' 0 x-' || p_size, '\s+', ' ', 'g')), '[^\p{L}\p{N}\- ]+', '', 'g')), '\s+'), lambda w: w NOT IN ('', '0'))[1:3], ' ') AS term FROM part")
def prj03(spark, sf):
    said = F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" 0 x-"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.clean_term(said).alias("term"))


@query("prj04_family", r"SELECT p_partkey AS id, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type)), '[\s-]+', '_', 'g'), '[^a-z0-9:_-]', '', 'g'), '^_+|_+$', '', 'g') AS family FROM part")
def prj04(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.normalize_family(F.col("p_type")).alias("family"))


@query("prj05_merge_words")
def prj05(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.merge_words(F.array("p_name", "p_type", "p_brand")).alias("words"))


@query("fn27_pair_key", "SELECT s_suppkey AS id, least(s_name, 'Supplier#000000050') || '||' || greatest(s_name, 'Supplier#000000050') AS pair_key FROM supplier")
def fn27(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), tx.pair_key(F.col("s_name"), F.lit("Supplier#000000050")).alias("pair_key"))


@query("fn29_fnv1a")
def fn29(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tx.fnv1a(F.col("c_name")).alias("fnv"))


@query("fn20_hamming", "SELECT p_partkey AS id, bit_count(xor(('0x' || substr(md5(p_name),1,8))::BIGINT, ('0x' || substr(md5(p_brand),1,8))::BIGINT))::DOUBLE AS bits FROM part")
def fn20(spark, sf):
    a, b = (F.substring(F.md5(x), 1, 8) for x in ("p_name", "p_brand"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.hamming(a, b).alias("bits"))


@query("fn25_js_round", "SELECT c_custkey AS id, floor(c_acctbal*10+0.5)/10 AS rounded FROM customer")
def fn25(spark, sf):
    from huestrata.functions.color import js_round

    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), js_round(F.col("c_acctbal"), 1).alias("rounded"))


@query("fn22_cosine", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(v, qv),5) AS cosine FROM e, q""")
def fn22(spark, sf):
    from huestrata.functions.stats import cosine

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q), F.lit(True)).select("vec_id", R(cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


TARGETS = {"content": (0.6, 1.0, 0.5), "theme": (0.4, 2.0, 0.25), "retrieval": (0.5, 0.5, 0.8)}


@query("fn35_colour_match", f"WITH {PHOTOS} SELECT id, round(((1-least(1,abs(content-0.6)/0.5))*1.0+(1-least(1,abs(theme-0.4)/0.25))*2.0+(1-least(1,abs(retrieval-0.5)/0.8))*0.5)/3.5,6) AS fit, round(((greatest(0,least(1,(content-0.7)/0.2)))*1+(greatest(0,least(1,(0.3-theme)/0.3)))*2)/3,6) AS penalty FROM photos")
def fn35(spark, sf):
    from huestrata.operators.profiles import colour_match, constraint_penalty

    limits = [("content", "maximum", 0.7, 0.2, 1.0), ("theme", "minimum", 0.3, 0.3, 2.0)]
    return photos(spark, sf).select("id", R(colour_match(TARGETS)).alias("fit"), R(constraint_penalty(limits)).alias("penalty"))


@query("jn02_left_score", "SELECT d.doc_id, coalesce(l.quality, -1) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jn02(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(-1)))


def mutual_by_cosine(spark, sf):
    """JN10: suppliers that are each other's nearest by cosine of what they sell of each part, with the margin to the second; rounded for ties."""
    items = table(spark, sf, "lineitem")
    n = items.count()
    s = items.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("p"), "l_quantity").repartition(nb.files_for(spark, n), "a", "p")
    d = nb.best_by_cosine(s.groupBy("a", "p").agg(F.sum("l_quantity").cast("double").alias("q")), n)
    return rel.mutual_nearest(d).select("a", "b", R("score").alias("score"), R("margin").alias("margin"))


COSINE_SQL = """WITH k AS (SELECT l_suppkey AS sup, l_partkey AS p, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1,2), n AS (SELECT sup, sqrt(sum(q*q)) AS len FROM k GROUP BY 1), s AS (SELECT sup, p, q/len AS q FROM k JOIN n USING (sup) WHERE len > 0),
    d AS (SELECT x.sup AS a, y.sup AS b, round(sum(x.q*y.q),9) AS score FROM s x JOIN s y ON x.p = y.p AND x.sup <> y.sup GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM d),
    t AS (SELECT a, max(CASE WHEN rn=1 THEN b END) AS b, max(CASE WHEN rn=1 THEN score END) AS s1, max(CASE WHEN rn=2 THEN score END) AS s2 FROM r WHERE rn <= 2 GROUP BY a)
    SELECT x.a, x.b, round(x.s1,6) AS score, round(x.s1-coalesce(x.s2,0),6) AS margin FROM t x JOIN t y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b"""
query("jn10_mutual_nearest", COSINE_SQL)(mutual_by_cosine)


@query("jn11_overlap", """WITH l AS (SELECT DISTINCT l_suppkey%20 AS l, l_orderkey AS x FROM lineitem), r AS (SELECT DISTINCT l_partkey%15 AS r, l_orderkey AS x FROM lineitem), nl AS (SELECT l, count(*) AS n FROM l GROUP BY 1), nr AS (SELECT r, count(*) AS n FROM r GROUP BY 1),
    b AS (SELECT l, r, count(*) AS i FROM l JOIN r USING (x) GROUP BY 1,2) SELECT b.l, b.r, i AS intersection, round(i/nl.n,6) AS coverage, round(i/(nl.n+nr.n-i),6) AS iou FROM b JOIN nl ON b.l=nl.l JOIN nr ON b.r=nr.r""")
def jn11(spark, sf):
    items = table(spark, sf, "lineitem")
    l = items.select((F.col("l_suppkey") % 20).alias("l"), F.col("l_orderkey").alias("x")).distinct()
    r = items.select((F.col("l_partkey") % 15).alias("r"), F.col("l_orderkey").alias("x")).distinct()
    return rel.overlaps(l, r, ["x"]).withColumns({"coverage": R("coverage"), "iou": R("iou")})


@query("jn13_adjacent", """WITH g AS (SELECT p_partkey%40 AS x, p_partkey//40 AS y, p_size%6 AS label FROM part), n AS (SELECT a.label AS p, b.label AS q FROM g a JOIN g b ON (b.x=a.x+1 AND b.y=a.y) OR (b.x=a.x AND b.y=a.y+1)) SELECT DISTINCT least(p,q) AS a, greatest(p,q) AS b FROM n WHERE p <> q""")
def jn13(spark, sf):
    g = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"), (F.col("p_size") % 6).alias("label"))
    return rel.adjacent(g)


@query("jn14_lineage", "SELECT cluster, (cluster%20)::BIGINT AS descendant, n FROM (SELECT (l_partkey%100)::BIGINT AS cluster, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)")
def jn14(spark, sf):
    m = table(spark, sf, "lineitem").select("l_partkey").distinct()
    base = m.select((F.col("l_partkey") % 100).alias("cluster"), F.col("l_partkey").alias("member"))
    after = m.select((F.col("l_partkey") % 20).alias("cluster"), F.col("l_partkey").alias("member"))
    return rel.lineage(base, after)


@query("jn15_anti", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def jn15(spark, sf):
    """Customers without an urgent order."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query("jn16_semi", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def jn16(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), "id", "left_semi")


@query("jn17_manifest_diff", """WITH o AS (SELECT p_partkey AS id, p_brand AS v FROM part WHERE p_partkey%7 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey%5=0 THEN 'x' ELSE p_brand END AS v FROM part WHERE p_partkey%11 <> 0)
    SELECT coalesce(o.id,n.id) AS id, o.v AS old_value, n.v AS new_value, CASE WHEN o.id IS NULL THEN 'ADDED' WHEN n.id IS NULL THEN 'REMOVED' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM o FULL JOIN n ON o.id = n.id""")
def jn17(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("v"))
    return rel.diff(p.where("id % 7 <> 0"), p.where("id % 11 <> 0").withColumn("v", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("v"))), "id", "v")


@query("jn18_staleness", "SELECT o_orderkey AS run, CASE WHEN c_custkey IS NULL THEN 'MISSING' WHEN o_custkey%4 = c_nationkey%4 THEN 'CURRENT' ELSE 'STALE' END AS state FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jn18(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(F.col("o_orderkey").alias("run"), F.when(F.col("c_custkey").isNull(), "MISSING").when(F.col("o_custkey") % 4 == F.col("c_nationkey") % 4, "CURRENT").otherwise("STALE").alias("state"))


@query("jn19_retest", "SELECT d.doc_id AS id, CASE WHEN l.toxic IS NULL THEN 'INCOMPLETE' WHEN l.toxic = d.doc_id%2 THEN 'AGREE' ELSE 'DISAGREE' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn19(spark, sf):
    j = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return j.select(F.col("doc_id").alias("id"), F.when(F.col("toxic").isNull(), "INCOMPLETE").when(F.col("toxic") == F.col("doc_id") % 2, "AGREE").otherwise("DISAGREE").alias("state"))


@query("jn20_fallback", "SELECT l_orderkey AS id, arg_min(l_shipdate, l_linenumber::BIGINT*1000000000+l_partkey*10000+l_suppkey) FILTER (WHERE l_returnflag <> 'N') AS variant FROM lineitem GROUP BY 1")
def jn20(spark, sf):
    ok = F.col("l_returnflag") != "N"
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_shipdate", F.when(ok, F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 10000 + F.col("l_suppkey"))).alias("variant"))


@query("jn21_upsert", """WITH o AS (SELECT p_partkey AS id, p_brand AS v FROM part WHERE p_partkey%3 <> 0), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey%2=0 THEN p_type END AS v FROM part WHERE p_partkey%4=0) SELECT coalesce(o.id,n.id) AS id, coalesce(n.v,o.v) AS v FROM o FULL JOIN n ON o.id=n.id""")
def jn21(spark, sf):
    p = table(spark, sf, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("v")).where("id % 3 <> 0")
    new = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("v"))
    return rel.upsert(old, new, "id")


@query("st02_first_wins", "SELECT o_custkey AS id, arg_min(o_orderkey, o_orderkey) AS first, list_sort(list(DISTINCT o_orderstatus))::VARCHAR[] AS states FROM orders GROUP BY 1")
def st02(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first"), "o_orderstatus")
    return so.first_wins(o, ["id"], ["first"], {"states": "o_orderstatus"}).select("id", "first", "states")


@query("st03_fold_case", "SELECT lower(p_type) AS key, min(p_partkey) AS first FROM part GROUP BY 1")
def st03(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower("p_type").alias("key")).agg(F.min("p_partkey").alias("first"))


@query("st05_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 48")
def st05(spark, sf):
    """Parts that no large line ever had."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).distinct().join(table(spark, sf, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("k")), "k", "left_anti")


@query("st07_set_digest", "SELECT digest FROM (" + digest_sql("(SELECT DISTINCT s_name FROM supplier)", [], "s_name", "s_name") + ")")
def st07(spark, sf):
    return so.digest_of_set(table(spark, sf, "supplier"), "s_name")


@query("st08_intersection", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def st08(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")))


OPPOSITE = [("1-URGENT", "5-LOW"), ("2-HIGH", "4-NOT SPECIFIED")]


@query("st09_opposites", "WITH o AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS p FROM orders), t(first,second) AS (VALUES ('1-URGENT','5-LOW'),('2-HIGH','4-NOT SPECIFIED')) SELECT a.id, t.first, t.second FROM o a JOIN t ON a.p=t.first JOIN o b ON b.id=a.id AND b.p=t.second")
def st09(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("p"))
    return so.opposites(o, "id", "p", OPPOSITE)


@query("gv01_readiness", "SELECT c_custkey AS id, CASE WHEN NOT c_acctbal > 0 THEN 'NO_FUNDS' WHEN NOT c_nationkey < 20 THEN 'NO_REGION' WHEN NOT c_mktsegment <> 'BUILDING' THEN 'NO_SEGMENT' ELSE 'READY' END AS state FROM customer")
def gv01(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), so.first_unmet([(F.col("c_acctbal") > 0, "NO_FUNDS"), (F.col("c_nationkey") < 20, "NO_REGION"), (F.col("c_mktsegment") != "BUILDING", "NO_SEGMENT")], "READY").alias("state"))


@query("gv02_gate_reasons", "SELECT c_custkey AS id, list_filter([CASE WHEN NOT c_acctbal > 0 THEN 'funds' END, CASE WHEN NOT c_nationkey < 20 THEN 'region' END], lambda x: x IS NOT NULL) AS reasons FROM customer")
def gv02(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), so.reasons({"funds": F.col("c_acctbal") > 0, "region": F.col("c_nationkey") < 20}).alias("reasons"))


@query("gv08_blind_order", "SELECT c_custkey AS id, sha256('salt|' || c_custkey) AS place_key FROM customer")
def gv08(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.sha2(F.concat(F.lit("salt|"), F.col("c_custkey").cast("string")), 256).alias("place_key"))


@query("gv10_mismatch", "SELECT l_returnflag AS flag, CASE WHEN sign(l_linenumber-4) > 0 THEN 'over' WHEN sign(l_linenumber-4) < 0 THEN 'under' ELSE 'equal' END AS direction, count(*) AS n FROM lineitem GROUP BY 1,2")
def gv10(spark, sf):
    d = F.col("l_linenumber") - 4
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.when(d > 0, "over").when(d < 0, "under").otherwise("equal").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("gv15_upstream", "SELECT o_custkey AS stage, bool_and(o_orderstatus <> 'P') AS ready, coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'P'), -1) AS first_block FROM orders GROUP BY 1")
def gv15(spark, sf):
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("stage")).agg(F.bool_and(s != "P").alias("ready"), F.coalesce(F.min(F.when(s == "P", F.col("o_orderkey"))), F.lit(-1)).alias("first_block"))


@query("gv16_timeline", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE value >= 80")
def gv16(spark, sf):
    return table(spark, sf, "events").where("value >= 80").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
