"""Queries over search results and colour pairs whose picks depend on each other, and over terms, pages and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from huestrata.functions import color as c
from huestrata.functions import text as tx
from huestrata.operators import lexicon as lx
from huestrata.operators import profiles as pr
from huestrata.operators import ranking as rk
from huestrata.operators import relations as rel
from huestrata.plans.hierarchy import style_swatches
from huestrata.plans.interpretation import concepts
from huestrata.plans.registry import ORACLES, query
from huestrata.plans.search import PHOTOS, photos, scored
from huestrata.sources.tables import table

R = lambda x, n=6: F.round(x, n)

# --- terms ------------------------------------------------------------------------------------

PRIMARY, SUPPORT = ["red widget", "brand 7"], ["red widget", "widget", "red", "small ring", "ring", "new gear", "gear", "large", "small", "vintage", "economy", "standard"]


@query("flt03_term_set", f"""WITH m AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' / ' || p_type || ' vintage'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM part),
    h AS (SELECT id, list_filter({PRIMARY}, lambda x: contains(t, x)) AS first, list_filter({SUPPORT}, lambda x: contains(t, x)) AS more FROM m), k AS (SELECT id, first, list_filter(more, lambda x: contains(x, ' ') OR len(list_filter(more, lambda p: contains(p, ' ') AND list_contains(string_split(p, ' '), x))) = 0) AS more FROM h),
    e AS (SELECT *, least(1.0, list_sum(list_transform(more, lambda x: CASE WHEN contains(x, ' ') THEN 0.5 WHEN x IN ('vintage') THEN 0.0 ELSE 0.08 END))) AS score FROM k)
    SELECT id, len(first) > 0 AS primary_matched, more AS support_terms, round(coalesce(score,0),5)::DOUBLE AS evidence, coalesce(score,0) >= 0.70 AS strong FROM e""")
def flt03(spark, sf):
    """Which terms a photo's text holds; a phrase takes its words with it, and phrases weigh more than words."""
    text = tx.normalize_text(F.concat("p_name", F.lit(" / "), "p_type", F.lit(" vintage")))
    m = tx.term_set(text, PRIMARY, SUPPORT)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), m["primary_matched"].alias("primary_matched"), m["support_terms"].alias("support_terms"), R(m["evidence"], 5).alias("evidence"), (m["evidence"] >= 0.70).alias("strong"))


# --- turns and caps ---------------------------------------------------------------------------


@query("tk03_round_robin")
def tk03(spark, sf):
    """A balanced slice of every hundred results over families and providers; buckets of 4 to 20."""
    p = photos(spark, sf).select("id", F.floor(F.col("id") / 100).alias("pool"), "provider", (F.col("id") % 3).alias("family"))
    return rk.balanced_slice(p, ["pool"], ["family", "provider"], "id", 60).select("pool", "place", "id")


def pairs(spark, sf):
    s = style_swatches(spark, sf).repartition("style").withColumns({"C": c.chroma(F.col("a"), F.col("bb")), "H": c.hue(F.col("a"), F.col("bb"))})
    p = rel.physical(rel.all_pairs(s, ["id", "L", "a", "bb", "C", "H"], ["style"]))
    return p.withColumn("pair_key", tx.pair_key(F.col("id_1").cast("string"), F.col("id_2").cast("string")))


@query("tk06_stratified")
def tk06(spark, sf):
    """Four pairs of each cell of a four by four grid of lightness and chroma differences, far apart, with a price on using a mode again."""
    cell = lambda x, k: F.least(F.lit(3), F.floor(F.col(x) * k).cast("int"))
    p = pairs(spark, sf).select("pair_key", "id_1", "id_2", "delta_L", "delta_C", "hue_chord", "min_C", "max_C", cell("delta_L", 32).alias("row"), cell("delta_C", 50).alias("col"))
    return rk.stratified_diverse(p, ["row", "col"], ["delta_C", "delta_L", "hue_chord", "min_C", "max_C"], 4, "tk06")


@query("tk07_capped_strata")
def tk07(spark, sf):
    """Nine pairs near a boundary: three of hue applicability, hue relation and tone each, on both sides; no mode more than twice."""
    p = pairs(spark, sf)
    k = c.rule_classes(F.col("delta_L"), F.col("delta_C"), F.col("delta_H"), F.col("min_C"))
    apart = F.col("delta_L") + 4 * F.sqrt(F.col("delta_L") * F.col("delta_C"))
    close = (F.col("delta_L") <= 0.06) & (F.col("delta_C") <= 0.033)
    p = p.select(
        "pair_key", "id_1", "id_2", F.abs(F.col("min_C") - 0.03).alias("chroma_margin"), F.when(F.col("min_C") >= 0.03, F.abs(F.col("delta_H") - 40)).alias("hue_margin"), F.when(~close, F.abs(apart - 0.54)).alias("tone_margin"),
        (F.col("min_C") >= 0.03).alias("reliable"), (F.col("delta_H") <= 40).alias("adjacent"), (apart >= 0.54).alias("different"), *(v.alias(f"class_{n}") for n, v in k.items()))
    takes = []
    for category, margin, side in (("hue_applicability", "chroma_margin", F.col("reliable")), ("hue_relation", "hue_margin", ~F.col("adjacent")), ("tone", "tone_margin", F.col("different"))):
        takes += [(category, margin, ~side, 1), (category, margin, side, 1), (category, margin, None, 1)]
    return rk.boundary_take(p, takes)


@query("tk10_evaluation_pick", f"WITH {PHOTOS}, g AS (SELECT id, id//100 AS pool, provider AS family, row_number() OVER (PARTITION BY id//100 ORDER BY round(score,9) DESC, id) AS rank, gate = 'PASS' OR id%3 = 0 AS good FROM scored), k AS (SELECT *, row_number() OVER (PARTITION BY pool, family ORDER BY rank) AS of_family FROM g WHERE good AND rank <= 40), t AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY (of_family > 8)::INT, rank) AS turn FROM k) SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY rank) AS place, id, rank FROM t WHERE turn <= 24")
def tk10(spark, sf):
    """Of every pool up to 24 good results among the first forty, in order; more than eight of a family only where others do not fill the set."""
    pool = F.floor(F.col("id") / 100)
    g = scored(spark, sf).select("id", pool.alias("pool"), F.col("provider").alias("family"), F.row_number().over(Window.partitionBy(pool).orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"), ((F.col("gate") == "PASS") | (F.col("id") % 3 == 0)).alias("good"))
    return rk.softly_capped(g.where("good AND rank <= 40"), ["pool"], "family", "rank", 24, 8).select("pool", "place", "id", "rank")


# --- pages ------------------------------------------------------------------------------------

REQUESTS_SQL = "req AS (SELECT n_nationkey AS request, n_nationkey%20 AS search, greatest(1, n_nationkey%4) AS page, CASE n_nationkey%5 WHEN 0 THEN NULL WHEN 1 THEN 5 WHEN 2 THEN 20 WHEN 3 THEN 50 ELSE 30 END AS asked, 1+n_nationkey%3 AS queries, 1+n_nationkey%4 AS providers FROM nation), sized AS (SELECT *, least(36,greatest(12,coalesce(asked,30))) AS size FROM req)"


def requests(spark, sf):
    k = F.col("n_nationkey")
    r = table(spark, sf, "nation").select(k.alias("request"), (k % 20).alias("search"), F.greatest(F.lit(1), k % 4).alias("page"), F.when(k % 5 == 1, 5).when(k % 5 == 2, 20).when(k % 5 == 3, 50).when(k % 5 == 4, 30).alias("asked"), (1 + k % 3).alias("queries"), (1 + k % 4).alias("providers"))
    return r.withColumn("size", rk.page_size(F.col("asked")))


@query("tk13_page", f"WITH {PHOTOS}, {REQUESTS_SQL}, r AS (SELECT id, search, row_number() OVER (PARTITION BY search ORDER BY round(score,9) DESC, id) AS place FROM scored) SELECT request, id, place FROM sized JOIN r USING (search) WHERE place > (page-1)*size AND place <= page*size")
def tk13(spark, sf):
    """The rows of every asked page. Requests are few; ranks of a search are taken up to the last row that any page needs."""
    place = F.row_number().over(Window.partitionBy("search").orderBy(F.desc(F.round("score", 9)), "id"))
    ranked = scored(spark, sf).select("id", "search", place.alias("place"))
    r = requests(spark, sf).select("request", "search", ((F.col("page") - 1) * F.col("size")).alias("first"), (F.col("page") * F.col("size")).alias("last"))
    return ranked.join(F.broadcast(r), "search").where("place > first AND place <= last").select("request", "id", "place")


@query("tk13_per_query", f"WITH {REQUESTS_SQL} SELECT request, size, least(18,greatest(8,(ceil(size/queries::DOUBLE/providers)+2)::INT)) AS per_query FROM sized")
def tk13_per_query(spark, sf):
    return requests(spark, sf).select("request", "size", rk.per_query(F.col("size"), F.col("queries"), F.col("providers")).alias("per_query"))


# --- branches and plans -----------------------------------------------------------------------

FEATURES = ["meanLightness", "meanChroma", "temperature", "contrast", "visualWeight", "neutralRatio", "darkRatio"]


def _feature(i, scale, shift):
    return (F.col("c_custkey") * (11 + 2 * i) % 100 / 100.0) * scale + shift


SCALES = {"meanLightness": (1.0, 0.0), "meanChroma": (0.33, 0.0), "temperature": (2.0, -1.0), "contrast": (1.0, 0.0), "visualWeight": (1.0, 0.0), "neutralRatio": (1.0, 0.0), "darkRatio": (1.0, 0.0)}
_BASE_SQL = ", ".join(f"((c_custkey*{11 + 2 * i}%100)/100.0::DOUBLE)*{s}+{t} AS {f}" for i, (f, (s, t)) in enumerate(SCALES.items()))
_DELTA_SQL = {f: "CASE code " + " ".join(f"WHEN '{b}' THEN {d.get(f, 0.0)}" for b, d in pr.DELTAS.items()) + " END" for f in FEATURES}
_MOVED_SQL = ", ".join(f"greatest({lo},least({hi},{'temperature*CASE code WHEN ' + chr(39) + 'A' + chr(39) + ' THEN 0.75 ELSE 1.0 END' if f == 'temperature' else f'{f}+{_DELTA_SQL[f]}'}))::DOUBLE AS m_{f}" for f, (lo, hi) in pr.RANGES.items())
_LIMIT_SQL = {"contrast": "least(m_contrast, 0.7)", "darkRatio": "greatest(m_darkRatio, 0.2)"}


@query("pl01_branches", f"""WITH b(code) AS (VALUES ('A'),('B'),('C')), t AS (SELECT c_custkey AS id, {_BASE_SQL} FROM customer), m AS (SELECT t.*, code, {_MOVED_SQL} FROM t, b), k AS (SELECT id, code, {', '.join(f"{_LIMIT_SQL.get(f, 'm_' + f)} AS v_{f}, {f} AS b_{f}" for f in FEATURES)} FROM m)
    SELECT id, code, {', '.join(f'round(v_{f},6) AS {f}, round(v_{f}-b_{f},6) AS delta_{f}' for f in FEATURES)} FROM k""")
def pl01(spark, sf):
    """Three branches of every profile: moved, kept in range, then inside two constraints, with the difference from the base."""
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *(_feature(i, *SCALES[f]).alias(f) for i, f in enumerate(FEATURES)))
    b = pr.branches(t).withColumns({"contrast": pr.clamp_to(F.col("contrast"), "maximum", 0.7), "darkRatio": pr.clamp_to(F.col("darkRatio"), "minimum", 0.2)})
    base = t.select("id", *(F.col(f).alias(f"base_{f}") for f in FEATURES))
    return b.join(base, "id").select("id", F.col("branch").alias("code"), *(x for f in FEATURES for x in (R(f).alias(f), R(F.col(f) - F.col(f"base_{f}")).alias(f"delta_{f}"))))


def _hint_sql(f, up, down):
    return f"CASE WHEN d_{f} >= 0.05 THEN '{up}' WHEN d_{f} <= -0.05 THEN '{down}' END"


@query("pl04_branch_hint", f"""WITH d AS (SELECT c_custkey AS id, {', '.join(f"(c_custkey*{11 + 2 * i}%41-20)/100.0 AS d_{f}" for i, (f, *_) in enumerate(pr.HINTS))} FROM customer) SELECT id, list_filter([{', '.join(_hint_sql(f, up, down) for f, up, down, _ in pr.HINTS)}], lambda x: x IS NOT NULL)[1:2] AS hints FROM d""")
def pl04(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *(((F.col("c_custkey") * (11 + 2 * i) % 41 - 20) / 100.0).alias(f"delta_{f}") for i, (f, *_) in enumerate(pr.HINTS)))
    return d.select("id", F.transform(pr.branch_hints(), lambda h: h["term"]).alias("hints"))


def _gather_sql(items: str, most: int, factor: float) -> str:
    where = "AND category <> 'exclusion'"
    return f"""WITH s AS ({ORACLES['prj01_concepts']}), x AS (SELECT input, id, list_position(['subject','context','atmosphere','color'], category) AS g, intensity*{factor} AS w, unnest({items}) AS item, generate_subscripts({items}, 1) AS pos FROM s WHERE TRUE {where}),
    d AS (SELECT *, row_number() OVER (PARTITION BY input, lower(item) ORDER BY g, id, pos) AS rn FROM x), k AS (SELECT input, item, w, row_number() OVER (PARTITION BY input ORDER BY w DESC, g, id, pos) AS place FROM d WHERE rn = 1) SELECT input, place, item, round(w,6) AS weight FROM k WHERE place <= {most}"""


def gathered(spark, sf, items, most, factor):
    """Items of an input's concepts in the order of their categories, each once, by weight."""
    s = lx.sanitize(concepts(spark, sf), "input", "id").where("category <> 'exclusion'")
    group = F.array_position(F.array(*map(F.lit, lx.CATEGORIES[:4])), F.col("category"))
    x = s.select("input", "id", group.alias("g"), (F.col("intensity") * factor).alias("w"), F.posexplode(items).alias("pos", "item"))
    d = x.withColumn("rn", F.row_number().over(Window.partitionBy("input", F.lower("item")).orderBy("g", "id", "pos"))).where("rn = 1")
    k = d.withColumn("place", F.row_number().over(Window.partitionBy("input").orderBy(F.desc("w"), "g", "id", "pos"))).where(F.col("place") <= most)
    return k.select("input", "place", "item", R("w").alias("weight"))


@query("pl05_style_gather", _gather_sql("style_terms", 8, 1.0))
def pl05(spark, sf):
    return gathered(spark, sf, "style_terms", 8, 1.0)


@query("pl05_theme_gather", _gather_sql("theme_elements", 16, 1.1))
def pl05_themes(spark, sf):
    return gathered(spark, sf, "theme_elements", 16, 1.1)


@query("pl02_query_plan")
def pl02(spark, sf):
    """Up to three queries for each branch of every input."""
    from huestrata.operators.planning import query_plans

    return query_plans(lx.sanitize(concepts(spark, sf), "input", "id"), "input", "id")
