"""Queries over free text and raw concepts: interpretation, normalising, sanitising and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from huestrata.functions import text as tx
from huestrata.operators import lexicon as lx
from huestrata.plans.registry import query
from huestrata.sources.tables import table

R = lambda x, n=6: F.round(x, n)

# --- texts ------------------------------------------------------------------------------------

CUES = ["非常", "稍微", "主要", "", "不要", "很", "偏", "避免", "極度", "有點", "不能太過於", "一點"]
TERMS = [t for spellings, *_ in lx.PATTERNS for t in spellings]
STOPS = ["，", "和", "。"]


def _pick(items, at):
    return F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))


def _quoted(items) -> str:
    return "[" + ",".join("'" + x + "'" for x in items) + "]"


def _pick_sql(items, at) -> str:
    return f"{_quoted(items)}[({at})::INT+1]"


def texts(spark, sf):
    """One description per part: two cues with a term each; every seventeenth holds no term."""
    k, n = F.col("p_partkey"), len(TERMS)
    said = F.concat(_pick(CUES, k % 12), _pick(TERMS, k % n), _pick(STOPS, k % 3), _pick(CUES, F.floor(k / 12) % 12), _pick(TERMS, (k * 7 + 3) % n))
    return table(spark, sf, "part").select(k.alias("id"), F.when(k % 17 == 0, F.concat(F.lit("  "), "p_name", F.lit(" (0) in "), "p_brand")).otherwise(said).alias("text"))


TEXTS_SQL = f"""t AS (SELECT p_partkey AS id, CASE WHEN p_partkey%17=0 THEN '  ' || p_name || ' (0) in ' || p_brand ELSE
    {_pick_sql(CUES, 'p_partkey%12')} || {_pick_sql(TERMS, f'p_partkey%{len(TERMS)}')} || {_pick_sql(STOPS, 'p_partkey%3')} || {_pick_sql(CUES, 'p_partkey//12%12')} || {_pick_sql(TERMS, f'(p_partkey*7+3)%{len(TERMS)}')} END AS text FROM part)"""
PATTERNS_SQL = "pat(nth, spelling, term, kind, search, rule) AS (VALUES " + ",".join(f"({i},{j},'{t}','{kind}','{search}','{rule}')" for i, (spellings, kind, search, rule) in enumerate(lx.PATTERNS) for j, t in enumerate(spellings)) + ")"


def _clean_sql(x: str) -> str:
    plain = rf"trim(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}\- ]+', '', 'g'))"
    return rf"array_to_string(list_filter(regexp_split_to_array({plain}, '\s+'), lambda w: w NOT IN ('', '0'))[1:3], ' ')"


NEAR_SQL = "substr(text, greatest(instr(text,term)-5,1), length(term)+10)"
PRIORITY_SQL = f"CASE WHEN regexp_matches({NEAR_SQL},'主要|最重要|尤其') THEN 'main' WHEN regexp_matches({NEAR_SQL},'稍微|有點|一點|些微') THEN 'slight' ELSE 'secondary' END"
INTENSITY_SQL = f"""(CASE WHEN regexp_matches({NEAR_SQL},'極度') THEN 1.5 WHEN regexp_matches({NEAR_SQL},'非常') THEN 1.4 WHEN regexp_matches({NEAR_SQL},'強烈|主要') THEN 1.3 WHEN regexp_matches({NEAR_SQL},'很') THEN 1.2
    WHEN regexp_matches({NEAR_SQL},'偏') THEN 0.85 WHEN regexp_matches({NEAR_SQL},'有點') THEN 0.7 WHEN regexp_matches({NEAR_SQL},'稍微') THEN 0.6 WHEN regexp_matches({NEAR_SQL},'一點|些微') THEN 0.5 ELSE 1.0 END)::DOUBLE"""
NEGATED_SQL = "regexp_matches(text, '(?:不要|不想要|避免|排除|不能太|不可以太|不要過度)[^，。；、]{0,8}' || term)"


@query("src07_interpret", f"""WITH {TEXTS_SQL}, {PATTERNS_SQL}, h AS (SELECT id, text, nth, term, kind, search, rule, row_number() OVER (PARTITION BY id, nth ORDER BY spelling) AS s FROM t JOIN pat ON contains(text, term)),
    f AS (SELECT id, nth, term, CASE WHEN {NEGATED_SQL} THEN 'exclusion' ELSE kind END AS category, search AS search_term, rule AS color_rule, CASE WHEN {NEGATED_SQL} THEN 'exclude' ELSE {PRIORITY_SQL} END AS priority, {INTENSITY_SQL} AS intensity, 0.72::DOUBLE AS confidence FROM h WHERE s = 1),
    d AS (SELECT *, row_number() OVER (PARTITION BY id, category, search_term ORDER BY nth) AS rn FROM f)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY nth) AS no, term, category, search_term, color_rule, priority, intensity, confidence, CASE WHEN color_rule <> 'none' THEN 'standard' ELSE 'search_only' END AS retrieval_mode FROM d WHERE rn = 1
    UNION ALL SELECT id, 1, text, 'subject', {_clean_sql('text')}, 'none', 'main', 1.0, 0.35, 'search_only' FROM t WHERE id NOT IN (SELECT id FROM h)""")  # fmt: skip
def src07(spark, sf):
    return lx.interpret(texts(spark, sf), "id")


@query("fn33_cue_window", f"WITH {TEXTS_SQL}, x AS (SELECT *, {_pick_sql(TERMS, f'id%{len(TERMS)}')} AS term FROM t) SELECT id, {PRIORITY_SQL} AS priority, {INTENSITY_SQL} AS intensity, {NEGATED_SQL} AS negated FROM x")
def fn33(spark, sf):
    """Priority, intensity and negation of a term wherever it may stand; a term that is not there has no cues."""
    term, t = _pick(TERMS, F.col("id") % len(TERMS)), F.col("text")
    where = lx.around(t, term)
    return texts(spark, sf).select("id", lx.first_cue(where, lx.PRIORITY_CUES, "secondary").alias("priority"), lx.first_cue(where, lx.INTENSITY_CUES, 1.0).alias("intensity"), lx.negated(t, term).alias("negated"))


# --- raw concepts -----------------------------------------------------------------------------

RAW_CATEGORY, RAW_PRIORITY = ["Subject ", "context", "color", "EXCLUSION", "mood", "exclusion"], ["main", "Very Important", "secondary", "low", "??", "exclude", "very-important"]
RAW_RULE = ["bright", "Very Dark", "muted", "none", "heavy9", "low saturation", "", "High-Saturation"]


def concepts(spark, sf):
    """One raw concept per part, eight to an input: odd spellings, repeated terms, values out of range, and some without any text.

    Parts are dealt by input first: their file is small and would be read by few tasks.
    """
    k, name, kind, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    bare = k % 10 == 0
    search = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(name, F.lit("!!"))).when(k % 5 == 2, F.concat(F.lit("  "), kind, F.lit('  x-ray "quoted" more words'))).when(k % 5 == 3, F.concat(brand, F.lit(" 0 #1"))).otherwise(name)
    element = lambda t, f: F.struct(t.alias("term"), f.alias("family"))
    family = (k % 3).cast("string")
    themes = F.array(element(name, F.concat(F.lit("Fam-"), family)), element(F.lit("Retro"), F.lit("x")), element(kind, F.lit(None).cast("string")), element(name, F.concat(F.lit("fam "), family)), element(F.lit(""), F.lit("z")))
    tags = F.array(F.lit("Red"), F.lit("red "), F.lit("mauve"), _pick(["dark", "cool", "vivid", "pink"], k % 4), brand, F.lit("Light"), F.lit("blue"))
    return table(spark, sf, "part").withColumn("input", F.floor(k / 8)).repartition("input").select(
        k.alias("id"), "input", _pick(RAW_CATEGORY, k % 6).alias("category"), F.when(k % 11 != 0, _pick(RAW_PRIORITY, k % 7)).alias("priority"), search.alias("search_term"),
        F.when((k % 3 == 0) | bare, "").otherwise(name).alias("original_text"),
        F.when(bare, F.array().cast("array<string>")).otherwise(F.array(name, F.upper(name), kind, F.lit(""), brand, F.lit("a b c d"))).alias("style_terms"),
        F.when(bare, F.slice(themes, 1, 0)).otherwise(themes).alias("theme_elements"), F.when(bare, F.array().cast("array<string>")).otherwise(tags).alias("visual_tags"),
        F.when(k % 13 != 0, _pick(RAW_RULE, k % 8)).alias("color_rule"), (k % 20 / 10.0).alias("intensity"), (k % 13 / 10.0).alias("confidence"),
    )


CONCEPTS_SQL = f"""raw AS (SELECT p_partkey AS id, p_partkey//8 AS input, {_pick_sql(RAW_CATEGORY, 'p_partkey%6')} AS category, CASE WHEN p_partkey%11<>0 THEN {_pick_sql(RAW_PRIORITY, 'p_partkey%7')} END AS priority,
    CASE p_partkey%5 WHEN 0 THEN '' WHEN 1 THEN p_name || '!!' WHEN 2 THEN '  ' || p_type || '  x-ray "quoted" more words' WHEN 3 THEN p_brand || ' 0 #1' ELSE p_name END AS search_term,
    CASE WHEN p_partkey%3=0 OR p_partkey%10=0 THEN '' ELSE p_name END AS original_text, CASE WHEN p_partkey%10=0 THEN []::VARCHAR[] ELSE [p_name, upper(p_name), p_type, '', p_brand, 'a b c d'] END AS style_terms,
    CASE WHEN p_partkey%10=0 THEN [] ELSE [{{'t': p_name, 'f': 'Fam-' || p_partkey%3}}, {{'t': 'Retro', 'f': 'x'}}, {{'t': p_type, 'f': 'visual_element'}}, {{'t': p_name, 'f': 'fam ' || p_partkey%3}}, {{'t': '', 'f': 'z'}}] END AS theme_elements,
    CASE WHEN p_partkey%10=0 THEN []::VARCHAR[] ELSE ['Red','red ','mauve',{_pick_sql(['dark', 'cool', 'vivid', 'pink'], 'p_partkey%4')},p_brand,'Light','blue'] END AS visual_tags,
    CASE WHEN p_partkey%13<>0 THEN {_pick_sql(RAW_RULE, 'p_partkey%8')} END AS color_rule, (p_partkey%20/10.0)::DOUBLE AS intensity, (p_partkey%13/10.0)::DOUBLE AS confidence FROM part)"""


def _distinct_sql(items: str, most: int, by: str = "lower({})") -> str:
    some = f"list_filter({items}, lambda x: length(x) > 0)"
    return f"list_filter({some}, lambda x, i: list_position(list_transform({some}, lambda y: {by.format('y')}), {by.format('x')}) = i)[1:{most}]"


STYLE_SQL = _distinct_sql(f"list_transform(style_terms, lambda s: {_clean_sql('s')})", 3)
FAMILY_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(e.f)), '[^a-z0-9_\- ]+', '', 'g'), '[\s\-]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _themes_sql(generic: bool) -> str:
    keep = "" if generic else " AND lower(c.t) NOT IN (" + ",".join(f"'{x}'" for x in lx.GENERIC_ELEMENTS) + ")"
    pairs = f"list_filter(list_transform(theme_elements, lambda e: {{'t': {_clean_sql('e.t')}, 'f': {FAMILY_SQL}}}), lambda c: length(c.t) > 0{keep})"
    return _distinct_sql(f"list_transform({pairs}, lambda c: c.f || '|' || c.t)", 8)


TAGS_SQL = _distinct_sql("list_filter(list_transform(visual_tags, lambda s: lower(trim(s))), lambda s: s IN (" + ",".join(f"'{x}'" for x in lx.VISUAL_TAGS) + "))", 3)
RULES_SQL = ",".join(f"'{x}'" for x in lx.COLOR_RULES)


@query("prj01_concepts", f"""WITH {CONCEPTS_SQL}, a AS (SELECT id, input, CASE WHEN lower(trim(category)) IN ('subject','context','atmosphere','color','exclusion') THEN lower(trim(category)) ELSE 'atmosphere' END AS cat, coalesce(lower(trim(priority)),'secondary') AS pri,
    {_clean_sql('search_term')} AS search_term, trim(original_text) AS original_text, {STYLE_SQL} AS style_terms, {_themes_sql(False)} AS theme_elements, {TAGS_SQL} AS visual_tags,
    CASE WHEN regexp_replace(lower(trim(coalesce(color_rule,'none'))),'[^a-z_]','','g') = '' THEN 'none' ELSE regexp_replace(lower(trim(coalesce(color_rule,'none'))),'[^a-z_]','','g') END AS rule, intensity, confidence FROM raw),
    b AS (SELECT *, CASE WHEN pri IN ('main','secondary','slight','exclude') THEN pri ELSE 'secondary' END AS p2 FROM a),
    c AS (SELECT id, input, CASE WHEN cat='exclusion' OR p2='exclude' THEN 'exclusion' ELSE cat END AS category, CASE WHEN cat='exclusion' OR p2='exclude' THEN 'exclude' ELSE p2 END AS priority, search_term, original_text, style_terms, theme_elements, visual_tags,
      CASE WHEN rule IN ({RULES_SQL}) THEN rule ELSE 'none' END AS color_rule, CASE WHEN pri IN ('main','secondary','slight','exclude') THEN 'exact' ELSE 'unmapped' END AS priority_status, CASE WHEN rule IN ({RULES_SQL}) THEN 'exact' ELSE 'unmapped' END AS color_status,
      least(1.5,greatest(0.5,intensity))::DOUBLE AS intensity, least(1.0,greatest(0.0,confidence))::DOUBLE AS confidence FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY input, lower(category || '|' || CASE WHEN search_term <> '' THEN search_term ELSE original_text END) ORDER BY id) AS rn FROM c WHERE NOT (search_term = '' AND original_text = '' AND len(style_terms)+len(theme_elements)+len(visual_tags) = 0))
    SELECT * EXCLUDE (rn), CASE WHEN color_rule <> 'none' AND color_status <> 'unmapped' THEN 'standard' WHEN len(visual_tags) > 0 THEN 'dual_track' ELSE 'search_only' END AS retrieval_mode FROM d WHERE rn = 1""")  # fmt: skip
def prj01(spark, sf):
    return lx.sanitize(concepts(spark, sf), "input", "id")


TOKEN_SQL = r"regexp_replace(lower(trim(coalesce({}, ''))), '[\s-]+', '_', 'g')"


@query("prj06_alias_status", f"""WITH {CONCEPTS_SQL}, a AS (SELECT id, lower(trim(category)) AS cat, {TOKEN_SQL.format('priority')} AS p, {TOKEN_SQL.format('color_rule')} AS c, least(1.0,greatest(0.0,confidence)) AS conf FROM raw),
    b AS (SELECT id, conf, CASE WHEN cat='exclusion' THEN 'exclude' WHEN p IN ('main','secondary','slight') THEN p WHEN p IN ('very_important','primary','important') THEN 'main' WHEN p IN ('minor','low') THEN 'slight' ELSE 'secondary' END AS priority,
      CASE WHEN cat='exclusion' THEN CASE WHEN p='exclude' THEN 'exact' ELSE 'normalized' END WHEN p IN ('main','secondary','slight') THEN 'exact' WHEN p IN ('very_important','primary','important','normal','medium','minor','low') THEN 'normalized' ELSE 'unmapped' END AS priority_status,
      CASE WHEN c IN ({RULES_SQL}) THEN c WHEN c IN ('darkness','very_dark') THEN 'dark' WHEN c = 'bright_light' THEN 'bright' WHEN c IN ('muted','low_saturation') THEN 'low_chroma' WHEN c IN ('saturated','high_saturation') THEN 'high_chroma' ELSE 'none' END AS color_rule,
      CASE WHEN c IN ({RULES_SQL}) THEN 'exact' WHEN c IN ('darkness','very_dark','bright_light','muted','low_saturation','saturated','high_saturation') THEN 'normalized' ELSE 'unmapped' END AS color_status FROM a)
    SELECT id, priority, priority_status, color_rule, color_status, round(greatest(0, greatest(0, conf - CASE priority_status WHEN 'normalized' THEN 0.05 WHEN 'unmapped' THEN 0.15 ELSE 0 END) - CASE color_status WHEN 'normalized' THEN 0.05 WHEN 'unmapped' THEN 0.25 ELSE 0 END), 6)::DOUBLE AS confidence FROM b""")  # fmt: skip
def prj06(spark, sf):
    p, ps = lx.normalize_priority(F.col("priority"), F.lower(F.trim("category")))
    c, cs = lx.normalize_color_rule(F.col("color_rule"))
    rows = concepts(spark, sf).select("id", p.alias("priority"), ps.alias("priority_status"), c.alias("color_rule"), cs.alias("color_status"), "confidence")
    return rows.withColumn("confidence", R(lx.doubted(F.col("confidence"), F.col("priority_status"), F.col("color_status"))))


@query("prj15_facets", f"WITH {CONCEPTS_SQL} SELECT id, {STYLE_SQL} AS style_terms, {_themes_sql(True)} AS theme_elements, {TAGS_SQL} AS visual_tags FROM raw")
def prj15(spark, sf):
    """Facets with their caps; unlike sanitising, terms that say little stay."""
    return concepts(spark, sf).select("id", lx.style_terms(F.col("style_terms")).alias("style_terms"), lx.theme_elements(F.col("theme_elements"), drop_generic=False).alias("theme_elements"), lx.visual_tags(F.col("visual_tags")).alias("visual_tags"))


# --- conflicts --------------------------------------------------------------------------------

RAW_TYPE, RAW_RESOLUTION = ["color_conflict", "priority_conflict", "other"], ["branch", "ask_user", "whatever", "use_primary"]


def conflicts(spark, sf):
    """One raw conflict per order: terms with blanks, repeats and empty ones; the customer is the input."""
    k = F.col("o_orderkey")
    terms = F.array(F.concat(F.lit(" "), "o_orderpriority"), F.when(k % 4 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")), F.lit("  "), F.when(k % 3 == 0, F.lit("x")).otherwise(F.lit("")), F.when(k % 6 == 0, F.lit("y")).otherwise(F.lit("")))
    return table(spark, sf, "orders").select(k.alias("id"), F.col("o_custkey").alias("input"), F.when(k % 2 == 0, F.reverse(terms)).otherwise(terms).alias("terms"), _pick(RAW_TYPE, k % 3).alias("type"), _pick(RAW_RESOLUTION, k % 4).alias("resolution"), F.when(k % 5 == 0, "  ").otherwise("said").alias("reason"))


CONFLICTS_SQL = f"""rc AS (SELECT o_orderkey AS id, o_custkey AS input, [' ' || o_orderpriority, CASE WHEN o_orderkey%4=0 THEN o_orderpriority ELSE o_orderstatus END, '  ', CASE WHEN o_orderkey%3=0 THEN 'x' ELSE '' END, CASE WHEN o_orderkey%6=0 THEN 'y' ELSE '' END] AS l,
      {_pick_sql(RAW_TYPE, 'o_orderkey%3')} AS ty, {_pick_sql(RAW_RESOLUTION, 'o_orderkey%4')} AS re, CASE WHEN o_orderkey%5=0 THEN '  ' ELSE 'said' END AS why FROM orders),
    rt AS (SELECT id, input, list_transform(CASE WHEN id%2=0 THEN list_reverse(l) ELSE l END, lambda x: trim(x)) AS l, ty, re, why FROM rc),
    rd AS (SELECT id, input, {_distinct_sql('l', 99, '{}')} AS l, CASE WHEN ty IN ('color_conflict','atmosphere_conflict','priority_conflict') THEN ty ELSE 'color_conflict' END AS type, CASE WHEN re IN ('use_primary','reduce_secondary','branch','ask_user') THEN re ELSE 'branch' END AS resolution, CASE WHEN trim(why)='' THEN '偵測到方向相反的需求。' ELSE trim(why) END AS reason FROM rt),
    conflicts AS (SELECT id, input, l[1:3] AS terms, type, resolution, reason FROM rd WHERE len(l) >= 2)"""


@query("prj15_conflicts", f"WITH {CONFLICTS_SQL} SELECT * FROM conflicts")
def prj15_conflicts(spark, sf):
    return lx.normalize_conflicts(conflicts(spark, sf))


@query("st06_conflict_merge", f"WITH {CONFLICTS_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY input, type || '|' || array_to_string(list_sort(terms),'|') ORDER BY id) AS rn FROM conflicts) SELECT * EXCLUDE (rn) FROM m WHERE rn = 1")
def st06(spark, sf):
    return lx.merge_conflicts(lx.normalize_conflicts(conflicts(spark, sf)), "input", ["id"])
