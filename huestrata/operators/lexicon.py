"""Free text and raw concepts: rule-based interpretation, normalisation, sanitising and conflicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.functions import text as tx

# What is looked for in a text, in this order: its spellings, category, search term and colour rule.
PATTERNS = [
    (["咖啡店", "咖啡"], "subject", "coffee", "none"),
    (["花朵", "花"], "subject", "flowers", "none"),
    (["保養品"], "subject", "skincare", "none"),
    (["服飾"], "subject", "fashion", "none"),
    (["夏季", "夏天"], "context", "summer", "none"),
    (["秋季", "秋天"], "context", "autumn", "none"),
    (["夜晚", "夜間"], "context", "night", "none"),
    (["室內"], "context", "interior", "none"),
    (["明亮"], "color", "bright", "bright"),
    (["深沉"], "color", "deep moody", "deep"),
    (["沉穩"], "color", "calm stable", "calm"),
    (["柔和"], "color", "soft", "soft"),
    (["鮮明"], "color", "vivid", "vivid"),
    (["溫暖"], "color", "warm", "warm"),
    (["冷靜"], "color", "cool calm", "cool"),
    (["自然"], "color", "natural", "natural"),
    (["現代"], "color", "modern", "modern"),
    (["成熟"], "color", "mature", "mature"),
    (["親切"], "color", "friendly", "friendly"),
    (["奢華"], "color", "luxury", "luxurious"),
    (["活潑"], "color", "lively", "lively"),
    (["專業"], "color", "professional", "professional"),
    (["科技感"], "color", "futuristic technology", "technological"),
    (["簡約"], "color", "minimalist", "minimalist"),
    (["優雅"], "color", "elegant", "elegant"),
    (["浪漫"], "color", "romantic", "romantic"),
    (["清爽"], "color", "fresh clean", "refreshing"),
    (["神秘"], "color", "mysterious", "mysterious"),
    (["復古"], "color", "vintage", "vintage"),
    (["純淨"], "color", "pure clean", "pure"),
    (["大膽"], "color", "bold", "bold"),
    (["俏皮"], "color", "playful", "playful"),
    (["療癒", "治癒"], "color", "soothing healing", "healing"),
    (["悶熱"], "atmosphere", "humid heat", "humid_heat"),
    (["壓抑", "壓迫"], "atmosphere", "oppressive", "oppressive"),
    (["黑暗", "昏暗", "陰暗"], "color", "dark", "dark"),
    (["鮮豔"], "color", "vivid", "high_chroma"),
    (["低彩度", "低飽和"], "color", "muted", "low_chroma"),
    (["高彩度", "高飽和"], "color", "vivid", "high_chroma"),
    (["中性"], "color", "neutral", "neutral"),
    (["低對比"], "color", "low contrast", "low_contrast"),
    (["高對比"], "color", "high contrast", "high_contrast"),
    (["輕盈"], "color", "light airy", "light_weight"),
    (["厚重"], "color", "heavy", "heavy"),
]
# Cues near a term, first match wins, and the marks of a negation with the letters it reaches over.
PRIORITY_CUES = [("主要|最重要|尤其", "main"), ("稍微|有點|一點|些微", "slight")]
INTENSITY_CUES = [("極度", 1.5), ("非常", 1.4), ("強烈|主要", 1.3), ("很", 1.2), ("偏", 0.85), ("有點", 0.7), ("稍微", 0.6), ("一點|些微", 0.5)]
NEGATION = "(?:不要|不想要|避免|排除|不能太|不可以太|不要過度)[^，。；、]{0,8}"
CUE_REACH = 5
# Allowed values, aliases and what a doubtful mapping costs in confidence.
CATEGORIES = ["subject", "context", "atmosphere", "color", "exclusion"]
PRIORITIES = ["main", "secondary", "slight", "exclude"]
STATUSES = ["exact", "normalized", "unmapped"]
VISUAL_TAGS = ["red", "orange", "yellow", "green", "cyan", "blue", "purple", "pink", "warm", "cool", "dark", "light", "muted", "vivid"]
COLOR_RULES = [
    "none", "bright", "deep", "calm", "soft", "vivid", "warm", "cool", "natural", "modern", "mature", "friendly", "luxurious", "lively", "professional", "technological", "minimalist", "elegant",
    "romantic", "refreshing", "mysterious", "vintage", "pure", "bold", "playful", "healing", "dark", "light_weight", "heavy", "neutral", "low_contrast", "high_contrast", "high_chroma", "low_chroma",
    "oppressive", "humid_heat",
]
PRIORITY_ALIASES = {"very_important": "main", "primary": "main", "important": "main", "normal": "secondary", "medium": "secondary", "minor": "slight", "low": "slight"}
COLOR_ALIASES = {"darkness": "dark", "very_dark": "dark", "bright_light": "bright", "muted": "low_chroma", "low_saturation": "low_chroma", "saturated": "high_chroma", "high_saturation": "high_chroma"}
PENALTIES = {"priority": {"normalized": 0.05, "unmapped": 0.15}, "color": {"normalized": 0.05, "unmapped": 0.25}}
GENERIC_ELEMENTS = [
    "style", "aesthetic", "vibe", "visual", "scene", "retro", "classic", "modern", "vintage", "y2k", "dark", "light", "colorful", "bright", "moody", "warm", "cool", "soft", "dramatic", "minimal",
]
CONFLICT_TYPES, RESOLUTIONS = ["color_conflict", "atmosphere_conflict", "priority_conflict"], ["use_primary", "reduce_secondary", "branch", "ask_user"]
CONFLICT_REASON = "偵測到方向相反的需求。"
#: Confidence of a term that was found, and of a text in which none was.
FOUND, NOT_FOUND = 0.72, 0.35


def _place(text: Column, term: Column) -> Column:
    return F.position(F.lower(term), F.lower(text))


def around(text: Column, term: Column, reach: int = CUE_REACH) -> Column:
    """From `reach` letters before a term's first place, as many letters as the term and twice the reach; empty if it is not there."""
    at = _place(text, term)
    return F.when(at > 0, F.substr(text, F.greatest(at - reach, F.lit(1)), (F.length(term) + 2 * reach).cast("int"))).otherwise("")


def first_cue(where: Column, cues: list[tuple], default) -> Column:
    """The value of the first pattern that is found."""
    out = None
    for pattern, value in cues:
        hit = F.rlike(where, F.lit(pattern))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def negated(text: Column, term: Column) -> Column:
    """Whether a mark of negation stands before some place of the term, with at most eight letters and no stop between."""
    return F.rlike(text, F.concat(F.lit(NEGATION), term))


def interpret(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, no, term, category, search_term, color_rule, priority, intensity, confidence, retrieval_mode: what a text asks for.

    Of each pattern the first spelling that the text contains counts; of patterns with one
    category and search term the first. A negated term is an exclusion. A text without any
    term is a subject of its own, searched by its first three words. The patterns are few
    and constant, so they are columns of every row: nothing is joined.
    """
    t = F.col("_t")
    found = F.array(*(
        F.coalesce(*(F.when(F.contains(t, F.lit(x)), F.struct(F.lit(i).alias("at"), F.lit(x).alias("term"), F.lit(category).alias("kind"), F.lit(search).alias("search_term"), F.lit(rule).alias("color_rule"))) for x in spellings))
        for i, (spellings, category, search, rule) in enumerate(PATTERNS)
    ))
    rows = texts.select(F.col(key), F.col(text_col).cast("string").alias("_t")).withColumn("_f", F.explode_outer(F.array_compact(found)))
    rows = rows.select(key, "_t", "_f.*").where("_t IS NOT NULL")
    no = negated(t, F.col("term"))
    where = around(t, F.col("term"))
    is_known = F.col("term").isNotNull()
    rows = rows.select(
        key, "_t", "at", F.coalesce("term", "_t").alias("term"),
        F.when(~is_known, "subject").when(no, "exclusion").otherwise(F.col("kind")).alias("category"),
        F.when(is_known, F.col("search_term")).otherwise(tx.clean_term(t)).alias("search_term"), F.coalesce("color_rule", F.lit("none")).alias("color_rule"),
        F.when(~is_known, "main").when(no, "exclude").otherwise(first_cue(where, PRIORITY_CUES, "secondary")).alias("priority"),
        F.when(is_known, first_cue(where, INTENSITY_CUES, 1.0)).otherwise(1.0).alias("intensity"), F.when(is_known, FOUND).otherwise(NOT_FOUND).alias("confidence"),
    )
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "category", "search_term").orderBy("at"))).where("_rn = 1")
    no = F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("no")
    mode = F.when(F.col("color_rule") != "none", "standard").otherwise("search_only").alias("retrieval_mode")
    return rows.select(key, no, "term", "category", "search_term", "color_rule", "priority", "intensity", "confidence", mode)


# --- normalising ------------------------------------------------------------------------------


def _alias(value: Column, known: list[str], aliases: dict[str, str], default: str) -> tuple[Column, Column]:
    mapped = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[value]
    return F.when(value.isin(known), value).otherwise(F.coalesce(mapped, F.lit(default))), F.when(value.isin(known), "exact").when(mapped.isNotNull(), "normalized").otherwise("unmapped")


def enum_token(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"[\s-]+", "_")


def normalize_priority(raw: Column, category: Column) -> tuple[Column, Column]:
    """Priority and how sure it is: exact, normalized by an alias, or unmapped. An exclusion's is always exclude."""
    value, out = category == "exclusion", enum_token(raw)
    v, status = _alias(out, ["main", "secondary", "slight"], PRIORITY_ALIASES, "secondary")
    return F.when(value, "exclude").otherwise(v), F.when(value, F.when(out == "exclude", "exact").otherwise("normalized")).otherwise(status)


def normalize_color_rule(raw: Column) -> tuple[Column, Column]:
    return _alias(enum_token(raw), COLOR_RULES, COLOR_ALIASES, "none")


def doubted(confidence: Column, priority_status: Column, color_status: Column) -> Column:
    """Confidence within 0..1, less what each doubtful mapping costs, never below 0."""
    out = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    for status, costs in ((priority_status, PENALTIES["priority"]), (color_status, PENALTIES["color"])):
        for name, cost in costs.items():
            out = F.when(status == name, F.greatest(F.lit(0.0), out - cost)).otherwise(out)
    return out


def retrieval_mode(color_rule: Column, color_status: Column, visual_tags: Column) -> Column:
    return F.when((color_rule != "none") & (color_status != "unmapped"), "standard").when(F.size(visual_tags) > 0, "dual_track").otherwise("search_only")


def first_distinct(items: Column, most: int, by=F.lower) -> Column:
    """The first `most` of an array that differ by by(item); empty and null ones do not count. One fold, so that items are worked out once."""
    new = lambda kept, x: (F.length(x) > 0) & (F.size(kept) < most) & ~F.exists(kept, lambda y: by(y) == by(x))
    return F.aggregate(F.coalesce(items, F.array().cast("array<string>")), F.array().cast("array<string>"), lambda kept, x: F.when(new(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def style_terms(raw: Column) -> Column:
    """At most three cleaned terms that differ without regard to case."""
    return first_distinct(F.transform(raw, lambda x: tx.clean_term(x)), 3)


def visual_tags(raw: Column) -> Column:
    """At most three distinct allowed tags."""
    tags = F.transform(raw, lambda x: F.lower(F.trim(x)))
    return first_distinct(F.filter(tags, lambda x: x.isin(VISUAL_TAGS)), 3)


def element_family(raw: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9_\- ]+", ""), r"[\s\-]+", "_")
    plain = F.array(F.regexp_replace(plain, "^_+|_+$", ""))
    return F.get(F.transform(plain, lambda p: F.when(F.length(p) > 0, p).otherwise("visual_element")), 0)


def theme_elements(raw: Column, drop_generic: bool = True) -> Column:
    """At most eight distinct family|term strings from structs (term, family); terms that say little are dropped if asked for."""
    pairs = F.transform(raw, lambda e: F.struct(tx.clean_term(e["term"]).alias("t"), element_family(F.coalesce(e["family"], F.lit("visual_element"))).alias("f")))
    pairs = F.filter(pairs, lambda e: (F.length(e["t"]) > 0) & (F.lit(not drop_generic) | ~F.lower(e["t"]).isin(GENERIC_ELEMENTS)))
    return first_distinct(F.transform(pairs, lambda e: F.concat_ws("|", e["f"], e["t"])), 8)


def sanitize(concepts: DataFrame, key: str, order: str) -> DataFrame:
    """Raw concepts of an input (key) in their order, made safe: one row per concept that is kept.

    Columns read: category, priority, search_term, original_text, style_terms, theme_elements
    (structs of term and family), visual_tags, color_rule, intensity, confidence. Values out
    of an enumeration fall back; a concept without any text goes; of concepts with one
    category and name the first stays.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    category, priority = F.lower(text("category")), F.lower(text("priority"))
    category = F.when(F.col("category").isNull() | ~category.isin(CATEGORIES), "atmosphere").otherwise(category)
    priority = F.when(F.col("priority").isNull(), "secondary").otherwise(priority)
    known = priority.isin(PRIORITIES)
    out_priority = F.when(known, priority).otherwise("secondary")
    excluded = (category == "exclusion") | (out_priority == "exclude")
    rule = F.regexp_replace(F.lower(F.trim(F.coalesce("color_rule", F.lit("none")))), "[^a-z_]", "")
    rule = F.when(F.length(rule) == 0, "none").otherwise(rule)
    rows = concepts.select(
        key, order, F.when(excluded, "exclusion").otherwise(category).alias("category"), F.when(excluded, "exclude").otherwise(out_priority).alias("priority"),
        tx.clean_term(text("search_term")).alias("search_term"), text("original_text").alias("original_text"), style_terms(F.col("style_terms")).alias("style_terms"),
        theme_elements(F.col("theme_elements")).alias("theme_elements"), visual_tags(F.col("visual_tags")).alias("visual_tags"),
        F.when(rule.isin(COLOR_RULES), rule).otherwise("none").alias("color_rule"), F.when(known, "exact").otherwise("unmapped").alias("priority_status"),
        F.when(rule.isin(COLOR_RULES), "exact").otherwise("unmapped").alias("color_status"),
        F.least(F.greatest(F.coalesce("intensity", F.lit(1.0)), F.lit(0.5)), F.lit(1.5)).alias("intensity"), F.least(F.greatest(F.coalesce("confidence", F.lit(0.7)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )
    says = (F.length("search_term") + F.length("original_text") + F.size("style_terms") + F.size("theme_elements") + F.size("visual_tags")) > 0
    name = F.when(F.length("search_term") > 0, F.col("search_term")).otherwise(F.col("original_text"))
    rows = rows.where(says).withColumn("_key", F.lower(F.concat_ws("|", "category", name)))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_key").orderBy(order))).where("_rn = 1").drop("_rn", "_key")
    return rows.withColumn("retrieval_mode", retrieval_mode(F.col("color_rule"), F.col("color_status"), F.col("visual_tags")))


# --- conflicts --------------------------------------------------------------------------------


def normalize_conflicts(rows: DataFrame) -> DataFrame:
    """Rows with terms, type, resolution and reason in order; those with fewer than two distinct terms go, of the rest three stay."""
    terms = first_distinct(F.transform("terms", lambda x: F.trim(x)), 1 << 20, by=lambda x: x)
    enum = lambda c, known, default: F.when(F.col(c).isin(known), F.col(c)).otherwise(default).alias(c)
    reason = F.trim(F.coalesce("reason", F.lit("")))
    rest = [c for c in rows.columns if c not in ("terms", "type", "resolution", "reason")]
    out = rows.select(*rest, terms.alias("terms"), enum("type", CONFLICT_TYPES, "color_conflict"), enum("resolution", RESOLUTIONS, "branch"), F.when(F.length(reason) > 0, reason).otherwise(CONFLICT_REASON).alias("reason"))
    return out.where(F.size("terms") >= 2).withColumn("terms", F.slice("terms", 1, 3))


def merge_conflicts(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of conflicts of one type with the same terms, in whatever order, the first stays."""
    same = F.concat_ws("|", "type", F.array_join(F.array_sort("terms"), "|"))
    rn = F.row_number().over(Window.partitionBy(key, same).orderBy(*order))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")
