"""Search plans: up to three queries for each branch of an input, from its sanitised concepts.

Concepts become weighted items, and windows rank items, styles and themes of each input. What
a branch picks from these short lists, how picks become queries and which queries stay are
column expressions over the lists of an input, so that no row leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.operators.profiles import DELTAS, HINT_STEP, HINTS
from huestrata.sources.staging import staged

# What a priority weighs, what a theme weighs more than its concept, what a branch's own term weighs, and how many styles, themes, own terms, fragments, words and queries there are at most.
PRIORITY_WEIGHT = {"main": 1.35, "secondary": 1.0, "slight": 0.6}
THEME_WEIGHT, OWN_WEIGHT = 1.10, 1.20
MOST_STYLES, MOST_THEMES, MOST_OWN, MOST_FRAGMENTS, MOST_WORDS, MOST_QUERIES = 8, 16, 3, 4, 10, 3
GROUPS = ["subject", "context", "atmosphere", "color"]
SHIFT = {"A": 0, "B": 1, "C": 2}

_ITEM, _THEME, _QUERY = "struct<term:string,weight:double>", "struct<term:string,weight:double,family:string>", "struct<query:string,family:string,kind:string,raw:double>"


def _item(term: Column, weight: Column) -> Column:
    return F.struct(term.alias("term"), weight.cast("double").alias("weight")).cast(_ITEM)


def _plain(x: Column) -> Column:
    """A theme or an item as an item; null stays null."""
    return F.when(x.isNotNull(), _item(x["term"], x["weight"]))


def family_name(x: Column) -> Column:
    x = F.regexp_replace(F.lower(F.trim(x)), r"[\s-]+", "_")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9:_-]", ""), "^_+|_+$", "")


def _turned(items: Column, by: Column) -> Column:
    """A list that begins at place `by`, what stood before at its end."""
    at = F.when(F.size(items) > 0, F.pmod(by, F.size(items))).otherwise(0)
    return F.concat(F.slice(items, at + 1, F.size(items)), F.slice(items, F.lit(1), at))


def _first_of_each(items: Column, key, kind: str, most: int | None = None) -> Column:
    """A list without what repeats an earlier key, cut after `most`."""
    room = lambda kept: F.lit(True) if most is None else F.size(kept) < most
    add = lambda kept, x: F.when(room(kept) & ~F.exists(kept, lambda y: key(y) == key(x)), F.concat(kept, F.array(x))).otherwise(kept)
    return F.aggregate(items, F.array().cast(f"array<{kind}>"), add)


def _with_candidates(rows: DataFrame, wanted: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """rows with a query for each name: from fragments (null ones are left out) their distinct words, with the family, kind
    and mean weight; null if there is no word. Each step is a column, so that none is worked out twice."""
    some = lambda items: F.filter(items, lambda x: x.isNotNull() & (x["term"] != ""))
    rows = rows.withColumns({f"_some_{n}": some(items) for n, (items, _, _) in wanted.items()})
    rows = rows.withColumns({f"_chosen_{n}": _first_of_each(F.col(f"_some_{n}"), lambda x: F.lower(x["term"]), _ITEM, MOST_FRAGMENTS) for n in wanted})
    words = lambda n: F.filter(F.flatten(F.transform(f"_chosen_{n}", lambda x: F.split(F.trim(x["term"]), r"\s+"))), lambda w: w != "")
    rows = rows.withColumns({f"_words_{n}": _first_of_each(words(n), F.lower, "string", MOST_WORDS) for n in wanted})
    weight = lambda n: F.aggregate(f"_chosen_{n}", F.lit(0.0), lambda s, x: s + x["weight"]) / F.size(f"_chosen_{n}")
    query = lambda n, family, kind: F.struct(F.array_join(f"_words_{n}", " ").alias("query"), family.alias("family"), F.lit(kind).alias("kind"), weight(n).alias("raw")).cast(_QUERY)
    rows = rows.withColumns({n: F.when(F.size(f"_words_{n}") > 0, query(n, family, kind)) for n, (_, family, kind) in wanted.items()})
    return rows.drop(*(f"_{step}_{n}" for n in wanted for step in ("some", "chosen", "words")))


def _hints(branch: str) -> list[Column]:
    """Up to two words for what a branch changes most."""
    moved = [(up if DELTAS[branch][f] > 0 else down, weight) for f, up, down, weight in HINTS if abs(DELTAS[branch].get(f, 0.0)) >= HINT_STEP]
    return [_item(F.lit(term), F.lit(weight)) for term, weight in moved[:2]]


# --- the lists of an input ----------------------------------------------------------------


def _listed(rows: DataFrame, key: str, name: str, same: Column, kind: str, most: int) -> DataFrame:
    """key and a list: of rows (item, place) the first of each that is the same, heaviest first, at most `most`."""
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, same).orderBy("place"))).where("_rn = 1")
    ranked = first.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("item.weight"), "place"))).where(F.col("_rn") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "item"))), lambda x: x["item"]).cast(f"array<{kind}>").alias(name))


def lists(concepts: DataFrame, key: str, order: str) -> DataFrame:
    """key, one item of each group (null if it has none), every item, styles and themes, heaviest first."""
    weight = reduce(lambda c, p: c.when(F.col("priority") == p[0], p[1]), PRIORITY_WEIGHT.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    group = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("category"))
    term = F.coalesce("search_term", F.lit(""))
    used = (group > 0) & ~F.coalesce(F.col("priority") == "exclude", F.lit(False)) & ((term != "") | (F.size("style_terms") > 0) | (F.size("theme_elements") > 0))
    item = _item(term, weight * F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.col("intensity"))))
    rows = concepts.where(used).select(key, group.alias("group"), item.alias("item"), "style_terms", "theme_elements", F.col(order).alias("_o"))
    heaviest = [F.desc("item.weight"), "_o"]
    rows = staged(rows)  # read for items, styles and themes: sanitised once
    rows = rows.withColumns({"place": F.row_number().over(Window.partitionBy(key).orderBy("group", *heaviest)), "_rn": F.row_number().over(Window.partitionBy(key, "group").orderBy(*heaviest))})
    every = F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("every")
    out = rows.groupBy(key).agg(every, *(F.max(F.when((F.col("group") == i) & (F.col("_rn") == 1), F.col("item"))).alias(g) for i, g in enumerate(GROUPS, 1)))
    told = lambda column, name: rows.select(key, "place", "item.weight", F.posexplode(column).alias("pos", name))
    styles = told("style_terms", "term").select(key, _item(F.col("term"), F.col("weight")).alias("item"), F.struct("place", "pos").alias("place"))
    family, word = F.substring_index("pair", "|", 1), F.expr("substring(pair, instr(pair, '|') + 1)")
    theme = F.struct(word.alias("term"), (F.col("weight") * THEME_WEIGHT).alias("weight"), family.alias("family"))
    themes = told("theme_elements", "pair").select(key, theme.alias("item"), F.struct("place", "pos").alias("place"))
    styles = _listed(styles, key, "styles", F.lower("item.term"), _ITEM, MOST_STYLES)
    themes = _listed(themes, key, "themes", F.lower(F.concat_ws("|", "item.family", "item.term")), _THEME, MOST_THEMES)
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>"))
    return out.join(styles, key, "left").join(themes, key, "left").withColumns({"styles": none("styles", _ITEM), "themes": none("themes", _THEME)})


# --- plans --------------------------------------------------------------------------------


def query_plans(concepts: DataFrame, key: str, order: str, own_terms: DataFrame | None = None) -> DataFrame:
    """key, branch, no, query, query_family, exploration_type, weight for every input and branch.

    Queries: what the input shows; that with a style and a theme; and a second theme or scene
    with a second style. They are distinct in words and, but for the first, in family; if fewer
    than two are left, the heaviest theme makes one more. Weights add up to 1. own_terms (key,
    branch, terms) are a branch's own words: they take the places of styles, which come after.
    """
    branch = F.explode(F.array(*(F.struct(F.lit(b).alias("branch"), F.lit(s).alias("shift"), F.array(*_hints(b)).cast(f"array<{_ITEM}>").alias("hints")) for b, s in SHIFT.items()))).alias("_b")
    rows = lists(concepts, key, order).select("*", branch).select("*", "_b.*").drop("_b")
    if own_terms is None:
        rows = rows.withColumn("own", F.array().cast(f"array<{_ITEM}>"))
    else:
        clean = F.filter(F.transform("terms", lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t.isNotNull() & (t != ""))
        own = F.transform(_first_of_each(clean, F.lower, "string", MOST_OWN), lambda t: _item(t, F.lit(OWN_WEIGHT)))
        rows = rows.join(own_terms.select(key, "branch", own.alias("own")), [key, "branch"], "left").withColumn("own", F.coalesce("own", F.array().cast(f"array<{_ITEM}>")))
    shift, styles = F.col("shift"), F.col("styles")
    rows = rows.withColumns({"turned": _turned(F.col("themes"), shift), "primary": F.coalesce(F.get("own", F.lit(0)), F.get(styles, F.least(shift, F.size(styles) - 1)))})
    rows = rows.withColumn("one", F.get("turned", F.lit(0)))
    others = F.filter(F.slice("turned", 2, MOST_THEMES), lambda t: t["family"] != F.col("one.family"))
    after = F.filter(_turned(F.concat(F.slice("own", 2, MOST_OWN), styles), shift), lambda s: (s["term"] != "") & (F.lower(s["term"]) != F.coalesce(F.lower("primary.term"), F.lit(""))))
    rows = rows.withColumns({"two": F.coalesce(F.get(others, F.lit(0)), F.get("turned", F.lit(1))), "second": F.get(after, F.lit(0)), "anchor": F.coalesce(*GROUPS)})
    named = lambda theme, style, other: F.when(F.col(theme).isNotNull(), F.concat(F.lit("element:"), family_name(F.col(f"{theme}.family")))).when(F.col(style).isNotNull(), F.concat(F.lit("style:"), family_name(F.col(f"{style}.term")))).otherwise(other)
    rows = rows.withColumns({"first_family": named("one", "primary", "style_primary"), "other_family": named("two", "second", "style_secondary")})
    rows = rows.withColumn("other_family", F.when(F.col("other_family") == F.col("first_family"), F.concat("other_family", F.lit("_alt"))).otherwise(F.col("other_family")))
    col = F.col
    heaviest, rows = F.get("themes", F.lit(0)), staged(rows)  # what follows refers to these columns often; the optimiser would work them out anew each time
    rows = _with_candidates(rows, {
        "core": (F.array("subject", "context", "atmosphere"), F.lit("core"), "core"),
        "styled": (F.array(F.coalesce("subject", "context", "atmosphere"), "primary", _plain(col("one")), F.get("hints", F.lit(0))), col("first_family"), "theme_element"),
        "placed": (F.array(F.coalesce("context", "subject"), _plain(col("two")), "second", F.get("hints", F.lit(1))), col("other_family"), "theme_context"),
        "last_way": (F.slice(F.concat("every", F.transform("themes", _plain), "styles"), 1, MOST_FRAGMENTS), F.lit("fallback"), "fallback"),
        "extra": (F.array(col("anchor"), _plain(heaviest)), F.concat(F.lit("element:"), family_name(heaviest["family"])), "theme_element"),
    })
    rows = staged(rows)
    rows = rows.withColumn("found", F.when(col("anchor").isNotNull(), F.array_compact(F.array("core", "styled", "placed"))).otherwise(F.array().cast(f"array<{_QUERY}>")))
    rows = rows.withColumn("found", F.when(F.size("found") > 0, col("found")).otherwise(F.array_compact(F.array("last_way"))))
    known = lambda kept, q: F.exists(kept, lambda p: (F.lower(p["query"]) == F.lower(q["query"])) | (~q["family"].isin("", "core") & (p["family"] == q["family"])))
    rows = rows.withColumn("plans", F.aggregate("found", F.array().cast(f"array<{_QUERY}>"), lambda kept, q: F.when(known(kept, q), kept).otherwise(F.concat(kept, F.array(q)))))
    lacks = (F.size("plans") < 2) & (F.size("themes") > 0) & col("extra").isNotNull() & ~F.exists("plans", lambda p: F.lower(p["query"]) == F.lower(F.col("extra.query")))
    rows = rows.withColumn("plans", F.slice(F.when(lacks, F.concat("plans", F.array("extra"))).otherwise(col("plans")), 1, MOST_QUERIES))
    rows = staged(rows.select(key, "branch", "plans"))
    rows = rows.withColumn("total", F.aggregate("plans", F.lit(0.0), lambda s, p: s + p["raw"]))
    out = rows.select(key, "branch", "total", F.posexplode("plans").alias("at", "p"))
    share = F.round(F.col("p.raw") / F.when(F.col("total") != 0, F.col("total")).otherwise(1.0), 4)
    return out.select(key, "branch", (F.col("at") + 1).alias("no"), "p.query", F.col("p.family").alias("query_family"), F.col("p.kind").alias("exploration_type"), share.alias("weight"))
