"""Text, identifier and hash functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(x: Column) -> Column:
    """Lower case, letters and digits of any script, single blanks."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def clean_term(x: Column, words: int = 3) -> Column:
    """The first words of a term; all but letters, digits, hyphens and blanks vanishes; empty words and "0" do not count."""
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"[^\p{L}\p{N}\- ]+", ""))
    return F.array_join(F.slice(F.filter(F.split(plain, r"\s+"), lambda w: ~w.isin("", "0")), 1, words), " ")


def normalize_family(x: Column) -> Column:
    """[a-z0-9:_-] only; blanks and hyphens become underscores, none at the ends."""
    joined = F.regexp_replace(F.lower(F.trim(x)), r"[\s-]+", "_")
    return F.regexp_replace(F.regexp_replace(joined, r"[^a-z0-9:_-]", ""), "^_+|_+$", "")


def merge_words(texts: Column, most: int = 10) -> Column:
    """Distinct words, without regard to case, of an array of texts: the first spelling of each, at most `most`."""
    words = F.filter(F.flatten(F.transform(texts, lambda t: F.split(F.trim(t), r"\s+"))), lambda w: w != "")
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda seen, w: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(w)), seen).otherwise(F.concat(seen, F.array(w))))
    return F.array_join(F.slice(kept, 1, most), " ")


def pair_key(a: Column, b: Column) -> Column:
    """Both ids in order, joined by two bars."""
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """url with one more query parameter."""
    mark = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.concat(url, mark, F.lit(f"{name}="), F.url_encode(value))


def nfkc(x: Column) -> Column:
    """Unicode compatibility normalisation, which Spark has no function for."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return normal(x)


def fingerprint(x: Column) -> Column:
    """SHA-256 of a text in NFKC, trimmed and in lower case."""
    return F.sha2(F.lower(F.trim(nfkc(x))), 256)


def record_hash(*names: str) -> Column:
    """SHA-256 of a record as JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def hash_score(seed: str, key: Column) -> Column:
    """A number in 0..1 from the first 12 hex digits of a salted SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed), key), 256), 1, 12), 16, 10).cast("double") / float(2**48 - 1)


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of a string's bytes, as 8 hex digits."""
    codes = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.ascii(F.substr(x, i, F.lit(1))).cast("long"))
    value = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(4294967296)))
    return F.when(F.length(x) > 0, F.lower(F.lpad(F.hex(value), 8, "0"))).otherwise("811c9dc5")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes of equal length; infinite otherwise."""
    bits = F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))
    return F.when(F.length(a) == F.length(b), bits.cast("double")).otherwise(float("inf"))


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text contains, in any case."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))


# Words that say little on their own, and what a phrase and a word weigh as evidence.
GENERIC_WORDS = [
    "style", "aesthetic", "image", "photo", "visual", "scene", "look", "vibe", "vibes", "classic", "colorful", "dark", "light", "chrome", "retro", "modern", "vintage",
    "warm", "cool", "soft", "bright", "moody", "dramatic", "beautiful", "art", "design",
]
PHRASE_EVIDENCE, WORD_EVIDENCE = 0.50, 0.08


def term_set(text: Column, primary: list[str], support: list[str]) -> dict[str, Column]:
    """What a normalised text holds of some terms: primary_matched, support_terms, evidence (0..1).

    A phrase that is found takes the words it is made of with it.
    """
    held = lambda terms: F.array_compact(F.array(*(F.when(F.contains(text, F.lit(t)), t) for t in terms)))
    found = held(support)
    phrases = F.filter(found, lambda t: F.contains(t, F.lit(" ")))
    kept = F.filter(found, lambda t: F.contains(t, F.lit(" ")) | ~F.exists(phrases, lambda p: F.array_contains(F.split(p, " "), t)))
    weigh = lambda t: F.when(F.contains(t, F.lit(" ")), PHRASE_EVIDENCE).when(t.isin(GENERIC_WORDS), 0.0).otherwise(WORD_EVIDENCE)
    return {"primary_matched": F.size(held(primary)) > 0, "support_terms": kept, "evidence": F.least(F.lit(1.0), F.aggregate(kept, F.lit(0.0), lambda s, t: s + weigh(t)))}


# What a text must hold to be of a failure category, in order, and what is done about each.
FAILURE_WORDS = {"TIMEOUT": "timeout|timed out|abort", "INVALID_INPUT": "invalid|schema|contract"}
FAILURE_ACTIONS = {
    "QUEUE_FULL": "DROP_SHADOW_TASK", "TIMEOUT": "ABORT_OR_IGNORE_SHADOW_RESULT", "INVALID_INPUT": "SKIP_INVALID_SHADOW_INPUT",
    "LOG_SINK_FAILURE": "CONTINUE_WITHOUT_PERSISTED_LOG", "SHADOW_ENGINE_FAILURE": "SKIP_FAILED_SHADOW_RESULT", "UNKNOWN": "SKIP_UNKNOWN_SHADOW_FAILURE",
}


def failure(error: Column, reason: Column, stage: Column) -> Column:
    """The category of a failure from its text, the reason given and the stage it happened in."""
    low = F.lower(F.coalesce(error, F.lit("")))
    out = F.when(reason.eqNullSafe("queue_full"), "QUEUE_FULL").when(stage.eqNullSafe("audit_log"), "LOG_SINK_FAILURE")
    for category, words in FAILURE_WORDS.items():
        out = out.when(F.rlike(low, F.lit(words)), category)
    return out.when(stage.eqNullSafe("shadow") | F.contains(low, F.lit("shadow")), "SHADOW_ENGINE_FAILURE").otherwise("UNKNOWN")


def failure_action(category: Column, side: str) -> Column:
    """What is done about a failure on the shadow or the audit side."""
    if side == "audit":
        return F.when(category == "LOG_SINK_FAILURE", "DROP_LOG_EVENT").otherwise("BEST_EFFORT_DIAGNOSTIC")
    return F.create_map(*(F.lit(x) for pair in FAILURE_ACTIONS.items() for x in pair))[category]


def status(said: Column) -> Column:
    """PASS, HOLD or FAIL by how a status begins, in any case; else null."""
    up = F.upper(F.coalesce(said, F.lit("")))
    return F.when(up.startswith("PASS") | (up == "READY_FOR_NEXT"), "PASS").when(up.startswith("HOLD"), "HOLD").when(up.startswith("FAIL"), "FAIL")


def classify(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern a text matches."""
    out, low = None, F.lower(text)
    for pattern, name in rules:
        test = F.rlike(low, F.lit(pattern))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)
