"""Colour functions as Column expressions: sRGB, OKLab, OKLCH, hue geometry, pair relations, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds halves up, towards positive infinity: floor(x * 10^k + 0.5) / 10^k."""
    factor = F.lit(float(10**digits))
    return F.floor(x * factor + 0.5) / factor


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null and NaN stay null."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ladder(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that x is below, else last."""
    out = None
    for bound, label in steps:
        out = F.when(x < bound, label) if out is None else out.when(x < bound, label)
    return out.otherwise(last)


# --- sRGB and OKLab -----------------------------------------------------------------------


def srgb_to_linear(channel: Column) -> Column:
    """Linear light of an 8-bit channel."""
    v = channel / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    """Gamma-encoded value in 0..1 of linear light."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


# The published OKLab matrices.
RGB_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def _times(matrix, vector: list[Column]) -> list[Column]:
    return [reduce(lambda a, b: a + b, (x * k for k, x in zip(row, vector, strict=True))) for row in matrix]


def rgb_to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lms = _times(RGB_TO_LMS, [srgb_to_linear(x) for x in (r, g, b)])
    return tuple(_times(LMS_TO_LAB, [F.cbrt(x) for x in lms]))


def oklab_to_linear(L: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    return tuple(_times(LMS_TO_RGB, [x * x * x for x in _times(LAB_TO_LMS, [L, a, b])]))


def in_gamut(L: Column, a: Column, b: Column, slack: float = 1e-7) -> Column:
    """Whether an OKLab colour is within sRGB, up to slack."""
    return reduce(lambda p, q: p & q, (x.between(-slack, 1 + slack) for x in oklab_to_linear(L, a, b)))


def oklab_to_hex(L: Column, a: Column, b: Column) -> Column:
    """#RRGGBB with clamped channels, halves rounded up."""
    parts = [F.lpad(F.conv(F.floor(clamp(linear_to_srgb(x)) * 255 + 0.5).cast("string"), 10, 16), 2, "0") for x in oklab_to_linear(L, a, b)]
    return F.upper(F.concat(F.lit("#"), *parts))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.upper(F.concat(F.lit("#"), *(F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b))))


def hex_channel(code: Column, k: int) -> Column:
    """Channel 0, 1 or 2 of #RRGGBB."""
    return F.conv(F.substring(F.regexp_replace(code, "^#", ""), 2 * k + 1, 2), 16, 10).cast("int")


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def hue(a: Column, b: Column, floor: float = 1e-5) -> Column:
    """Degrees in [0, 360); null for colours of less chroma than floor."""
    h = F.degrees(F.atan2(b, a))
    return F.when(F.hypot(a, b) >= floor, F.when(h < 0, h + 360).otherwise(h))


# --- distances ----------------------------------------------------------------------------


def delta_e(l1, a1, b1, l2, a2, b2, chroma_weight: float = 1.0) -> Column:
    d = (l1 - l2) * (l1 - l2) + (a1 - a2) * chroma_weight * (a1 - a2) * chroma_weight + (b1 - b2) * chroma_weight * (b1 - b2) * chroma_weight
    return F.sqrt(d)


def hue_difference(h1: Column, h2: Column) -> Column:
    """Degrees on the circle, 0..180; null if a hue is missing."""
    d = F.abs(h1 - h2) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low))
    return t * t * (3 - 2 * t)


def hue_reliability(C: Column, low: float = 0.005, high: float = 0.04) -> Column:
    return smoothstep(low, high, F.greatest(C, F.lit(0.0)))


def pair_hue_reliability(c1: Column, c2: Column) -> Column:
    return F.sqrt(hue_reliability(c1) * hue_reliability(c2))


def hue_chord(c1: Column, c2: Column, dh: Column) -> Column:
    """Separation of two hues at their chromas; 0 where a hue is missing."""
    return F.coalesce(2 * F.sqrt(F.greatest(c1, F.lit(0.0)) * F.greatest(c2, F.lit(0.0))) * F.sin(F.radians(dh) / 2), F.lit(0.0))


def chroma_similarity(c1: Column, c2: Column) -> Column:
    a, b = F.greatest(c1, F.lit(0.0)), F.greatest(c2, F.lit(0.0))
    return F.when(a + b <= 1e-12, 1.0).otherwise(clamp(1 - F.abs(a - b) / (a + b)))


def tone_similarity(l1, c1, l2, c2) -> Column:
    return F.sqrt(clamp(1 - F.abs(l1 - l2)) * chroma_similarity(c1, c2))


def signed_hue_evidence(c1, c2, dh) -> Column:
    """Reliability times 2s - 1 for the angular similarity s; 0 where a hue is missing."""
    return F.coalesce(pair_hue_reliability(c1, c2) * (2 * clamp(1 - dh / 180) - 1), F.lit(0.0))


# --- relation classes ---------------------------------------------------------------------


def rule_classes(dl, dc, dh, min_c) -> dict[str, Column]:
    """Fixed-parameter pair classes: hue applicability and relation, tone relation, separation score."""
    reliable = min_c >= 0.03
    score = dl + 4.0 * F.sqrt(F.greatest(dl * dc, F.lit(0.0)))
    return {
        "hue_applicability": F.when(reliable, "reliable").otherwise("low_chroma"),
        "hue_relation": F.when(reliable & dh.isNotNull(), F.when(dh <= 40, "same_or_adjacent").otherwise("different")).otherwise("not_applicable"),
        "tone_relation": F.when((dl <= 0.06) & (dc <= 0.033), "similar").when(score >= 0.54, "different").otherwise("similar_or_partial"),
        "tone_score": score,
    }


def three_way(x: Column, similar_max: float, different_min: float) -> Column:
    return F.when(x <= similar_max, "similar").when(x >= different_min, "different").otherwise("similar_or_partial")


def combine_tone(light: Column, chroma_class: Column, rule: str) -> Column:
    """Tone class from lightness and chroma classes by one of four rules."""
    both_similar = (light == "similar") & (chroma_class == "similar")
    far = {
        "CONSENSUS_AXES": (light == "different") & (chroma_class == "different"),
        "CONSERVATIVE_DIFFERENT": (light == "different") | (chroma_class == "different"),
        "LIGHTNESS_DOMINANT": light == "different",
        "CHROMA_DOMINANT": chroma_class == "different",
    }[rule]
    return F.when(far, "different").when(both_similar, "similar").otherwise("similar_or_partial")


def baseline_classes(reliability, dh, tone) -> dict[str, Column]:
    low = reliability < 0.15
    return {
        "hue_applicability": F.when(low, "low_chroma").otherwise("reliable"),
        "hue_relation": F.when(low, "not_applicable").when(dh <= 60, "same_or_adjacent").when(dh >= 90, "different").otherwise("review"),
        "tone_relation": F.when(tone >= 0.65, "similar").when(tone >= 0.45, "similar_or_partial").otherwise("different"),
    }


# --- bands and labels ---------------------------------------------------------------------

# Upper bounds and names of the bands.
LIGHTNESS_BANDS = [(0.25, "near_black"), (0.42, "dark"), (0.62, "mid"), (0.78, "light")], "very_light"
CHROMA_BANDS = [(0.02, "achromatic"), (0.05, "muted"), (0.10, "soft"), (0.17, "chromatic")], "vivid"
NEUTRALITY_BANDS = [(0.02, "achromatic"), (0.045, "near_neutral"), (0.08, "weak_chromatic")], "chromatic"
HUE_FAMILIES = [(20, "red"), (55, "orange_brown"), (90, "yellow"), (150, "green"), (205, "cyan"), (255, "blue"), (300, "purple"), (345, "magenta")], "red"
VECTOR_FAMILIES = [(20, "red"), (55, "orange"), (100, "yellow"), (165, "green"), (205, "cyan"), (265, "blue"), (325, "purple"), (345, "pink")], "red"


def lightness_band(L):
    return ladder(L, *LIGHTNESS_BANDS)


def chroma_band(C):
    return ladder(C, *CHROMA_BANDS)


def neutrality_class(C):
    return ladder(C, *NEUTRALITY_BANDS)


def tone_class(L, C):
    return F.concat_ws("_", lightness_band(L), chroma_band(C))


def hue_family(h, C):
    return F.when(C < 0.025, "neutral").otherwise(ladder(h, *HUE_FAMILIES))


def temperature_family(h, C):
    return F.when(C < 0.025, "neutral").when((h >= 320) | (h < 100), "warm").when((h >= 180) & (h < 300), "cool").otherwise("mixed")


def vector_hue_family(x, y, mean_chroma, neutral_ratio):
    h = F.degrees(F.atan2(y, x))
    weak = (mean_chroma < 0.045) | (neutral_ratio > 0.72) | (F.hypot(x, y) < 0.08)
    return F.when(weak, "neutral").otherwise(ladder(F.when(h < 0, h + 360).otherwise(h), *VECTOR_FAMILIES))


def brightness_label(x):
    return F.when(x >= 0.72, "高明度").when(x >= 0.48, "中等明度").otherwise("低明度")


def chroma_label(x):
    return F.when(x < 0.055, "低彩度").when(x < 0.13, "柔和彩度").otherwise("高彩度")


def temperature_label(x, neutral_ratio):
    return F.when((neutral_ratio >= 0.7) | (F.abs(x) < 0.16), "中性").when(x > 0, "暖色").otherwise("冷色")


def contrast_label(x):
    return F.when(x < 0.28, "低對比").when(x < 0.5, "中等對比").otherwise("高對比")


def visual_weight_label(x):
    return F.when(x < 0.4, "輕盈視覺").when(x < 0.65, "中等視覺重量").otherwise("厚重視覺")


# The name of a direction by hue family; for some by whether it is bright, dark or heavy.
DIRECTIONS = {
    "neutral": [("bright", "柔和明亮"), ("heavy", "經典深沉"), ("", "自然沉穩")],
    "red": [("bright", "柔和雅緻"), ("", "經典成熟")],
    "orange": [("dark", "經典暖調"), ("", "自然暖調")],
    "yellow": [("bright", "清新暖陽"), ("", "沉靜金調")],
    "green": [("bright", "清新自然"), ("heavy", "森林沉穩"), ("", "自然沉穩")],
    "cyan": [("bright", "清透冷調"), ("", "安靜青灰")],
    "blue": [("bright", "清透冷調"), ("", "專業冷靜")],
    "purple": [("bright", "優雅霧紫"), ("", "深邃高級")],
    "pink": [("bright", "柔和浪漫"), ("", "成熟柔霧")],
}


def direction_name(family: Column, brightness: Column, chroma_name: Column, weight: Column) -> Column:
    """The name of a direction; strong colours that are not dark have names of their own."""
    test = {"bright": brightness == "高明度", "dark": brightness == "低明度", "heavy": weight == "厚重視覺", "": F.lit(True)}
    out = F.when((chroma_name == "高彩度") & (brightness != "低明度"), F.when(family.isin("blue", "cyan"), "鮮明現代").otherwise("活力亮彩"))
    for name, choices in DIRECTIONS.items():
        for kind, label in choices:
            out = out.when((family == name) & test[kind], label)
    return out.otherwise("現代平衡")


def gaussian(d: Column, sigma: float) -> Column:
    return F.exp(-0.5 * F.pow(d / sigma, F.lit(2.0)))


def affinity(dl, dc, dh, de, c1, c2) -> Column:
    """Overall similarity of two colours from Gaussian similarities of their differences."""
    reliable = F.least(*(clamp((c - 0.015) / 0.065) for c in (c1, c2)))
    tone = clamp(0.68 * gaussian(dl, 0.16) + 0.32 * gaussian(dc, 0.075))
    hue_part = reliable * gaussian(dh, 38.0) + (1 - reliable) * 0.5
    return clamp(0.44 * tone + 0.40 * hue_part + 0.16 * gaussian(de, 0.14))


def verdict(dl, dc, dh, de, c1, c2) -> dict[str, Column]:
    """What two colours are to each other: similarity, verdict, and an array of warnings."""
    reliable = F.least(*(clamp((c - 0.015) / 0.065) for c in (c1, c2)))
    tone = clamp(0.68 * gaussian(dl, 0.16) + 0.32 * gaussian(dc, 0.075))
    weak, either = (c1 < 0.045) & (c2 < 0.045), (c1 < 0.045) | (c2 < 0.045)
    grey = F.when(tone >= 0.84, "SAME").when(tone >= 0.64, "RELATED").otherwise("DIFFERENT")
    hued = F.when((dh <= 25) & (tone >= 0.76), "SAME").when((dh <= 60) & (tone >= 0.62), "RELATED").when((dh > 60) & (tone >= 0.72), "RELATED").when((dh > 85) & (tone < 0.72), "DIFFERENT").when(either & (tone >= 0.70), "RELATED").otherwise("REVIEW")
    warnings = F.array_compact(F.array(
        F.when((dh > 60) & (tone >= 0.72) & (reliable >= 0.35), "TONE_SIMILAR_HUE_CONFLICT"), F.when(reliable < 0.30, "LOW_CHROMA_HUE_UNCERTAIN"), F.when((dl < 0.08) & (dh > 75) & (reliable >= 0.35), "SIMILAR_LIGHTNESS_DIFFERENT_HUE"),
    ))
    return {"similarity": affinity(dl, dc, dh, de, c1, c2), "verdict": F.when(weak, grey).otherwise(hued), "warnings": warnings}


def pixel_weight(L, C) -> Column:
    """How much a pixel counts: less at the ends of lightness, more with chroma."""
    light = F.when((L < 0.045) | (L > 0.985), 0.12).when(L < 0.1, 0.38).when(L > 0.95, 0.42).otherwise(1.0)
    return light * F.when(C > 0.12, 1.3).when(C < 0.015, 0.82).otherwise(1.0)


# --- contrast -----------------------------------------------------------------------------


def luminance(r, g, b) -> Column:
    return 0.2126 * srgb_to_linear(r) + 0.7152 * srgb_to_linear(g) + 0.0722 * srgb_to_linear(b)


def contrast_ratio(y1: Column, y2: Column) -> Column:
    return (F.greatest(y1, y2) + 0.05) / (F.least(y1, y2) + 0.05)


def readable_text(y: Column) -> Column:
    """White or black, whichever stands out more on a background of luminance y."""
    return F.when(contrast_ratio(F.lit(1.0), y) >= contrast_ratio(F.lit(0.0), y), "#FFFFFF").otherwise("#000000")
