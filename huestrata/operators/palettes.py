"""Palettes of colour directions, distinct from each other within a search.

A direction's colours are merged, and of these the darkest, lightest, dominant and most
striking ones and then the furthest become its candidates. Directions choose in order, each
from its own candidates, and keep away from what earlier ones took. A search has a few
directions of a few dozen colours, so it is one group; searches grow in number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from huestrata.operators.ranking import ordered_merge

# Distances in OKLab and weights that decide what a palette holds.
MERGE, TWIN, SAME, APART, LEAST_RATIO = 0.045, 0.02, 0.018, 0.055, 0.002
SPREAD_WEIGHTS = {"distance": 0.62, "ratio": 0.25, "chroma": 0.13}
DISTINCT_WEIGHTS = {"others": 0.42, "own": 0.28, "ratio": 0.22, "chroma": 0.08}


def _away(lab: np.ndarray, from_: np.ndarray) -> np.ndarray:
    return np.sqrt(((lab - from_) ** 2).sum(1))


def spread(colours: np.ndarray, most: int) -> np.ndarray:
    """Of colours (ratio, L, a, b) in falling ratio at most `most`, dark to light: four that stand out, then the furthest."""
    colours = colours[colours[:, 0] >= LEAST_RATIO]
    if len(colours) > most:
        w, lab = colours[:, 0], colours[:, 1:]
        chroma = np.hypot(lab[:, 1], lab[:, 2])
        share = np.minimum(w * 8, 1)
        far, chosen = np.full(len(w), np.inf), []
        for k in (np.argmin(lab[:, 0]), np.argmax(lab[:, 0]), 0, np.argmax(chroma * (0.55 + share))):
            if far[k] >= TWIN:
                chosen.append(int(k))
                far = np.minimum(far, _away(lab, lab[k]))
        fixed = SPREAD_WEIGHTS["ratio"] * share + SPREAD_WEIGHTS["chroma"] * np.minimum(chroma / 0.22, 1)
        while len(chosen) < most and (far >= TWIN).any():
            k = int(np.argmax(np.where(far >= TWIN, SPREAD_WEIGHTS["distance"] * far + fixed, -np.inf)))
            chosen.append(k)
            far = np.minimum(far, _away(lab, lab[k]))
        colours = colours[chosen[:most]]
    return colours[np.argsort(colours[:, 1], kind="stable")]


def distinct(candidates: np.ndarray, taken: np.ndarray, size: int) -> np.ndarray:
    """At most `size` candidates (ratio, L, a, b), dark to light, far from those taken and from each other; ratios add up to 1."""
    single: list[int] = []
    for i, c in enumerate(candidates):
        if not single or _away(candidates[single, 1:], c[1:]).min() >= SAME:
            single.append(i)
    colours = candidates[single]
    if not len(colours):
        return colours
    w, lab = colours[:, 0], colours[:, 1:]
    others = np.min([_away(lab, t) for t in taken], axis=0) if len(taken) else np.full(len(w), 2 * APART)
    fixed = DISTINCT_WEIGHTS["others"] * np.minimum(others / (1.8 * APART), 1) + DISTINCT_WEIGHTS["ratio"] * np.minimum(w * 10, 1)
    fixed += DISTINCT_WEIGHTS["chroma"] * np.minimum(np.hypot(lab[:, 1], lab[:, 2]) / 0.18, 1) - 9 * np.maximum(APART - others, 0)
    own, open_, chosen = np.full(len(w), 2 * APART), np.ones(len(w), bool), []
    while len(chosen) < size and open_.any():
        k = int(np.argmax(np.where(open_, fixed + DISTINCT_WEIGHTS["own"] * np.minimum(own / (1.5 * APART), 1), -np.inf)))
        open_[k] = False
        own = _away(lab, lab[k]) if not chosen else np.minimum(own, _away(lab, lab[k]))
        chosen.append(k)
    out = colours[chosen].copy()
    total = out[:, 0].sum() or len(out)
    out[:, 0] = np.where(out[:, 0] > 0, out[:, 0], 1) / total
    return out[np.argsort(out[:, 1], kind="stable")]


def direction_palettes(colours: DataFrame, keys: list[str], direction: str, order: str, ratio: str = "ratio", candidates: int = 12, size: int = 5) -> DataFrame:
    """keys, direction, place, L, a, bb, ratio: the palette of every direction of a search (keys), dark to light.

    colours: keys, direction, L, a, bb, ratio; equal ratios go by `order`. Directions choose in
    their own order. A direction whose colours are all too rare has no rows.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = np.empty((0, 3)), []
        pdf = pdf.sort_values([direction, order], kind="stable")
        for name, own in pdf.groupby(direction, sort=True):
            merged = np.array(ordered_merge(own[[ratio, "L", "a", "bb"]].itertuples(index=False, name=None), MERGE), float)
            merged = merged[np.argsort(-merged[:, 0], kind="stable")]
            palette = distinct(spread(merged, candidates), taken, size)
            taken = np.concatenate((taken, palette[:, 1:]))
            rows = pd.DataFrame(palette, columns=["ratio", "L", "a", "bb"])
            out.append(rows.assign(**{k: pdf[k].iloc[0] for k in keys}, **{direction: name}, place=range(1, len(rows) + 1)))
        return pd.concat(out)[[*keys, direction, "place", "L", "a", "bb", "ratio"]]

    kinds = {f.name: f.dataType.simpleString() for f in colours.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, direction)) + ", place int, L double, a double, bb double, ratio double"
    return colours.select(*keys, direction, order, "L", "a", "bb", ratio).groupBy(*keys).applyInPandas(pick, schema)
