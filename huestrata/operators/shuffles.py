"""Seeded shuffles that equal a generator stepped draw by draw.

The generator's state grows by a constant with each draw, so the i-th draw is a function of
seed and i, and all draws of all decks are worked out at once as column expressions. Only the
swaps depend on each other; they are folded deck by deck. A deck is a set of bounded size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the 32-bit generator.
STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without an overflow of 64."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(0xFFFF)
    return (a * b.bitwiseAND(0xFFFF) + F.shiftleft(high, 16)).bitwiseAND(MASK)


def seed32(text: Column) -> Column:
    """The first 32 bits of the text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def draw(seed: Column, i: Column) -> Column:
    """The i-th draw, from 0, of the generator with this seed: in [0, 1)."""
    a = (seed.cast("long").bitwiseAND(MASK) + (i.cast("long") + 1) % (MASK + 1) * F.lit(STEP) % (MASK + 1)).bitwiseAND(MASK)
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(1))
    more = (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(MASK)
    t = more.bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / 4294967296.0


def shuffled(df: DataFrame, deck: list[str], order: list[str], seed: Column) -> DataFrame:
    """df with `place` from 1: each deck, laid out by `order`, after a Fisher-Yates shuffle from its last card down.

    seed: a number per deck. Cards that are equal in deck and order are dealt as they happen to lie.
    """
    key = Window.partitionBy(*deck)
    laid = df.withColumns({"_at": F.row_number().over(key.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(key), "_seed": seed})
    # the swap of card i is draw n - 1 - i
    laid = laid.withColumn("_with", F.floor(draw(F.col("_seed"), F.col("_n") - 1 - F.col("_at")) * (F.col("_at") + 1)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable")
        cards = list(range(len(pdf)))
        swaps = pdf["_with"].tolist()
        for i in range(len(cards) - 1, 0, -1):
            cards[i], cards[swaps[i]] = cards[swaps[i]], cards[i]
        out = pdf.iloc[cards].drop(columns=["_at", "_n", "_seed", "_with"])
        return out.assign(place=range(1, len(out) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", place int"
    return laid.groupBy(*deck).applyInPandas(fold, schema)
