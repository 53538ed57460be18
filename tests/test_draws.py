"""Distinct palettes, seeded shuffles and digests of long lists against plain Python."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from huestrata.operators import digests, palettes, shuffles
from huestrata.plans import registry

registry.load_all()


# --- shuffles -----------------------------------------------------------------------------


def stepped(seed):
    """The generator as it is stepped: 32-bit arithmetic, draw after draw."""
    m = 0xFFFFFFFF
    a = seed & m
    while True:
        a = (a + 0x6D2B79F5) & m
        t = (a ^ (a >> 15)) * (1 | a) & m
        t = ((t + ((t ^ (t >> 7)) * (61 | t) & m)) & m) ^ t
        yield (t ^ (t >> 14)) / 4294967296


def test_draws_equal_the_stepped_generator(spark):
    seeds = [0, 1, 2**31, 2**32 - 1, 123456789]
    rows = spark.createDataFrame([(s,) for s in seeds], "s long").crossJoin(spark.range(300)).select("s", "id", shuffles.draw(F.col("s"), F.col("id")).alias("u"))
    want = {}
    for s in seeds:
        g = stepped(s)
        want |= {(s, i): next(g) for i in range(300)}
    assert {(r["s"], r["id"]): r["u"] for r in rows.collect()} == want
    far = spark.range(1).select(shuffles.draw(F.lit(7), F.lit(5_000_000_000)).alias("u")).first()["u"]  # the state goes round
    assert far == spark.range(1).select(shuffles.draw(F.lit(7), F.lit(5_000_000_000 - 2**32)).alias("u")).first()["u"]


def test_shuffle_equals_swapping_in_place(spark):
    cards = [(d, i) for d, n in ((1, 1), (2, 2), (3, 57), (None, 9)) for i in range(n)]
    random.Random(2).shuffle(cards)
    df = spark.createDataFrame(cards, "deck long, id long").repartition(3)
    seed = shuffles.seed32(F.concat(F.lit("x|"), F.coalesce(F.col("deck").cast("string"), F.lit("-"))))
    got = {}
    for r in shuffles.shuffled(df, ["deck"], ["id"], seed).collect():
        got.setdefault(r["deck"], {})[r["place"]] = r["id"]
    for deck, n in ((1, 1), (2, 2), (3, 57), (None, 9)):
        a, g = list(range(n)), stepped(int(hashlib.sha256(f"x|{'-' if deck is None else deck}".encode()).hexdigest()[:8], 16))
        for i in range(n - 1, 0, -1):
            j = math.floor(next(g) * (i + 1))
            a[i], a[j] = a[j], a[i]
        assert [got[deck][p] for p in range(1, n + 1)] == a
    assert shuffles.shuffled(df.limit(0), ["deck"], ["id"], seed).count() == 0


# --- digests ------------------------------------------------------------------------------


def plain_digest(items, separator, fan):
    while True:
        items = [hashlib.sha256(separator.join(items[i : i + fan]).encode()).hexdigest() for i in range(0, len(items), fan)]
        if len(items) == 1:
            return items[0]
        separator = ""


def test_digests_do_not_depend_on_partitions(spark):
    rnd = random.Random(6)
    rows = [(k, rnd.randrange(10**6), rnd.choice(["é", "x", "", None]) or f"v{i}") for k, n in (("a", 1), ("b", 16), ("c", 17), ("d", 700), (None, 40)) for i in range(n)]
    rows += [("a", 5, None), ("gone", 1, None)]
    want = {}
    for k in ("a", "b", "c", "d", None):
        items = [v for _, _, v in sorted((r for r in rows if r[0] == k and r[2] is not None), key=lambda r: (r[1], r[2]))]
        want[k] = (len(items), plain_digest(items, "|", 16))
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k string, o long, v string").repartition(parts)
        assert {r["k"]: (r["n"], r["digest"]) for r in digests.ordered_digest(df, ["k"], ["o"], "v", "|", fan=16).collect()} == want
    whole = digests.ordered_digest(spark.range(3000).select("id", F.col("id").cast("string").alias("v")), [], ["id"], "v").collect()
    assert [(r["n"], r["digest"]) for r in whole] == [(3000, plain_digest([str(i) for i in range(3000)], "\n", 1024))]
    assert digests.ordered_digest(df.limit(0), ["k"], ["o"], "v").count() == 0


# --- palettes -----------------------------------------------------------------------------


def merge(colours):
    out = []
    for w, *lab in sorted(colours, key=lambda c: -c[0]):
        hit = next((m for m in out if math.dist(m[1:], lab) < 0.045), None)
        if hit is None:
            out.append([w, *lab])
        else:
            t = hit[0] + w
            hit[1:] = [(x * hit[0] + y * w) / t for x, y in zip(hit[1:], lab, strict=True)]
            hit[0] = t
    return sorted((m for m in out if m[0] >= 0.002), key=lambda m: -m[0])


def candidates_of(merged, most):
    chroma = lambda m: math.hypot(m[2], m[3])
    if len(merged) <= most:
        return sorted(merged, key=lambda m: m[1])
    chosen = []
    free = lambda m: all(math.dist(m[1:], c[1:]) >= 0.02 for c in chosen)
    first = [min(merged, key=lambda m: m[1]), max(merged, key=lambda m: m[1]), merged[0], max(merged, key=lambda m: chroma(m) * (0.55 + min(m[0] * 8, 1)))]
    for m in first:
        if free(m):
            chosen.append(m)
    while len(chosen) < most and any(map(free, merged)):
        score = lambda m: min(math.dist(m[1:], c[1:]) for c in chosen) * 0.62 + min(m[0] * 8, 1) * 0.25 + min(chroma(m) / 0.22, 1) * 0.13
        chosen.append(max((m for m in merged if free(m)), key=score))
    return sorted(chosen[:most], key=lambda m: m[1])


def palette_of(candidates, used, size):
    single = []
    for c in candidates:
        if all(math.dist(c[1:], s[1:]) >= 0.018 for s in single):
            single.append(c)
    chosen = []
    while len(chosen) < size and len(chosen) < len(single):
        def score(c):
            du = min((math.dist(c[1:], u) for u in used), default=0.11)
            ds = min((math.dist(c[1:], s[1:]) for s in chosen), default=0.11)
            penalty = (0.055 - du) * 9 if du < 0.055 else 0
            return min(du / 0.099, 1) * 0.42 + min(ds / 0.0825, 1) * 0.28 + min(c[0] * 10, 1) * 0.22 + min(math.hypot(c[2], c[3]) / 0.18, 1) * 0.08 - penalty

        chosen.append(max((c for c in single if c not in chosen), key=score))
    total = sum(c[0] for c in chosen)
    return sorted(([c[0] / total, *c[1:]] for c in chosen), key=lambda c: c[1])


def test_palettes_equal_the_rules_step_by_step(spark):
    rnd, rows = random.Random(4), []
    for search in range(5):
        for direction in range(3):
            for i in range((30, 14, 3)[direction]):
                rows.append((search, direction, i, rnd.uniform(0.05, 0.95), rnd.uniform(-0.2, 0.2), rnd.uniform(-0.2, 0.2), rnd.choice([0.001, rnd.random() / 9])))
    df = spark.createDataFrame(rows, "search long, direction long, id long, L double, a double, bb double, ratio double").repartition(4)
    got = {}
    for r in palettes.direction_palettes(df, ["search"], "direction", "id").orderBy("search", "direction", "place").collect():
        got.setdefault((r["search"], r["direction"]), []).append([r["ratio"], r["L"], r["a"], r["bb"]])
    for search in range(5):
        used = []
        for direction in range(3):
            own = [(w, L, a, b) for s, d, _, L, a, b, w in rows if (s, d) == (search, direction)]
            want = palette_of(candidates_of(merge(own), 12), used, 5)
            used += [c[1:] for c in want]
            have = got.get((search, direction), [])
            assert len(have) == len(want) and all(math.dist(x, y) < 1e-9 for x, y in zip(have, want, strict=True)), (search, direction)


def test_palette_query_covers_every_style(spark):
    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES["tk11_distinct_palettes"](spark, sf).collect()
    assert {r["place"] for r in rows} <= {1, 2, 3, 4, 5} and all(0 < r["ratio"] <= 1 for r in rows)
