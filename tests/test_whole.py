"""Queries whose SQL cannot show the whole job, or that have none, against brute force on small fixtures."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from huestrata.functions import text as tx
from huestrata.operators import ranking as rk
from huestrata.operators import relations as rel
from huestrata.plans import registry
from huestrata.sources.tables import modes

registry.load_all()


def items(spark, folder, rows):
    """lineitem of (l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity)."""
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def mutual(scores):
    """(a, b): (score, margin) from scores of every ordered pair."""
    order = defaultdict(list)
    for (a, b), s in scores.items():
        order[a].append((-s, b))
    best = {a: sorted(x) for a, x in order.items()}
    return {(a, x[0][1]): (-x[0][0], -x[0][0] + (x[1][0] if len(x) > 1 else 0)) for a, x in best.items() if a < x[0][1] and best[x[0][1]][0][1] == a}


def test_mutual_nearest_tells_all_suppliers_apart(spark, tmp_path):
    rows = [(s, (s * s + 7 * k * s + k) % 50, s, k, float(1 + (s * 31 + k * 17) % 40)) for s in range(90, 230) for k in range(12)]
    sf, v = items(spark, tmp_path, rows), defaultdict(Counter)
    for s, p, _, _, q in rows:
        v[s][p] += q
    dot = {(a, b): d for a in v for b in v if a != b and (d := sum(q * v[b][p] for p, q in v[a].items() if p in v[b]))}
    cosine = {(a, b): round(d / (sum(q * q for q in v[a].values()) * sum(q * q for q in v[b].values())) ** 0.5, 9) for (a, b), d in dot.items()}
    for name, scores, n in (("jn10_mutual_nearest", cosine, 6),):
        got = {(r["a"], r["b"]): (r["score"], r["margin"]) for r in registry.QUERIES[name](spark, sf).collect()}
        want = mutual(scores)
        assert want and got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 2 * 10**-n and abs(got[k][1] - want[k][1]) < 2 * 10**-n for k in want)


def test_space_filling_takes_the_whole_pool(spark):
    sf, axes = "/root/testdata/sf0.01", ["delta_L", "delta_C", "hue_chord", "min_C", "max_C"]
    p = rel.physical(rel.all_pairs(modes(spark, sf), ["id", "L", "a", "bb", "C", "H"], ["style"]))
    p = p.select(F.lit(1).alias("g"), "id_1", "id_2", tx.pair_key(F.col("id_1").cast("string"), F.col("id_2").cast("string")).alias("pair_key"), *axes)
    want = [(r["place"], r["pair_key"]) for r in rk.space_filling(p, ["g"], 24, axes, "v7").collect()]
    got = rk.space_filling_pool(p, 24, axes, "v7")
    assert p.count() == 53 * 52 // 2 + 47 * 46 // 2 and len(want) == 24
    assert [(r["place"], r["pair_key"]) for r in got.orderBy("place").collect()] == want
    assert rk.space_filling_pool(p.limit(0), 24, axes, "v7").count() == 0
    lists = registry.QUERIES["tk05_space_filling"](spark, sf).collect()
    assert sorted({(r["style"], r["place"]) for r in lists}) == [(s, k) for s in (0, 1) for k in range(1, 25)] and len({r["pair_key"] for r in lists}) == 48


def masks(spark, folder):
    """Masks over orders, dealt over all line numbers: 2 within 1; 4 near 3 and 5 near 4, but 5 not near 3; 6 half of 1; 7 alone; 31 is not 1."""
    spans = {1: (1, 101), 2: (1, 97), 3: (200, 600), 4: (202, 602), 5: (204, 604), 6: (51, 101), 7: (900, 905), 31: (80, 130)}
    return items(spark, folder, [(m, 1, x, x % 5 + 1, 1.0) for m, (a, b) in spans.items() for x in range(a, b)]), {m: set(range(a, b)) for m, (a, b) in spans.items()}


def test_masks_are_of_all_rows(spark, tmp_path):
    sf, of = masks(spark, tmp_path)
    cover = {(a, b): len(of[a] & of[b]) / len(of[a]) for a in of for b in of if a != b and of[a] & of[b]}
    got = {tuple(r) for r in registry.QUERIES["jn12_containment"](spark, sf).collect()}
    assert got == {(a, b) for (a, b), c in cover.items() if c >= 0.95 and len(of[a]) < len(of[b])} == {(2, 1), (6, 1)}
    got = {r["mask"]: r["gain"] for r in registry.QUERIES["cl19_recovery_gain"](spark, sf).collect()}
    assert got == {a: round(max(c for (x, _), c in cover.items() if x == a), 6) for a in of if a != 7}


def test_near_duplicate_masks_are_joined(spark, tmp_path):
    sf, _ = masks(spark, tmp_path)
    got = {r["mask"]: r["component"] for r in registry.QUERIES["jn23_near_duplicate_masks"](spark, sf).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 31: 31}
