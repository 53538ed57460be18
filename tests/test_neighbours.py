"""Nearest companions in blocks: results against brute force, and that pairs are neither shuffled nor written."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from huestrata.operators import neighbours as nb
from huestrata.operators import relations as rel
from huestrata.plans import registry

registry.load_all()


def stages(spark):
    """Records that each finished stage wrote to a shuffle."""
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}


def test_pairs_of_a_common_part_are_not_shuffled(spark, tmp_path):
    """300 suppliers of the same 4 parts: 1200 entries, 44850 pairs."""
    rows = [(s, p, s, p, float(1 + (s * 31 + p * p * 17) % 40)) for s in range(300) for p in range(4)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = stages(spark)
    assert registry.QUERIES["jn10_mutual_nearest"](spark, str(tmp_path)).collect()
    assert 0 < sum(n for k, n in stages(spark).items() if k not in before) < 8 * len(rows)


def rank(score):
    return (0, 0.0) if score is not None and math.isnan(score) else (2, 0.0) if score is None else (1, -score)


def two_best(entries):
    """a: [(b, score), (b, score)] from entries (a, p, q)."""
    v = defaultdict(dict)
    for a, p, q in entries:
        v[a][p] = q
    out = {}
    length = {a: math.sqrt(sum(q * q for q in x.values() if q is not None)) for a, x in v.items()}
    v = {a: {p: None if q is None else q / length[a] for p, q in sorted(x.items())} for a, x in v.items() if length[a] > 0 or math.isnan(length[a])}
    for a, x in v.items():
        found = []
        for b, y in v.items():
            shared = [p for p in x if p in y] if a != b else []
            known = [x[p] * y[p] for p in shared if x[p] is not None and y[p] is not None]
            if shared:
                found.append((b, round(sum(known), 9) if known else None))
        if found:
            out[a] = sorted(found, key=lambda f: (rank(f[1]), f[0]))[:2]
    return out


def drawn(spread, seed):
    """Random entries with ties, a hot vector and a hot place; negative, zero, null and NaN values; vectors of no length; keys far apart."""
    r = random.Random(seed)
    far = lambda a: a * 10**15 - 7
    entries = {(far(a), p): float(r.randint(1, 5)) for a in range(60) for p in r.sample(range(spread), 6)}
    entries |= {(far(7), p): float(1 + p % 3) for p in range(spread)} | {(far(a), -(10**14)): 1.0 for a in range(40)}
    entries |= {(far(a), p): q for a, q in ((60, -2.0), (61, 0.0), (62, None), (63, 3.0), (64, 3.0), (65, 3.0)) for p in (0, 1, 2)}
    entries |= {(far(66), 10**12): None, (far(66), 5): 2.0, (far(67), 10**12): 4.0, (far(67), 6): 2.0, (far(68), 10**13): math.nan, (far(69), 10**13): 1.0, (far(70), 10**16): 1.0}
    return [(a, p, q) for (a, p), q in entries.items()]


@pytest.mark.parametrize("spread, sizes", [(12, nb.Sizes()), (400, nb.Sizes()), (12, nb.Sizes(40, 100, 50)), (400, nb.Sizes(40, 100, 50)), (30, nb.Sizes(60, 10**6, 9))])
def test_two_best_equal_brute_force(spark, spread, sizes):
    entries = drawn(spread, spread)
    df = spark.createDataFrame(entries, "a long, p long, q double").repartition(3)
    got = defaultdict(list)
    for r in nb.best_by_cosine(df, len(entries), sizes=sizes).collect():
        got[r["a"]].append((r["b"], r["score"]))
    got = {a: sorted(x, key=lambda f: (rank(f[1]), f[0]))[:2] for a, x in got.items()}
    want = two_best(entries)
    assert got.keys() == want.keys()
    for a, x in want.items():
        assert [b for b, _ in got[a]] == [b for b, _ in x]
        assert all(rank(s) == pytest.approx(rank(t), abs=1.5e-9) for (_, s), (_, t) in zip(got[a], x, strict=True))


def test_no_entries_have_no_companions(spark):
    none = spark.createDataFrame([], "a int, p long, q double")
    assert nb.best_by_cosine(none, 0).schema.simpleString() == "struct<a:int,b:int,score:double>"
    assert rel.mutual_nearest(nb.best_by_cosine(none, 0)).count() == 0
    alone = spark.createDataFrame([(1, 1, 2.0), (2, 2, 2.0), (3, 2, 0.0), (None, 2, 1.0), (4, None, 1.0)], "a int, p long, q double")
    assert nb.best_by_cosine(alone, 5).count() == 0


def test_rounding_is_that_of_sql(spark):
    r = random.Random(1)
    x = [k / 1024 for k in range(-9, 10)] + [float(f"0.{r.randint(0, 10**9 - 1):09d}5") for _ in range(3000)] + [r.uniform(-1, 1) for _ in range(300)] + [1e-12, 123456.7890123455, -9e7 - 1 / 3, math.nan]
    want = [s["y"] for s in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double").orderBy("i").select(F.round("x", 9).alias("y")).collect()]
    got = nb._rounded(nb.np.array(x), 9).tolist()
    assert [str(v) for v in got] == [str(v) for v in want]
