"""Percentiles and running sums within keys: against plain Python, and without a task that holds a key."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from huestrata.functions import stats as st
from huestrata.operators import scans

KINDS = {"r": ("round", 0.9), "c": ("ceil", 0.95), "f": ("floor", 0.5), "l": ("linear", 0.25), "low": ("round", 0.0), "high": ("linear", 1.0)}


def places(values):
    v, n = sorted(values), len(values)
    at = (n - 1) * 0.25
    k = math.floor(at + 1e-9)
    line = v[k] + (v[min(k + 1, n - 1)] - v[k]) * (at - k)
    return v[math.floor((n - 1) * 0.9 + 0.5)], v[max(math.ceil(n * 0.95 - 1e-9) - 1, 0)], v[math.floor((n - 1) * 0.5)], line, v[0], v[-1]


def made_up():
    rnd, rows = random.Random(8), []
    for key, n in (("hot", 3000), ("ties", 900), ("one", 1), ("two", 2), ("same", 500), ("wide", 300), (None, 40)):
        for _ in range(n):
            v = {"hot": rnd.gauss(0, 1), "ties": float(rnd.randrange(4)), "same": 7.5, "wide": rnd.choice([1, -1]) * 10.0 ** rnd.randrange(-300, 300)}.get(key, rnd.random())
            rows.append((key, v, rnd.random()))
    rows += [("hot", None, 1.0), ("none", None, 1.0), ("hot", float("nan"), 1.0), ("hot", float("inf"), 1.0)]
    rnd.shuffle(rows)
    return rows


def test_percentiles_equal_sorting(spark):
    rows = made_up()
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    for sizes in ({}, {"bins": 32, "few": 60}):  # sorted at once, and narrowed over many rounds
        got = {r["k"]: r for r in scans.percentiles(df, ["k"], "v", KINDS, **sizes).collect()}
        assert set(got) == {"hot", "ties", "one", "two", "same", "wide", None}
        for k, r in got.items():
            values = [v for key, v, _ in rows if key == k and v is not None and math.isfinite(v)]
            assert r["n"] == len(values) and np.allclose([r[x] for x in KINDS], places(values), rtol=1e-12, atol=0)
    values = [v for _, v, _ in rows if v is not None and math.isfinite(v)]
    whole = scans.percentiles(df, [], "v", KINDS, bins=16, few=50).collect()
    assert len(whole) == 1 and np.allclose([whole[0][x] for x in KINDS], places(values), rtol=1e-12)
    assert scans.percentiles(df.limit(0), ["k"], "v", KINDS).count() == scans.percentiles(df.limit(0), [], "v", KINDS).count() == 0


def test_weighted_quantiles_equal_running_sums(spark):
    rows = [(k, v, w) for k, v, w in made_up() if v is not None and math.isfinite(v)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r["k"]: r for r in scans.inverse_cdf(df, ["k"], "v", {f"q{q}": F.lit(q / 10) * F.col("total") for q in (1, 5, 9, 10)}, "w", slack=1e-12, bins=32, few=60).collect()}
    for k, r in got.items():
        own = sorted((v, w) for key, v, w in rows if key == k)
        run = np.cumsum([w for _, w in own])
        for q in (1, 5, 9):
            assert r[f"q{q}"] == own[int(np.argmax(run + 1e-12 >= q / 10 * run[-1]))][0]
        assert r["q10"] == own[-1][0]


def test_a_hot_key_is_no_task(spark, monkeypatch):
    """A million rows of one key: what is sorted in the end is a small part, and no window goes by the key alone."""
    df = spark.range(1_000_000, numPartitions=4).select(F.lit("k").alias("k"), (F.sin("id") * 1000).alias("v"))
    last, picked = [], scans._picked
    monkeypatch.setattr(scans, "_picked", lambda rows, ranges, *rest: (last.append(ranges), picked(rows, ranges, *rest))[1])
    got = scans.percentiles(df, ["k"], "v", {"p50": ("floor", 0.5), "p95": ("ceil", 0.95)}).first()
    assert last[0].agg(F.max("_in")).first()[0] <= 4096 < 0.05 * 1_000_000
    want = np.sort(np.array([r["v"] for r in df.select("v").toLocalIterator(prefetchPartitions=True)]))
    assert (got["n"], got["p50"], got["p95"]) == (1_000_000, want[499_999], want[949_999])


def test_segmented_scan_equals_running_sums(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, 1.5, 2.0, -1.0])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(6)
    for keys in (["k"], []):
        got = {r["i"]: r for r in scans.segmented_scan(df, keys, ["i"], {"run": "x"}, "place", {"all": "x"}).collect()}
        run, count = {}, {}
        for k, i, x in rows:
            g = k if keys else 0
            run[g], count[g] = run.get(g, 0) + (x or 0), count.get(g, 0) + 1
            assert got[i]["place"] == count[g] and abs(got[i]["run"] - run[g]) < 1e-9 and got[i]["k"] == k
        assert all(abs(got[i]["all"] - run[k if keys else 0]) < 1e-9 for k, i, _ in rows)
    assert scans.segmented_scan(df.limit(0), ["k"], ["i"], {"run": "x"}).count() == 0


def test_segments_are_spread_over_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit(1).alias("k"), "id", F.lit(1).alias("one"))
        out = scans.segmented_scan(df, ["k"], ["id"], {"run": "one"}, "place")
        assert out.where("run <> place OR place <> id + 1").count() == 0
        assert "partitionBy" not in out._jdf.queryExecution().toString() and "hashpartitioning(_part" in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_mid_rank_and_entropy_within_keys(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("aab"), float(rnd.randrange(9))) for i in range(300)] + [(300, "alone", 2.0)]
    df = spark.createDataFrame(rows, "i long, k string, v double")
    got = {r["i"]: r["mid_rank"] for r in st.mid_rank(df, "v", ["k"]).collect()}
    for i, k, v in rows:
        own = [x for _, g, x in rows if g == k]
        want = 1.0 if len(own) == 1 else (sum(x < v for x in own) + (own.count(v) - 1) / 2) / (len(own) - 1)
        assert abs(got[i] - want) < 1e-12
    for r in st.normalized_entropy(df, ["k"], "v").collect():
        own = [x for _, g, x in rows if g == r["k"] and x > 0]
        h = -sum(x / sum(own) * math.log(x / sum(own)) for x in own)
        assert r["n"] == len(own) and abs(r["entropy"] - (h / math.log(len(own)) if len(own) > 1 else 0)) < 1e-12


def test_components_of_a_long_chain(spark):
    from huestrata.operators import relations as rel

    nodes = spark.range(10_000).select(F.format_string("m%05d", F.col("id")).alias("node"))
    chain = spark.range(1, 10_000).select(F.format_string("m%05d", F.col("id")).alias("l"), F.format_string("m%05d", F.col("id") - 1).alias("r"))
    stars, rounds = rel.contracted(chain)
    assert rounds < 20 and stars.where("v <> 'm00000'").count() == 0 and stars.count() == 9_999
    parts = chain.where("l NOT LIKE '%00'")  # broken every hundred
    got = rel.components(nodes, parts.unionByName(parts.select(F.col("r").alias("l"), F.col("l").alias("r"))))
    assert got.where("substring(node, 1, 4) <> substring(component, 1, 4) OR component NOT LIKE '%00'").count() == 0 and got.count() == 10_000
    assert rel.components(nodes.limit(3), chain.limit(0)).where("node <> component").count() == 0
