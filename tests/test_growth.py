"""That what a query holds or works out does not grow faster than its input: plans, folds and results of the steps that did."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huestrata.functions import stats as st
from huestrata.operators import clustering as cl
from huestrata.operators import lexicon as lx
from huestrata.operators import ranking as rk
from huestrata.operators import relations as rel
from huestrata.plans import registry
from huestrata.plans.hierarchy import style_runs, style_swatches
from huestrata.streaming import jobs

registry.load_all()
SF = "/root/testdata/sf0.001"


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cl20_go_no_go", "cl21_roles", "cl10_longest_chain", "jn12_nesting", "jn23_symmetric_dedupe"])
def test_rows_of_masks_are_never_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(registry.QUERIES[name](spark, SF))


def test_nearest_centroid_neither_sorts_nor_shuffles(spark):
    text = plan(registry.QUERIES["jn09_nearest_centroid"](spark, SF)).split("BroadcastNestedLoopJoin")[0]
    assert "Sort" not in text and "Exchange" not in text
    points = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 9.0)], "id long, x double")
    centres = spark.createDataFrame([(7, 10.0), (4, 0.0), (2, 10.0)], "idx long, c double")
    got = rel.nearest(points, centres, lambda k: F.abs(F.col("x") - k["c"]), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, 4, 0.0), (2, 2, 5.0), (3, 2, 1.0)]


def test_softmax_entropy_of_scores_far_apart(spark):
    rows = spark.createDataFrame([([0.0, -2000.0],), ([1.0, 1.0, 1.0],), ([3.0],)], "s array<double>").select(st.softmax_entropy(F.col("s")).alias("h"))
    assert [r["h"] for r in rows.collect()] == [0.0, pytest.approx(1.0), 0.0]


def test_terms_are_cleaned_once(spark):
    df = spark.range(1).select(lx.style_terms(F.split(F.col("id").cast("string"), ",")).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2


def test_splits_are_picked_in_one_pass(spark):
    assert plan(registry.QUERIES["gv06_fresh_split"](spark, SF)).count("FlatMapGroupsInPandas") == 1


def test_clusters_at_equal_a_cut_trace(spark):
    """Clusters against a replay of merge_trace."""
    s = style_swatches(spark, SF)
    cuts = [0.03, 0.05, 0.08]
    steps = sorted(map(tuple, cl.merge_trace(s, ["style"], 0.08 + 1e-12).select("style", "step", "a", "b", "distance").collect()))
    ids = [tuple(r) for r in s.select("style", "id").collect()]
    want = set()
    for t in cuts:
        cluster = {i: i for i in ids}
        open_styles = {style for style, _ in ids}
        for style, _, a, b, d in steps:
            if d > t + 1e-12:
                open_styles.discard(style)
            if style in open_styles:
                low, high = sorted((cluster[style, a], cluster[style, b]))
                cluster = {i: low if c == high else c for i, c in cluster.items()}
        want |= {(style, t, i, c[1]) for (style, i), c in cluster.items()}
    got = cl.clusters_at(s, ["style"], cuts).select("style", "threshold", "id", "cluster")
    assert {tuple(r) for r in got.collect()} == want and len({w[3] for w in want}) > 1


def test_stability_finds_clusters_in_one_pass(spark):
    assigned, classes = style_runs(spark, SF)
    text = plan(assigned) + plan(classes)
    assert "FlatMapGroups" not in text and "InMemoryTableScan" not in text


def test_picks_keep_no_pool(spark, monkeypatch):
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: pytest.fail("the pool was kept"))
    for name in ("tk06_stratified", "tk07_capped_strata"):
        assert registry.QUERIES[name](spark, SF).count()


def test_boundary_take_looks_further_when_first_rows_run_out(spark):
    rows = [(f"p{i:02d}", 1 if i < 20 else 2, 100 + i, float(i)) for i in range(30)]
    pool = spark.createDataFrame(rows, "pair_key string, id_1 long, id_2 long, m double")
    got = rk.boundary_take(pool, [("a", "m", None, 3), ("b", "m", F.col("id_1") == 1, 1)], first=2)
    assert [tuple(r) for r in got.orderBy("no").collect()] == [(1, "a", "p00"), (2, "a", "p01"), (3, "a", "p20")]


def test_lifecycle_takes_many_views_a_task(spark):
    log = jobs.soak_events(jobs.soak_plan(spark.range(40).select(F.col("id").alias("run"))))
    out = jobs.lifecycle_batch(log)
    assert "FlatMapGroups" not in plan(out)
    assert {r["n"] for r in out.where("status = 'COMPLETED'").groupBy("view").agg(F.count(F.lit(1)).alias("n")).collect()} == {375}


def test_covered_tries_few_members(spark):
    sets = {1: range(100), 2: range(96), 3: range(200, 230), 4: range(215, 400), 5: range(96), 6: range(500, 502)}
    df = spark.createDataFrame([(m, x) for m, xs in sets.items() for x in xs], "m long, x long")
    for share, alike in ((0.95, False), (0.95, True), (0.5, False)):
        want = {(a, b) for a in sets for b in sets if a != b and (k := len(set(sets[a]) & set(sets[b]))) >= share * len(sets[a]) and (not alike or k >= share * len(sets[b]))}
        got = {(r["l"], r["r"]) for r in rel.covered(df, share, alike).collect()}
        assert got == want and want


def test_largest_coverage_is_counted_by_set(spark):
    sets = {1: range(10), 2: range(8), 3: range(7, 30), 4: range(90, 95)}
    df = spark.createDataFrame([(m, x) for m, xs in sets.items() for x in xs], "m long, x long")
    got = rel.largest_coverage(df, 3)
    assert {r["m"]: round(r["coverage"], 6) for r in got.collect()} == {1: 0.8, 2: 1.0, 3: round(3 / 23, 6)}
    assert "REPARTITION_BY_NUM" in plan(got)


def test_dots_are_worked_out_once_a_pair(spark):
    v = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (3, 1, 1.0), (1, 2, 4.0), (3, 2, 0.5), (9, 3, 1.0)], "a long, p long, q double")
    got = rel.dots(v, 2)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 6.0), (1, 3, 4.0), (2, 1, 6.0), (2, 3, 3.0), (3, 1, 4.0), (3, 2, 3.0)]
    assert "Join" not in plan(got)
