"""Hand-checked values and properties of the function library."""

import math
import time

from pyspark.sql import functions as F

from huestrata.functions import color as c
from huestrata.functions import stats as st
from huestrata.functions import text as tx
from huestrata.operators import ranking as rk
from huestrata.sources import landing as ld
from huestrata.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hue_circle(spark):
    assert one(spark, c.hue_difference(F.lit(350.0), F.lit(10.0)), c.hue_difference(F.lit(10.0), F.lit(190.0)), c.hue_difference(F.lit(None).cast("double"), F.lit(1.0)))[:] == (20.0, 180.0, None)


def test_hue_reliability(spark):
    low, high = one(spark, c.pair_hue_reliability(F.lit(0.0055), F.lit(0.035)), c.pair_hue_reliability(F.lit(0.08), F.lit(0.10)))
    assert low < 0.1 and high > 0.95


def test_rounding_and_clamp(spark):
    assert one(spark, c.js_round(F.lit(-2.5)), c.clamp(F.lit(float("nan"))), c.clamp(F.lit(3.0)))[:] == (-2.0, None, 1.0)


def test_grey_has_no_hue(spark):
    L, a, b = c.rgb_to_oklab(F.lit(128), F.lit(128), F.lit(128))
    row = one(spark, L.alias("L"), c.hue(a, b).alias("H"), c.oklab_to_hex(L, a, b).alias("hex"))
    assert row["H"] is None and row["hex"] == "#808080" and 0.59 < row["L"] < 0.61


def test_rule_edges(spark):
    k = c.rule_classes(F.lit(0.05), F.lit(0.02), F.lit(39.0), F.lit(0.05))
    assert one(spark, k["hue_relation"], k["tone_relation"])[:] == ("same_or_adjacent", "similar")
    assert one(spark, c.rule_classes(F.lit(0.5), F.lit(0.2), F.lit(41.0), F.lit(0.05))["hue_relation"])[0] == "different"
    assert one(spark, c.rule_classes(F.lit(0.5), F.lit(0.2), F.lit(41.0), F.lit(0.01))["hue_relation"])[0] == "not_applicable"


def test_text(spark):
    row = one(spark, tx.normalize_text(F.lit("Héllo, 世界! Z9K")), tx.domain(F.lit("https://www.Ex.com/a")), tx.hamming(F.lit("ff"), F.lit("0f")), tx.hamming(F.lit("f"), F.lit("0f")), tx.fnv1a(F.lit("a")), tx.pair_key(F.lit("b"), F.lit("a")))
    assert row[:] == ("héllo 世界 z9k", "ex.com", 4.0, math.inf, "e40c292c", "a||b")


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1, 1.0, 0.85), (2, 2.0, 1.0), (3, 3.0, 1.0)], "id int, v double, w double").withColumn("g", F.lit(1))
    assert st.weighted_quantiles(df, ["g"], "v", "w", [0.5]).first()["q50"] == 2.0


def test_mid_rank(spark):
    got = st.mid_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double"), "v").orderBy("v").select("mid_rank").toPandas()["mid_rank"].tolist()
    assert got == [0.0, 0.5, 0.5, 1.0]
    assert st.mid_rank(spark.createDataFrame([(5.0,)], "v double"), "v").first()["mid_rank"] == 1.0


def test_global_rank_is_a_total_order(spark):
    df = rk.global_rank(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), [F.asc("k")], "r")
    assert df.where("r <> k + 1").count() == 0 and df.count() == 1000


def test_diverse_top_caps(spark):
    rows = [(1, i, f"u{i}", "p1" if i < 9 else "p2", f"a{i % 3}", 1.0 - i / 100) for i in range(12)]
    got = rk.diverse_top(spark.createDataFrame(rows, "g int, id int, url string, provider string, author string, score double"), ["g"], 5).toPandas()
    assert len(got) == 5 and got["id"].is_unique and (got["provider"] == "p1").sum() <= 3 and got["author"].value_counts().max() <= 2


def test_image_kind(spark):
    df = spark.createDataFrame([(b"\xff\xd8\xff\xe0aaaaaaaaaa",), (b"\x89PNG\r\n\x1a\n0000",), (b"RIFF0000WEBPVP8 ",), (b"<html><body>xx",)], "c binary")
    assert [r[0] for r in df.select(ld.image_kind(F.col("c"))).collect()] == ["jpeg", "png", "webp", None]


def test_lifecycle_steps():
    log = [("START", 1, 0, 1.0, -1), ("FULL", 1, 0, 2.0, 7), ("DELTA", 1, 0, 3.0, 8), ("DELTA", 1, 0, 4.0, 7), ("START", 2, 1, 5.0, -1), ("END", 1, 0, 6.0, 0), ("END", 2, 1, 7.0, 0)]
    state, said = None, []
    for row in log:
        state, more = jobs.step(state, row)
        said += [m[2] for m in more]
    assert said == ["ACTIVE", "FULL", "REJECTED", "DELTA", "SUPERSEDED", "ACTIVE", "STALE", "COMPLETED"]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(f"v{i % 3}", k, i // 3, i // 9, float(i), 1) for i, k in enumerate(["START", "FULL", "END"] * 9)]
    df = spark.createDataFrame(rows, "view string, kind string, job long, generation long, at double, snapshot long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.lifecycle(jobs.event_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("life").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    want, began = sorted(map(tuple, jobs.lifecycle_batch(df).collect())), time.time()
    while spark.table("life").count() < len(want) and time.time() - began < 60:  # timeouts keep the query busy for ever
        time.sleep(0.5)
    got = sorted(map(tuple, spark.table("life").collect()))
    q.stop()
    assert got == want and got


def test_stream_log_sink(spark, tmp_path):
    spark.range(50).select(F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("k"), F.lit(1.0).alias("v")).write.parquet(str(tmp_path / "in"))
    q = jobs.log_sink(jobs.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), str(tmp_path / "out"), str(tmp_path / "cp"), 20)
    assert q.awaitTermination(90)
    assert spark.read.json(str(tmp_path / "out")).count() == 50
