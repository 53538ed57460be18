"""Readers, sinks and streams on small files; shipping the package."""

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huestrata.sources import landing as ld
from huestrata.streaming import jobs

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_documents_with_defaults(spark, tmp_path):
    write(tmp_path / "a.json", '{"id": 1,\n "name": "one"}')
    write(tmp_path / "b.json", '{"id": 2, "name": ')
    write(tmp_path / "c.json", '{"other": 3}')
    got = sorted((r["id"] or 0, r["name"]) for r in ld.read_document(spark, str(tmp_path), ROW).collect())
    assert got[-1] == (1, "one") and all(r == (0, None) for r in got[:-1]) and len(got) >= 2


def test_latest_file(spark, tmp_path):
    for name, i in (("new", 2), ("old", 1), ("older", 0)):
        write(tmp_path / f"{name}.json", json.dumps({"id": i, "name": name}))
        os.utime(tmp_path / f"{name}.json", (time.time() - 1000 * (3 - i),) * 2)
    assert [tuple(r) for r in ld.read_latest(spark, str(tmp_path), ROW).collect()] == [(2, "new")]


def test_tail_of_a_log(spark, tmp_path):
    write(tmp_path / "log.ndjson", "\n".join([*(json.dumps({"id": i, "name": f"n{i}"}) for i in range(150)), "{broken", '{"id": 150, "name": "n150"}']))
    got = [r["id"] for r in ld.tail(spark, str(tmp_path), ROW, "id", 100).collect()]
    assert got == list(range(150, 50, -1))


def test_pair_keys_are_walked_not_matched(spark):
    docs = [
        {"cases": [{"pair_key": "a||b"}, {"deep": {"pair_key": 'quo"te||x'}}]}, {"note": 'says "pair_key": "no||no" in a text'}, {"pair_key": 7, "x": [[{"pair_key": "é||ü"}]]}, {"pair_key": {"pair_key": "in||side"}},
    ]
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("{broken",), (None,)], "body string")
    assert sorted(r["pair_key"] for r in ld.pair_keys(rows).collect()) == sorted(["a||b", 'quo"te||x', "é||ü", "in||side"])
    assert ld.pair_keys(rows.where("body IS NULL")).count() == 0


def test_pair_keys_are_found_at_any_depth_without_python(spark):
    deep = {"pair_key": "bottom"}
    for k in range(30):
        deep = [deep] if k % 2 else {"x": deep, "pair_key": f"level {k}"}
    out = ld.pair_keys(spark.createDataFrame([(json.dumps(deep),)], "body string"))
    assert {r["pair_key"] for r in out.collect()} == {"bottom", *(f"level {k}" for k in range(0, 30, 2))}
    assert "Python" not in out._jdf.queryExecution().toString()


def test_packets_hold_no_subjective_fields(spark):
    ok = spark.createDataFrame([(1, (0.5,))], "a long, physical struct<delta_L: double>")
    assert ld.physical_only(ok) is ok
    with pytest.raises(ValueError, match="tone_relation"):
        ld.physical_only(ok.withColumn("seen", F.array(F.struct(F.lit("x").alias("tone_relation")))))


def test_rounded_json(spark, tmp_path):
    ld.write_rounded(spark.createDataFrame([(1, 0.12345678901), (2, None)], "id long, v double"), str(tmp_path / "out"))
    rows = sorted((r["id"], r["v"]) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert rows == [(1, 0.12345679), (2, None)]


def test_log_sink_keeps_fields_and_file_sizes(spark, tmp_path):
    spark.range(1000).select(F.col("id"), F.lit("x" * 300).alias("note"), F.array("id").alias("secret")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    jobs.log_sink(ld.allowlisted(stream, ["id", "note", "secret"], 240), str(tmp_path / "log"), str(tmp_path / "cp"), 300).awaitTermination(120)
    rows = spark.read.json(str(tmp_path / "log"))
    assert rows.count() == 1000 and set(rows.columns) == {"id", "note"} and rows.agg(F.max(F.length("note"))).first()[0] == 240
    assert len([f for f in os.listdir(tmp_path / "log") if f.endswith(".json")]) == 4


def test_a_watched_folder_gives_each_file_once(spark, tmp_path):
    seen = []
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.event_stream(spark, str(tmp_path / "in"), T.StructType([T.StructField("id", T.LongType())]))
        q = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r["id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(seen) == list(range(30))


def test_requests_are_told_apart_by_what_they_ask(spark):
    d = spark.createDataFrame([("a b&c", None), ("ü" * 120, "red")], "q string, c string")
    rows = d.select(ld.pexels_url(F.col("q"), F.lit(0), F.lit(500), {"color": F.col("c")}).alias("x"), ld.pixabay_url(F.col("q"), F.lit(2), F.lit(1), F.lit("cartoon"), F.lit("LATEST")).alias("y")).collect()
    assert rows[0]["x"] == "https://api.pexels.com/v1/search?query=a%20b%26c&page=1&per_page=80"
    assert rows[1]["x"].endswith("&color=red") and rows[1]["y"].count("%C3%BC") == 100
    assert rows[0]["y"] == "https://pixabay.com/api/?q=a%20b%26c&image_type=all&order=latest&page=2&per_page=3"


def test_the_package_can_be_shipped(tmp_path):
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import huestrata
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
huestrata.ship(s)
def use(batches):
    from huestrata.operators.ranking import ordered_merge
    for b in batches:
        yield b
print("ROWS", s.range(3).mapInArrow(use, "id long").count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 3" in done.stdout, done.stderr[-2000:]
