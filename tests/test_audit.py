"""The audit log: bounds, file sizes, what is kept, and a restart in the middle of a batch."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from huestrata.streaming import jobs
from huestrata.streaming.audit import AuditLog


def land(spark, folder, start, n):
    spark.range(start, start + n).select("id", F.lit("é" * 50).alias("note"), F.lit("hidden").alias("secret")).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return jobs.event_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


def lines(folder):
    out = {}
    for f in sorted(glob.glob(f"{folder}/log/batch=*/file=*/part-*")):
        with open(f, encoding="utf-8") as text:
            out[f] = [json.loads(x) for x in text]
    return out


def test_rows_are_bounded_counted_and_filed_by_bytes(spark, tmp_path):
    log = AuditLog(str(tmp_path / "log"), ["id", "note", "absent"], ["id"], most_rows=120, file_bytes=5000, keep_files=100)
    for k, n in enumerate((50, 300)):
        land(spark, str(tmp_path / "in"), 1000 * k, n)
        log.start(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(120)
    held = lines(tmp_path / "log")
    rows = [r for f in held.values() for r in f]
    assert [r["id"] for r in rows] == [*range(50), *range(1000, 1120)] and set(rows[0]) == {"id", "note"}
    assert len(held) > 4 and all(os.path.getsize(f) <= 5000 for f in held)
    counts = sorted((r["came"], r["written"], r["dropped"]) for r in spark.read.json(str(tmp_path / "log/counts")).collect())
    assert counts == [(50, 50, 0), (300, 120, 180)]


def test_only_the_last_files_stay(spark, tmp_path):
    log = AuditLog(str(tmp_path / "log"), ["id", "note"], ["id"], file_bytes=3000, keep_files=3)
    for k in range(3):
        land(spark, str(tmp_path / "in"), 100 * k, 60)
        log.start(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(120)
    held = lines(tmp_path / "log")
    rows = [r["id"] for f in held.values() for r in f]
    assert len(held) == len(log.files(spark)) == 3 and rows == list(range(260 - len(rows), 260))


def test_a_restart_in_the_middle_of_a_batch_loses_and_doubles_nothing(spark, tmp_path):
    log = AuditLog(str(tmp_path / "log"), ["id"], ["id"], keep_files=100)
    land(spark, str(tmp_path / "in"), 0, 40)
    land(spark, str(tmp_path / "in"), 100, 40)

    def failing(batch, batch_id):
        log.write(batch, batch_id)  # written, but the batch is not committed
        if batch_id == 1:
            raise RuntimeError("the job dies here")

    with pytest.raises(Exception, match="dies here"):
        log.start(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "cp"), write=failing).awaitTermination(120)
    land(spark, str(tmp_path / "in"), 200, 40)
    log.start(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(120)
    ids = sorted(r["id"] for f in lines(tmp_path / "log").values() for r in f)
    assert ids == [*range(40), *range(100, 140), *range(200, 240)]
    assert spark.read.json(str(tmp_path / "log/counts")).agg(F.sum("came"), F.count("*")).first()[0] == 120
