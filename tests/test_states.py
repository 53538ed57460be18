"""Job and package states as streams: equal to the finished log, over a restart, with state that can be read back."""

import time

import pytest
from pyspark.sql import functions as F

from huestrata.plans import jobs as plans
from huestrata.streaming import jobs, states

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k) for k in states.STORE}
    for k, v in states.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def land(df, folder, parts, order):
    """df in `parts` files that come one after another, in the order of a column."""
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(f"{folder}")
        yield k


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_job_states_equal_the_finished_log_after_a_restart(spark, tmp_path, store):
    log = plans.job_log(spark, SF).where("length(view) < 2")
    mid = log.agg(F.percentile_approx("at", 0.5)).first()[0]
    parts = [f"at <= {mid}", f"at > {mid}"]
    for k in land(log, str(tmp_path / "in"), parts, "at"):
        stream = jobs.event_stream(spark, str(tmp_path / "in"), log.schema, files_per_trigger=1)
        want = sorted(map(tuple, jobs.lifecycle_batch(log.where(" OR ".join(parts[: k + 1]))).collect()))
        # timers keep such a query running, so it is stopped when its rows are there, and started again from its checkpoint
        q = states.job_views(stream, idle_ms=3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            began, got = time.time(), []
            while time.time() - began < 120 and len(got) < len(want):
                time.sleep(1)
                got = sorted(map(tuple, spark.read.schema(jobs.JOB_OUT).parquet(str(tmp_path / "out")).collect())) if (tmp_path / "out/_spark_metadata").exists() else []
        finally:
            q.stop()
        assert got == want and len(got) > 10
    kept = {r["key"]["view"] for r in states.held(spark, str(tmp_path / "cp"), "job").collect()}
    assert kept and kept <= {r["view"] for r in log.select("view").distinct().collect()}


def test_an_idle_job_is_aborted_by_its_timer(spark, tmp_path, store):
    spark.createDataFrame([("v", "START", 5, 1, 1.0, 0)], "view string, kind string, job long, generation long, at double, snapshot long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = states.job_views(stream, idle_ms=500).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        began = time.time()
        while time.time() - began < 90 and spark.table("idle").count() < 2:
            time.sleep(0.5)
        assert sorted(r["status"] for r in spark.table("idle").collect()) == ["ABORTED", "ACTIVE"]
    finally:
        q.stop()


def test_package_states_equal_the_finished_chains(spark, tmp_path, store):
    rows = [(c, p, own) for c in range(4) for p, own in enumerate((["PASS", "PASS", "NEW", "PASS"], ["FAIL", "PASS", "REJECTED", "NEW"], ["NEW"], ["PASS", "REJECTED", "PASS", "HOLD"])[c])]
    df = spark.createDataFrame(rows, "chain long, package long, own string")
    for _ in land(df, str(tmp_path / "in"), ["package < 2", "package >= 2", "package = 1"], "package"):  # the last comes again
        run(states.chain_states(jobs.event_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, jobs.package_states(df).collect()))
    held = {r["key"]["chain"]: (r["value"]["last"], r["value"]["block"]) for r in states.held(spark, str(tmp_path / "cp"), "chain").collect()}
    assert held == {0: (3, 2), 1: (3, 0), 2: (0, 0), 3: (3, 1)}
