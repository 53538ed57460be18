"""Streaming job lifecycle: latest-wins scheduling, staleness, batches against snapshots, windows and log sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

JOB_OUT = "view string, job long, generation long, status string"
JOB_STATE = "job long, generation long, at double, snapshot long"


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def step(state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
    """One event of a view against its state (job, generation, at, snapshot): the new state and the rows (job, generation, status).

    START supersedes an active job, END completes it, ABORT ends it; ROUTE moves the view to
    another generation, so that what is still under way is STALE when it ends; a DELTA batch
    needs the snapshot of a FULL one.
    """
    kind, job, generation, at, snapshot = row
    out = []
    if state and generation < state[1]:
        over = kind in ("END", "ABORT") and state[0] == job
        return (-1, *state[1:]) if over else state, [(job, generation, "STALE")]
    if kind == "START":
        if state and state[0] >= 0:
            out.append((state[0], state[1], "SUPERSEDED"))
        return (job, generation, at, snapshot), [*out, (job, generation, "ACTIVE")]
    if kind == "ROUTE":
        return (state[0] if state else -1, generation, at, state[3] if state else -1), out
    if kind == "ABORT":
        if state and state[0] == job:
            return (-1, generation, at, state[3]), [(job, generation, "ABORTED")]
        return state, [(job, generation, "STALE")]
    if kind == "END":
        if state and state[0] == job:
            return (-1, generation, at, state[3]), [(job, generation, "COMPLETED")]
        return state, [(job, generation, "STALE")]
    if kind == "DELTA" and (not state or state[3] < 0 or state[3] != snapshot):
        return state, [(job, generation, "REJECTED")]
    if state and state[0] == job:
        return (job, generation, at, snapshot), [(job, generation, kind)]
    return state, [(job, generation, "STALE")]


def lifecycle(events: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Status rows of jobs, keyed by view: columns view, kind, job, generation, at, snapshot. A job that is idle too long times out."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            if now and now[0] >= 0:
                yield pd.DataFrame([(key[0], now[0], now[1], "ABORTED")], columns=["view", "job", "generation", "status"])
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "job"], kind="stable")
        out = []
        for r in rows[["kind", "job", "generation", "at", "snapshot"]].itertuples(index=False):
            now, more = step(now, (r[0], int(r[1]), int(r[2]), float(r[3]), int(r[4])))
            out += [(key[0], *m) for m in more]
        if now:
            state.update(now)
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["view", "job", "generation", "status"])

    return events.groupBy("view").applyInPandasWithState(run, JOB_OUT, JOB_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def lifecycle_batch(events: DataFrame) -> DataFrame:
    """The same status rows from a finished log: views are dealt over tasks, each of which steps through its sorted views one after another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, None
        for pdf in frames:
            views, out = [], []
            for view, *row in zip(*(pdf[c].tolist() for c in ("view", "kind", "job", "generation", "at", "snapshot")), strict=True):
                if view != last:
                    last, now = view, None
                now, more = step(now, tuple(row))
                views += [view] * len(more)
                out += more
            yield pd.DataFrame(out, columns=["job", "generation", "status"]).assign(view=views)[["view", "job", "generation", "status"]]

    kinds = events.select("view", "kind", F.col("job").cast("long"), F.col("generation").cast("long"), F.col("at").cast("double"), F.col("snapshot").cast("long"))
    return kinds.repartition("view").sortWithinPartitions("view", "at", "job").mapInPandas(run, JOB_OUT)


def package_states(results: DataFrame) -> DataFrame:
    """chain, package, state, reason: a package's own result if all before it in its chain passed, else that it waits and for which; rejected ones stay rejected."""
    before = Window.partitionBy("chain").orderBy("package").rowsBetween(Window.unboundedPreceding, -1)
    u = results.withColumns({"_up": F.coalesce(F.bool_and(F.col("own") == "PASS").over(before), F.lit(True)), "_block": F.min(F.when(F.col("own") != "PASS", F.col("package"))).over(before)})
    rejected = F.col("own") == "REJECTED"
    state = F.when(rejected, F.col("own")).when(~F.col("_up"), "WAITING_UPSTREAM_GATE").when(F.col("own") == "NEW", "READY").otherwise(F.col("own"))
    return u.select("chain", "package", state.alias("state"), F.when(~rejected & ~F.col("_up"), F.concat(F.lit("UPSTREAM_NOT_PASS:"), F.col("_block").cast("string"))).alias("reason"))


# --- a bounded queue ------------------------------------------------------------------------------

QUEUE_OUT = "event_id long, status string"
QUEUE_STATE = "busy array<double>, waiting array<double>"


def enqueue(state: tuple[list[float], list[float]], at: float, work: float, limit: int, workers: int, timeout: float) -> tuple[tuple[list[float], list[float]], str]:
    """One sampled task that arrives at a time: the new state and its status.

    State: when each running task ends, and the work of those that wait, both in order. A task
    is dropped if those that run or wait are `limit`. Tasks start in order of arrival; one that
    works longer than the timeout ends then.
    """
    busy, waiting = list(state[0]), list(state[1])
    while busy and busy[0] <= at:
        end = busy.pop(0)
        if waiting:
            busy = sorted([*busy, end + min(waiting.pop(0), timeout)])
    if len(busy) + len(waiting) >= limit:
        return (busy, waiting), "DROPPED_QUEUE_FULL"
    if len(busy) < workers:
        busy = sorted([*busy, at + min(work, timeout)])
    else:
        waiting.append(work)
    return (busy, waiting), "TIMEOUT" if work > timeout else "OK"


def _queue_rows(pdf: pd.DataFrame, state: tuple, limit: int, workers: int, timeout: float) -> tuple[tuple, list[tuple]]:
    out = []
    for r in pdf.sort_values(["at", "event_id"], kind="stable")[["event_id", "at", "work", "sampled"]].itertuples(index=False):
        status = "NOT_SAMPLED"
        if r[3]:
            state, status = enqueue(state, float(r[1]), float(r[2]), limit, workers, timeout)
        out.append((int(r[0]), status))
    return state, out


def sampled_queue(events: DataFrame, limit: int = 64, workers: int = 2, timeout: float = 1.2) -> DataFrame:
    """event_id, status of tasks in a finished log: columns middleware (each has a queue of its own), event_id, at, work, sampled."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_queue_rows(pdf, ([], []), limit, workers, timeout)[1], columns=["event_id", "status"])

    return events.groupBy("middleware").applyInPandas(run, QUEUE_OUT)


def sampled_queue_stream(events: DataFrame, limit: int = 64, workers: int = 2, timeout: float = 1.2) -> DataFrame:
    """The same from a stream; the state of a queue is at most `limit` numbers."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(list(x) for x in state.get) if state.exists else ([], [])
        now, out = _queue_rows(pd.concat(list(frames)), now, limit, workers, timeout)
        state.update(now)
        yield pd.DataFrame(out, columns=["event_id", "status"])

    return events.groupBy("middleware").applyInPandasWithState(run, QUEUE_OUT, QUEUE_STATE, "append", GroupStateTimeout.NoTimeout)


# --- staleness, batches and soak runs -------------------------------------------------------------

#: What identifies the view a job works for.
IDENTITY = ["generation", "view", "route", "request"]


def staleness(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """Status of jobs by whether their view's identity is still the same when they run and when they end.

    jobs: job, view_key, made_at, run_at, end_at; moves: view_key, at and IDENTITY, the
    identity from then on. An as-of join without a join: both are put in one order per view,
    and each job's three moments take the last move before them.
    """
    who = F.struct(*IDENTITY)
    moments = jobs.select("job", "view_key", F.explode(F.map_from_arrays(F.array(F.lit("made"), F.lit("run"), F.lit("end")), F.array("made_at", "run_at", "end_at"))).alias("moment", "at"))
    none = F.lit(None)
    rows = moments.select("view_key", "at", F.lit(1).alias("order"), "job", "moment", none.cast(moves.select(who.alias("w")).schema["w"].dataType).alias("who"))
    rows = rows.unionByName(moves.select("view_key", "at", F.lit(0).alias("order"), none.cast("long").alias("job"), none.cast("string").alias("moment"), who.alias("who")))
    last = F.last("who", ignorenulls=True).over(Window.partitionBy("view_key").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0))
    known = rows.withColumn("now", last).where("job IS NOT NULL").groupBy("job").agg(*(F.max(F.when(F.col("moment") == m, F.col("now"))).alias(m) for m in ("made", "run", "end")))
    status = F.when(~F.col("made").eqNullSafe(F.col("run")), "STALE_ROUTE_OR_GENERATION").when(~F.col("made").eqNullSafe(F.col("end")), "STALE_AFTER_WORK").otherwise("COMPLETED")
    return known.select("job", status.alias("status"))


def latest_wins(jobs: DataFrame) -> DataFrame:
    """job, status: a job is SUPERSEDED by the next one of its view if that starts before it ends. jobs: job, view_key, made_at, end_at."""
    following = F.lead("made_at").over(Window.partitionBy("view_key").orderBy("made_at", "job"))
    return jobs.select("job", F.when(following < F.col("end_at"), "SUPERSEDED").otherwise("COMPLETED").alias("status"))


def batch_faults(mode, start, end, seen, base):
    """Array of what is wrong with a batch: FULL begins at 0 without a base; DELTA after index 0 needs one."""
    from huestrata.operators.sets import reasons

    return reasons({
        "mode": mode.isin("FULL", "DELTA"), "start": start >= 0, "end": end >= start, "seen": seen >= end, "full_start": (mode != "FULL") | (start == 0), "full_base": (mode != "FULL") | base.isNull(),
        "delta_base": (mode != "DELTA") | (start <= 0) | (F.length(F.coalesce(base, F.lit(""))) > 0),
    })


# The phases of a soak run, first and last job, and how its jobs end.
PHASES = [("WARMUP", 1, 50, "COMPLETED"), ("NORMAL", 51, 250, "COMPLETED"), ("DELTA_STRESS", 251, 350, "COMPLETED"), ("ABORT_STORM", 351, 425, "ABORTED"), ("ROUTE_STORM", 426, 475, "STALE"), ("RECOVERY", 476, 500, "COMPLETED")]
# Growth in bytes, and a slope in bytes a job, beyond which rising memory is suspicious.
HEAP_GROWTH, HEAP_SLOPE = 20 * 1024 * 1024, 20 * 1024


def soak_plan(runs: DataFrame) -> DataFrame:
    """run, job (1 to 500), phase and nodes of every job of every run."""
    job = F.col("job")
    phase = None
    for name, first, last, _ in PHASES:
        phase = F.when(job.between(first, last), name) if phase is None else phase.when(job.between(first, last), name)
    first = F.col("job") - F.when(job <= 50, 1).when(job <= 250, 51).otherwise(251)
    nodes = F.when(job <= 250, F.element_at(F.array(F.lit(30), F.lit(60), F.lit(120)), (first % 3 + 1).cast("int"))).when(job <= 350, 30).otherwise(120)
    return runs.select("run", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("job")).select("run", "job", phase.alias("phase"), nodes.alias("nodes"))


def soak_events(plan: DataFrame) -> DataFrame:
    """The log of a soak plan for lifecycle(): a START for every job, then its END, ABORT, or a ROUTE before its END."""
    at = lambda kind, k, shift=0: F.struct(F.lit(kind).alias("kind"), (F.col("job") * 10.0 + k).alias("at"), (F.col("job") * 2 + shift).cast("long").alias("generation"))
    ends = F.when(F.col("phase") == "ABORT_STORM", F.array(at("START", 0), at("ABORT", 1))).when(F.col("phase") == "ROUTE_STORM", F.array(at("START", 0), at("ROUTE", 1, 1), at("END", 2))).otherwise(F.array(at("START", 0), at("END", 1)))
    return plan.select(F.col("run").cast("string").alias("view"), F.col("job").cast("long").alias("job"), F.explode(ends).alias("e")).select("view", "e.kind", "job", "e.generation", "e.at", F.lit(-1).cast("long").alias("snapshot"))


def windowed(events: DataFrame, stamp: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per time window and key, with a watermark for late rows; batch or stream."""
    w = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    out = events.withWatermark(stamp, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, stamp: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: rows closer than the gap belong together."""
    out = events.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def log_sink(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 20_000):
    """An append-only NDJSON log of a stream, in files of bounded size, that runs until the input is used up."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file).trigger(availableNow=True).start()


def admitted(scans: DataFrame) -> DataFrame:
    """Files (path, size, mtime per scan) that two scans in a row saw with the same size and time."""
    order = Window.partitionBy("path").orderBy("scan")
    same = (F.lag("size").over(order) == F.col("size")) & (F.lag("mtime").over(order) == F.col("mtime"))
    return scans.withColumn("_same", F.coalesce(same, F.lit(False))).groupBy("path").agg(F.min(F.when(F.col("_same"), F.col("scan"))).alias("admitted_at")).where("admitted_at IS NOT NULL")
