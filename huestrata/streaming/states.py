"""Job and package states as streams with state that can be read back.

A processor holds a value per key and a timer; what it holds lies in the state store of the
query's checkpoint, survives a restart, and is a table for the state data source. The rules
are those of the finished logs (lifecycle_batch, package_states), event by event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from huestrata.streaming.jobs import JOB_OUT, JOB_STATE, step

#: What keeps many small states: the store that transformWithState needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_ORDER = ["at", "job"]
_COLUMNS = ["kind", "job", "generation", "at", "snapshot"]


def _values(row: tuple) -> tuple:
    return row[0], int(row[1]), int(row[2]), float(row[3]), int(row[4])


class JobViews(StatefulProcessor):
    """The job of a view: events move it on, and one that is idle for idle_ms is aborted by a timer."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB_STATE)

    def _held(self) -> tuple | None:
        return tuple(self.job.get()) if self.job.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = self._held(), []
        for row in pd.concat(list(rows)).sort_values(_ORDER, kind="stable")[_COLUMNS].itertuples(index=False):
            now, more = step(now, _values(row))
            out += [(key[0], *m) for m in more]
        if now:
            self.job.update(now)
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if now[0] >= 0:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["view", "job", "generation", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = self._held(), []
        if now and now[0] >= 0:
            out.append((key[0], now[0], now[1], "ABORTED"))
            self.job.update((-1, *now[1:]))
        yield pd.DataFrame(out, columns=["view", "job", "generation", "status"])

    def close(self) -> None:
        pass


def job_views(events: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Status rows (view, job, generation, status) of a stream of job events: view, kind, job, generation, at, snapshot.

    Events of a view must come in the order of their time, batch by batch. Needs the settings of STORE.
    """
    return events.groupBy("view").transformWithStateInPandas(JobViews(idle_ms), JOB_OUT, "append", "processingTime")


PACKAGE_OUT = "chain long, package long, state string, reason string"


class Chains(StatefulProcessor):
    """Of a chain of packages the last one seen and the first that did not pass; a package that comes again is passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", "last long, block long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, block = tuple(self.chain.get()) if self.chain.exists() else (None, None)
        out = []
        for package, own in pd.concat(list(rows)).sort_values("package", kind="stable")[["package", "own"]].itertuples(index=False):
            package = int(package)
            if last is not None and package <= last:
                continue
            waits = own != "REJECTED" and block is not None
            state = "WAITING_UPSTREAM_GATE" if waits else "READY" if own == "NEW" else own
            out.append((key[0], package, state, f"UPSTREAM_NOT_PASS:{block}" if waits else None))
            last, block = package, package if block is None and own != "PASS" else block
        self.chain.update((last, block))
        yield pd.DataFrame(out, columns=["chain", "package", "state", "reason"])

    def close(self) -> None:
        pass


def chain_states(results: DataFrame) -> DataFrame:
    """package_states() of a stream: chain, package, own. Packages of a chain must come in their order, batch by batch. Needs the settings of STORE."""
    return results.groupBy("chain").transformWithStateInPandas(Chains(), PACKAGE_OUT, "append", "none")


def held(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a stopped or running query holds under a state's name: key, value, partition_id."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select(F.col("key"), F.col("value"), "partition_id")
