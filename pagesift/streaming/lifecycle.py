"""The job life cycle (``operators.lifecycle``) as a keyed streaming state.

An event waits in its job's state until the watermark has passed it, so events
are taken in order whatever the order of the files; a timer wakes a job for its
next waiting event or the end of its lease. Rows come out once, also after a
restart; those at or behind the watermark when the input ends are still waiting.
Needs the RocksDB state store, which keeps states on disk (``state_store``).
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import COLUMNS, LEASE_SECONDS, events_only, fold, order_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobState(StatefulProcessor):
    def __init__(self, lease_seconds: int):
        self.lease_us = lease_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, since long, us long, seq long, last string")
        self.waiting = handle.getListState("waiting", "us long, seq long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(us), None if pd.isna(seq) else int(seq), status) for pdf in rows for us, seq, status in zip(pdf["us"], pdf["seq"], pdf["status"])]
        yield from self.advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs())

    def advance(self, key, new: list, watermark: int) -> Iterator[pd.DataFrame]:
        waiting = set(new) | {(x[0], x[1], x[2]) for x in self.waiting.get()}
        ready = sorted((x for x in waiting if x[0] < watermark * 1000), key=order_of)
        got = self.state.get()
        state = (got[0], got[1], (got[2], got[3], got[4])) if got is not None else (None, 0, None)
        rows = []
        for row, state in fold(state, ready, watermark * 1000, self.lease_us):
            rows.append(row)
        waiting -= set(ready)
        if waiting:
            self.waiting.put(sorted(waiting, key=order_of))
        else:
            self.waiting.clear()
        if state[2] is not None:
            self.state.update((state[0], state[1], *state[2]))
        due = [min(x[0] for x in waiting)] if waiting else []
        if state[0] == "running":
            due.append(state[1] + self.lease_us)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due:
            self.handle.registerTimer(max(min(due) // 1000, watermark))
        if rows:
            out = pd.DataFrame(rows, columns=["us", "seq", "from_status", "to_status", "verdict"])
            out["seq"] = out["seq"].astype("Int64")
            out.insert(0, "id", key[0])
            yield out

    def close(self) -> None:
        pass


def state_store(spark: SparkSession) -> None:
    """Choose the state store that the life cycle needs, for streams started after."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def lifecycle_stream(events: DataFrame, *, delay: str = "0 seconds", lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """The rows of ``operators.lifecycle.lifecycle`` of a stream of job events
    (id, ts, seq, status); events later than ``delay`` are dropped as late."""
    rows = events_only(events).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    kind = events.schema["id"].dataType.simpleString()
    out = rows.groupBy("id").transformWithStateInPandas(
        JobState(lease_seconds), f"id {kind}, us long, seq long, from_status string, to_status string, verdict string",
        outputMode="append", timeMode="eventTime")
    return out.withColumn("ts", F.timestamp_micros("us")).select(*COLUMNS)
