"""Keyed state with timers: events are folded per key in the order in which they happened.

Time is told by a clock of its own: every event moves it to its own time less ``late``, and ticks move it on where nothing
arrives. Events themselves have no watermark, so none is ever discarded: one that arrives in time waits until the clock has
passed it and is folded in event order, one that comes later still is folded when it arrives. State per key is the fold's
own (a few numbers) and the events that wait, never the log; a fold that returns no state frees its key.

Results of a micro-batch are written to its own folder, so a replayed batch overwrites itself.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
MICROS = 1_000_000

#: (state, event) → (state, rows). An event is its fields with ``at`` in microseconds; None is the state of a new key.
Step = Callable[[Any, dict], tuple[Any, list[tuple]]]


class Fold:
    """What a job does with the events of a key. States are JSON values."""

    schema: str
    tie: str | None = None

    def step(self, state: Any, event: dict) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def after(self, state: Any) -> list[tuple]:
        """Rows given out once for the events of one micro-batch."""
        return []

    def due(self, state: Any) -> int | None:
        """When (in microseconds) the key wants to be woken without an event."""
        return None

    def wake(self, state: Any, clock: int) -> tuple[Any, list[tuple]]:
        return state, []


class _Processor(StatefulProcessor):
    """Lets events wait for the clock, then hands them to the fold in order."""

    def __init__(self, fold: Fold, columns: list[str]):
        self.fold, self.columns = fold, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event string")
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows, timerValues):
        found = []
        for frame in rows:
            frame = frame[frame["at"].notna()]
            found += list(zip(frame["at"].astype("int64").tolist(), frame["event"].tolist(), strict=True))
        if found:
            self.waiting.appendList(found)
            self.handle.registerTimer(_wake_ms(min(at for at, _ in found)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        clock = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get())
        ready = [(at, json.loads(event)) for at, event in held if at <= clock]
        rest = [(at, event) for at, event in held if at > clock]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        state, out, due = _passed(self.fold, state, ready, clock)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        self._sleep(rest, [due] if due is not None else [])
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=self.columns)

    def _sleep(self, rest: list[tuple], dues: list[int]) -> None:
        """Ask to be woken for the first event that waits and for the first key that is due."""
        if rest:
            self.handle.registerTimer(_wake_ms(min(at for at, _ in rest)))
        if dues:
            self.handle.registerTimer(_wake_ms(min(dues) + 1))

    def close(self) -> None:
        pass


class _Together(_Processor):
    """The same for groups of neighbouring keys, whose states are one value: a call of the state store takes far longer than a step.

    Events name their key. A group holds a bounded number of keys, so what is read and written at once is bounded too.
    """

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        clock = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = defaultdict(list), []
        for at, event in self.waiting.get():
            if at <= clock:
                told = json.loads(event)
                ready[told["key"]].append((at, told))
            else:
                rest.append((at, event))
        before = dict(json.loads(self.state.get()[0])) if self.state.exists() else {}
        states, out, dues = {}, [], []
        for k in {**before, **ready}:
            state, rows, due = _passed(self.fold, before.get(k), ready.get(k, []), clock)
            out += [(k, *row) for row in rows]
            if state is not None:
                states[k] = state
            if due is not None:
                dues.append(due)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if not states:
            self.state.clear()
        elif states != before:
            self.state.update((json.dumps(list(states.items())),))
        self._sleep(rest, dues)
        if out:
            yield pd.DataFrame(out, columns=self.columns)


def _passed(fold: Fold, state: Any, ready: list[tuple[int, dict]], clock: int) -> tuple[Any, list[tuple], int | None]:
    """A key's state, rows and next due time after its events up to ``clock``."""
    out: list[tuple] = []
    ready.sort(key=lambda e: (e[0], e[1].get(fold.tie) or 0) if fold.tie else e[0])
    for at, event in ready:
        state, rows = fold.step(state, {**event, "at": at})
        out += rows
    if ready:
        out += fold.after(state)
    due = fold.due(state) if state is not None else None
    if due is not None and due < clock:
        state, rows = fold.wake(state, clock)
        out += rows
        due = fold.due(state) if state is not None else None
    return state, out, due


def _wake_ms(at: int) -> int:
    """The first millisecond at or after ``at``."""
    return -(-at // 1000)


def folded_in_order(
    stream: DataFrame, key: str, at: str, columns: Sequence[str], fold: Fold, base: str, late: Column | str, until: Column | None = None,
    together: int = 1,
) -> DataFrame:
    """Rows that ``fold`` gives out for each key's events, of all that has arrived and happened up to ``until`` (None: the newest).

    ``late`` (an interval) is how long events are waited for. Events without a key belong to nobody and are left out; events without a
    time come first. ``together``: so many neighbouring keys, which must be whole numbers, share one state; for many keys of few events.
    A job's folder is continued with the ``together`` it was begun with.
    """
    spark = stream.sparkSession
    late = F.expr(f"INTERVAL {late}") if isinstance(late, str) else late
    for name, value in CONF.items():
        spark.conf.set(name, value)
    kind = stream.schema[key].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    named = [F.col(key).alias("key"), *columns] if together > 1 else columns
    event = F.to_json(F.struct(*named), {"ignoreNullFields": "false"})
    micros = F.unix_micros(F.coalesce(F.col(at), F.lit(0).cast("timestamp")))
    events = stream.select(F.col(key).alias("key"), micros.alias("at"), event.alias("event"), none("timestamp").alias("clock"))
    events = events.where("key IS NOT NULL")
    tick = lambda clock: [none(kind).alias("key"), none("long").alias("at"), none("string").alias("event"), clock.alias("clock")]
    moved = stream.where(F.col(at).isNotNull()).select(*tick(F.col(at) - late))
    ticks, data = f"{base}/ticks", f"{base}/data"
    spark.createDataFrame([], "clock timestamp").write.mode("ignore").parquet(ticks)
    told = spark.readStream.schema("clock timestamp").parquet(ticks).select(*tick(F.col("clock")))
    names = ["key", *[c.split()[0] for c in fold.schema.split(", ")]]
    schema = f"key {kind}, {fold.schema}"
    # the condition names the clock, so that it stays above the operator that reads the clock of all rows
    timed = events.union(moved).union(told).withWatermark("clock", "0 seconds").where("clock IS NULL")
    grouped = timed.withColumn("keys", F.expr(f"key DIV {together}")).groupBy("keys") if together > 1 else timed.groupBy("key")
    out = grouped.transformWithStateInPandas((_Together if together > 1 else _Processor)(fold, names), schema, "Append", "EventTime")
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{data}/batch=-1")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{data}/batch={batch_id}")

    def drain() -> None:
        query = out.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p.eventTime.get("watermark")]
        passed.extend(p.eventTime["watermark"] for p in progress[-1:])

    passed: list[str] = []
    drain()
    # watermarks are in whole milliseconds, so the newest event lies up to one of them later
    end = until if until is not None else (F.lit(passed[-1]).cast("timestamp") + late + F.expr("INTERVAL 2 MILLISECONDS") if passed else None)
    if end is not None:
        _tick(spark, ticks, end)
        drain()
    return spark.read.schema(f"{schema}, batch long").parquet(data)


def _tick(spark: SparkSession, folder: str, clock: Column) -> None:
    """Move the clock of a job on; a service does so every minute."""
    name = f"{folder}-{uuid.uuid4().hex}"
    spark.range(1).select(clock.cast("timestamp").alias("clock")).write.parquet(name)
    rows = spark.read.schema("clock timestamp").parquet(name)
    rows.write.mode("append").parquet(folder)
