"""Recursive state in event time: rows wait until the watermark has passed them, late rows go to a side table, state is saved and
read back.

A fold over a stream sees rows of a key in the order of their times, whatever the order in which they arrive: each key keeps
rows that the watermark has not passed in a list state, and a timer at the earliest of them folds, in order, all that it has
passed. So the results are those of the batch fold over all rows that came in time; rows that come after the watermark has passed
them are left out, as in Spark's own windows, and late_split() tells which. Keys share the state of a group, which holds the rows of the
delay of its keys, no more.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegerType, IntegralType, StringType, StructField, StructType

from .state import Fold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A column of each row's time in microseconds, beside the values of a fold. (Names with underscores in front are lost on the way to pandas.)
MICROS = "us"
#: The keys of a row as one text.
KEY = "fold_key"
#: Keys are dealt by hash to so many groups, each with one state, as a state's calls cost more than its rows. A stream keeps its number.
GROUP, GROUPS = "fold_group", 256


def _plain(value, kind: DataType):
    """A value as the state store takes it; what pandas has for null becomes None."""
    if isinstance(value, (list, tuple, np.ndarray)):
        return [float(v) for v in value]
    if value is None or value is pd.NaT or value != value:
        return None
    if isinstance(kind, BooleanType):
        return bool(value)
    return int(value) if isinstance(kind, IntegralType) else value


def _listed(column: pd.Series, kind: DataType) -> list:
    """A column as the state store takes it."""
    if column.dtype.kind == ("f" if isinstance(kind, FractionalType) else "i" if isinstance(kind, IntegralType) else "b" if isinstance(kind, BooleanType) else "") and not column.hasnans:
        return column.tolist()
    return [_plain(v, kind) for v in column.tolist()]


class EventFolding(StatefulProcessor):
    """Folds in event time of the keys of a group. State: `state`, the folds' as JSON by key; `held`, rows that wait, an array a
    column; `timer`, the next timer in milliseconds. Calls and state are a group's, so that their number doesn't follow the keys."""

    def __init__(self, step: Fold, keep: list[str], order: list[str], rows: StructType):
        self.step, self.keep, self.order, self.rows = step, keep, [KEY, MICROS, *order], rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField(c, ArrayType(StringType())) for c in (KEY, "state")]))
        self.held = handle.getListState("held", StructType([StructField(f.name, ArrayType(f.dataType)) for f in self.rows.fields]))
        self.timer = handle.getValueState("timer", "ms long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        known = initialState[initialState["state"].notna()]
        if not known.empty:
            self._know(self._known() | dict(zip(known[KEY], known["state"], strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for frame in rows:
            if frame.empty:  # of a group that has none but saved states
                continue
            frame = frame[frame[MICROS].notna()]
            if frame.empty:
                continue
            self._hold(frame, self.held.appendValue)
            first = int(frame[MICROS].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(-(-earliest // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts = list(self.held.get()) if self.held.exists() else []
        frame = pd.DataFrame({name: list(chain.from_iterable(p[i] for p in parts)) for i, name in enumerate(self.rows.names)})
        self.timer.clear()
        ripe = frame[MICROS] <= passed
        rest = frame[~ripe]
        if rest.empty:
            self.held.clear()
        else:
            if ripe.any():
                self._hold(rest, lambda row: self.held.put([row]))
            self._wake(-(-int(rest[MICROS].min()) // 1000))
        now = frame[ripe].sort_values(self.order, kind="stable")
        if now.empty:
            return iter(())
        texts = now[KEY].to_numpy()
        starts = np.flatnonzero(np.append(True, texts[1:] != texts[:-1]))
        before, known = self.step.states(len(starts)), self._known()
        for i, text in enumerate(texts[starts]):
            if text in known:
                for name, value in self.step.load(known[text]).items():
                    before[name][i] = value
        out, after = self.step.run({c: now[c].to_numpy() for c in now.columns}, starts, before)
        for i, text in enumerate(texts[starts]):
            known[text] = self.step.dump({k: v[i] for k, v in after.items()})
        self._know(known)
        return iter([pd.DataFrame({KEY: texts, **{c: now[c].to_numpy() for c in self.keep}, **out})])

    def _known(self) -> dict[str, str]:
        return dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}

    def _know(self, states: dict[str, str]) -> None:
        self.state.update((list(states), list(states.values())))

    def _hold(self, frame: pd.DataFrame, put: Callable[[tuple], None]) -> None:
        put(tuple(_listed(frame[f.name], f.dataType) for f in self.rows.fields))

    def _wake(self, ms: int) -> None:
        """One timer a group, at the earliest row that waits."""
        if self.timer.exists():
            known = self.timer.get()[0]
            if known <= ms:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with its keys as one text: groups of a null key would be mixed up on the way to pandas."""
    return df.withColumn(KEY, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).drop(*keys)


def _grouped(df: DataFrame, groups: int) -> GroupedData:
    return df.withColumn(GROUP, F.pmod(F.xxhash64(KEY), F.lit(groups)).cast("int")).groupBy(GROUP)


def _unkeyed(df: DataFrame, schema: str, keys: list[str]) -> list:
    return [F.from_json(KEY, schema)[k].alias(k) for k in keys]


def fold_events(stream: DataFrame, keys: list[str], time: str, order: list[str], step: Fold, schema: str, keep: list[str], late: str = "50 minutes", start: DataFrame | None = None, groups: int = GROUPS) -> DataFrame:
    """A fold over a stream in event time; `order` settles rows of one time. schema: of kept columns and results; keys come first.

    start: (keys, state as JSON) of a batch fold or another stream, from which keys go on. groups: a stream that goes on from its
    checkpoint needs the number with which it began; more groups hold fewer rows each. Rows without a time are left out. Needs
    the RocksDB provider, which is set for the session.
    """
    if {MICROS, KEY, GROUP} & set(stream.columns) or any(c.startswith("_") for c in stream.columns):
        raise ValueError(f"columns of a fold can't be named {MICROS}, {KEY} or {GROUP}, nor begin with an underscore")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = _keyed(stream.withColumn(MICROS, F.unix_micros(time)).withWatermark(time, late), keys)
    rows = StructType([f for f in timed.schema.fields if f.name != time])
    initial = None if start is None else _grouped(_keyed(start.select(*keys, "state"), keys), groups)
    out = _grouped(timed, groups).transformWithStateInPandas(EventFolding(step, keep, order, rows), f"{KEY} string, {schema}", "Append", "EventTime", initial)
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    return out.select(*_unkeyed(out, kinds, keys), *(c for c in out.columns if c != KEY))


def _state(spark: SparkSession, log: str, name: str) -> DataFrame:
    """A row a key or held row of a stream's groups, of arrays of the same length."""
    df = spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "true").load(log)
    value = "value" if "value" in df.columns else "list_element"
    return df.select(F.explode(F.arrays_zip(*(F.col(f"{value}.{c}") for c in df.schema[value].dataType.names))).alias("row")).select("row.*")


def saved_state(spark: SparkSession, log: str, keys: list[str], kinds: str) -> DataFrame:
    """(keys, state) of a stream of fold_events(), by the state data source, from its checkpoint. kinds: schema of the keys."""
    df = _state(spark, log, "state")
    return df.select(*_unkeyed(df, kinds, keys), "state")


def held_rows(spark: SparkSession, log: str, keys: list[str], kinds: str) -> DataFrame:
    """Rows of a stream of fold_events() that still wait for the watermark."""
    df = _state(spark, log, "held")
    return df.select(*_unkeyed(df, kinds, keys), *(c for c in df.columns if c != KEY))


def _watermark(spark: SparkSession, log: str, number: int) -> int | None:
    """Microseconds of the watermark with which a micro-batch began, by the stream's own log; None before the first."""
    if number < 0:
        return None
    for r in spark.read.text(f"{log}/offsets/{number}").collect():  # a line for the batch, and one a source
        if r.value.startswith("{") and "batchWatermarkMs" in r.value:
            ms = json.loads(r.value)["batchWatermarkMs"]
            return ms * 1000 if ms > 0 else None
    return None


def late_split(stream: DataFrame, path: str, time: str = "ts", late: str = "50 minutes") -> tuple[DataFrame, DataFrame]:
    """Run a stream over what is there now; (rows in time, late rows), each row in one of both tables.

    Late are rows that windows and folds of the same stream and delay leave out: those not after the watermark with which the
    micro-batch before began. Each micro-batch writes its own part of both tables, so one that is run again replaces them. Rows
    without a time are in time.
    """
    spark, log = stream.sparkSession, f"{path}/log"

    def put(batch: DataFrame, number: int) -> None:
        passed = _watermark(batch.sparkSession, log, number - 1)
        told = batch.withColumn("late", F.coalesce(F.unix_micros(time) <= F.lit(passed), F.lit(False)) if passed is not None else F.lit(False))
        told.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("late").parquet(f"{path}/rows/batch={number}")

    stream.withWatermark(time, late).writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    schema = StructType(stream.schema.fields).add("batch", IntegerType()).add("late", BooleanType())
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*")
    return rows.where("NOT late").drop("late"), rows.where("late").drop("late")
