"""Keyed state that expires: rows of a stream are kept by key until they are older than the newest row by some days.

The clock is the newest time in the stream, not the machine's. State is one time and one count for each live key, in
the state store of the session (RocksDB, see ``session``). Keys are dealt to a fixed number of buckets by their hash: a
bucket is one entry of the store with one timer, for the oldest of its keys, so that a task handles the keys of a bucket
together and not one by one. A batch rewrites the buckets it has rows for, live keys only. Every micro-batch writes what it
changed under its own number, so a batch that is replayed overwrites itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

DAY_MS = 86_400_000
BUCKETS = 4096  # part of what a checkpoint holds: it has to stay as it is over a stream's life


class Expiring(StatefulProcessor):
    """State of a bucket: its live keys (texts), each with its newest time (microseconds) and the rows seen while it is kept."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "oldest long, live binary")
        self.schema = pa.schema([*((k, pa.string()) for k in self.keys), ("at_us", pa.int64()), ("n", pa.int64())])

    def live(self) -> pa.Table:
        if not self.kept.exists():
            return self.schema.empty_table()
        with pa.ipc.open_stream(self.kept.get()[1]) as stream:
            return stream.read_all()

    def keep(self, live: pa.Table, was: int | None) -> None:
        """Store what is live, with a timer for the oldest; ``was`` is the oldest that has a timer now."""
        oldest = min(live["at_us"].to_pylist(), default=None)
        if was is not None and was != oldest:
            self.handle.deleteTimer(timer(was))
        if oldest is None:
            self.kept.clear()
            return
        if was != oldest:
            self.handle.registerTimer(timer(oldest))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as stream:
            stream.write_table(live)
        self.kept.update((oldest, sink.getvalue().to_pybytes()))

    def summed(self, parts: list[pa.Table]) -> pa.Table:
        """One row for each key, null keys included."""
        found = pa.concat_tables(parts).group_by(self.keys, use_threads=False).aggregate([("at_us", "max"), ("n", "sum")])
        return found.select([*self.keys, "at_us_max", "n_sum"]).rename_columns(self.schema.names).cast(self.schema)

    def change(self, rows: pa.Table, gone: bool) -> pd.DataFrame:
        return rows.append_column("gone", pa.array([gone] * len(rows), pa.bool_())).to_pandas()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = self.kept.get()[0] if self.kept.exists() else None
        new = None
        for frame in rows:
            part = pa.table([*(pa.array(frame[k], pa.string(), from_pandas=True) for k in self.keys), pa.array(frame["at_us"], pa.int64()),
                             pa.array([1] * len(frame), pa.int64())], schema=self.schema)
            new = self.summed([part] if new is None else [new, part])
        now = self.summed([self.live(), new])
        self.keep(now, was)
        fresh = set(zip(*(new[k].to_pylist() for k in self.keys)))
        changed = [k in fresh for k in zip(*(now[k].to_pylist() for k in self.keys))]
        yield self.change(now.filter(pa.array(changed, pa.bool_())), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        live = self.live()
        gone = pa.array([timer(at) <= now for at in live["at_us"].to_pylist()], pa.bool_())
        out = live.filter(gone)
        self.keep(live.filter(pc.invert(gone)), None)
        yield self.change(out, True)

    def close(self) -> None:
        pass


def timer(at_us: int) -> int:
    """Millisecond at which a time expires: a timer fires as soon as the watermark reaches it."""
    return at_us // 1000


def _text(name: str, kind: str) -> Column:
    """A key as a text that ``_value`` reads back without loss."""
    if kind in ("timestamp", "binary"):
        return (F.unix_micros(name) if kind == "timestamp" else F.hex(name)).cast("string").alias(name)
    if kind.startswith(("array", "map", "struct", "variant", "interval")):
        raise ValueError(f"{name}: keys are plain values")
    return F.col(name).cast("string").alias(name)


def _value(name: str, kind: str) -> Column:
    text = F.col(name)
    if kind in ("timestamp", "binary"):
        return (F.timestamp_micros(text.cast("bigint")) if kind == "timestamp" else F.unhex(text)).alias(name)
    return text.cast(kind).alias(name)


def expiring(rows: DataFrame, keys: list[str], time: Column, days: int, buckets: int = BUCKETS) -> DataFrame:
    """Changes of what is kept: keys, at_us, n, gone.

    A key is kept at its newest time and goes when that is more than ``days`` days, to the millisecond, before the
    newest time of the stream. Rows that are that old when they come are never kept. Null times are left out; null
    keys are keys. Rows may come in any order: what is kept in the end depends on the rows only.
    """
    kinds = {k: rows.select(k).schema[0].dataType.simpleString() for k in keys}
    stamped = rows.select(*keys, time.cast("timestamp").alias("at")).filter("at is not null").withColumn("at_us", F.unix_micros("at"))
    # Rows at the watermark count as late and timers at the watermark fire: it stands one millisecond before what is kept.
    marked = stamped.withWatermark("at", f"{days * DAY_MS + 1} milliseconds")
    dealt = marked.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"), *[_text(k, kinds[k]) for k in keys], "at", "at_us")
    out = ", ".join(f"`{k}` string" for k in keys) + ", at_us long, n long, gone boolean"
    changes = dealt.groupBy("_bucket").transformWithStateInPandas(Expiring(keys), out, "Update", "EventTime")
    return changes.select(*[_value(k, kinds[k]) for k in keys], "at_us", "n", "gone")


def write_changes(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of every micro-batch to ``target/batch=<n>``; the checkpoint holds state, timers and position."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    return (
        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def kept_rows(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """keys, at, n of what is kept after the last batch. In a batch rows come before timers, so a key that is gone stays gone."""
    last = spark.read.parquet(target).groupBy(*keys).agg(F.max(F.struct("batch", "gone", "at_us", "n")).alias("last"))
    return last.filter("not last.gone").select(*keys, F.timestamp_micros("last.at_us").alias("at"), F.col("last.n").alias("n"))
