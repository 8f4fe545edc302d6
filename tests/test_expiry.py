"""Keyed state that expires, against a plain version: any order, restarts, replays and rows at the boundary."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tellerlake.session import own_session, work_path
from tellerlake.streaming import expiry as X
from tellerlake.streaming.incremental import read_stream

START = dt.datetime(2020, 1, 1)
SCHEMA = "k string, at timestamp, extra int"


def plain(rows, days):
    newest = max(at for _, at, _ in rows if at)
    latest = {}
    for k, at, _ in rows:
        if at:
            latest[k] = max(at, latest.get(k, at))
    return {k: at for k, at in latest.items() if at >= newest - dt.timedelta(days=days)}


class Run:
    """A stream over files that are added one by one."""

    def __init__(self, spark, days):
        self.spark, self.days = own_session(spark), days
        self.source, self.target, self.checkpoint = (work_path(spark, n) for n in ("source", "target", "checkpoint"))

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)

    def go(self, target=None, checkpoint=None):
        changes = X.expiring(read_stream(self.spark, self.source, SCHEMA, files_per_batch=1), ["k"], F.col("at"), self.days)
        X.write_changes(changes, target or self.target, checkpoint or self.checkpoint).awaitTermination()

    def kept(self, target=None):
        rows = X.kept_rows(self.spark, target or self.target, ["k"]).collect()
        assert len({r.k for r in rows}) == len(rows)
        return {r.k: r["at"] for r in rows}


def test_restarts_and_replays_in_any_order(spark):
    rnd, run = random.Random(3), Run(spark, 10)
    rows = [(rnd.choice(["a", "b", "c", "d", "e", None, "f" * 300]) if i % 9 else f"only{i}", START + dt.timedelta(hours=rnd.randrange(24 * 40)), i) for i in range(90)]
    rows += [("never", None, 1), ("a", None, 2)]
    rnd.shuffle(rows)
    for start in range(0, len(rows), 31):  # a restart for each file
        run.add(rows[start : start + 31])
        run.go()
        assert run.kept() == plain(rows[: start + 31], 10)
    batches = {f for f in os.listdir(run.target) if f.startswith("batch=")}
    run.go()  # nothing new
    assert {f for f in os.listdir(run.target) if f.startswith("batch=")} == batches and run.kept() == plain(rows, 10)
    run.go(checkpoint=work_path(spark, "checkpoint"))  # every batch again, over itself
    assert run.kept() == plain(rows, 10)


def test_the_boundary(spark):
    run, ms = Run(spark, 2), dt.timedelta(milliseconds=1)
    end = START + dt.timedelta(days=5)
    edge = end - dt.timedelta(days=2)
    run.add([("stays", edge, 1), ("goes", edge - ms, 1), ("renewed", START, 1), ("gone and back", START, 1)])
    run.go()
    run.add([("newest", end, 1)])
    run.go()
    assert set(run.kept()) == {"stays", "newest"}
    run.add([("stays late", edge, 1), ("too late", edge - ms, 1), ("renewed", edge + ms, 1), ("gone and back", end, 1), ("gone and back", START, 1)])
    run.go()
    assert run.kept() == {"stays": edge, "stays late": edge, "newest": end, "renewed": edge + ms, "gone and back": end}
    live = X.kept_rows(run.spark, run.target, ["k"]).filter("k = 'renewed'").first()
    assert live.n == 1  # the count begins anew


def test_state_is_dropped_with_its_timer(spark):
    """State holds the live keys only, however many have been seen."""
    run = Run(spark, 3)
    for day in range(0, 40, 8):
        run.add([(f"k{day}-{i}", START + dt.timedelta(days=day), i) for i in range(20)])
    run.go()
    assert len(run.kept()) == 20
    gone = run.spark.read.parquet(run.target).filter("gone").count()
    assert gone == 80


def test_many_keys_of_every_kind(spark):
    """Keys keep their types and nulls, and those of a bucket are handled together."""
    run, base = Run(spark, 5), "a long, d date, t timestamp, b binary, f boolean, m int, x double, s string"
    end = dt.datetime(2020, 3, 1, 1, 2, 3, 456789)
    rows = [(None if i % 7 == 0 else 2**60 + i % 50, dt.date(2020, 1, 1 + i % 3), None if i % 5 == 0 else end - dt.timedelta(microseconds=i % 4), bytes([255, i % 3]),
             i % 2 == 0, None if i % 11 == 0 else i % 6, 0.1 * (i % 5), "" if i % 4 else None, end - dt.timedelta(days=i % 9)) for i in range(3000)]
    names = [c.split()[0] for c in base.split(", ")]
    source = run.spark.createDataFrame(rows, base + ", at timestamp").withColumn("m", F.col("m").cast("decimal(20,3)"))
    source.repartition(3).write.parquet(run.source)
    stream = read_stream(run.spark, run.source, source.schema, files_per_batch=1)
    X.write_changes(X.expiring(stream, names, F.col("at"), run.days, 8), run.target, run.checkpoint).awaitTermination()
    got = X.kept_rows(run.spark, run.target, names).select(*names, "at")
    want = source.groupBy(*names).agg(F.max("at").alias("at")).filter(F.col("at") >= F.lit(end - dt.timedelta(days=5)))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 500
