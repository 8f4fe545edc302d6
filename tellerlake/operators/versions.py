"""The version of a key that was valid at a date, for facts that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, in_ranges


def as_of(events: DataFrame, versions: DataFrame, key: str, event_time: str, version_time: str, values: list[str],
          from_ever: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``events`` with the ``values`` of the latest version of their key that begins at their time or before.

    Versions are unique by key and time. Events without a version, a key or a time get nulls; with ``from_ever`` the first
    version of a key holds for all time before it, too. Values that ``events`` has already are replaced.

    Versions and events are put in one order, by key and time, and cut into ranges of rows; each range looks for the
    last version before a row, and takes over the last one of the ranges before it. No inequality join, and a key
    with very many events spreads over several ranges.
    """
    begin = F.col(version_time)
    known = versions.filter(F.col(key).isNotNull() & begin.isNotNull())
    if from_ever:  # a key has one version a day at most, which bounds the window
        begin = F.when(begin > F.min(version_time).over(Window.partitionBy(key)), begin)
    held = F.struct(*[F.col(v).alias(v) for v in values])
    left = known.select(F.col(key).alias("_key"), begin.alias("_time"), F.lit(0).alias("_kind"), held.alias("_held"))
    event = F.struct(*[F.col(f"`{c}`") for c in events.columns if c not in values])
    right = events.select(F.col(key).alias("_key"), F.col(event_time).alias("_time"), F.lit(1).alias("_kind"), event.alias("_event"))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("_tie", F.xxhash64("_event"))

    order = ["_key", "_time", "_kind"]
    ranged = in_ranges(rows, [*order, "_tie"], "as-of", range_rows)
    version = F.when(F.col("_kind") == 0, F.struct("_key", "_held"))
    inside = F.last(version, ignorenulls=True).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = ranged.filter("_kind = 0").groupBy("_range").agg(F.max_by(F.struct("_key", "_held"), F.struct("_key", "_time")).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = ranged.select("_range").distinct().join(last, "_range", "left").select("_range", before.alias("_before"))  # a row for each range
    found = F.coalesce(F.col("_inside"), F.col("_before"))
    joined = (ranged.withColumn("_inside", inside).filter("_kind = 1").join(F.broadcast(carried), "_range")
              .withColumn("_found", F.when((found["_key"] == F.col("_key")) & F.col("_time").isNotNull(), found["_held"])))
    return joined.select("_event.*", *[F.col("_found")[v].alias(v) for v in values])
