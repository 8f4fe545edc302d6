"""Order-dependent results that never sort one whole group in one task.

A group (a member, a feature, the whole table) may hold a third of all rows. Positions are therefore
built bottom-up: rows are ordered only inside small key ranges, and ranges pass on counts and sums. Every
level works on the partial results of the level below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

RANGE_ROWS = 500_000  # rows of one key range
ACCURACY = 10_000  # of approximate quantiles: ranks are off by rows / ACCURACY at most


def _before(weight: Column, group: Sequence[str], order: Sequence[str]) -> Column:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(w), F.lit(0))


def in_ranges(df: DataFrame, order: Sequence[str], label: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_range``, the number of the range of ``order`` that a row lies in; ranges ascend with their numbers.

    The ranges are cut from the data, so sparse, dense and skewed keys give ranges of like size, and a group larger
    than a range spreads over several. The table is written once to the work folder: every later pass, and every
    retry of a task, sees the same ranges.
    """
    spark = df.sparkSession
    parts = max(blocks_needed(df.count(), rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    return kept(ranged, label)


def number_rows(df: DataFrame, id_column: str, name: str = "position", rows: int = RANGE_ROWS) -> DataFrame:
    """1-based position of every row by a unique integer id, over the whole table.

    Rows are sorted inside key ranges; only one count for each range goes through a single ordered pass.
    """
    ranged = in_ranges(df, [id_column], "numbered", rows)
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy(id_column)))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", _before(F.col("_n"), [], ["_range"]).alias("_start"))
    return local.join(F.broadcast(starts), "_range").withColumn(name, F.col("_local") + F.col("_start")).drop("_range", "_local", "_start")


def _fold(parts: DataFrame, group: list[str], order: str, extra: dict[str, Column]) -> DataFrame:
    """Merge ordered parts of (n rows, sum of values, sum of position * value) into one row per group."""
    shifted = parts.withColumn("_before", _before(F.col("n"), group, [order]))
    return shifted.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"),
        F.sum(F.col("sx") + F.col("_before") * F.col("s")).alias("sx"),
        *[agg.alias(name) for name, agg in extra.items()],
    )


def trend_sums(df: DataFrame, group: str, day: str, id_column: str, value: Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per group, over rows ordered by (day, id) with positions 0..n-1: n, sum, sum of squares,
    sum of position * value, first and last day. ``value`` is a whole number.

    Rows are folded inside key ranges first, then the ranges of a group's day, then its days.
    """
    slim = df.select(group, day, id_column, value.cast("decimal(20,0)").alias("_value"))
    value = F.col("_value")
    rows = in_ranges(slim, [group, day, id_column], "trend", range_rows).select(
        group, day, id_column, "_range",
        F.lit(1).cast("bigint").alias("n"), value.cast("decimal(20,0)").alias("s"),
        F.lit(0).cast("decimal(38,0)").alias("sx"),
        (value.cast("decimal(18,0)") * value.cast("decimal(18,0)")).cast("decimal(38,0)").alias("ss"),
        F.col(day).alias("first_day"), F.col(day).alias("last_day"),
    )

    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(38,0)")

    def fold(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
        out = _fold(parts, keys, order, {
            "ss": F.sum("ss"), "first_day": F.min("first_day"), "last_day": F.max("last_day")})
        return out.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("s").cast("decimal(20,0)").alias("s"),
                          wide("sx").alias("sx"), wide("ss").alias("ss"), "first_day", "last_day")

    by_range = fold(rows, [group, day, "_range"], id_column)
    by_day = fold(by_range, [group, day], "_range")
    return fold(by_day, [group], day)


def previous_day(df: DataFrame, group: str, day: str, id_column: str) -> DataFrame:
    """Each row with the day of the row before it in (day, id) order of its group.

    Only the first row of a day looks back to another day, so the lag runs over distinct days; a group has
    no more of them than the calendar.
    """
    days = df.groupBy(group, day).agg(F.min(id_column).alias("_first"))
    w = Window.partitionBy(group).orderBy(day)
    days = days.withColumn("_previous", F.lag(day).over(w))
    joined = df.join(days, [group, day])
    back = F.when(F.col(id_column) == F.col("_first"), F.col("_previous")).otherwise(F.col(day))
    return joined.withColumn("previous_day", back).drop("_first", "_previous")


class _Wanted:
    """The values at two neighbouring ranks of a column, searched for in the open interval (low, high)."""

    def __init__(self, column: str, rows: int, p: float):
        self.column, self.ranks = column, {math.floor(p * (rows - 1)), math.ceil(p * (rows - 1))}
        self.low, self.high, self.below, self.inside = None, None, 0, rows
        self.values: dict[int, float] = {}

    def left(self) -> list[int]:
        return sorted(self.ranks - set(self.values))

    def rows(self) -> Column:
        """The column where it lies in the interval, else null."""
        held = F.lit(True)
        if self.low is not None:
            held = held & (F.col(self.column) > self.low)
        if self.high is not None:
            held = held & (F.col(self.column) < self.high)
        return F.when(held, F.col(self.column))

    def guess(self) -> Column:
        """Two approximate quantiles of the interval, a little below and above the ranks."""
        left, margin = self.left(), 2 / ACCURACY
        at = [(left[0] - self.below) / self.inside - margin, (left[-1] + 1 - self.below) / self.inside + margin]
        return F.percentile_approx(self.rows(), [min(1.0, max(0.0, x)) for x in at], ACCURACY)

    def counts(self, low: float, high: float) -> Column:
        c = F.col(self.column)
        return F.array(*[F.count(F.when(test, 1)) for test in (c < low, c <= low, c < high, c <= high)])

    def narrow(self, low: float, high: float, counts: list[int]) -> None:
        """Settle the ranks that fall on the two guesses; the others lie below, between or above them."""
        under_low, with_low, under_high, with_high = counts
        for rank in self.left():
            if under_low <= rank < with_low:
                self.values[rank] = low
            elif under_high <= rank < with_high:
                self.values[rank] = high
        left = self.left()
        if not left:
            return
        end = self.below + self.inside
        if left[-1] < under_low:
            self.high, end = low, under_low
        elif left[0] >= with_high:
            self.low, self.below = high, with_high
        else:
            if left[0] >= with_low:
                self.low, self.below = low, with_low
            if left[-1] < under_high:
                self.high, end = high, under_high
        self.inside = end - self.below


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                    fetched: int = 1000) -> dict[str, dict[float, float]]:
    """Exact linearly interpolated quantiles of many columns: {column: {probability: quantile}}.

    Each round is two aggregates over all columns at once: approximate quantiles bracket the wanted ranks, and exact
    counts tell which ranks fall on a bracket's ends and how many rows are left inside. Brackets shrink by a factor
    of thousands each round; once at most ``fetched`` rows are inside, these are fetched. No value is shuffled, and
    copies of a value cost nothing, as they are counted at a bracket's end.
    """
    slim = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist()
    try:
        rows = slim.agg(*[F.count(c).alias(c) for c in columns]).first()
        wanted = {(c, p): _Wanted(c, rows[c], p) for c in columns for p in probabilities if rows[c]}
        while open_ := [w for w in wanted.values() if w.left() and w.inside > fetched]:
            guesses = slim.agg(*[w.guess().alias(str(i)) for i, w in enumerate(open_)]).first()
            counts = slim.agg(*[w.counts(*guesses[i]).alias(str(i)) for i, w in enumerate(open_)]).first()
            for i, w in enumerate(open_):
                w.narrow(*guesses[i], counts[i])
        if rest := [w for w in wanted.values() if w.left()]:
            found = slim.agg(*[F.sort_array(F.collect_list(w.rows())).alias(str(i)) for i, w in enumerate(rest)]).first()
            for i, w in enumerate(rest):
                for rank in w.left():
                    w.values[rank] = found[i][rank - w.below]
    finally:
        slim.unpersist()
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for (c, p), w in wanted.items():
        low, high = w.values[min(w.ranks)], w.values[max(w.ranks)]
        out[c][p] = low + (high - low) * (p * (rows[c] - 1) - min(w.ranks))
    return out


def page(df: DataFrame, key: list[str], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page in key order with the total, page number and page count on every row.

    The page itself is a top-k (skip + limit rows per task); the total is a separate count.
    """
    if skip < 0 or limit < 1:
        raise ValueError("skip >= 0 and limit >= 1")
    total = df.agg(F.count("*").alias("total")).scalar()
    rows = df.orderBy(*key).offset(skip).limit(limit)
    return rows.withColumn("total", total).withColumns({
        "page_number": F.lit(skip // limit + 1),
        "total_pages": F.ceil(F.col("total") / F.lit(limit)).cast("int"),
    })


def blocks_needed(rows: int, block: int) -> int:
    return max(1, math.ceil(rows / block))
