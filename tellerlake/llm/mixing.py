"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weight of a source as a function of training time 0..1: knots (time, weight), straight lines between them.
#: The sources take them in turn, in code point order. Their areas are 5, 2 and 1.
SCHEDULES = [[(0.0, 7.0), (0.5, 5.0), (1.0, 3.0)], [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)], [(0.0, 1.0), (1.0, 1.0)]]
MAX_REPEATS = 3
#: Rows that one task makes of a unit of repeated rows.
ROWS_AT_ONCE = 1 << 16


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def area(knots: list[tuple[float, float]]) -> float:
    """Integral of a schedule over training time."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def training_time(knots: list[tuple[float, float]], share: Column) -> Column:
    """The time by which ``share`` (0..1) of a schedule's area is spent: the inverse of its integral."""
    total, spent, out = area(knots), 0.0, F.lit(1.0)
    cases = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        slope = (w1 - w0) / (t1 - t0)
        need = share * total - F.lit(spent)  # demand left for this stretch: w0 x + slope x^2 / 2
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * need))
        x = 2 * need / (F.lit(w0) + root)
        spent += (t1 - t0) * (w0 + w1) / 2
        cases.append((share * total <= F.lit(spent), F.least(F.lit(t1), F.lit(t0) + x)))
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def targets(sizes: DataFrame, schedules=SCHEDULES, repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size): schedule index and target of each source.

    All sizes together are shared by weight; a source stops at ``repeats`` times its own size and what it leaves is
    shared again by weight. The result of that repetition is ``least(weight * level, cap)``. The level follows from
    running sums over the sources in order of cap / weight: the first k stop at their caps, the others share the
    rest. One row per source; null counts as a source, the last.
    """
    weights = [area(k) for k in schedules]
    rank = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("schedule", ((F.row_number().over(rank) - 1) % len(schedules)).cast("int"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("schedule") + 1))
        .withColumn("cap", F.col("source_size") * repeats))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("spent", F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everything))
        # the level if all sources before this one stop at their caps and this one does not
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("spent")))
        .withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))))
    level = level.withColumn("level", F.max("level").over(everything))
    return level.select("source", "source_size", "schedule",
                        F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def placements(units: DataFrame, schedules=SCHEDULES, repeats: int = MAX_REPEATS) -> DataFrame:
    """Training positions of documents. ``units``: source, doc_id, text_hash, key, size, multiplicity; other columns stay.

    Inside its source a document's place is its rank by ``key``, the md5 of its id and text. Its offset in the source's
    words is found from totals of sqrt(rows) hash ranges and a running sum inside a range, so that neither step holds
    more than about sqrt(rows) units of a source. A source of ``z`` words and target ``g`` is read ``g div z`` times,
    and the rows whose middle lies in the first ``g mod z`` words once more. Reading at offset ``x`` happens at the
    time when the source's schedule has spent the share ``x / g`` of its area.

    Adds source_size, target, whole (readings of all its rows), extra (rows that are read once more) and times (of
    the readings of a row, ascending; rows of a unit share them).
    """
    ranges = math.ceil(math.sqrt(max(1, units.count())))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("multiplicity")).alias("source_size"))
    plan = targets(sizes, schedules, repeats)
    keyed = units.withColumn("_m_range", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / 4294967296).cast("long"))
    totals = keyed.groupBy("source", "_m_range").agg(F.sum(F.col("size") * F.col("multiplicity")).alias("_m_sum"))
    offsets = totals.select(
        F.col("source").alias("_m_source"), F.col("_m_range").alias("_m_r"),
        F.coalesce(F.sum("_m_sum").over(W.partitionBy("source").orderBy("_m_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_m_before"))
    offsets = offsets.join(plan, F.col("_m_source").eqNullSafe(F.col("source"))).drop("source")
    inside = W.partitionBy("source", "_m_range").orderBy("key", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    own = F.col("size") * F.col("multiplicity")
    # rows of a unit whose middle lies before the rest's end
    before_end = F.ceil((F.col("_m_rest") - F.col("_m_start")) / F.greatest(F.col("size"), F.lit(1)) - 0.5)
    placed = (
        keyed.withColumn("_m_run", F.sum(own).over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("_m_source")) & (F.col("_m_range") == F.col("_m_r")), "left")
        .withColumn("_m_start", F.col("_m_before") + F.col("_m_run") - own)
        .withColumn("whole", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long"))
        .withColumn("_m_rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("extra", F.when(F.col("size") > 0, F.least(F.col("multiplicity"), F.greatest(F.lit(0), before_end)))
                    .otherwise(F.when(F.col("_m_start") < F.col("_m_rest"), F.col("multiplicity")).otherwise(0)).cast("long")))
    share = lambda i: (i * F.col("source_size") + F.col("_m_start") + own / 2) / F.greatest(F.col("target"), F.lit(1.0))
    times = []
    for i in range(repeats):
        when = F.lit(None).cast("double")
        for j, knots in enumerate(schedules):
            when = F.when(F.col("schedule") == j, training_time(knots, F.least(F.lit(1.0), share(i)))).otherwise(when)
        times.append(when)
    return placed.select(*units.columns, "source_size", "target", "whole", "extra", F.array(*times).alias("times"))


def units_of(docs: DataFrame) -> DataFrame:
    """One row for each distinct (source, doc_id, text), stored without texts; repeated rows are counted."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = docs.select("source", "doc_id", F.xxhash64("text").alias("text_hash"), key.alias("key"), n_words("text").alias("size"))
    return stored(rows.groupBy("source", "doc_id", "text_hash", "key", "size").agg(F.count(F.lit(1)).alias("multiplicity")), "mix-units")


def mixture(docs: DataFrame, schedules=SCHEDULES, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, positions, in training order.

    A null text has no words; documents without words are taken 0 words. Rows equal in source, id and text share
    their times; where the mix ends between them, some are read once more than the others. The rows are range-sorted
    by first position, then id, source and text; those that the mix leaves out come last.
    """
    placed = stored(placements(units_of(docs), schedules, repeats), "mix-placed")
    parts = F.sequence(F.lit(0).cast("long"), F.col("multiplicity") - 1, F.lit(ROWS_AT_ONCE).cast("long"))
    # a unit may stand for very many rows: they are made in parts, by different tasks
    parted = placed.filter(F.col("multiplicity") > ROWS_AT_ONCE).withColumn("_m_from", F.explode(parts)).repartition("key", "_m_from")
    rows = placed.filter(F.col("multiplicity") <= ROWS_AT_ONCE).withColumn("_m_from", F.lit(0).cast("long")).unionByName(parted)
    rows = rows.withColumn("_m_row", F.explode(F.sequence("_m_from", F.least(F.col("multiplicity"), F.col("_m_from") + ROWS_AT_ONCE) - 1)))
    rows = rows.withColumn("copies", (F.col("whole") + (F.col("_m_row") < F.col("extra")).cast("long")).cast("int"))
    rows = rows.withColumn("positions", F.slice("times", F.lit(1), F.col("copies")))
    order = [F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id", "source", "text_hash", F.desc("copies")]
    return stored(rows, "mixture").orderBy(*order).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "positions")


def training_documents(docs: DataFrame, schedules=SCHEDULES, repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents as they are read in training: a row for each copy, all columns of ``docs``, sorted by time, id, source and text.

    Where the mix ends between rows equal in source, id and text, which happens once a source at most, these rows are
    numbered and the first of them read once more.
    """
    units = stored(placements(units_of(docs), schedules, repeats), "mix-places").select(
        F.col("source").alias("_m_source"), F.col("doc_id").alias("_m_id"), F.col("text_hash").alias("_m_hash"), "multiplicity", "whole", "extra", F.col("times").alias("_m_times"))
    keyed = docs.withColumn("_m_text", F.xxhash64("text"))
    same = (F.col("doc_id").eqNullSafe(F.col("_m_id")) & (F.col("_m_text") == F.col("_m_hash")) & F.col("source").eqNullSafe(F.col("_m_source")))
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("multiplicity"))
    copies = (F.col("whole") + (F.col("extra") > 0).cast("long")).cast("int")
    plain = units.filter(~cut).withColumn("_m_times", F.slice("_m_times", F.lit(1), copies)).filter(F.size("_m_times") > 0)
    joined = keyed.join(plain.select("_m_source", "_m_id", "_m_hash", "_m_times"), same)
    divided = units.filter(cut)
    if not divided.isEmpty():
        place = F.row_number().over(W.partitionBy("_m_source", "_m_id", "_m_hash").orderBy("_m_hash"))
        numbered = keyed.join(divided, same).withColumn("_m_place", place)
        times = F.slice("_m_times", F.lit(1), (F.col("whole") + (F.col("_m_place") <= F.col("extra")).cast("long")).cast("int"))
        joined = joined.unionByName(numbered.withColumn("_m_times", times).select(*joined.columns))
    timed = joined.withColumn("_m_time", F.explode("_m_times"))
    return timed.orderBy("_m_time", "_m_id", "_m_source", "_m_hash").select(*[F.col(f"`{c}`") for c in docs.columns])
