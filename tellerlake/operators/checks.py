"""Data checks: orphan keys, values outside a domain, repeated keys, decimals that do not fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def orphan_counts(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows per foreign key whose parent is missing.

    Child keys are counted before the join, so a hot key is one row.
    """
    out = []
    for child, column, parent, key in links:
        keys = tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
        lost = keys.join(tables[parent].select(F.col(key).alias("k")), "k", "left_anti")
        out.append(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
            F.lit(f"{child}.{column}").alias("constraint_name"), "orphans"))
    return _stack(out)


def enum_counts(tables: dict[str, DataFrame], domains: dict[tuple[str, str], list[str]]) -> DataFrame:
    """Non-null values outside the allowed list, per column; one pass per table."""
    out = []
    for table in sorted({t for t, _ in domains}):
        columns = [c for t, c in domains if t == table]
        counts = tables[table].agg(*[
            F.count(F.when(~F.col(c).isin(domains[table, c]), 1)).alias(c) for c in columns])
        rows = F.array(*[F.struct(F.lit(f"{table}.{c}").alias("column_name"), F.col(c).alias("outside")) for c in columns])
        out.append(counts.select(F.explode(rows).alias("r")).select("r.*"))
    return _stack(out)


def repeated_keys(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """How many keys occur more than once, and how many rows they have."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg(F.count("*").alias("repeated_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_affected")).select(
        F.lit(name).alias("key_name"), "repeated_keys", "rows_affected")


def decimal_overflow(df: DataFrame, values: dict[str, tuple[Column, int, int]]) -> DataFrame:
    """Values too large for DECIMAL(p,s), per named expression."""
    counts = df.agg(*[
        F.count(F.when(F.abs(v.cast("double")) >= F.lit(10.0 ** (p - s)), 1)).alias(n) for n, (v, p, s) in values.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("value_name"), F.col(n).alias("overflows")) for n in values])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
