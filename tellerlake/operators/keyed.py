"""Keyed table changes: upsert, patch, delete, slowly changing dimensions, high-water marks.

All of them join on a key that is unique on the incoming side, so a join never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    Spark keeps one row per key and task before the shuffle (window group limit), so a hot key is cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Replace or insert rows by key; ``order`` picks the row to keep when the batch repeats a key."""
    if order:
        new = latest_per_key(new, keys, order)
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def patch(old: DataFrame, changes: DataFrame, keys: list[str], stamp: Column | None = None) -> DataFrame:
    """Overwrite the non-null fields of ``changes``; rows without a change stay as they are."""
    fields = [c for c in changes.columns if c not in keys]
    moved = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = old.join(moved, keys, "left")
    out = []
    for name in old.columns:
        if name in fields:
            out.append(F.coalesce(F.col(f"_new_{name}"), F.col(name)).alias(name))
        elif name == "updated_at" and stamp is not None:
            out.append(F.when(F.col("_hit"), stamp).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


def delete_keys(old: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(doomed.select(*keys), keys, "left_anti")


def surrogate_key(natural: Column, effective: Column) -> Column:
    """Collision-free key of a dimension version: natural key and day number side by side.

    Deterministic and local to the row: no sequence, no sort, no hash collisions at billions of rows.
    """
    return (natural.cast("bigint") * 100000 + F.datediff(effective, F.lit("1970-01-01").cast("date"))).cast("bigint")


def first_versions(rows: DataFrame, natural: str, key: str, effective: Column, expiry: str) -> DataFrame:
    """Open versions of a slowly changing dimension."""
    return rows.select(
        surrogate_key(F.col(natural), effective).alias(key), *rows.columns,
        effective.alias("effective_date"), F.lit(None).cast("date").alias(expiry), F.lit(True).alias("is_current"),
    )


def scd2_load(history: DataFrame, rows: DataFrame, natural: str, key: str, effective: Column, expiry: str,
              compare: list[str] | None = None) -> DataFrame:
    """Expire the current version of every loaded key and add the new one.

    Without ``compare`` every loaded row opens a version; with it, only rows whose compared columns differ
    from the current version do. A repeated load of the same day replaces that day's versions.
    """
    history = history.filter(F.col("effective_date") < effective)
    if compare:
        current = history.filter("is_current").select(
            natural, F.lit(True).alias("_known"),
            *[F.col(c).alias(f"_old_{c}") for c in compare])
        joined = rows.join(current, natural, "left")
        same = F.lit(True)
        for c in compare:
            same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
        rows = joined.filter(F.col("_known").isNull() | ~same).select(*rows.columns)
    touched = rows.select(natural, F.lit(True).alias("_touched"))
    closes = F.col("is_current") & F.coalesce(F.col("_touched"), F.lit(False))
    closed = history.join(touched, natural, "left").select(
        *[c for c in history.columns if c not in (expiry, "is_current")],
        F.when(closes, effective).otherwise(F.col(expiry)).alias(expiry),
        (F.col("is_current") & ~closes).alias("is_current"),
    )
    opened = first_versions(rows, natural, key, effective, expiry)
    return closed.unionByName(opened)


def validity(versions: DataFrame, natural: str) -> DataFrame:
    """Expiry and current flag from distinct (key, effective_date) versions.

    A key has at most one version per day, which bounds every window partition.
    """
    w = Window.partitionBy(natural).orderBy("effective_date")
    distinct = versions.select(natural, "effective_date").distinct()
    following = F.lead("effective_date").over(w)
    return distinct.withColumn("expiry_date", following).withColumn("is_current", F.col("expiry_date").isNull())


def rows_since(df: DataFrame, id_column: str, last_id: int) -> DataFrame:
    """Rows above the high-water mark; the filter reaches the scan."""
    return df.filter(F.col(id_column) > F.lit(last_id))


def high_water_marks(df: DataFrame, id_column: str, job: str, source: str) -> DataFrame:
    return df.agg(
        F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("last_processed_id"),
        F.count("*").alias("records_processed"),
    ).select(F.lit(job).alias("job_name"), F.lit(source).alias("source_table"), "last_processed_id",
             "records_processed")
