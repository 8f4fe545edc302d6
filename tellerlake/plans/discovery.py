"""The catalogue of a session: columns as the session lists them, keys and links found in the data.

Sketches propose, rows decide: a column may be a key if its distinct count is about its row count, a column may refer to a
key if its theta sketch minus that of the key is empty; only proposals are counted exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import orphan_counts, repeated_keys
from ..operators.profiles import DISTINCT_ERROR, Profiles

COLUMNS = "table_name STRING, position INT, column_name STRING, column_type STRING, nullable BOOLEAN, comment STRING"


def listed(spark: SparkSession, tables: list[str] | None = None) -> DataFrame:
    """A row for each column of the session's tables and views; as many as the catalogue has."""
    names = [t.name for t in spark.catalog.listTables() if tables is None or t.name in tables]
    rows = [(name, i, c.name, c.dataType, c.nullable, c.description) for name in names for i, c in enumerate(spark.catalog.listColumns(name), 1)]
    return spark.createDataFrame(rows, COLUMNS)


def described(df: DataFrame, comments: dict[str, str], required: set[str] = frozenset()) -> DataFrame:
    """``df`` with comments on its columns, and columns (numbers or texts) that are declared to have no nulls: one fails the job."""
    out = []
    for f in df.schema.fields:
        value = F.col(f.name)
        if f.name in required:
            never = F.lit("") if f.dataType.typeName() == "string" else F.lit(0).cast(f.dataType)
            value = F.coalesce(value, F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType), never)
        out.append(value.alias(f.name, metadata={"comment": comments[f.name]}) if f.name in comments else value.alias(f.name))
    return df.select(*out)


def profiled(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> Profiles:
    profiles = Profiles(spark, folder)
    for name, rows in tables.items():
        profiles.write(name, 0, rows, rows.columns)
    return profiles


def keys(profiles: Profiles, tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, column) of the columns without nulls and without repeats."""
    about = profiles.merged().filter((F.col("n") > 0) & (F.col("nulls") == 0) & (F.col("distinct_count") >= F.col("n") * (1 - 5 * DISTINCT_ERROR)))
    proposed = sorted((r["table"], r["column_name"]) for r in about.select("table", "column_name").collect())  # columns of the catalogue
    counts = [repeated_keys(tables[t], f"{t}.{c}", [c]) for t, c in proposed]
    if not counts:
        return []
    sound = reduce(DataFrame.unionByName, counts).filter("repeated_keys = 0").select("key_name").collect()
    return sorted(tuple(r["key_name"].split(".", 1)) for r in sound)


def links(profiles: Profiles, tables: dict[str, DataFrame], found_keys: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(table, column, other table, key) of the columns all of whose values are values of a key of the same name and type there.

    The name has to be the same because small numbers are contained in every long row of numbers.
    """
    def kind(table: str, column: str) -> str:
        return tables[table].schema[column].dataType.simpleString()

    pairs = [(t, c, p, k) for t, rows in tables.items() for c in rows.columns for p, k in found_keys if t != p and c == k and kind(t, c) == kind(p, k)]
    proposed = [link for link in pairs if link not in set(profiles.suspected_orphans(pairs))]
    if not proposed:
        return []
    names = {f"{i}": link for i, link in enumerate(proposed)}
    counts = reduce(DataFrame.unionByName, [orphan_counts(tables, [link]).withColumn("i", F.lit(i)) for i, link in names.items()])
    return sorted(names[r["i"]] for r in counts.filter("orphans = 0").collect())


def catalogue(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The columns of ``tables``, which are made views of the session, with is_key and refers_to as found in their rows."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
    profiles = profiled(spark, folder, tables)
    own = keys(profiles, tables)
    refers: dict[tuple[str, str], list[str]] = {}
    for t, c, p, k in links(profiles, tables, own):
        refers.setdefault((t, c), []).append(f"{p}.{k}")
    rows = [(t, c, True, None) for t, c in own if (t, c) not in refers] + [(t, c, (t, c) in own, ", ".join(sorted(p))) for (t, c), p in refers.items()]
    found = spark.createDataFrame(rows, "table_name STRING, column_name STRING, is_key BOOLEAN, refers_to STRING")
    return listed(spark, list(tables)).join(found, ["table_name", "column_name"], "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))
