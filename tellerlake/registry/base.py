"""Registry of named queries, each with its output columns and, where SQL can say it, an oracle.

``columns`` declares name and type of every output column once; both engines cast to it, so results
compare value by value. Types: b = bigint, d = double, s = string (dates too), o = boolean.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import day
from ..plans.warehouse import Warehouse
from ..session import own_session
from ..sources.bank import BankSources, read_table
from .oracle_tables import TABLES

ASOF = "2002-01-01"
FIRST_YEAR, LAST_YEAR = 1995, 2002
# Partitions after a shuffle: what a task sorts and hashes is bounded by them, not by the input.
PARTITION_BYTES = "16m"
TYPES = {"b": ("bigint", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "o": ("boolean", "BOOLEAN")}


class Context:
    """What a query reads: the source tables and the star schema of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = own_session(spark)
        self.spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES)
        self.folder = folder
        self.asof = day(ASOF)

    @cached_property
    def src(self) -> BankSources:
        return BankSources(self.spark, self.folder)

    @cached_property
    def wh(self) -> Warehouse:
        return Warehouse(self.src, ASOF, FIRST_YEAR, LAST_YEAR)

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)


@dataclass(frozen=True)
class Query:
    key: str
    columns: list[tuple[str, str]]
    build: Callable[[Context], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Context(spark, folder))
        return df.selectExpr(*[f"CAST(`{n}` AS {TYPES[t][0]}) AS `{n}`" for n, t in self.columns])

    @property
    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = ", ".join(f'CAST("{n}" AS {TYPES[t][1]}) AS "{n}"' for n, t in self.columns)
        return f"{with_tables(self.sql)}SELECT {casts} FROM ({self.sql}) result"


def with_tables(sql: str) -> str:
    """WITH clause of the derived tables a statement names, in order of their dependencies."""
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z_0-9]+\b", text):
            if name in TABLES and name not in needed:
                visit(TABLES[name])
                needed[name] = TABLES[name]

    visit(sql)
    if not needed:
        return ""
    return "WITH " + ",\n".join(f"{n} AS (\n{t.strip()}\n)" for n, t in needed.items()) + "\n"


QUERIES: dict[str, Query] = {}


def query(key: str, columns: str, sql: str | None = None):
    """Register a query; ``columns`` is "name type, name type, ..."."""
    spec = [(part.split()[0].strip('"'), part.split()[-1]) for part in columns.split(",")]

    def register(build: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = Query(key, spec, build, sql)
        return build

    return register
