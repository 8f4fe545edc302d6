"""Tables in embedded database files, as a Spark data source: key ranges are partitions, conditions go into the query.

A table is a folder of SQLite files that all executors can open by path; each task opens the file it reads, there is no
server. Tables are written by tasks, one file each. Columns are whole numbers, texts, floating-point numbers, and dates
or decimals as texts.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BATCH_ROWS = 8192
SIGNS = ("=", ">", ">=", "<", "<=", "in")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def write_embedded(rows: DataFrame, folder: str, table: str, key: str) -> None:
    """Write ``rows`` as one file for each partition, with an index on ``key``; complete files get their name at the end.

    Dates and decimals are stored as texts. A task that is run again leaves its broken file unnamed.
    """
    plain = rows.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("date", "timestamp", "decimal") else F.col(f.name) for f in rows.schema.fields])
    columns = plain.columns
    path = os.path.join(folder, table)
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = os.path.join(path, uuid.uuid4().hex)
        with sqlite3.connect(name) as file:
            file.execute(f"CREATE TABLE t ({', '.join(map(_quoted, columns))})")
            for batch in batches:
                file.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(columns))})", zip(*[c.to_pylist() for c in batch.columns]))
            file.execute(f"CREATE INDEX k ON t ({_quoted(key)})")
        file.close()
        yield pa.RecordBatch.from_pydict({"file": [name]})

    # the list of written files commits them: what a lost task left behind is not in it
    for r in plain.mapInArrow(write, "file string").collect():  # a name for each task
        os.rename(r["file"], f"{r['file']}.db")


@dataclass
class Part(InputPartition):
    """A key range of one file; the range without a lower end also holds the null keys."""

    file: str
    low: int | None
    high: int | None


class EmbeddedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder, self.key = schema, options["path"], options["key"]
        self.parts = int(options.get("partitions", "1"))
        self.tests = [(f"{_quoted(c)} {sign} ?", [value]) if sign != "in" else (f"{_quoted(c)} IN ({', '.join('?' * len(value))})", value)
                      for c, sign, value in json.loads(options.get("where", "[]"))]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name in sorted(glob.glob(os.path.join(self.folder, "*.db"))):
            file = sqlite3.connect(f"file:{name}?mode=ro", uri=True)
            low, high = file.execute(f"SELECT min({_quoted(self.key)}), max({_quoted(self.key)}) FROM t").fetchone()  # ends of the index
            file.close()
            step = 1 if low is None else max(1, -(-(high - low + 1) // self.parts))
            cuts = [None] if low is None else [None, *range(low + step, high + 1, step)]
            out += [Part(name, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a table without files
            return
        key, arrow = _quoted(self.key), _arrow(self.schema)
        tests, values = [t for t, _ in self.tests], [v for _, vs in self.tests for v in vs]
        if partition.low is not None:
            tests, values = [*tests, f"{key} >= ?"], [*values, partition.low]
        if partition.high is not None:
            tests, values = [*tests, f"({key} < ?{' OR ' + key + ' IS NULL' if partition.low is None else ''})"], [*values, partition.high]
        file = sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True)
        try:
            found = file.execute(f"SELECT {', '.join(_quoted(c) for c in arrow.names)} FROM t{' WHERE ' + ' AND '.join(tests) if tests else ''}", values)
            while rows := found.fetchmany(BATCH_ROWS):
                columns = [pa.array([bool(x) if x is not None else None for x in c]) if f.type == pa.bool_() else pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            file.close()


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Embedded(DataSource):
    """``spark.read.format("embedded")`` with the options path, key and partitions (of each file), and a schema."""

    @classmethod
    def name(cls) -> str:
        return "embedded"

    def reader(self, schema: StructType) -> DataSourceReader:
        return EmbeddedReader(schema, self.options)


def _registered(spark: SparkSession) -> str:
    """The name of the source in this session.

    A session made from one that has registered a name can neither use nor replace it (Spark 4.1), so it takes the next one.
    """
    source, number = Embedded, 1
    while True:
        try:
            spark.dataSource.register(source)
            return source.name()
        except AnalysisException as taken:
            if taken.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
                raise
        number += 1
        source = type("Embedded", (Embedded,), {"name": classmethod(lambda cls, own=f"embedded_{number}": own)})


def scan_embedded(spark: SparkSession, folder: str, table: str, schema: StructType, key: str, partitions: int = 4,
                  where: list[tuple[str, str, object]] | None = None) -> DataFrame:
    """A stored table with the types of ``schema``; dates and decimals are cast from their texts.

    ``where`` lists conditions (column, one of SIGNS, value) on numbers and texts that become part of the files' queries;
    all have to hold. They are stated here and not pushed down by the planner, because it keeps what one query pushed
    for all later uses of the same table.
    """
    texts = {f.name for f in schema.fields if f.dataType.typeName() in ("date", "timestamp", "decimal")}
    for column, sign, _ in where or []:
        if sign not in SIGNS or column in texts or column not in schema.names:
            raise ValueError(f"no condition on {column} with {sign}")
    plain = ", ".join(f"`{f.name}` {'string' if f.name in texts else f.dataType.simpleString()}" for f in schema.fields)
    options = {"path": os.path.join(folder, table), "key": key, "partitions": str(partitions), "where": json.dumps(where or [])}
    rows = spark.read.format(_registered(spark)).schema(plain).options(**options).load()
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in texts else F.col(f.name) for f in schema.fields])
