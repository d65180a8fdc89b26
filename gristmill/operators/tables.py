"""Tables of the session's catalogue: scratch ones, what a client or a foreign catalogue sees, and statements for many
sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gristmill.operators.relational import swap_table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """The name of a table that is dropped at the end."""
    name = f"scratch_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def columns(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table_name, position, name, type, nullable) of the given results, or of the catalogue's tables."""
    found = tables if tables is not None else {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
    rows = [(t, k, f.name, f.dataType.simpleString(), f.nullable) for t, df in found.items() for k, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, name string, type string, nullable boolean")


def foreign_table(spark: SparkSession, name: str, source: str, schema: str | None = None, **options: str) -> DataFrame:
    """A name for rows that another system or file holds; they are read when they are asked for."""
    reader = spark.read.format(source).options(**options)
    df = (reader.schema(schema) if schema else reader).load()
    df.createOrReplaceTempView(name)
    return spark.table(name)


def fan_out(sessions: list[SparkSession], text: str) -> list[DataFrame]:
    """One statement for all sessions at once, their results in the sessions' order."""
    if not sessions:
        return []
    with ThreadPoolExecutor(len(sessions)) as pool:
        return list(pool.map(lambda s: s.sql(text), sessions))


class Transaction:
    """New versions of tables that only its own reads see until the commit, with savepoints. A version is a plan, so
    nothing is written before the commit. That writes all versions first and renames them then, one after the other:
    a failure while writing leaves every table as it was. There is no lock: of two that commit the same table, the
    later one wins."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._now: dict[str, DataFrame] = {}
        self._saved: list[tuple[str, dict[str, DataFrame]]] = []

    def table(self, name: str) -> DataFrame:
        return self._now[name] if name in self._now else self.spark.table(name)

    def put(self, name: str, version: DataFrame) -> None:
        self._now[name] = version

    def savepoint(self, name: str) -> None:
        self._saved.append((name, dict(self._now)))

    def _at(self, name: str) -> int:
        """The latest savepoint of the name."""
        at = [k for k, (x, _) in enumerate(self._saved) if x == name]
        if not at:
            raise ValueError(f"no such savepoint: {name}")
        return at[-1]

    def rollback_to(self, name: str) -> None:
        """Later savepoints go, this one stays."""
        at = self._at(name)
        self._now = dict(self._saved[at][1])
        del self._saved[at + 1 :]

    def release(self, name: str) -> None:
        del self._saved[self._at(name) :]

    def rollback(self) -> None:
        self._now, self._saved = {}, []

    def commit(self) -> None:
        written = {}
        try:
            for name, version in self._now.items():
                written[name] = f"{name}__{uuid.uuid4().hex}"
                version.write.format("parquet").saveAsTable(written[name])
            for name, staged in written.items():
                swap_table(self.spark.table(staged), name)
        finally:
            for staged in written.values():
                self.spark.sql(f"DROP TABLE IF EXISTS {staged}")
        self.rollback()
