"""Incremental delivery: cursors over results, and files that keep arriving as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.relational import numbered, spare


class Cursor:
    """FETCH over a result; the driver holds one partition at a time."""

    def __init__(self, df: DataFrame):
        self._rows: Iterator[Row] = df.toLocalIterator(prefetchPartitions=True)

    def fetch(self, n: int = 1) -> list[Row]:
        return [r for _, r in zip(range(n), self._rows, strict=False)]

    def move(self, n: int = 1) -> int:
        return len(self.fetch(n))


class ScrollCursor:
    """FETCH in both directions over a result in an order. Rows are numbered once, into a checkpoint; each fetch reads
    its own rows only. Position 0 is before the first row."""

    def __init__(self, df: DataFrame, order: list[Column]):
        (self._name,) = spare(df, "_nth")
        self._rows = numbered(df, order, self._name).checkpoint()
        self._size = self._rows.count()
        self.at = 0

    def _between(self, a: int, b: int) -> list[Row]:
        found = self._rows.filter(F.col(self._name).between(a, b)).orderBy(self._name)
        return found.drop(self._name).collect()

    def forward(self, n: int = 1) -> list[Row]:
        """The next n rows; with a negative n the rows before, nearest first."""
        if n < 0:
            return self.backward(-n)
        begin, self.at = self.at + 1, min(self.at + n, self._size + 1)
        return self._between(begin, min(begin + n - 1, self._size))

    def backward(self, n: int = 1) -> list[Row]:
        end, self.at = self.at - 1, max(self.at - n, 0)
        return self._between(max(end - n + 1, 1), end)[::-1]

    def absolute(self, n: int) -> list[Row]:
        """Row n, or counted from the end if negative; none outside."""
        self.at = min(max(n if n >= 0 else self._size + 1 + n, 0), self._size + 1)
        return self._between(self.at, self.at)

    def relative(self, n: int) -> list[Row]:
        self.at = min(max(self.at + n, 0), self._size + 1)
        return self._between(self.at, self.at)

    def move(self, n: int) -> int:
        """How many rows a fetch of n would have given."""
        before, self.at = self.at, min(max(self.at + n, 0), self._size + 1)
        low, high = (before + 1, min(before + n, self._size)) if n > 0 else (max(before + n, 1), before - 1)
        return max(high - low + 1, 0) if n else 0


def arriving(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Delimited files as they arrive."""
    return spark.readStream.schema(schema).options(**options).csv(path)


def notify(df: DataFrame, handler, checkpoint: str) -> StreamingQuery:
    """handler(rows, batch id) is called once for each batch of news; ends when what is there has been handled."""
    return df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
