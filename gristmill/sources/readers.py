"""Readers and writers: delimited text, transactions, edges, and series in text or binary form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Escapes of the text dialect, but for the backslash's own.
_ESCAPES = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "\b": "\\b", "\f": "\\f", "\v": "\\v"}


def _unescaped(field: Column) -> Column:
    pieces = F.split(field, r"\\\\")  # between doubled backslashes

    def plain(p: Column) -> Column:
        for c, told in _ESCAPES.items():
            p = F.replace(p, F.lit(told), F.lit(c))
        return F.replace(p, F.lit("\\"), F.lit(""))

    return F.array_join(F.transform(pieces, plain), "\\")


def copy_from(spark: SparkSession, path: str, schema: str, csv: bool = False, delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None) -> DataFrame:
    """COPY FROM: text (tabs, \\N for null, backslash escapes, a row for each line) or csv (commas, empty for null,
    quotes). A row with too few or too many fields is an error."""
    if header and not csv:
        raise ValueError("HEADER needs CSV mode")
    if csv:
        options = {"sep": delimiter or ",", "nullValue": null if null is not None else "", "header": header, "multiLine": True, "quote": quote, "escape": escape or quote, "mode": "FAILFAST"}
        return spark.read.options(**options).schema(schema).csv(path)
    fields = T.StructType.fromDDL(schema).fields
    parts = F.split(F.col("value"), rf"(?<!(?<!\\)(?:\\\\){{0,50}}\\){re.escape(delimiter or chr(9))}")
    told = F.when(F.size(parts) == len(fields), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))))
    rows = spark.read.option("lineSep", "\n").text(path).filter("value <> '\\\\.'").select(told.alias("_f"))
    mark = "\\N" if null is None else null
    return rows.select(*[F.when(F.col("_f")[k] != mark, _unescaped(F.col("_f")[k])).cast(f.dataType).alias(f.name) for k, f in enumerate(fields)])


def copy_to(df: DataFrame, path: str, csv: bool = False, delimiter: str | None = None, null: str | None = None, header: bool = False, quote_all: bool = False) -> None:
    """COPY TO, of a table or a query, in the dialects of copy_from."""
    if csv:
        df.write.options(sep=delimiter or ",", nullValue=null if null is not None else "", header=header, escape='"', quoteAll=quote_all, emptyValue='""').csv(path)
        return
    sep = delimiter or "\t"

    def field(c: str) -> Column:
        v = F.replace(F.col(f"`{c}`").cast("string"), F.lit("\\"), F.lit("\\\\"))
        for x, told in _ESCAPES.items():
            v = F.replace(v, F.lit(x), F.lit(told))
        v = v if sep in _ESCAPES else F.replace(v, F.lit(sep), F.lit("\\" + sep))
        return F.coalesce(v, F.lit("\\N" if null is None else null))

    if sep not in _ESCAPES and len(sep) > 1:
        raise ValueError("the delimiter is one character")
    df.select(F.concat_ws(sep, *[field(c) for c in df.columns]).alias("value")).write.text(path)


def transactions(spark: SparkSession, path: str, delimiter: str = " ", shift: int = 0) -> DataFrame:
    """(tid, item) from one transaction a line of item ids; blanks at line ends are dropped. shift: added to every
    id, for files whose items begin at 0. tid is unique, not dense."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("tid"), F.split(F.trim("value"), f"\\Q{delimiter}\\E").alias("v"))
    items = lines.select("tid", F.explode(F.array_distinct("v")).alias("item")).filter("item <> ''")
    return items.select("tid", (F.col("item").cast("int") + shift).alias("item"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("a long, b long, w double").csv(path)


def partition_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("a long, p int").csv(path)


def series_text(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) from one value a line, across files in the order of their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("k")).filter("trim(value) <> ''")
    return _numbered(lines.select("f", "k", F.col("value").cast("double").alias("value")))


def series_binary(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) from files of little-endian float32."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for f, raw in zip(pdf.path, pdf.content, strict=True):
                v = np.frombuffer(raw, "<f4")
                yield pd.DataFrame({"f": f, "k": np.arange(len(v)), "value": v.astype("float64")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _numbered(files.mapInPandas(parse, "f string, k long, value double"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Numbers all rows by (f, k) without one task that holds them: ranges first, then an offset for each."""
    from pyspark.sql import Window

    placed = rows.repartitionByRange("f", "k").withColumn("_p", F.spark_partition_id()).checkpoint()
    held = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("f", "k")) - 1
    return placed.withColumn("_i", own).join(F.broadcast(held.select("_p", before.alias("_b"))), "_p").select((F.col("_b") + F.col("_i")).cast("long").alias("pos"), "value")


def jdbc_rows(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """A remote query as rows."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
