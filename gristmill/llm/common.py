"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts go through Python in slices of about this many characters.
SLICE_CHARS = 4_000_000


#: Rows and bytes in a batch that goes to Python at most. Texts can be long, and the JVM and Python hold a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 16_000_000


def small_batches(spark: SparkSession) -> None:
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key).lower().removesuffix("b")
        if not held.isdecimal() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order, nulls as empty, in lists of about `limit` characters; a longer text stands alone."""
    part, held = [], 0
    for x in texts:
        s = x.as_py() or ""
        if part and held + len(s) > limit:
            yield part
            part, held = [], 0
        part.append(s)
        held += len(s)
    if part:
        yield part


def batches(items: list, sizes: list[int], most: int) -> Iterator[list]:
    """The items in order, in lists whose sizes add up to `most` at most; a larger one stands alone."""
    part, held = [], 0
    for x, n in zip(items, sizes, strict=True):
        if part and held + n > most:
            yield part
            part, held = [], 0
        part.append(x)
        held += n
    if part:
        yield part


def release() -> None:
    """Gives memory that is free in this process back to the system. A worker lives on after its task, and several of
    them share an executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """fn, which turns batches into batches, with a release() once its task has ended."""

    def run(it: Iterator) -> Iterator:
        yield from fn(it)
        release()

    return run


def text_udf(fn: Callable[[], Callable[[list[str]], list]], kind: str, arrow: pa.DataType, limit: int = SLICE_CHARS):
    """An Arrow UDF over one string column. fn() is called once for each partition and returns the function
    that turns a list of texts into a list of results, so that automata and caches live as long as the task."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = fn()
        for batch in it:
            out: list = []
            for part in slices(batch, limit):
                out += work(part)
            yield pa.array(out, type=arrow)
        del work
        release()

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or the one that the context has been given. Only a local
    session without either gets a temporary one; on a cluster other nodes couldn't read it, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and held.isDefined():
        named = held.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's file system of that path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes that Spark takes an unknown size for.
MOST_SIZE = 2**63 - 1


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint: lost executors cost no upstream work, and what was
    nondeterministic above, such as sampled range bounds, is now fixed. A checkpoint keeps the size that was estimated
    for its plan, and a join's is the product of both sides', so in a loop its digits double with each round until they
    fill the driver. One beyond MOST_SIZE is dropped; Spark's default for an unknown size takes its place."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    held = df.checkpoint()
    plan = held._jdf.logicalPlan()
    try:
        if plan.stats().sizeInBytes() <= MOST_SIZE:
            return held
    except ValueError:  # Python reads no number of more than 4300 digits
        pass
    jvm = spark.sparkContext._jvm
    none = jvm.scala.Option.empty()
    rows = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, rows), spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds `out`: the row's number from 0 within its key, in the given order; no task ever holds a whole key.

    Rows are range-partitioned by (key, order), so that a hot key spreads over many tasks, and checkpointed.
    A small table of rows per (partition, key), at most partitions + keys rows, gives each slice its offset;
    within a slice a window numbers the rows. Ties in the order go by a hash of the row, so that reruns agree, and
    rows that are alike by their place, so that any number of them spreads too. Null keys are a key of their own;
    columns of any name pass through, but one named `out` is replaced."""
    part, rows, place, alike, at, before, nth, *names = fresh(df, "_part", "_rows", "_place", "_alike", "_at", "_before", "_nth", *[f"_k{i}" for i in range(len(keys))])
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    ties = [F.col(alike), F.col(place)]
    placed = df.withColumns({alike: F.xxhash64(*plain), place: F.monotonically_increasing_id()})
    placed = placed.repartitionByRange(shuffle_partitions(df.sparkSession), *[F.col(k).asc_nulls_last() for k in keys], *order, *ties)
    placed = cut(placed.withColumn(part, F.spark_partition_id()))
    held = placed.groupBy(part, *keys).agg(F.count(F.lit(1)).alias(rows))
    above = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col(part).alias(at), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.coalesce(F.sum(rows).over(above), F.lit(0)).alias(before))
    match = F.col(part) == F.col(at)
    for k, n in zip(keys, names, strict=True):
        match = match & F.col(k).eqNullSafe(F.col(n))
    within = Window.partitionBy(part, *keys).orderBy(*order, *ties)
    joined = placed.withColumn(nth, F.row_number().over(within) - 1).join(starts, match)
    return joined.withColumn(out, (F.col(nth) + F.col(before)).cast("long")).select(*[f"`{c}`" for c in df.columns if c != out], out)


#: A key is hot if more than one of HOT rows has it, so there are HOT of them at most.
HOT = 10_000


def look_up(df: DataFrame, key: str, found: DataFrame, hot: DataFrame, place: Column | None = None) -> DataFrame:
    """df with the columns of found, (key, ...) with a row for each key: a left join in which no task gets many
    rows of one key. hot: (key) of the hot ones, HOT rows at most. Their rows of `found` are broadcast; the rows of
    df that they match, and those with a null key, which match nothing, don't go by their key but by their place.
    `place` is a string or negative long that differs among those rows; without one df must stand behind a checkpoint
    or a table, so that the rows' own places don't change when a task runs again. `found` must not share column names
    with df except `key`; the key is a string or a long that isn't negative."""
    columns = [c for c in found.columns if c != key]
    k, hit, by, other, *held = fresh(df.select("*", *[F.lit(0).alias(c) for c in columns]), "_key", "_hit", "_by", "_other", *[f"_hot_{i}" for i in range(len(columns))])
    first = found.join(F.broadcast(hot.select(key)), key, "left_semi").select(F.col(key).alias(k), F.lit(True).alias(hit), *[F.col(c).alias(h) for c, h in zip(columns, held, strict=True)])
    if place is None:
        place = -1 - F.monotonically_increasing_id()
        place = place.cast("string") if dict(df.dtypes)[key] == "string" else place
    told = df.join(F.broadcast(first), F.col(key) == F.col(k), "left").withColumn(by, F.when(F.col(hit) | F.col(key).isNull(), place).otherwise(F.col(key)))
    rest = found.withColumnRenamed(key, other)
    got = told.join(rest, F.col(by) == F.col(other), "left")
    mixed = [F.when(F.col(hit), F.col(h)).otherwise(F.col(c)).alias(c) for c, h in zip(columns, held, strict=True)]
    return got.select(*[F.col(f"`{c}`") for c in df.columns], *mixed)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, made from `names` by adding underscores."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def struct_type(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
