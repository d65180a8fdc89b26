"""Relational operators that the DataFrame API lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fragment(df: DataFrame, column: str, nodes: int) -> DataFrame:
    """Rows placed by a hash of the fragment attribute; joins and groupings on it need no other exchange."""
    return df.repartition(nodes, column)


def fragments(df: DataFrame, column: str, nodes: int) -> DataFrame:
    """df with node, the attribute modulo `nodes`, and each node's rows in a partition; without an attribute node 0."""
    (n,) = spare(df, "node")
    return df.withColumn(n, F.coalesce(F.pmod(F.col(column), F.lit(nodes)), F.lit(0))).repartition(nodes, n)


def sort(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """(column, ascending) keys; nulls count as larger than any value."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in keys])


def limit_offset(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A limit of None is none, an offset of None 0; negative ones are errors."""
    if (limit or 0) < 0 or (offset or 0) < 0:
        raise ValueError("LIMIT and OFFSET must not be negative")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; Spark limits the groups before its exchange."""
    (n,) = spare(df, "_nth")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from `names` by adding underscores."""
    taken = {c.lower() for c in df.columns}
    return [next(n + "_" * k for k in range(len(taken) + 1) if (n + "_" * k).lower() not in taken) for n in names]


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with `out`, the row's number from 1 in the given order. Rows are placed by ranges of the order and written
    to a checkpoint; a table with a row for each range gives its first number. No task holds all rows."""
    part, rows, before, own = spare(df, "_part", "_rows", "_before", "_own")
    placed = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).checkpoint()
    held = placed.groupBy(part).agg(F.count(F.lit(1)).alias(rows))
    starts = held.select(part, F.coalesce(F.sum(rows).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    got = placed.withColumn(own, nth).join(F.broadcast(starts), part)
    return got.withColumn(out, (F.col(own) + F.col(before)).cast("long")).drop(part, before, own)


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    return x.between(F.least(a, b), F.greatest(a, b)) & a.isNotNull() & b.isNotNull()


def zip_join(left: DataFrame, right: DataFrame, order_left: list[Column], order_right: list[Column]) -> DataFrame:
    """Full outer join of two results by row number."""
    return numbered(left, order_left, "row_number").join(numbered(right, order_right, "row_number"), "row_number", "full_outer")


def or_join(left: DataFrame, right: DataFrame, *any_of: Column) -> DataFrame:
    """Inner join where one of several conditions holds: a join for each, less the pairs that an earlier one gave.
    Spark compares all pairs for a condition with OR; equalities apart are hash or merge joins."""
    out = None
    for k, c in enumerate(any_of):
        got = left.join(right, c)
        for known in any_of[:k]:
            got = got.filter(~F.coalesce(known, F.lit(False)))
        out = got if out is None else out.union(got)
    return out


def inherit(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """A query on a parent table scans its children too, with the parent's columns."""
    out = parent
    for c in children:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.select(*parent.columns)


#: Estimated sizes of a checkpoint beyond this are dropped.
MOST_SIZE = 2**63 - 1


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint that keeps nothing of its plan but the partitioning and order. Spark hands the plan's constraints
    on, and infers new filters from them and from expressions that are joined on; in a loop these, as the product of
    the sizes that a join is estimated at, grow with each round until they fill the driver."""
    spark = df.sparkSession
    held = df.checkpoint()
    plan = held._jdf.logicalPlan()
    jvm = spark.sparkContext._jvm
    none = jvm.scala.Option.empty()
    size = jvm.scala.Option.apply(plan.stats()) if plan.stats().sizeInBytes() <= MOST_SIZE else none
    rows = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, size, none)
    return type(df)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, rows), spark)


def recursive_union(seed: DataFrame, step, distinct: bool = True, most: int = 10_000) -> DataFrame:
    """WITH RECURSIVE: step(working) gives the next rows until there are none. With distinct, rows that any round
    had already are dropped, so that cycles end. Each round's rows are checkpointed; the plan doesn't grow."""
    known = settled(seed.distinct() if distinct else seed)
    work = known
    for _ in range(most):
        new = step(work).select(*seed.columns)
        if distinct:
            on = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in seed.columns]
            new = new.distinct().alias("n").join(known.alias("k"), on, "left_anti")
        work = settled(new)
        if work.isEmpty():
            return known
        known = settled(known.unionByName(work))
    raise RuntimeError(f"no end after {most} rounds")


def update_from(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table's new version: rows with an equal key take the columns of changes, nulls included. Of several changes
    of one key one is taken, the smallest by its columns, so no row of the table multiplies."""
    return _updated(table, changes, key)[0]


def update_returning(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """update_from's result and what RETURNING gives: the new versions of the rows that were hit."""
    return _updated(table, changes, key)


def _updated(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    names = [c for c in changes.columns if c != key]
    (v,) = spare(table, "_change")
    one = changes.groupBy(key).agg(F.min(F.struct(*names, F.lit(True).alias("_hit"))).alias(v))
    both = table.join(one, key, "left")
    hit = F.col(v).isNotNull()
    new = [F.when(hit, F.col(v)[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns]
    return both.select(*new), both.filter(hit).select(*new)


def insert_returning(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table's new version and the rows as inserted, with nulls for columns that they lack."""
    return insert_rows(table, rows), insert_rows(table.limit(0), rows)


def create_table_as(df: DataFrame, name: str, cluster_by: list[str] | None = None, replace: bool = False) -> DataFrame:
    """CREATE TABLE AS and SELECT INTO: the result as a table of the session's catalogue, written as Parquet. With
    cluster_by, its files hold ranges of these columns in order, so filters on them skip files and row groups."""
    placed = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    placed.write.mode("overwrite" if replace else "errorifexists").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def swap_table(df: DataFrame, name: str) -> DataFrame:
    """Replaces a table by a new version that is complete before the old one goes: it is written beside it, then two
    renames put it in place. A failure while writing leaves the old version as it is."""
    spark = df.sparkSession
    new, old = f"{name}__new", f"{name}__old"
    spark.sql(f"DROP TABLE IF EXISTS {new}")
    df.write.format("parquet").saveAsTable(new)
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def sample_statistics(df: DataFrame, share: float, seed: int = 0, common: int = 10, bounds: int = 10) -> DataFrame:
    """What ANALYZE gathers from a sample of the rows: for each column null_frac, n_distinct in the sample, the most
    common values with their shares, and the bounds of a histogram, all as strings."""
    seen = df.sample(share, seed)
    parts = []
    for c in df.columns:
        v = F.col(f"`{c}`").cast("string")
        counts = seen.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        top = F.slice(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), "v")))), 1, common)
        one = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls"), F.count("v").alias("n_distinct")).select(
            F.lit(c).alias("column"), (F.coalesce("nulls", F.lit(0)) / F.col("n")).alias("null_frac"), "n_distinct", F.col("n").alias("sampled")
        )
        best = counts.filter("v is not null").orderBy(F.desc("n"), "v").limit(common).agg(top.alias("top")).select(F.transform("top", lambda t: F.struct(t.v.alias("value"), (-t.n).alias("n"))).alias("most_common"))
        edge = seen.agg(F.transform(F.percentile_approx(F.col(f"`{c}`").cast("double"), [k / bounds for k in range(bounds + 1)]), lambda x: x.cast("string")).alias("histogram")) if dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") else df.sparkSession.range(1).select(F.lit(None).cast("array<string>").alias("histogram"))
        parts.append(one.join(F.broadcast(best)).join(F.broadcast(edge)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def violations(df: DataFrame, not_null: tuple[str, ...] = (), unique: tuple[str, ...] = (), checks: dict[str, str] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(constraint, n): how many rows break each constraint; a key that several rows have counts each of them. A check
    that is null holds, as does a foreign key that is null."""
    out = df.sparkSession.createDataFrame([], "constraint string, n long")
    plain = [(f"not null {c}", F.col(c).isNull()) for c in not_null] + [(f"check {k}", ~F.coalesce(F.expr(e), F.lit(True))) for k, e in (checks or {}).items()]
    if plain:
        counts = df.agg(*[F.sum(F.when(bad, 1).otherwise(0)).alias(f"_{i}") for i, (_, bad) in enumerate(plain)])
        out = out.union(counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("long").alias("n")) for i, (n, _) in enumerate(plain)])).alias("x")).select("x.*"))
    if unique:
        rows = df.filter(F.concat(*[F.col(c).isNotNull().cast("string") for c in unique]).contains("false") == F.lit(False)).groupBy(*unique).agg(F.count(F.lit(1)).alias("_n"))
        out = out.union(rows.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n")).select(F.lit(f"unique {', '.join(unique)}"), "n"))
    for c, (parent, key) in (foreign or {}).items():
        lost = df.filter(F.col(c).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(c) == F.col("_key"), "left_anti")
        out = out.union(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"foreign key {c}"), "n"))
    return out


def tids(df: DataFrame) -> DataFrame:
    """df, read from files, with tid: struct<file, row>, where each row stands."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("tid"))


def fetch_tids(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of df that stand at the tids of `wanted`."""
    return tids(df).join(wanted.select("tid").distinct(), "tid", "left_semi").drop("tid")


def delete_using(table: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table's new version and what RETURNING gives: the rows that went."""
    return table.join(doomed, key, "left_anti"), table.join(doomed, key, "left_semi")


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns that rows lack are null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def crosstab(df: DataFrame, row: str, category: str, value: str, categories: list) -> DataFrame:
    """One row per `row`, a column for each named category."""
    return df.groupBy(row).pivot(category, categories).agg(F.first(value, ignorenulls=True))


def crosstab_by_place(df: DataFrame, row: str, order: list[str], value: str, n: int) -> DataFrame:
    """Without a list of categories: each row's values fill c1 to cn from the left in the order given, nulls beyond the
    last one. A task keeps the first n of each row before the shuffle."""
    (place,) = spare(df, "_place")
    first = df.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(*[F.asc_nulls_last(c) for c in [*order, value]]))).filter(F.col(place) <= n)
    return first.groupBy(row).agg(*[F.max(F.when(F.col(place) == k, F.col(value))).alias(f"c{k}") for k in range(1, n + 1)])


def connect_by(df: DataFrame, key: str, parent: str, start, max_depth: int = 0) -> DataFrame:
    """(key, parent, level, branch): the tree below `start`, its path joined by '~'. A key that repeats on its own
    path is an error, as endless recursion would be."""
    # fixed, so that a computed parent isn't computed anew in the filters of each round; merged, as a copy of all links
    # would go through the driver in each
    links = settled(df.select(F.col(key).alias("_key"), F.col(parent).alias("_parent")).filter(F.col("_parent").isNotNull())).hint("merge")
    seed = df.filter(F.col(key) == F.lit(start)).select(F.col(key).alias("key"), F.lit(None).cast(df.schema[parent].dataType).alias("parent"), F.lit(0).alias("level"), F.col(key).cast("string").alias("branch")).distinct()

    def step(work: DataFrame) -> DataFrame:
        grown = work.join(links, F.col("key") == F.col("_parent"))
        loops = F.array_contains(F.split("branch", "~"), F.col("_key").cast("string"))
        branch = F.when(loops, F.raise_error(F.lit("infinite recursion detected"))).otherwise(F.concat_ws("~", "branch", F.col("_key").cast("string")))
        grown = grown.select(F.col("_key").alias("key"), F.col("_parent").alias("parent"), (F.col("level") + 1).alias("level"), branch.alias("branch"))
        return grown.filter(F.col("level") <= max_depth) if max_depth else grown

    return recursive_union(seed, step, distinct=False)


def normal_rand(spark: SparkSession, n: int, mean: float, stddev: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select((F.randn(seed) * stddev + mean).alias("normal_rand"))


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    if step == 0:
        raise ValueError("step size must not be zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "generate_series")
