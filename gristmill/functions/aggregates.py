"""Aggregates from a state function, and table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, keys: list[str], value: Column, initial: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None, out: str = "value", order: list[Column] | None = None, combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """CREATE AGGREGATE: (keys, out) with the state after `step` over each group's values, and `final` of it. Null
    values are left out, as a strict step has it; a group without values has the initial state's final.

    With `combine`, which joins two states, each task folds its own rows of a group and only states are shuffled, so
    no group is gathered whole. Without it a group's values are folded in `order` in one row, which must hold them."""
    done = final or (lambda s: s)
    held = F.struct(*(order or []), value.alias("_v"))
    names = [F.col(k) for k in keys]
    taken = lambda rows: F.transform(rows, lambda r: r._v)
    run = lambda rows: F.aggregate(taken(rows), initial, step)
    one = F.when(value.isNotNull(), held)
    if combine is None:
        return df.groupBy(*names).agg(F.array_sort(F.collect_list(one)).alias("_rows")).select(*keys, done(run(F.col("_rows"))).alias(out))
    # rows of one task and key by small runs, so an array stays short
    runs = df.withColumn("_run", F.shiftright(F.monotonically_increasing_id(), 10))
    states = runs.groupBy(*names, "_run").agg(F.collect_list(one).alias("_rows")).select(*keys, run(F.col("_rows")).alias("_state"), F.pmod(F.xxhash64("_run"), F.lit(64)).alias("_salt"))
    for by in ([*keys, "_salt"], keys):
        states = states.groupBy(*by).agg(F.collect_list("_state").alias("_states")).select(*by, F.aggregate("_states", initial, combine).alias("_state"))
    return states.select(*keys, done(F.col("_state")).alias(out))


def xml_agg(x: Column, *order: Column) -> Column:
    """Pieces of XML one after the other, by `order`."""
    rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*order, x.alias("_x")))))
    return F.array_join(F.transform(rows, lambda r: r._x), "")


def sum_exact(x: Column) -> Column:
    """The sum of long whole numbers, which may exceed a long."""
    return F.sum(x.cast("decimal(38,0)"))
