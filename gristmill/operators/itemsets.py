"""Frequent itemsets, complete up to any size: level-wise counting by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_itemsets(rows: DataFrame, minsup: int) -> DataFrame:
    """rows: (tid, item). (items array, support, share): all itemsets of at least minsup transactions, with their share
    of the transactions. Repeated items of a transaction count once, null ones not at all. The sets of a level that
    differ in their last item only give the candidates of the next; a transaction makes a row for each candidate that
    it holds, so infrequent combinations make none. Transactions of the same frequent items, by their number and 128 bits
    of hashes, are counted as one with their number. It ends at the first level without a frequent set."""
    base = rows.select("tid", "item").filter("item is not null").distinct()
    n = rows.select(F.count_distinct("tid")).first()[0]
    ones = base.groupBy("item").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= minsup).checkpoint()
    base = base.join(ones.select("item"), "item").select("tid", "item").checkpoint()
    told = base.filter("tid is not null").groupBy("tid").agg(F.bit_xor(F.xxhash64("item")).alias("h"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("g"), F.count(F.lit(1)).alias("size"))
    one = told.groupBy("h", "g", "size").agg(F.min("tid").alias("_one"), F.count(F.lit(1)).alias("n"))
    base = base.join(one, F.col("tid") == F.col("_one")).select("tid", "item", "n").checkpoint()
    out = found = ones.select(F.array("item").alias("items"), "support")
    level = base.select("tid", F.array("item").alias("items"))
    while True:
        shared = F.slice("items", 1, F.size("items") - 1)
        last = found.select("items", shared.alias("head"), F.element_at("items", -1).alias("last"))
        other = last.select(F.col("head").alias("_head"), F.col("last").alias("next"))
        candidates = last.join(other, (F.col("head") == F.col("_head")) & (F.col("last") < F.col("next"))).select(F.col("items").alias("_items"), "next")
        grown = level.join(candidates, F.col("items") == F.col("_items")).join(base.select(F.col("tid").alias("_tid"), "item", "n"), (F.col("tid") == F.col("_tid")) & (F.col("item") == F.col("next")))
        grown = grown.select("tid", F.concat("items", F.array("item")).alias("items"), "n").checkpoint()
        found = grown.groupBy("items").agg(F.sum("n").alias("support")).filter(F.col("support") >= minsup).checkpoint()
        if found.isEmpty():
            return out.withColumn("share", F.col("support") / F.lit(max(n, 1)))
        out = out.union(found)
        level = grown.join(found.select("items"), "items", "left_semi").select("tid", "items")
