"""Connected components of an edge table, by labels that spread along edges and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), long. Returns (id, label) of every node that has an edge: label is the smallest id in its
    component. A round is a join along the edges and a jump; star-like graphs take a handful. Self-loops and
    repeated edges do no harm; nulls have no edges; an empty table gives an empty one."""
    # fixed first: edges that are one of many equal choices may come out otherwise when they are computed again
    known = cut(edges.filter("a is not null and b is not null").select("a", "b"))
    both = cut(known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")).select("id", "label"))
    while True:
        heard = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("_heard"))
        lower = labels.join(heard, F.col("id") == F.col("a")).select("id", F.least("label", "_heard").alias("_now"), F.col("label").alias("_was"))
        up = labels.select(F.col("id").alias("_up"), F.col("label").alias("_far"))
        after = cut(lower.join(up, F.col("_now") == F.col("_up")).select("id", F.least("_now", "_far").alias("label"), "_was"))
        labels = after.select("id", "label")
        if after.filter("label <> _was").isEmpty():
            return labels
