"""Fuzzy c-means over points in array columns.

A round joins nothing: the centroids, k rows of d numbers, are literals of the plan, as k * d is a parameter of the
call. Distances are squared and their exponent is 2 / (1 - m), as in the reproduced formulation.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def memberships(x: Column, centroids: list[list[float]], m: float) -> Column:
    """array<double>: the point's memberships; a point on a centroid belongs to it alone. The plan's size doesn't
    depend on the dimensions."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    dist = F.transform(F.array(*[F.lit(c) for c in centroids]), lambda c: add(F.zip_with(x, c, lambda a, b: (a - b) * (a - b))))

    def rate(d: Column) -> Column:
        part = F.transform(d, lambda v: F.when(v > 0, F.pow(v, F.lit(2 / (1 - m)))).otherwise(0.0))
        own = F.size(F.filter(d, lambda v: v == 0))
        alone = F.transform(d, lambda v: F.when(v == 0, 1.0 / own).otherwise(0.0))
        return F.when(own > 0, alone).otherwise(_let(part, lambda p: _let(add(p), lambda t: F.transform(p, lambda v: v / t))))

    return _let(dist, rate)


def start(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """points with u: memberships that come from hashes of i, so that reruns agree."""
    raw = [(F.pmod(F.xxhash64(F.lit(seed + j), "i"), F.lit(1_000_003)) + 1) / F.lit(1_000_004.0) for j in range(k)]
    total = sum(raw, F.lit(0.0))
    return points.withColumn("u", F.array(*[r / total for r in raw]))


def centroids(rated: DataFrame, d: int, k: int, m: float) -> list[list[float]]:
    """k centroids by one aggregation by dimension; k * (d + 1) numbers come to the driver."""
    weight = [F.pow(F.col("u")[j], F.lit(m)).alias(f"w{j}") for j in range(k)]
    sums = [F.sum(F.col(f"w{j}") * F.col("v")).alias(f"s{j}") for j in range(k)] + [F.sum(f"w{j}").alias(f"n{j}") for j in range(k)]
    rows = sorted(rated.select(*weight, F.posexplode("x").alias("l", "v")).filter(F.col("l") < d).groupBy("l").agg(*sums).collect())
    return [[row[f"s{j}"] / row[f"n{j}"] for row in rows] for j in range(k)]


def fuzzy_c_means(points: DataFrame, d: int, k: int, m: float = 2.0, eps: float = 1e-4, itermax: int = 20, rated: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, list[list[float]], list[dict]]:
    """points: i, x (array<double> of d). Returns (i, x, u), the centroids and the protocol of the rounds. It ends
    when no membership moves by eps or more, or after itermax rounds."""
    now = rated if rated is not None else start(points, k, seed)
    log = []
    c: list[list[float]] = []
    for s in range(1, itermax + 1):
        began = time.perf_counter()
        c = centroids(now, d, k, m)
        after = now.withColumn("_u", memberships(F.col("x"), c, m))
        moved = F.max(F.array_max(F.zip_with("u", "_u", lambda a, b: F.abs(a - b))))
        after = after.checkpoint()
        delta, n = after.agg(moved, F.count(F.lit(1))).first()
        now = after.select("i", "x", F.col("_u").alias("u"))
        log.append({"d": d, "k": k, "n": n, "s": s, "delta": delta, "runtime": time.perf_counter() - began})
        if delta is None or delta < eps:
            break
    return now, c, log


def protocol(spark: SparkSession, log: list[dict]) -> DataFrame:
    """The rounds as rows: delta, dimensions, clusters, points, round, seconds."""
    return spark.createDataFrame([(r["delta"], r["d"], r["k"], r["n"], r["s"], r["runtime"]) for r in log], "delta double, d int, k int, n long, s int, runtime double")


def views(rated: DataFrame, centres: list[list[float]]) -> dict[str, DataFrame]:
    """What a run may be looked at by: SH (i, x), SV (i, l, val), U (i, j, val), C (j, l, val) and SD (i, j, dist), all
    numbered from 1."""
    spark = rated.sparkSession
    c = spark.createDataFrame([(j, l, float(v)) for j, row in enumerate(centres, 1) for l, v in enumerate(row, 1)], "j int, l int, val double")
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.array(*map(F.lit, row)).alias("c")) for j, row in enumerate(centres, 1)])
    apart = lambda s: F.sqrt(F.aggregate(F.zip_with("x", s.c, lambda a, b: F.pow(a - b, F.lit(2.0))), F.lit(0.0), lambda t, v: t + v))
    sd = rated.select("i", F.inline(F.transform(each, lambda s: F.struct(s.j.alias("j"), apart(s).alias("dist")))))
    u = rated.select("i", F.posexplode("u").alias("j", "val")).withColumn("j", F.col("j") + 1)
    return {"SH": rated.select("i", "x"), "SV": to_vertical(rated), "U": u, "C": c, "SD": sd}


def to_horizontal(vertical: DataFrame, d: int) -> DataFrame:
    """(i, l, val), l from 1, to (i, x)."""
    return vertical.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "val"))), lambda s: s.val).alias("x")).filter(F.size("x") == d)


def to_vertical(points: DataFrame) -> DataFrame:
    return points.select("i", F.posexplode("x").alias("l", "val")).withColumn("l", F.col("l") + 1)
