"""What the third round's findings broke."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gristmill.functions import formatting as fm
from gristmill.operators import itemsets, relational, series


def by_sql(spark, path, name, rows, schema, table):
    """The query's rows and its SQL's, over one small table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(path))
    want = c.execute(entry.oracle_sql()[name])
    order = [d[0] for d in want.description]
    return sorted(map(tuple, df.select(*order).collect())), sorted(want.fetchall())


def test_sign_of_rounded_zero(spark, tmp_path):
    rows = [(k, x) for k, x in enumerate((-0.49, -0.04, -0.01, 0.0, 0.01, 0.49, -0.5, -999.85))]
    got, want = by_sql(spark, tmp_path, "s21_to_char_number", rows, "c_custkey long, c_acctbal double", "customer")
    assert got == want and got[0][3:] == ("     -0", "  -0")
    assert spark.range(1).select(fm.to_char_number(F.lit(-0.4), "999PR")).first()[0] == "  <0>"


def test_points_on_a_circle(spark, tmp_path):
    rows = [(k, size, price) for k, (size, price) in enumerate(((12, 999.72), (28, 999.73), (12, 1000.0), (20, 1800.0), (20, 1801.0), (20, 200.0)))]
    got, want = by_sql(spark, tmp_path, "s60_boxes_and_circles", rows, "p_partkey long, p_size int, p_retailprice double", "part")
    assert got == want and got[0][-1] is True


def test_deep_tree_of_computed_parents(spark, monkeypatch):
    """The plan of a round stays as small as the first ones': their filters grew threefold with each level."""
    tree = spark.range(1, 1 << 7).selectExpr("id AS k", "CASE WHEN id > 1 THEN id div 2 END AS up")
    seen, kind = [], type(tree)
    held = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, *a, **k: seen.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or held(df, *a, **k))
    assert relational.connect_by(tree, "k", "up", 1).count() == (1 << 7) - 1
    assert max(seen) < 3000


def test_or_join_without_pairs(spark):
    plan = entry.queries()["q20_or_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    a, b = spark.createDataFrame([(1, 1), (2, 5), (None, 3)], "x int, y int"), spark.createDataFrame([(1, 1), (2, 3), (3, None)], "u int, v int")
    got = relational.or_join(a, b, F.col("x") == F.col("u"), F.col("y") == F.col("v"))
    assert sorted((str(r.x), r.u) for r in got.collect()) == [("1", 1), ("2", 2), ("None", 2)]


def test_discord_without_pairs_of_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 1, 230)
    for v, n, size in ((noise, 8, 50), (np.tile(noise[:60], 3), 8, 40), (np.repeat(noise[:40], 5), 6, 30), (np.round(noise * 2), 4, 25), (noise[:9], 6, 50)):
        s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pos long, value double")
        near = sorted((-r.nn, r.pos) for r in series.nearest_neighbours(s, n, size).collect())
        got = series.discord(s, n, size, first=4, most=16).collect()
        assert len(got) == min(1, len(near))
        if near:
            assert got[0].pos == min(p for d, p in near if np.isclose(d, near[0][0], atol=1e-12)) and np.isclose(got[0].distance, (-near[0][0]) ** 0.5)
    monkeypatch.setattr(series, "nearest_neighbours", None)  # it makes a row for each pair of chunks
    assert series.discord(s, 3, 4).count() == 1


def test_equal_transactions_are_one(spark, monkeypatch):
    """What a level writes goes by the different transactions, not by all."""
    rows = [(t, i) for t in range(60) for i in ("abc" if t % 3 else "abd")] + [(None, "a"), (60, None)]
    df, most = spark.createDataFrame(rows, "tid int, item string"), []
    kind, held = type(df), type(df).checkpoint

    def checkpoint(d, *a, **k):
        out = held(d, *a, **k)
        if {"tid", "items"} <= set(d.columns):
            most.append(out.count())
        return out

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    got = {"".join(r["items"]): r.support for r in itemsets.frequent_itemsets(df, 20).collect()}
    assert got == {"a": 61, "b": 60, "c": 40, "d": 20, "ab": 60, "ac": 40, "bc": 40, "ad": 20, "bd": 20, "abc": 40, "abd": 20}
    assert max(most) <= 6
