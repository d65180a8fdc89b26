"""Every query with an oracle gives the oracle's rows on the smallest data."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gristmill.operators import fcm, series
from gristmill.plans.common import TABLES

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if n[0] in "qrms" and n[1].isdigit()]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    assert got == sorted(tuple(norm(r[order.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fuzzy_c_means(spark):
    """The query against numpy on whole embeddings, from the same start to the same end."""
    raw = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").alias("x"))
    begun = fcm.start(raw, 4).orderBy("i").collect()
    x, u = np.array([r.x for r in begun], float), np.array([r.u for r in begun])
    assert x.shape[1] == 64
    for _ in range(1000):
        w = u**2
        c = (w.T @ x) / w.sum(0)[:, None]
        p = ((x[:, None] - c) ** 2).sum(2) ** -2.0
        u, before = p / p.sum(1, keepdims=True), u
        if abs(u - before).max() < 1e-4:
            break
    got = {(r.i, r.j): r.val for r in entry.queries()["m08_fuzzy_c_means"](spark, DATA).collect()}
    assert len(got) == u.size and np.allclose(u, [[got[r.i, j] for j in range(4)] for r in begun], atol=1e-6)


def test_event_series(spark, duck):
    """The queries against numpy on all events."""
    v = np.array([r[0] for r in duck.execute("SELECT value::DOUBLE FROM events ORDER BY ts, event_id").fetchall()])
    assert len(v) == 1000
    z = np.lib.stride_tricks.sliding_window_view((v - v.mean()) / v.std(ddof=1), 24)
    at = np.arange(len(z))
    nn = np.array([((z[abs(at - k) >= 24] - z[k]) ** 2).sum(1).min() for k in at])
    got = entry.queries()["m09_event_discord"](spark, DATA).first()
    assert got.pos == nn.argmax() and abs(got.distance - nn.max() ** 0.5) < 1e-5
    q = series.znorm(np.array([min(k, 23 - k) for k in range(24)], float))
    d = series.banded_dtw(q, series.znorm(np.lib.stride_tricks.sliding_window_view(v, 24)), 2)
    got = entry.queries()["m07_best_match"](spark, DATA).first()
    assert got.pos == d.argmin() and abs(got.distance - d.min() ** 0.5) < 1e-9
