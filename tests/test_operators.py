import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import aggregates, compat, values
from gristmill.functions import formatting as fm
from gristmill.operators import fcm, graphs, itemsets, relational, series, tables
from gristmill.sources import readers
from gristmill.sql import Session, translate
from gristmill.streaming.cursors import Cursor


def test_limit_offset(spark):
    df = spark.range(10).orderBy("id")
    assert [r.id for r in relational.limit_offset(df, None, 7).collect()] == [7, 8, 9]
    assert relational.limit_offset(df, 3, None).count() == 3
    with pytest.raises(ValueError):
        relational.limit_offset(df, -1)


def test_sort_nulls_are_largest(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in relational.sort(df, ("x", True)).collect()] == [1, 3, None]
    assert [r.x for r in relational.sort(df, ("x", False)).collect()] == [None, 3, 1]


def test_recursive_union_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    out = relational.recursive_union(spark.createDataFrame([(1,)], "n long"), lambda w: w.join(e, F.col("n") == F.col("a")).select(F.col("b").alias("n")))
    assert sorted(r.n for r in out.collect()) == [1, 2, 3]


def test_connect_by(spark):
    rows = [("row1", None), ("row2", "row1"), ("row3", "row1"), ("row4", "row2"), ("row5", "row2"), ("row6", "row4"), ("row7", "row3"), ("row8", "row6"), ("row9", "row5")]
    df = spark.createDataFrame(rows, "k string, p string")
    got = {r.key: (r.level, r.branch) for r in relational.connect_by(df, "k", "p", "row2").collect()}
    assert got["row8"] == (3, "row2~row4~row6~row8") and "row3" not in got and len(got) == 6
    assert relational.connect_by(df, "k", "p", "row2", 1).count() == 3
    with pytest.raises(Exception, match="infinite recursion"):
        relational.connect_by(spark.createDataFrame([("a", "b"), ("b", "a")], "k string, p string"), "k", "p", "a").collect()


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, relational.update_from(t, spark.createDataFrame([(2, "z")], "k int, v string"), "k").collect())) == [(1, "a"), (2, "z")]
    assert sorted(map(tuple, relational.update_from(t, spark.createDataFrame([(2, None)], "k int, v string"), "k").collect())) == [(1, "a"), (2, None)]
    several = spark.createDataFrame([(2, "y"), (2, "x"), (9, "n")], "k int, v string")
    new, hit = relational.update_returning(t.withColumn("_change", F.lit(1)), several, "k")
    assert sorted(map(tuple, new.collect())) == [(1, "a", 1), (2, "x", 1)] and [tuple(r) for r in hit.collect()] == [(2, "x", 1)]
    grown, added = relational.insert_returning(t, spark.createDataFrame([(5,)], "k int"))
    assert grown.count() == 3 and [tuple(r) for r in added.collect()] == [(5, None)]
    odd = spark.createDataFrame([(1, 2, "n"), (1, 1, "m")], "k int, o int, _nth string")
    assert [tuple(r) for r in relational.distinct_on(odd, ["k"], [F.asc("o")]).collect()] == [(1, 1, "m")]
    rows = relational.numbered(spark.range(500).withColumn("_part", F.lit("p")).repartition(7), [F.desc("id")], "n").collect()
    assert {(r.id, r.n, r._part) for r in rows} == {(i, 500 - i, "p") for i in range(500)}
    kept, gone = relational.delete_using(t, spark.createDataFrame([(1,)], "k int"), "k")
    assert [r.k for r in kept.collect()] == [2] and [r.k for r in gone.collect()] == [1]


BUTTERFLY = [(0, 0), (0, 2), (0, 4), (1, 1), (1, 2), (1, 3), (2, 2), (3, 2), (4, 2), (5, 1), (5, 2), (5, 3), (6, 0), (6, 2), (6, 4)]


def test_fuzzy_c_means(spark):
    pts = spark.createDataFrame([(i + 1, [float(a), float(b)]) for i, (a, b) in enumerate(BUTTERFLY)], "i int, x array<double>")
    rated, c, log = fcm.fuzzy_c_means(pts, d=2, k=2, m=2.0, eps=1e-9, itermax=25)
    x = np.array(BUTTERFLY, float)
    u0 = np.array([r.u for r in fcm.start(pts, 2).orderBy("i").collect()])
    for _ in range(len(log)):
        w = u0**2
        cc = (w.T @ x) / w.sum(0)[:, None]
        d = ((x[:, None] - cc) ** 2).sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = d**-2.0
            u0 = np.where((d == 0).any(1, keepdims=True), (d == 0) / np.maximum(1, (d == 0).sum(1, keepdims=True)), p / p.sum(1, keepdims=True))
    assert np.allclose(cc, c) and np.allclose(u0, [r.u for r in rated.orderBy("i").collect()])
    assert sorted(round(v[0]) for v in c) == [1, 5]
    assert [r.x for r in fcm.to_horizontal(fcm.to_vertical(pts).withColumnRenamed("l", "l"), 2).orderBy("i").collect()] == [list(map(float, p)) for p in BUTTERFLY]


def two_cliques(spark):
    e = [(a, b, 1.0) for a, b in itertools.combinations(range(4), 2)] + [(a, b, 1.0) for a, b in itertools.combinations(range(4, 8), 2)] + [(3, 4, 0.1)]
    return spark.createDataFrame(e, "a long, b long, w double")


def test_communities(spark):
    e = two_cliques(spark)
    found = {r.a: r.c for r in graphs.label_propagation(e, 2).collect()}
    assert len({found[k] for k in range(3)}) == 1 and len({found[k] for k in range(5, 8)}) == 1
    each = spark.createDataFrame([(a, a) for a in range(8)], "a long, c long")
    assert graphs.consolidate(e, each, 2).select("c").distinct().count() == 2


def brute_refine(rows, part):
    part = dict(part)
    side = 0
    while True:
        gain = {v: sum(w if part[a] != part[b] else -w for a, b, w in rows if v in (a, b)) for v in part}
        best = min((v for v in part if part[v] == side), key=lambda v: (-gain[v], v), default=None)
        if best is None or gain[best] <= 0:
            return part
        part[best], side = 1 - side, 1 - side


def test_partitioning_brute(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(int(a), int(b)): float(w) for a, b, w in rng.integers(0, 30, (120, 3)) if a < b and w}.items())
    rows = [(a, b, w) for (a, b), w in rows]
    e = spark.createDataFrame(rows, "a long, b long, w double")
    part = {v: int(rng.integers(0, 2)) for v in sorted({x for a, b, _ in rows for x in (a, b)})}
    got = graphs.refine(e, spark.createDataFrame(list(part.items()), "a long, p int")).collect()
    assert {r.a: r.p for r in got} == brute_refine(rows, part)
    chain = spark.createDataFrame([(i, i + 1, float(i)) for i in range(30)], "a long, b long, w double")
    for g, edges in ((chain, [(i, i + 1) for i in range(30)]), (e, [(a, b) for a, b, _ in rows])):
        used = [v for r in graphs.match(g).collect() for v in (r.a, r.b)]
        assert len(used) == len(set(used)) and all(a in used or b in used for a, b in edges)  # no edge is left
    parts = graphs.bisect(chain, least=8)
    assert sorted(r.a for r in parts.collect()) == list(range(31)) and {r.p for r in parts.collect()} == {0, 1}
    assert graphs.cut_weight(chain, parts).first().w < sum(range(30)) / 3
    with pytest.raises(RuntimeError, match="still change"):
        graphs.label_propagation(spark.createDataFrame([(1, 2, 1.0)], "a long, b long, w double"), 1, rounds=3)


def test_consolidation_brute(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2)) if a < b})
    c = {v: 10 * int(rng.integers(1, 9)) for v in {x for r in rows for x in r}}
    names = {x: k for k, x in enumerate(sorted(set(c.values())), 1)}
    now, new = {v: names[x] for v, x in c.items()}, len(names)
    while len(set(now.values())) > 3:
        inner = {x: sum(now[a] == now[b] == x for a, b in rows) for x in now.values()}
        pairs = {(min(now[a], now[b]), max(now[a], now[b])) for a, b in rows if now[a] != now[b]}
        if not pairs:
            break
        x, y = min(pairs, key=lambda p: (inner[p[0]] + inner[p[1]] + sum({now[a], now[b]} == set(p) for a, b in rows), p))
        new += 1
        now = {v: new if k in (x, y) else k for v, k in now.items()}
    last = {x: k for k, x in enumerate(sorted(set(now.values())), 1)}
    got = graphs.consolidate(spark.createDataFrame([(a, b, 1.0) for a, b in rows], "a long, b long, w double"), spark.createDataFrame(list(c.items()), "a long, c long"), 3)
    assert {r.a: r.c for r in got.collect()} == {v: last[x] for v, x in now.items()}


def test_partitioning(spark):
    e = two_cliques(spark)
    bad = spark.createDataFrame([(a, a % 2) for a in range(8)], "a long, p int")
    rows = e.collect()
    cut = lambda p: sum(r.w for r in rows if p[r.a] != p[r.b])
    before = {r.a: r.p for r in bad.collect()}
    after = {r.a: r.p for r in graphs.refine(e, bad).collect()}
    assert cut(after) < cut(before)
    g = {r.a: r.gain for r in graphs.gains(e, bad).collect()}
    for a in before:
        assert g[a] == pytest.approx(sum((r.w if before[r.a] != before[r.b] else -r.w) for r in rows if a in (r.a, r.b)))
    m = graphs.match(e)
    used = [v for r in m.collect() for v in (r.a, r.b)]
    assert len(used) == len(set(used)) and used
    coarse = graphs.coarsen(e, m)
    assert coarse.filter("a = b").isEmpty()
    parts = spark.createDataFrame([(r.a, r.a % 2) for r in coarse.select("a").union(coarse.select("b")).distinct().collect()], "a long, p int")
    assert graphs.uncoarsen(e, m, parts).count() == 8


def test_itemsets(spark):
    rng = np.random.default_rng(1)
    tx = [sorted({int(x) for x in rng.integers(1, 9, 5)}) for _ in range(60)]
    got = {tuple(r["items"]): r.support for r in itemsets.frequent_itemsets(spark.createDataFrame([(t, i) for t, s in enumerate(tx) for i in s + s[:1]], "tid int, item int"), 8).collect()}
    want = {}
    for k in range(1, 6):
        for c in itertools.combinations(range(1, 9), k):
            n = sum(set(c) <= set(s) for s in tx)
            if n >= 8:
                want[c] = n
    assert got == want


def test_long_itemsets(spark):
    """Every level, to the first without a frequent set."""
    rows = [(t, i) for t in range(2) for i in range(1, 7)] + [(2, None), (3, 99)]
    got = itemsets.frequent_itemsets(spark.createDataFrame(rows, "tid int, item int"), 2)
    assert got.count() == 2**6 - 1 and max(len(r["items"]) for r in got.collect()) == 6
    assert {r.share for r in got.collect()} == {0.5}
    assert itemsets.frequent_itemsets(spark.createDataFrame([], "tid int, item int"), 1).count() == 0


def test_search_by_words(spark):
    rng = np.random.default_rng(6)
    noise = rng.normal(0, 1, 150)
    wave = np.cos(np.arange(700) / 5) + rng.normal(0, 0.02, 700)
    wave[300:320] += 2
    for v, n in ((noise, 12), (wave, 20), (np.cos(np.arange(30)), 20)):
        s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pos long, value double")
        want = series.discord(s, n).collect()
        got = series.discord_sax(s, n, size=100, first=32, most=128).collect()
        assert [r.pos for r in got] == [r.pos for r in want] and np.allclose([r.distance for r in got], [r.distance for r in want])
    w = series.planted(spark, 400, 32, 200)
    assert abs(series.discord_sax(w, 32).first().pos - 200) < 64
    assert series.paa(np.arange(8.0)).tolist() == [0.5, 2.5, 4.5, 6.5] and series.spelled(int(series.words(np.array([-1.0, -0.5, 0.5, 1.0])))) == "abcd"
    assert {r["kind"] for r in [{"kind": k} for k in ("cos", "exp", "linear") if series.planted(spark, 64, 8, kind=k).count() == 64]} == {"cos", "exp", "linear"}


def test_warping_bounds():
    rng = np.random.default_rng(7)
    for n, r in ((6, 1), (12, 3), (25, 0), (3, 1)):
        q, w = series.znorm(rng.normal(0, 1, n)), series.znorm(rng.normal(0, 1, (300, n)))
        exact = series.banded_dtw(q, w, r)
        up, low = series.envelope(q, r)
        keogh = series.lb_keogh(w, up, low)
        wu, wl = series.envelope(w, r)
        for bound in (series.lb_kim(q, w), keogh.sum(1), series.lb_keogh(q[None], wu, wl).sum(1)):
            assert (bound <= exact + 1e-9).all()
        rest = np.concatenate([np.cumsum(keogh[:, ::-1], 1)[:, ::-1], np.zeros((300, 1))], 1)
        limit = np.median(exact)
        given = series.banded_dtw(q, w, r, limit, rest)
        assert np.allclose(given[exact <= limit], exact[exact <= limit]) and (given[exact > limit] > limit).all()
        assert series.best_windows(q, w, r) == (exact.min(), int(exact.argmin()))


def test_series(spark):
    rng = np.random.default_rng(2)
    v = np.cos(np.arange(400) / 3) + 2 + rng.normal(0, 0.05, 400)
    v[200:216] += np.linspace(0, 3, 16)
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pos long, value double")
    n = 16
    z = (v - v.mean()) / v.std(ddof=1)
    w = np.lib.stride_tricks.sliding_window_view(z, n)
    nn = [min(((w[i] - w[j]) ** 2).sum() for j in range(len(w)) if abs(i - j) >= n) for i in range(len(w))]
    for size in (64, 4096):
        got = series.discord(s, n, size).first()
        assert got.pos == int(np.argmax(nn)) and got.distance == pytest.approx(np.sqrt(max(nn)))
    q = list(v[50 : 50 + n] * 2 + 1)
    r = 3

    def dtw(a, b):
        d = np.full((n + 1, n + 1), np.inf)
        d[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(max(1, i - r), min(n, i + r) + 1):
                d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        return np.sqrt(d[n, n])

    every = [dtw(series.znorm(np.array(q)), series.znorm(x)) for x in np.lib.stride_tricks.sliding_window_view(v, n)]
    got = series.best_match(s, q, r, size=50).first()
    assert got.distance == pytest.approx(min(every), abs=1e-9) and got.pos == int(np.argmin(every))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_functions(spark):
    lit = F.lit
    assert one(spark, compat.int_div(lit(-7), lit(2))) == -3
    assert one(spark, compat.round_float(lit(2.5))) == 2.0
    assert one(spark, compat.regexp_replace_first(lit("banana"), "(a)", r"<\1>")) == "b<a>nana"
    assert one(spark, compat.regexp_replace_first(lit("xyz"), "q", "")) == "xyz"
    assert one(spark, compat.similar_to(lit("abc"), "(a|b)_c%")) and not one(spark, compat.similar_to(lit("a.c"), "abc"))
    assert one(spark, compat.similarity(lit("word"), lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, compat.hstore_concat(F.create_map(lit("a"), lit("1")), F.create_map(lit("a"), lit("2")))) == {"a": "2"}
    assert one(spark, compat.ltree_is_ancestor(lit("Top.Science"), lit("Top.Science.Astronomy")))
    assert one(spark, compat.ltree_subpath(lit("a.b.c.d"), 1, 2)) == "b.c"
    assert one(spark, compat.matches(lit("The quick brown fox"), "quick & (cat | fox) & !dog"))
    assert one(spark, compat.trunc(lit(-2.7))) == -2
    assert one(spark, compat.dow(F.to_date(lit("2024-01-07")))) == 0
    with pytest.raises(Exception, match="logarithm"):
        one(spark, compat.ln(lit(0.0)))
    got = spark.createDataFrame([(1,), (None,)], "v int").agg(compat.array_agg(F.col("v")).alias("x")).first().x
    assert len(got) == 2 and None in got


def test_xml(spark):
    lit = F.lit
    assert one(spark, compat.xml_element("a")) == "<a/>"
    assert one(spark, compat.xml_element("a", {"x": lit('1"<'), "y": lit(None)}, compat.xml_text(lit("b & c")))) == '<a x="1&quot;&lt;">b &amp; c</a>'
    assert one(spark, compat.xml_forest(p=lit(1), q=lit(None), r=lit("z"))) == "<p>1</p><r>z</r>"
    assert one(spark, compat.split_part(lit("a,b"), ",", 3)) == ""


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b'), (2, None)], "k int, v string")
    readers.copy_to(df, str(tmp_path / "csv"), csv=True, header=True)
    back = readers.copy_from(spark, str(tmp_path / "csv"), "k int, v string", csv=True, header=True)
    assert sorted(map(tuple, back.collect())) == [(1, 'a,"b'), (2, None)]
    (tmp_path / "t.txt").write_text("1 2 3 \n2 2\n")
    assert readers.transactions(spark, str(tmp_path / "t.txt")).count() == 4
    np.arange(10, dtype="<f4").tofile(tmp_path / "s.bin")
    assert [(r.pos, r.value) for r in readers.series_binary(spark, str(tmp_path / "s.bin")).orderBy("pos").collect()] == [(i, float(i)) for i in range(10)]
    (tmp_path / "s.txt").write_text("\n".join(map(str, range(20))))
    assert [r.value for r in readers.series_text(spark, str(tmp_path / "s.txt")).orderBy("pos").collect()] == list(map(float, range(20)))


def test_cursor(spark):
    c = Cursor(spark.range(5).orderBy("id"))
    assert [r.id for r in c.fetch(2)] == [0, 1] and c.move(1) == 1 and [r.id for r in c.fetch(9)] == [3, 4]


def test_formatting(spark):
    t = F.lit("2001-04-05 15:06:07.089").cast("timestamp")
    for form, want in {"YYYY-MM-DD HH24:MI:SS.MS": "2001-04-05 15:06:07.089", "HH12:MI pm": "03:06 pm", 'Day, DD "of" FMMonth': "Thursday , 05 of April", "DAY|day|Dy": "THURSDAY |thursday |Thu", "FMDD.FMMM.YY Q WW J": "5.4.01 2 14 2452005", "SSSS US": "54367 089000", "CC D": "21 5"}.items():
        assert one(spark, fm.to_char_time(t, form)) == want, form
    cases = {(485, "999"): " 485", (-485, "999"): "-485", (485, "99"): " ##", (0.1, "99.99"): "   .10", (0.1, "0.9"): " 0.1", (-0.1, "FM99.99"): "-.1", (1485, "9,999"): " 1,485", (12, "9,999"): "    12", (485, "999MI"): "485 ", (-485, "999MI"): "485-", (-485, "FM999MI"): "485-", (485, "S999"): "+485", (-12, "999PR"): " <12>", (148.5, "999.999"): " 148.500", (148.5, "FM999.990"): "148.500", (12, "0009"): " 0012", (485, "999S"): "485+"}
    for (x, form), want in cases.items():
        assert one(spark, fm.to_char_number(F.lit(x), form)) == want, (x, form)
    assert one(spark, fm.to_number(F.lit("-12,454.8"), "99G999D9")) == __import__("decimal").Decimal("-12454.8")
    assert str(one(spark, fm.to_date(F.lit("05 Dec 2000"), "DD Mon YYYY"))) == "2000-12-05"
    a = one(spark, fm.age(F.lit("2001-04-10").cast("timestamp"), F.lit("1957-06-13").cast("timestamp")))
    assert (a.years, a.months, a.days, a.seconds) == (43, 9, 27, 0)
    d = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, fm.overlaps(d("2001-02-16"), d("2001-12-21"), d("2001-10-30"), d("2002-10-30")))
    assert not one(spark, fm.overlaps(d("2001-02-16"), d("2001-03-01"), d("2001-03-01"), d("2002-10-30")))
    assert str(one(spark, fm.add_interval(d("2024-01-31 10:00:00"), 1, 1, 30))) == "2024-03-01 10:00:30"
    assert str(one(spark, fm.at_time_zone(d("2024-07-01 12:00:00"), "Europe/Berlin"))) == "2024-07-01 14:00:00"


def test_values(spark):
    lit = F.lit
    assert one(spark, values.bit_xor(lit("10001"), lit("01101"))) == "11100" and one(spark, values.bit_shift(lit("10001"), 3)) == "01000" and one(spark, values.bit_shift(lit("10001"), -2)) == "00100"
    with pytest.raises(Exception, match="different sizes"):
        one(spark, values.bit_and(lit("1"), lit("10")))
    assert one(spark, values.network(lit("192.168.1.5/24"))) == "192.168.1.0/24" and one(spark, values.broadcast(lit("192.168.1.5/24"))) == "192.168.1.255/24"
    assert one(spark, values.contained(lit("192.168.1/25"), lit("192.168.1/24"))) and not one(spark, values.contained(lit("192.168.1/24"), lit("192.168.1/24")))
    assert one(spark, values.host(lit("10.1.2.3/8"))) == "10.1.2.3" and one(spark, values.masklen(lit("10.1.2.3"))) == 32
    assert one(spark, values.uuid(lit("{A0EEBC999C0B4EF8BB6D6BB9BD380A11}"))) == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"
    with pytest.raises(Exception, match="invalid"):
        one(spark, values.uuid(lit("x")))
    assert one(spark, values.encode(lit(bytearray(b"a\\b\0\xff")), "escape")) == "a\\\\b\\000\\377"
    assert bytes(one(spark, values.convert(lit(bytearray("é".encode())), "UTF-8", "ISO-8859-1"))) == b"\xe9"
    assert one(spark, values.quote_literal(lit("O'Reilly"))) == "'O''Reilly'" and one(spark, values.quote_nullable(lit(None).cast("string"))) == "NULL" and one(spark, values.quote_ident(lit("Foo bar"))) == '"Foo bar"'
    assert one(spark, values.initcap(lit("hi THOMAS-lee"))) == "Hi Thomas-Lee"
    assert one(spark, values.regexp_matches(lit("foobarbequebaz"), "(bar)(beque)")) == [["bar", "beque"]] and one(spark, values.regexp_matches(lit("x"), "y")) == []
    assert one(spark, values.difference(lit("Anne"), lit("Andrew"))) == 2
    assert one(spark, values.headline(lit("The cat and the category"), ["cat"])) == "The <b>cat</b> and the category"
    df = spark.createDataFrame([(i % 2, i if i else None) for i in range(3000)], "k int, v int")
    got = aggregates.fold(df, ["k"], F.col("v"), F.lit(0), lambda s, v: s + v, lambda s: s * 10, combine=lambda a, b: a + b)
    assert {r.k: r.value for r in got.collect()} == {k: 10 * sum(range(k, 3000, 2)) for k in (0, 1)}


def test_dialect(spark):
    s = Session(spark)
    assert [tuple(r) for r in s.sql("SELECT 7 / 2, 2 ^ 3 ^ 2, 5 # 3, -7 / 2, 'a/b ^ $1' , (1 + 3) / 2 -- x / y").collect()] == [(3, 64, 6, -3, "a/b ^ $1", 2)]
    s.prepare("p", "SELECT id FROM range(10) WHERE id > $1 AND id <> ALL (ARRAY[7, $2]) ORDER BY id DESC LIMIT ALL")
    assert [r.id for r in s.execute("p", 5, 9).collect()] == [8, 6]
    s.deallocate("p")
    with pytest.raises(KeyError):
        s.execute("p", 1, 2)
    assert "NULLS LAST" in translate("SELECT a FROM t ORDER BY a") and "NULLS FIRST" in translate("SELECT rank() OVER (ORDER BY a DESC) FROM t")
    assert translate("SELECT a !~* 'x' FROM t") == "SELECT a NOT RLIKE concat ('(?i)', 'x') FROM t"


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "a")], "k int, v string")
    with tables.scratch(spark) as name:
        assert relational.create_table_as(df, name, ["k"]).count() == 3
        with pytest.raises(Exception, match="exists"):
            relational.create_table_as(df, name)
        assert relational.swap_table(df.limit(1), name).count() == 1
        assert tables.columns(spark).filter(F.col("table_name") == name).count() == 2
    bad = {r.constraint: r.n for r in relational.violations(df, ("k",), ("v",), {"k": "k > 1"}, {"k": (df.filter("k = 1"), "k")}).collect()}
    assert bad == {"not null k": 1, "unique v": 2, "check k": 1, "foreign key k": 1}
    stats = {r.column: r for r in relational.sample_statistics(df, 1.0).collect()}
    assert stats["k"].null_frac == pytest.approx(1 / 3) and stats["v"].most_common[0].value == "a" and stats["v"].n_distinct == 2
    df.write.json(str(tmp_path / "j"))
    assert tables.foreign_table(spark, "far_rows", "json", "k int, v string", path=str(tmp_path / "j")).count() == 3
    assert [d.first()[0] for d in tables.fan_out([spark, spark.newSession()], "SELECT 1")] == [1, 1] and tables.fan_out([], "x") == []
    got = relational.fragments(df, "k", 2).select("node", F.spark_partition_id().alias("p"), "k").collect()
    assert {r.k: r.node for r in got} == {3: 1, 1: 1, None: 0}


def test_more_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc\\d"), (2, None), (3, "")], "k int, v string")
    readers.copy_to(df, str(tmp_path / "text"))
    assert sorted(map(tuple, readers.copy_from(spark, str(tmp_path / "text"), "k int, v string").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    readers.copy_to(df.withColumn("k", F.lit("a|b\\")), str(tmp_path / "bar"), delimiter="|")
    assert {tuple(r) for r in readers.copy_from(spark, str(tmp_path / "bar"), "k string, v string", delimiter="|").collect()} == {("a|b\\", r.v) for r in df.collect()}
    with pytest.raises(Exception, match="number of fields"):
        readers.copy_from(spark, str(tmp_path / "text"), "k int").collect()
    (tmp_path / "e.csv").write_text("1,2,0.5\n2,3,1\n")
    (tmp_path / "p.csv").write_text("1,0\n2,1\n")
    assert [tuple(r) for r in readers.edges(spark, str(tmp_path / "e.csv")).collect()] == [(1, 2, 0.5), (2, 3, 1.0)]
    assert [tuple(r) for r in readers.partition_table(spark, str(tmp_path / "p.csv")).collect()] == [(1, 0), (2, 1)]
    (tmp_path / "b").write_bytes(b"\0\xffblob")
    assert bytes(readers.blobs(spark, str(tmp_path / "b")).first().content) == b"\0\xffblob"
