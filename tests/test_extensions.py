"""Geometry and extensions against plain Python."""

import hmac
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gristmill.functions import compat, shapes
from gristmill.functions import extensions as ex
from gristmill.sql import Session, translate


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def text(s):
    return F.lit(s).cast("string")


def test_polygons(spark):
    """A polygon with a notch: points against the count of crossings in plain Python, area against the notch's."""
    corners = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    polygon = F.array(*[shapes.point(F.lit(x), F.lit(y)) for x, y in corners])
    rng = random.Random(1)
    points = [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(300)] + [(5.0, 4.0), (0.0, 5.0), (5.0, 0.0), (5.0, 5.0)]

    def inside(x, y):
        sides = list(zip(corners, corners[1:] + corners[:1], strict=True))
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides) % 2 == 1

    got = spark.createDataFrame(points, "x double, y double").select("x", "y", shapes.polygon_has_point(polygon, shapes.point(F.col("x"), F.col("y"))).alias("i")).collect()
    assert [r.i for r in got[:300]] == [inside(r.x, r.y) for r in got[:300]]
    assert [r.i for r in got[300:]] == [True, True, True, False]
    p = lambda x, y: shapes.point(F.lit(float(x)), F.lit(float(y)))
    assert one(spark, shapes.polygon_area(polygon), shapes.segments_meet(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), shapes.segments_meet(p(0, 0), p(1, 1), p(2, 2), p(3, 3)), shapes.segments_meet(p(0, 0), p(2, 2), p(1, 1), p(3, 3))) == (70.0, True, False, True)
    assert one(spark, shapes.box_intersection(shapes.box(p(0, 0), p(1, 1)), shapes.box(p(2, 2), p(3, 3)))) == (None,)


def test_cubes_and_intervals(spark):
    c = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    a, b = shapes.cube(c(0, 4, 0), c(2, 0, 1)), shapes.cube(c(5, 8, 0))
    assert one(spark, shapes.cube_distance(a, b), shapes.cube_size(a), shapes.cube_contains(shapes.cube_union(a, b), b), shapes.cube_size(shapes.cube_enlarge(a, -1.0))) == (5.0, 8.0, True, 0.0)
    whole, part = shapes.seg(F.lit(None), F.lit(5.0)), shapes.seg(F.lit(1.0), F.lit(2.0))
    assert one(spark, shapes.seg_contains(whole, part), shapes.seg_left(part, shapes.seg(F.lit(3.0), F.lit(None)))) == (True, True)


@pytest.mark.parametrize("at", [(0.0, 0.0), (60.0, -179.5), (-89.0, 10.0), (45.0, 179.0)])
def test_places_near(spark, at):
    """The box in degrees loses no place within the distance."""
    rng = random.Random(2)
    rows = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(3000)]
    lat, lon = F.col("lat"), F.col("lon")
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("near", shapes.earth_distance(lat, lon, F.lit(at[0]), F.lit(at[1])) <= 3e6)
    assert df.filter("near").count() > 50
    assert df.filter("near").filter(~shapes.near_in_degrees(lat, lon, at, 3e6)).count() == 0


def test_arrays(spark):
    a = F.array(*[F.lit(x) for x in (3, 3, None, None, 3, 1)])
    n = F.array(*[F.lit(x) for x in (1, 2, 3, 4)])
    assert one(spark, ex.uniq(a), ex.subarray(n, 2), ex.subarray(n, -3, 2), ex.subarray(n, 1, -1), ex.subarray(n, 9)) == ([3, None, 3, 1], [2, 3, 4], [2, 3], [1, 2, 3], [])
    assert one(spark, ex.int_matches(n, "(1|9)&!7"), ex.int_matches(n, "9")) == (True, False)
    with pytest.raises(ValueError):
        ex.int_matches(n, "1 & | 2")


def test_keyed_texts(spark):
    m = ex.hstore(text(r'a=>1, "b c" => "x, \"y\" => z", n=>NULL, q=>"NULL", a=>2'))
    assert one(spark, m, ex.hstore_text(m)) == ({"a": "1", "b c": 'x, "y" => z', "n": None, "q": "NULL"}, r'"a"=>"1", "b c"=>"x, \"y\" => z", "n"=>NULL, "q"=>"NULL"')
    assert one(spark, F.map_entries(ex.hstore(ex.hstore_text(m))) == F.array_sort(F.map_entries(m)), ex.hstore_defined(m, text("n")), ex.hstore_contains(m, ex.hstore(text("n=>NULL"))), ex.hstore(text(""))) == (True, False, True, {})


def test_label_paths(spark):
    path = text("top.Science.astro_physics.stars")
    cases = {"top.*": True, "*.stars": True, "top.*{1}.stars": False, "top.*{2}.stars": True, "*.science@.*": True, "*.science.*": False, "*.astro%.*": True, "*.astr%.*": False, "*.astr*.*": True, "*.!moons": True, "*{,3}": False, "*{4}": True, "top.Science|Arts.*{1,2}": True, "top.!Science.*": False}
    assert dict(zip(cases, one(spark, *[ex.ltree_matches(path, q) for q in cases]), strict=True)) == cases
    assert one(spark, ex.ltree_index(path, text("astro_physics.stars")), ex.ltree_index(path, text("a")), ex.ltree_lca(path, text("top.Science.x")), ex.ltree_lca(path, text("top.Science")), ex.ltree_lca(text("a.b"), text("c.d"))) == (2, -1, "top.Science", "top", "")
    with pytest.raises(ValueError):
        ex.lquery_pattern("a.*{x}")


def test_product_numbers(spark):
    cases = {"4006381333931": "4006381333931", "4006381333930": None, "0-306-40615-2": "9780306406157", "080442957X": "9780804429573", "0378-5955": "9770378595002", "036000291452": "0036000291452", "M-060-11561-5": "9790060115615", "nothing": None, "": None}
    assert dict(zip(cases, one(spark, *[ex.ean13(text(s)) for s in cases]), strict=True)) == cases
    assert one(spark, ex.isbn10(text("978-0-8044-2957-3")), ex.isbn10(text("4006381333931")), ex.ean13(text(None))) == ("080442957X", None, None)


@pytest.mark.parametrize("kind", ["md5", "sha1", "sha224", "sha256", "sha384", "sha512"])
def test_digests(spark, kind):
    for key in (b"", b"key", b"k" * 300):
        assert one(spark, ex.hmac(F.lit(b"text"), key, kind))[0] == hmac.new(key, b"text", kind).digest()


def test_name_identifiers(spark):
    for name in ("", "example.org", "zażółć"):
        assert one(spark, ex.name_uuid("dns", text(name)), ex.name_uuid("url", text(name), 3)) == (str(uuid.uuid5(uuid.NAMESPACE_DNS, name)), str(uuid.uuid3(uuid.NAMESPACE_URL, name)))


def test_xml(spark):
    cases = {"<a/>": True, "<a>x<b/></a><!-- <c> -->": True, "<?xml version='1.0'?> <a>x</a> ": True, "x<a/>": False, "<a/><b/>": False, "<a>": False, "": False, "</a><a>": False}
    assert dict(zip(cases, one(spark, *[ex.is_document(text(s)) for s in cases]), strict=True)) == cases
    assert one(spark, ex.xml_concat(text(None), text(None)), ex.xml_concat(text("<a/>"), text(None)), ex.xml_pi("x")) == (None, "<a/>", "<?x?>")
    with pytest.raises(Exception, match="comment"):
        one(spark, ex.xml_comment(text("a--b")))


def test_dictionaries(spark):
    read = lambda s: ex.lexize(compat.words(text(s)), ("the",), {"auto": "car"}, {"new york": "nyc"})
    assert one(spark, read("the new new york auto new"), read(""), read("new york"), read("york new")) == (["new", "nyc", "car", "new"], [], ["nyc"], ["york", "new"])


def test_own_types(spark):
    assert one(spark, ex.enum_order(text("ok"), ["sad", "ok"]), ex.enum_order(text(None), ["sad"]), ex.domain(F.lit(3), F.lit(3) > 2, "big"), ex.domain(F.lit(3), F.lit(None).cast("boolean"), "big")) == (2, None, 3, 3)
    with pytest.raises(Exception, match="invalid label"):
        one(spark, ex.enum_order(text("new"), ["sad", "ok"]))
    with pytest.raises(Exception, match="violates"):
        one(spark, ex.domain(F.lit(1), F.lit(1) > 2, "big"))


def test_dialect_functions(spark):
    s = Session(spark)
    assert tuple(s.sql("SELECT regexp_replace('banana', 'a(.)', '<\\1>'), regexp_replace('banana', 'A', 'o', 'gi'), regexp_replace('xyz', 'a', 'b'), ltrim('xxabx', 'x'), rtrim('xxabx', 'x'), ltrim('  a'), log(100), strpos('abc', 'c')").first()) == ("b<n>ana", "bonono", "xyz", "abx", "xxab", "a", 2.0, 3)
    s.create_function("apart", "a INT, b INT", "INT", "abs(a - b)")
    s.create_operator("<->", "apart")
    s.create_cast("far", "apart_from_ten")
    s.create_function("apart_from_ten", "a INT", "INT", "abs(a - 10)")
    assert tuple(s.sql("SELECT 3 <-> 10, (2 + 1)::far, '<->', 5 < -1").first()) == (7, 7, "<->", False)
    with pytest.raises(ValueError):
        s.create_operator("--", "apart")
    assert "log10" not in translate("SELECT t.log(x) FROM t")


def test_transaction(spark, tmp_path):
    from gristmill.operators.tables import Transaction, scratch

    with scratch(spark) as a, scratch(spark) as b:
        spark.range(5).write.saveAsTable(a)
        work = Transaction(spark)
        work.put(a, work.table(a).filter("id < 2"))
        assert work.table(a).count() == 2 and spark.table(a).count() == 5
        work.savepoint("s")
        work.put(b, spark.range(7))
        work.rollback_to("s")
        with pytest.raises(Exception, match="not found|cannot be found"):
            work.table(b).count()
        work.release("s")
        with pytest.raises(ValueError):
            work.rollback_to("s")
        # a version that fails while it is written leaves all tables as they were
        work.put(b, spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id")))
        with pytest.raises(Exception, match="broken"):
            work.commit()
        assert spark.table(a).count() == 5 and not spark.catalog.tableExists(b)
        work.put(b, spark.range(3))
        work.commit()
        assert spark.table(a).count() == 2 and spark.table(b).count() == 3
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith((a + "_", b + "_"))]


def test_scroll_cursor(spark, tmp_path):
    from gristmill.streaming.cursors import ScrollCursor

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    c = ScrollCursor(spark.range(10).withColumn("_nth", F.lit("x")), [F.desc("id")])
    ids = lambda rows: [r.id for r in rows]
    assert ids(c.forward(3)) == [9, 8, 7] and ids(c.backward()) == [8] and ids(c.relative(4)) == [4]
    assert c.move(-2) == 2 and c.at == 4 and c.move(100) == 6 and ids(c.forward()) == [] and ids(c.backward(2)) == [0, 1]
    assert ids(c.absolute(-1)) == [0] and ids(c.absolute(0)) == [] and ids(c.absolute(11)) == [] and ids(c.absolute(1)) == [9]
    assert ids(c.backward(5)) == [] and c.at == 0 and ids(c.forward(0)) == [] and c.forward(1)[0]._nth == "x"
    empty = ScrollCursor(spark.range(0), [F.asc("id")])
    assert empty.forward(2) == [] and empty.absolute(-1) == []


def test_cluster_views(spark, tmp_path):
    from gristmill.operators import fcm

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    points = spark.createDataFrame([(i, [float(i % 2 * 10 + i / 10), 1.0]) for i in range(8)], "i long, x array<double>")
    rated, centres, log = fcm.fuzzy_c_means(points, 2, 2)
    steps = fcm.protocol(spark, log).orderBy("s").collect()
    assert [r.s for r in steps] == list(range(1, len(log) + 1)) and {(r.d, r.k, r.n) for r in steps} == {(2, 2, 8)} and all(r.runtime > 0 for r in steps)
    v = fcm.views(rated, centres)
    assert {k: x.count() for k, x in v.items()} == {"SH": 8, "SV": 16, "U": 16, "C": 4, "SD": 16}
    near = {r.i: r.j for r in v["SD"].groupBy("i").agg(F.min_by("j", "dist").alias("j")).collect()}
    most = {r.i: r.j for r in v["U"].groupBy("i").agg(F.max_by("j", "val").alias("j")).collect()}
    assert near == most and len(set(near.values())) == 2


def test_crosstab_by_place(spark):
    from gristmill.operators import relational

    rows = spark.createDataFrame([("a", 2, "y", 0), ("a", 1, "x", 0), ("a", 3, "z", 0), (None, 1, "n", 0), ("b", 1, None, 0)], "k string, at int, v string, _place int")
    got = {r.k: (r.c1, r.c2) for r in relational.crosstab_by_place(rows, "k", ["at"], "v", 2).collect()}
    assert got == {"a": ("x", "y"), None: ("n", None), "b": (None, None)}
    assert relational.crosstab_by_place(rows.limit(0), "k", ["at"], "v", 2).collect() == []
