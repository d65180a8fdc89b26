"""Queries that apply the engine's own operators to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import compat
from gristmill.operators import fcm, graphs, itemsets, relational, series
from gristmill.plans.common import load
from gristmill.sources import readers

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@register("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def r01_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_on(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("SELECT coalesce(a.r, b.r) AS row_number, r_name, n_name FROM (SELECT row_number() OVER (ORDER BY r_name) AS r, r_name FROM region) a FULL JOIN (SELECT row_number() OVER (ORDER BY n_name) AS r, n_name FROM nation) b ON a.r = b.r")
def r02_zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = load(spark, sf_dir, "region").select("r_name"), load(spark, sf_dir, "nation").select("n_name")
    return relational.zip_join(a, b, [F.asc("r_name")], [F.asc("n_name")]).select("row_number", "r_name", "n_name")


@register("SELECT p_partkey FROM part WHERE p_size BETWEEN least(30, 10) AND greatest(30, 10)")
def r03_between_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").filter(relational.between_symmetric(F.col("p_size"), F.lit(30), F.lit(10))).select("p_partkey")


@register("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000000 + l_partkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    t AS (SELECT (SELECT min(a) FROM e) AS n UNION SELECT s.b FROM t JOIN s ON s.a = t.n) SELECT n::BIGINT AS n FROM t""")
def r04_recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers and parts that orders connect with the first customer."""
    lines = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = lines.select(F.col("o_custkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b")).distinct()
    both = e.union(e.select("b", "a")).checkpoint()
    return relational.recursive_union(e.agg(F.min("a").alias("n")), lambda w: w.join(both, F.col("n") == F.col("a")).select(F.col("b").alias("n")))


@register("SELECT c_custkey, c_nationkey, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def r05_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return relational.update_from(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), new, "c_custkey")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def r06_delete_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.delete_using(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), doomed, "c_custkey")[0]


@register("SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def r07_insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return relational.insert_rows(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), rows)


@register("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def r08_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return relational.inherit(parent, load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal"))


@register("SELECT o_custkey, max(n) FILTER (o_orderstatus = 'F') AS F, max(n) FILTER (o_orderstatus = 'O') AS O, max(n) FILTER (o_orderstatus = 'P') AS P FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def r09_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return relational.crosstab(counts, "o_custkey", "o_orderstatus", "n", ["F", "O", "P"])


@register("""WITH RECURSIVE t AS (SELECT p_partkey AS key, NULL::BIGINT AS parent, 0 AS level, p_partkey::VARCHAR AS branch FROM part WHERE p_partkey = 1
    UNION ALL SELECT p.p_partkey, p.p_partkey // 3, level + 1, branch || '~' || p.p_partkey FROM t JOIN part p ON p.p_partkey // 3 = t.key WHERE p.p_partkey > 2) SELECT key, parent, level, branch FROM t""")
def r10_connect_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = load(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CASE WHEN p_partkey > 2 THEN p_partkey div 3 END AS up")
    return relational.connect_by(tree, "k", "up", 1)


@register("SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(small|red).*')")
def r11_similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").filter(compat.similar_to(F.col("p_name"), "(small|red)%")).select("p_partkey")


@register("SELECT p_partkey, regexp_replace(p_name, '([aeiou])', '<\\1>') AS name FROM part")
def r12_regexp_replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", compat.regexp_replace_first(F.col("p_name"), "([aeiou])", r"<\1>").alias("name"))


@register("SELECT p_partkey, (round_even(p_retailprice, 0))::INTEGER AS r, trunc(p_retailprice - 1000) AS t, CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 7 ELSE floor((p_size - 10.0) / 30 * 6) + 1 END::BIGINT AS b FROM part")
def r13_number_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    return load(spark, sf_dir, "part").select("p_partkey", compat.to_int(p).alias("r"), compat.trunc(p - 1000).cast("double").alias("t"), compat.width_bucket(F.col("p_size"), 10.0, 40.0, 6).alias("b"))


@register("""WITH w AS (SELECT DISTINCT p_name AS s, unnest(string_split(p_name, ' ')) AS w FROM part),
    g AS (SELECT DISTINCT s, substr('  ' || w || ' ', i, 3) AS t FROM w, range(1, 100) r(i) WHERE i <= length(w) + 1),
    c AS (SELECT s, count(*) AS n FROM g GROUP BY s), k AS (SELECT count(*) AS n FROM (SELECT DISTINCT substr('  ' || x || ' ', i, 3) AS t FROM (VALUES ('red'), ('ring')) v(x), range(1, 100) r(i) WHERE i <= length(x) + 1))
    SELECT g.s AS name, round(count(q.t) / (any_value(c.n) + (SELECT n FROM k) - count(q.t))::DOUBLE, 9) AS sim FROM g JOIN c USING (s)
    LEFT JOIN (SELECT DISTINCT substr('  ' || x || ' ', i, 3) AS t FROM (VALUES ('red'), ('ring')) v(x), range(1, 100) r(i) WHERE i <= length(x) + 1) q ON q.t = g.t GROUP BY g.s""")
def r14_trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("name"), F.round(compat.similarity(F.col("p_name"), F.lit("red ring")), 9).alias("sim"))


@register(r"""SELECT doc_id FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents) WHERE list_contains(w, 'license') AND NOT list_contains(w, 'zebra')""")
def r15_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter(compat.matches(F.col("text"), "license & !zebra")).select("doc_id")


GRAPH = "SELECT o_custkey AS a, 1000000 + l_suppkey AS b, count(*)::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the suppliers of their orders' lines."""
    lines = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))


@register(f"""WITH g AS ({GRAPH}), s AS (SELECT a, b, w FROM g UNION SELECT b, a, w FROM g), h AS (SELECT a, b AS c, sum(w) AS w FROM s GROUP BY 1, 2)
    SELECT DISTINCT ON (a) a, c FROM h ORDER BY a, w DESC, c""")
def m01_label_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round, from each vertex as its own community."""
    both = graphs.symmetric(graph(spark, sf_dir)).checkpoint()
    return graphs.propagate_once(both, both.select("a", F.col("a").alias("c")).distinct())


BASKET = """SELECT x.l_partkey AS a, y.l_partkey AS b, count(*)::DOUBLE AS w FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) y
  ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2"""


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the orders that hold both."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a")).distinct()
    other = lines.select(F.col("l_orderkey").alias("_o"), F.col("a").alias("b"))
    pairs = lines.join(other, (F.col("l_orderkey") == F.col("_o")) & (F.col("a") < F.col("b")))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


@register(f"""WITH RECURSIVE g AS ({BASKET}), s AS MATERIALIZED (SELECT a, b, w FROM g UNION SELECT b, a, w FROM g),
    lp(r, a, c, done) AS (SELECT 0, a, a, false FROM (SELECT DISTINCT a FROM s) UNION ALL
      SELECT r, a, c, 2 * count(*) FILTER (c = old) OVER () > count(*) OVER () FROM (
        SELECT DISTINCT ON (a) a, c, old, r FROM (SELECT s.a, y.c, x.c AS old, x.r + 1 AS r, sum(s.w) AS w FROM s JOIN lp x ON x.a = s.a JOIN lp y ON y.a = s.b WHERE NOT x.done GROUP BY ALL) ORDER BY a, w DESC, c))
    SELECT a, c FROM lp WHERE done""")
def m02_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of parts that are ordered together, to the stop rule."""
    return graphs.label_propagation(basket(spark, sf_dir))


@register(f"""WITH g AS ({GRAPH}), p AS (SELECT a, a % 2 AS p FROM (SELECT a FROM g UNION SELECT b FROM g)),
    e AS (SELECT a AS v, b AS u, w FROM g UNION ALL SELECT b, a, w FROM g),
    t AS (SELECT v, sum(CASE WHEN x.p = y.p THEN -w ELSE w END) AS gain FROM e JOIN p x ON x.a = v LEFT JOIN p y ON y.a = u GROUP BY v)
    SELECT a, p, gain FROM p LEFT JOIN t ON v = a""")
def m03_partition_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph(spark, sf_dir)
    return graphs.gains(e, e.select("a").union(e.select("b")).distinct().withColumn("p", F.col("a") % 2))


@register(f"""WITH g AS ({GRAPH}), f AS (SELECT a // 2 * 2 AS a, b // 2 * 2 AS b, w FROM g) SELECT least(a, b) AS a, greatest(a, b) AS b, sum(w) AS w FROM f WHERE a <> b GROUP BY 1, 2""")
def m04_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each odd vertex folded into the even one before it."""
    e = graph(spark, sf_dir)
    odd = e.select("a").union(e.select("b")).distinct().filter("a % 2 = 1")
    return graphs.coarsen(e, odd.select((F.col("a") - 1).alias("_a"), F.col("a").alias("b")).withColumnRenamed("_a", "a"))


@register("""WITH RECURSIVE t AS (SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey),
    m AS (SELECT greatest(2, count(DISTINCT tid) // 200) AS n, count(DISTINCT tid) AS tids FROM t),
    b AS MATERIALIZED (SELECT t.* FROM t WHERE item IN (SELECT item FROM t GROUP BY item HAVING count(*) >= (SELECT n FROM m))),
    f(tid, items, last) AS (SELECT tid, item, item FROM b UNION ALL
      SELECT tid, items, last FROM (SELECT f.tid, f.items || ',' || b.item AS items, b.item AS last, count(*) OVER (PARTITION BY f.items || ',' || b.item) AS c FROM f JOIN b ON b.tid = f.tid AND b.item > f.last) WHERE c >= (SELECT n FROM m))
    SELECT items, count(*) AS support, round(count(*) / (SELECT tids FROM m)::DOUBLE, 9) AS share FROM f GROUP BY items""")
def m05_frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that orders hold together; the least support is a half per cent of the orders."""
    t = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), F.col("p_brand").alias("item"))
    least = max(2, t.select(F.count_distinct("tid")).first()[0] // 200)
    return itemsets.frequent_itemsets(t, least).select(F.array_join("items", ",").alias("items"), "support", F.round("share", 9).alias("share"))


SERIES = "SELECT row_number() OVER (ORDER BY h) - 1 AS pos, v FROM (SELECT date_trunc('hour', ts) AS h, sum(value::DECIMAL(18,2))::DOUBLE AS v FROM events GROUP BY 1)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, value): the events' values by hour, all hours that have events."""
    by_hour = load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return relational.numbered(by_hour, [F.asc("h")], "pos").select((F.col("pos") - 1).alias("pos"), "value")


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, value): all events in the order of (ts, event_id)."""
    return readers._numbered(load(spark, sf_dir, "events").select(F.col("ts").alias("f"), F.col("event_id").alias("k"), F.col("value").cast("double").alias("value")))


@register(f"""WITH s AS ({SERIES}), z AS (SELECT pos, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS x FROM s), last AS (SELECT max(pos) - 23 AS m FROM s),
    d AS (SELECT a.pos - k AS i, b.pos - k AS j, sum((a.x - b.x) * (a.x - b.x)) AS d FROM z a JOIN z b ON b.pos - a.pos >= 24 OR a.pos - b.pos >= 24, range(0, 24) r(k), last
      WHERE a.pos - k BETWEEN 0 AND m AND b.pos - k BETWEEN 0 AND m GROUP BY 1, 2),
    n AS (SELECT i, min(d) AS nn FROM d GROUP BY i) SELECT i AS pos, round(sqrt(nn), 6) AS distance FROM n ORDER BY nn DESC, i LIMIT 1""")
def m06_discord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.discord(hourly(spark, sf_dir), 24).select("pos", F.round("distance", 6).alias("distance"))


@register()
def m07_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 events that warp best onto a fixed rising and falling shape."""
    shape = [float(min(k, 23 - k)) for k in range(24)]
    return series.best_match(single(spark, sf_dir), shape, 0.1)


@register()
def m09_event_discord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m06 over single events; a self-join in SQL would be too slow."""
    return series.discord(single(spark, sf_dir), 24).select("pos", F.round("distance", 6).alias("distance"))


@register(SQL["m06_discord"])
def m10_sax_discord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m06 by words: rare ones first, windows with a near copy of the same word never compared."""
    return series.discord_sax(hourly(spark, sf_dir), 24).select("pos", F.round("distance", 6).alias("distance"))


@register()
def m08_fuzzy_c_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole embeddings, until no membership moves by 1e-4."""
    eps, most = 1e-4, 1000
    points = load(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    d, least = points.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if d != least:
        raise ValueError(f"embeddings of {least} to {d} numbers")
    rated, _, log = fcm.fuzzy_c_means(points, d=d, k=4, m=2.0, eps=eps, itermax=most)
    if log[-1]["delta"] >= eps:
        raise RuntimeError(f"memberships still move by {log[-1]['delta']} after {most} rounds")
    return rated.select("i", F.posexplode("u").alias("j", "val"))


@register("SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events QUALIFY r <= 3")
def r16_top_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.rank().over(w).alias("r")).filter("r <= 3")


@register("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def r17_fragmented_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping on the fragment attribute reuses its placement."""
    return relational.fragment(load(spark, sf_dir, "customer").select("c_nationkey"), "c_nationkey", 8).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT n_nationkey, '<nation id="' || n_nationkey || '"><name>' || replace(replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name><region>' || n_regionkey || '</region></nation>' AS xml FROM nation""")
def r18_xml_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = compat.xml_forest(name=F.col("n_name"), region=F.col("n_regionkey"))
    return load(spark, sf_dir, "nation").select("n_nationkey", compat.xml_element("nation", {"id": F.col("n_nationkey")}, inner).alias("xml"))
