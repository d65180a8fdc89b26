"""Queries of the engine's own functions, dialect, table commands and user-defined functions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import aggregates, compat, values
from gristmill.functions import formatting as fm
from gristmill.operators import graphs, relational, series
from gristmill.plans.common import load
from gristmill.plans.mining import SERIES, hourly
from gristmill.sql import Session

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def both(name: str, text: str, oracle: str, *params) -> None:
    """A query in the dialect, through the SQL entry point, and the oracle's."""
    tables = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents") if f"{{{t}}}" in text]
    QUERIES[name] = lambda spark, sf_dir: Session(spark).sql(text, *params, **{t: load(spark, sf_dir, t) for t in tables})
    SQL[name] = oracle


# ---- scans, predicates, expressions

both("s01_result", "SELECT 1 + 1 AS two, 'x' AS s WHERE 1 < 2", "SELECT 2 AS two, 'x' AS s")
both("s02_bitmap_and_or", "SELECT p_partkey FROM {part} WHERE (p_size = 7 AND p_retailprice > 950) OR (p_brand = 'Brand#13' AND p_size < 20)", "SELECT p_partkey FROM part WHERE (p_size = 7 AND p_retailprice > 950) OR (p_brand = 'Brand#13' AND p_size < 20)")
both(
    "s03_boolean_tests",
    "SELECT count(CASE WHEN (x > 0) IS TRUE THEN 1 END) AS t, count(CASE WHEN (x > 0) IS NOT TRUE THEN 1 END) AS nt, count(CASE WHEN (x > 0) IS FALSE THEN 1 END) AS f, count(CASE WHEN (x > 0) IS UNKNOWN THEN 1 END) AS u FROM (SELECT nullif(n_regionkey, 2) - 1 AS x FROM {nation}) v",
    "SELECT count(*) FILTER (x > 0) AS t, count(*) FILTER (NOT coalesce(x > 0, false)) AS nt, count(*) FILTER (x <= 0) AS f, count(*) FILTER (x IS NULL) AS u FROM (SELECT nullif(n_regionkey, 2) - 1 AS x FROM nation) v",
)
both("s04_parameters", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = $1 AND o_totalprice > $2", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000", "P", 150000)
both(
    "s05_dialect_operators",
    "SELECT p_partkey, p_size / 7 AS d, p_size ^ 2 AS sq, p_size # 6 AS x, -p_size / 4 AS neg, p_retailprice / 2 AS half FROM {part} WHERE p_name ~ '^s' OR p_name ~* 'RED' AND p_name !~ 'bolt$'",
    "SELECT p_partkey, (p_size // 7)::DOUBLE AS d, power(p_size, 2) AS sq, xor(p_size, 6) AS x, -(p_size // 4)::DOUBLE AS neg, p_retailprice / 2 AS half FROM part WHERE regexp_matches(p_name, '^s') OR regexp_matches(lower(p_name), 'red') AND NOT regexp_matches(p_name, 'bolt$')",
)
both("s06_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM {orders} ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
both("s07_nulls_order", "SELECT n_nationkey, row_number() OVER (ORDER BY nullif(n_regionkey, 3), n_nationkey) AS up, row_number() OVER (ORDER BY nullif(n_regionkey, 3) DESC, n_nationkey) AS down FROM {nation}", "SELECT n_nationkey, row_number() OVER (ORDER BY nullif(n_regionkey, 3) NULLS LAST, n_nationkey) AS up, row_number() OVER (ORDER BY nullif(n_regionkey, 3) DESC NULLS FIRST, n_nationkey) AS down FROM nation")
both("s08_any_all", "SELECT p_partkey FROM {part} WHERE p_size = ANY (ARRAY[1, 5, 9]) OR p_size > ALL (ARRAY[45, 47])", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) OR p_size > 47")
both("s09_similar_to", "SELECT p_partkey FROM {part} WHERE p_name SIMILAR TO '(small|red)%'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(small|red).*')")
both("s10_order_using", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice USING >, o_orderkey LIMIT 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
both("s11_window_inheritance", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r FROM {orders}", "SELECT o_orderkey, rank() OVER (w ORDER BY o_totalprice) AS r FROM orders WINDOW w AS (PARTITION BY o_orderstatus)")
both("s12_union_types", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_acctbal FROM {supplier} UNION SELECT NULL", "SELECT c_nationkey::DOUBLE AS k FROM customer UNION SELECT s_acctbal FROM supplier UNION SELECT NULL")
both("s13_array_subquery", "SELECT r_name, array_join(sort_array((SELECT collect_list(n_name) FROM {nation} WHERE n_regionkey = r_regionkey)), ',') AS names FROM {region}", "SELECT r_name, array_to_string(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name), ',') AS names FROM region")
both("s14_fields_and_subscripts", "SELECT n_nationkey, v.r.a AS a, v.m[1][0] AS m FROM (SELECT n_nationkey, named_struct('a', n_regionkey) AS r, ARRAY[ARRAY[n_nationkey, 1], ARRAY[n_nationkey * 2, 2]] AS m FROM {nation}) v", "SELECT n_nationkey, n_regionkey AS a, n_nationkey * 2 AS m FROM nation")


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey % 7 = 3")
def s17_tid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fetched by where they stand in their file."""
    part = load(spark, sf_dir, "part")
    return relational.fetch_tids(part, relational.tids(part).filter("p_partkey % 7 = 3")).select("p_partkey", "p_name")


@register("SELECT p_partkey, typeof(p_size) IN ('INTEGER', 'BIGINT') AS whole, typeof(p_name) = 'DOUBLE' AS real_ FROM part")
def s18_is_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", values.is_of(F.col("p_size"), "int", "bigint").alias("whole"), values.is_of(F.col("p_name"), "double").alias("real_"))


# ---- formatting, dates, text, types


@register("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%d/%m/%y') AS b, rpad(upper(strftime(ts, '%B')), 9, ' ') || strftime(ts, ' %d') AS c, strftime(ts, '%b %a') AS d,
    strftime(ts, '%I:%M %p') AS e, strftime(ts, '%j') || 'Q' || quarter(ts) AS f, strftime(ts, '%G-%V') AS g, lpad((datepart('microsecond', ts) % 1000000)::VARCHAR, 6, '0') AS h, month(ts) || '.' || day(ts) AS i FROM events""")
def s20_to_char_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    forms = {"a": "YYYY-MM-DD HH24:MI:SS", "b": "DD/MM/YY", "c": "MONTH DD", "d": "Mon Dy", "e": "HH12:MI AM", "f": 'DDD"Q"Q', "g": "IYYY-IW", "h": "US", "i": "FMMM.FMDD"}
    return load(spark, sf_dir, "events").select("event_id", *[fm.to_char_time(t, f).alias(k) for k, f in forms.items()])


@register("""SELECT c_custkey, lpad(CASE WHEN c_acctbal < 0 THEN '-' ELSE ' ' END || format('{:,.2f}', abs(c_acctbal)), 11, ' ') AS a,
    CASE WHEN c_acctbal < 0 THEN '-' ELSE ' ' END || lpad(format('{:.1f}', abs(c_acctbal)::DECIMAL(18,1)), 8, '0') AS b, lpad(CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END || abs(c_acctbal)::DECIMAL(18,0)::VARCHAR, 7, ' ') AS c,
    CASE WHEN abs(c_acctbal)::DECIMAL(18,0) > 999 THEN CASE WHEN c_acctbal < 0 THEN '-' ELSE ' ' END || '###' ELSE lpad(CASE WHEN c_acctbal < 0 THEN '-' ELSE ' ' END || abs(c_acctbal)::DECIMAL(18,0)::VARCHAR, 4, ' ') END AS d FROM customer""")
def s21_to_char_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").select("c_custkey", fm.to_char_number(x, "999,990.99").alias("a"), fm.to_char_number(x, "000000.0").alias("b"), fm.to_char_number(x, "S999999").alias("c"), fm.to_char_number(x, "999").alias("d"))


@register("SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate + INTERVAL 90 MINUTE AS t, o_totalprice::DECIMAL(18,2)::DOUBLE AS n FROM orders")
def s22_read_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    day, moment = fm.to_char_time(F.col("o_orderdate"), "DD.MM.YYYY"), fm.to_char_time(F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE"), "YYYY/MM/DD HH24:MI:SS")
    return o.select("o_orderkey", fm.to_date(day, "DD.MM.YYYY").alias("d"), fm.to_timestamp(moment, "YYYY/MM/DD HH24:MI:SS").alias("t"), fm.to_number(fm.to_char_number(F.col("o_totalprice"), "999,999,990.99"), "999,999,990.99").cast("double").alias("n"))


@register("""SELECT o_orderkey, datepart('year', a) AS y, datepart('month', a) AS m, datepart('day', a) AS d, b AS before FROM (SELECT o_orderkey, age(TIMESTAMP '1997-03-13 00:00:00', o_orderdate) AS a, datepart('day', age(o_orderdate, TIMESTAMP '1997-03-13 00:00:00')) AS b FROM orders)""")
def s23_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lit("1997-03-13 00:00:00").cast("timestamp")
    o = load(spark, sf_dir, "orders").select("o_orderkey", fm.age(t, F.col("o_orderdate")).alias("a"), fm.age(F.col("o_orderdate"), t).alias("b"))
    return o.select("o_orderkey", F.col("a.years").cast("long").alias("y"), F.col("a.months").cast("long").alias("m"), F.col("a.days").cast("long").alias("d"), F.col("b.days").cast("long").alias("before"))


@register("""SELECT o_orderkey, CASE WHEN o_orderdate = TIMESTAMP '1996-01-01' THEN true WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN TIMESTAMP '1996-01-01' < o_orderdate + INTERVAL 60 DAY ELSE o_orderdate < TIMESTAMP '1996-06-01' END AS o,
    o_orderdate + INTERVAL 2 MONTH + INTERVAL 3 DAY + INTERVAL 90 SECOND AS later FROM orders""")
def s24_overlaps_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    day = lambda s: F.lit(s).cast("timestamp")
    return load(spark, sf_dir, "orders").select("o_orderkey", fm.overlaps(t, t + F.expr("INTERVAL 60 DAY"), day("1996-06-01"), day("1996-01-01")).alias("o"), fm.add_interval(t, 2, 3, 90).alias("later"))


@register("SELECT p_partkey, right((p_size::BIT)::VARCHAR, 8) AS b, right(((p_size & 29)::BIT)::VARCHAR, 8) AS a, right(((p_size | 29)::BIT)::VARCHAR, 8) AS o, right((xor(p_size, 29)::BIT)::VARCHAR, 8) AS x, right(((255 - p_size)::BIT)::VARCHAR, 8) AS n, right((((p_size << 2) & 255)::BIT)::VARCHAR, 8) AS s, (p_size >> 1)::BIGINT AS i FROM part")
def s25_bit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = values.bits(F.col("p_size"), 8), F.lit("00011101")
    return load(spark, sf_dir, "part").select("p_partkey", b.alias("b"), values.bit_and(b, c).alias("a"), values.bit_or(b, c).alias("o"), values.bit_xor(b, c).alias("x"), values.bit_not(b).alias("n"), values.bit_shift(b, 2).alias("s"), values.bit_int(values.bit_shift(b, -1)).alias("i"))


@register("""SELECT event_id, '10.' || user_id % 256 || '.' || (event_id % 16) * 16 || '.0/20' AS net, '10.' || user_id % 256 || '.' || (event_id % 16) * 16 + 15 || '.255/20' AS bc, '255.255.240.0' AS mask, 20 AS len, user_id % 256 = 13 AS within FROM events""")
def s26_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit("10."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 16 * 16 + F.col("event_id") % 13).cast("string"), F.lit("."), (F.col("event_id") % 251).cast("string"), F.lit("/20"))
    return load(spark, sf_dir, "events").select("event_id", values.network(a).alias("net"), values.broadcast(a).alias("bc"), values.netmask(a).alias("mask"), values.masklen(a).alias("len"), values.contained(a, F.lit("10.13.0.0/16")).alias("within"))


@register("SELECT p_partkey, md5(p_name)::UUID::VARCHAR AS u FROM part")
def s27_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", values.uuid(F.concat(F.lit("{"), F.upper(F.md5("p_name")), F.lit("}"))).alias("u"))


@register("""SELECT p_partkey, lower(hex(encode(p_name))) AS h, to_base64(encode(p_name)) AS b, p_name AS back, lower(to_hex(p_partkey)) AS n,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap, chr(39) || p_name || chr(39) || chr(39) || chr(39) AS lit, '"' || p_name || '"' AS ident FROM part""")
def s28_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_name")
    raw = p.cast("binary")
    return load(spark, sf_dir, "part").select(
        "p_partkey", values.encode(raw, "hex").alias("h"), values.encode(raw, "base64").alias("b"), F.decode(values.decode(values.encode(raw, "hex"), "hex"), "UTF-8").alias("back"), values.to_hex(F.col("p_partkey")).alias("n"),
        values.initcap(p).alias("cap"), values.quote_literal(F.concat(p, F.lit("'"))).alias("lit"), values.quote_ident(p).alias("ident"),
    )


@register("SELECT p_partkey, unnest(regexp_extract_all(p_name, '([aeiou])([a-z])', 1)) AS a, unnest(regexp_extract_all(p_name, '([aeiou])([a-z])', 2)) AS b FROM part")
def s29_regexp_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "part").select("p_partkey", F.explode(values.regexp_matches(F.col("p_name"), "([aeiou])([a-z])", every=True)).alias("m"))
    return m.select("p_partkey", F.col("m")[0].alias("a"), F.col("m")[1].alias("b"))


@register(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'the')) AS b FROM w)
    SELECT doc_id, round((coalesce(list_sum([0.1 / (k * k) for k in range(1, a + 1)]), 0) / 1.64493406685 + coalesce(list_sum([0.1 / (k * k) for k in range(1, b + 1)]), 0) / 1.64493406685) / 2, 9) AS r FROM c""")
def s30_text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(values.text_rank(F.col("text"), ["license", "the"]), 9).alias("r"))


@register(r"SELECT w AS word, count(DISTINCT doc_id) AS ndoc, count(*) AS nentry FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def s31_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their documents and occurrences; each document's are counted before the shuffle."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    each = load(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("ndoc"), F.sum("n").alias("nentry"))


# ---- aggregates and user-defined functions

both(
    "s40_all_statistics",
    """SELECT p_brand, count(*) AS n, round(avg(p_size), 6) AS av, sum(CAST(p_size AS decimal(38,0))) AS su, round(variance(p_retailprice), 3) AS va, round(var_samp(p_retailprice), 3) AS vs, round(var_pop(p_size), 6) AS vp,
    round(stddev(p_retailprice), 4) AS sd, round(stddev_samp(p_size), 6) AS ss, round(stddev_pop(p_retailprice), 4) AS sp, round(regr_intercept(p_retailprice, p_size), 4) AS ri, round(regr_syy(p_retailprice, p_size), 2) AS ry,
    every(p_size > 0) AS ev, bool_and(p_size < 50) AS ba, bool_or(p_size = 7) AS bo, bit_and(p_size) AS bn, bit_or(p_size) AS br, min(p_name) AS mi, max(p_name) AS ma, min(p_retailprice) AS mr FROM {part} GROUP BY p_brand""",
    """SELECT p_brand, count(*) AS n, round(avg(p_size), 6) AS av, sum(p_size)::DECIMAL(38,0) AS su, round(variance(p_retailprice), 3) AS va, round(var_samp(p_retailprice), 3) AS vs, round(var_pop(p_size), 6) AS vp,
    round(stddev(p_retailprice), 4) AS sd, round(stddev_samp(p_size), 6) AS ss, round(stddev_pop(p_retailprice), 4) AS sp, round(regr_intercept(p_retailprice, p_size), 4) AS ri, round(regr_syy(p_retailprice, p_size), 2) AS ry,
    bool_and(p_size > 0) AS ev, bool_and(p_size < 50) AS ba, bool_or(p_size = 7) AS bo, bit_and(p_size) AS bn, bit_or(p_size) AS br, min(p_name) AS mi, max(p_name) AS ma, min(p_retailprice) AS mr FROM part GROUP BY p_brand""",
)
both("s41_extremes_by_type", "SELECT o_orderstatus, min(o_orderdate) AS a, max(o_orderdate) AS b, min(CAST(o_orderdate AS date)) AS c, max(CAST(o_totalprice AS decimal(18,2))) AS d, max(CAST(o_custkey AS smallint)) AS e, max(CAST(o_totalprice AS float)) AS f, max(o_orderpriority) AS g FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_orderdate::DATE) AS c, max(o_totalprice::DECIMAL(18,2)) AS d, max(o_custkey::SMALLINT) AS e, max(o_totalprice::FLOAT) AS f, max(o_orderpriority) AS g FROM orders GROUP BY o_orderstatus")


@register("SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) AS x FROM nation GROUP BY n_regionkey")
def s42_xml_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(aggregates.xml_agg(compat.xml_forest(n=F.col("n_name")), F.col("n_name")).alias("x"))


@register("SELECT l_returnflag, sum(l_linenumber * l_linenumber)::BIGINT AS value FROM lineitem GROUP BY l_returnflag")
def s43_user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state function and one that joins states: folded by tasks, then merged."""
    return aggregates.fold(load(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_linenumber").cast("long"), F.lit(0).cast("long"), lambda s, v: s + v * v, combine=lambda a, b: a + b)


@register("SELECT n_regionkey, string_agg(n_name, '>' ORDER BY n_nationkey DESC) AS value FROM nation GROUP BY n_regionkey")
def s44_user_aggregate_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return aggregates.fold(n, ["n_regionkey"], F.col("n_name"), F.lit(""), lambda s, v: F.when(s == "", v).otherwise(F.concat(s, F.lit(">"), v)), order=[(-F.col("n_nationkey")).alias("_o")])


@register("SELECT n_nationkey, n_nationkey * 2 + 1 AS y, x FROM nation, generate_series(1, 3) g(x)")
def s45_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice_and_one(x INT) RETURNS INT RETURN x * 2 + 1")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION up_to(n INT) RETURNS TABLE (x INT) RETURN SELECT explode(sequence(1, n))")
    return spark.sql("SELECT n_nationkey, twice_and_one(n_nationkey) AS y, CAST(x AS bigint) AS x FROM {nation}, up_to(3)", nation=load(spark, sf_dir, "nation"))


@register("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS at FROM part")
def s46_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RETURNS SETOF in Python."""

    class Words:
        def eval(self, key: int, name: str):
            for k, w in enumerate(name.split(" "), 1):
                yield key, w, k

    spark.udtf.register("name_words", F.udtf(Words, returnType="p_partkey long, word string, at long"))
    return spark.sql("SELECT w.* FROM {part} p, LATERAL name_words(p.p_partkey, p.p_name) w", part=load(spark, sf_dir, "part"))


@register("SELECT p_partkey, length(replace(replace(replace(replace(replace(p_name, 'a', ''), 'e', ''), 'i', ''), 'o', ''), 'u', '')) AS n FROM part")
def s47_python_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedural function in Python, by Arrow batches."""
    def consonants(name: pa.Array) -> pa.Array:
        return pc.cast(pc.utf8_length(pc.replace_substring_regex(name, "[aeiou]", "")), pa.int64())

    return load(spark, sf_dir, "part").select("p_partkey", F.arrow_udf(consonants, "long")(F.col("p_name")).alias("n"))


@register("WITH RECURSIVE f(k, a, b) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < 40) SELECT a AS fib FROM f WHERE k = 40")
def s48_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables, a loop and an exit, as a procedural block."""
    return spark.sql("""BEGIN
        DECLARE a BIGINT = 0; DECLARE b BIGINT = 1; DECLARE k INT = 0; DECLARE t BIGINT;
        l: LOOP
          IF k >= 40 THEN LEAVE l; END IF;
          SET t = a + b; SET a = b; SET b = t; SET k = k + 1;
        END LOOP;
        SELECT a AS fib;
      END""")


# ---- table commands


@register("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def s50_create_table_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustered table from a query; it goes at once, its rows are in a checkpoint."""
    from gristmill.operators.tables import scratch

    with scratch(spark) as name:
        made = relational.create_table_as(load(spark, sf_dir, "part").select("p_partkey", "p_size"), name, ["p_size"])
        return made.filter("p_size > 25").checkpoint()


@register("SELECT s_suppkey AS c_custkey, s_acctbal AS c_acctbal FROM supplier JOIN customer ON c_custkey = s_suppkey")
def s51_update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return relational.update_returning(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), new.union(new), "c_custkey")[1]


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def s52_delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.delete_using(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), doomed, "c_custkey")[1]


@register("""SELECT 'not null o_orderdate' AS constraint, count(*) FILTER (o_orderdate IS NULL) AS n FROM orders UNION ALL SELECT 'check priced', count(*) FILTER (NOT o_totalprice > 2000) FROM orders
    UNION ALL SELECT 'unique o_custkey', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'foreign key o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def s54_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return relational.violations(o, not_null=("o_orderdate",), unique=("o_custkey",), checks={"priced": "o_totalprice > 2000"}, foreign={"o_custkey": (load(spark, sf_dir, "customer").filter("c_acctbal > 0"), "c_custkey")})


@register("SELECT 'p_size' AS column, 0.0 AS null_frac, count(DISTINCT p_size) AS n_distinct, count(*) AS sampled, (SELECT p_size::VARCHAR FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size::VARCHAR LIMIT 1) AS top FROM part")
def s55_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANALYZE with all rows in the sample."""
    got = relational.sample_statistics(load(spark, sf_dir, "part").select("p_size"), 1.0)
    return got.select("column", F.col("null_frac").cast("double").alias("null_frac"), "n_distinct", "sampled", F.col("most_common")[0].value.alias("top"))


@register("SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE 'other' END AS type FROM (DESCRIBE SELECT * FROM customer) t(column_name, data_type, a, b, c, d) WHERE data_type IN ('BIGINT', 'INTEGER')")
def s56_system_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.tables import columns

    return columns(spark, {"customer": load(spark, sf_dir, "customer")}).filter("type IN ('bigint', 'int')").select("name", "type")


@register("SELECT c_nationkey % 4 AS node, count(*) AS n FROM customer GROUP BY 1")
def s57_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the node that attr % N gives; each node's are one partition."""
    return relational.fragments(load(spark, sf_dir, "customer").select("c_nationkey"), "c_nationkey", 4).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


# ---- mining


@register(f"""WITH s AS ({SERIES}), z AS (SELECT pos, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS x FROM s), last AS (SELECT max(pos) - 23 AS m FROM s),
    p AS (SELECT z.pos - k AS i, k // 6 AS part, avg(x) AS a FROM z, range(0, 24) r(k), last WHERE z.pos - k BETWEEN 0 AND m GROUP BY 1, 2),
    w AS (SELECT i, string_agg(CASE WHEN a < -0.67 THEN 'a' WHEN a < 0 THEN 'b' WHEN a < 0.67 THEN 'c' ELSE 'd' END, '' ORDER BY part) AS word FROM p GROUP BY i) SELECT word, count(*) AS n FROM w GROUP BY word""")
def m11_sax_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of four letters occurs among the windows of 24 hours."""
    return series.sax_words(hourly(spark, sf_dir), 24).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def parts_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the parts that they share."""
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    other = lines.select(F.col("l_partkey").alias("_p"), F.col("l_suppkey").alias("b"))
    pairs = lines.join(other, (F.col("l_partkey") == F.col("_p")) & (F.col("l_suppkey") < F.col("b")))
    return pairs.groupBy(F.col("l_suppkey").alias("a"), "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


@register()
def m12_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of the suppliers: heavy edges folded level by level, refined on the way back."""
    return graphs.bisect(parts_graph(spark, sf_dir).checkpoint())


@register()
def m13_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' suppliers as communities, merged until five are left."""
    edges = parts_graph(spark, sf_dir).checkpoint()
    nation = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("c"))
    return graphs.consolidate(edges, nation.join(edges.select(F.explode(F.array("a", "b")).alias("a")).distinct(), "a", "left_semi"), 5)
