"""Relational queries: SQL that Spark and the oracle read alike, or differing texts for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import relational
from gristmill.plans.common import load, plain, sql_query

D2 = "decimal(18,2)"

#: name: SQL for both.
SHARED = {
    "q01_pricing_summary": """
        SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS decimal(18,2))) AS double) AS sum_qty,
          CAST(sum(CAST(l_extendedprice AS decimal(18,2))) AS double) AS sum_base_price,
          CAST(sum(CAST(l_extendedprice AS decimal(18,2)) * (1 - CAST(l_discount AS decimal(4,2)))) AS double) AS sum_disc_price,
          count(*) AS count_order
        FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "q02_projection_filter": "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS twice FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "q03_three_valued_logic": """SELECT count(*) AS n, count(CASE WHEN NOT (c_acctbal > 0) THEN 1 END) AS not_positive,
        count(CASE WHEN (c_acctbal > 0) IS NULL THEN 1 END) AS unknown FROM {customer}""",
    "q04_in_list": "SELECT n_nationkey, n_name FROM {nation} WHERE n_regionkey IN (1, 2) AND n_nationkey NOT IN (3, 7)",
    "q05_is_distinct_from": "SELECT count(*) AS n FROM {lineitem} WHERE nullif(l_returnflag, 'N') IS DISTINCT FROM nullif(l_linestatus, 'O')",
    "q06_conditional_functions": """SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, greatest(c_acctbal, 0.0) AS pos,
        least(c_acctbal, 0.0) AS neg FROM {customer}""",
    "q07_case": """SELECT CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS k,
        CASE WHEN p_retailprice > 950 THEN 'dear' ELSE 'cheap' END AS price, count(*) AS n FROM {part} GROUP BY 1, 2""",
    "q08_like": "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%ring%' AND p_name NOT LIKE 's%'",
    "q09_casts": "SELECT o_orderkey, CAST(o_orderkey AS varchar(20)) AS s, CAST(CAST(o_totalprice AS decimal(18,0)) AS bigint) AS whole FROM {orders}",
    "q10_hash_join": """SELECT n_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS double) AS total
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name""",
    "q11_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
    "q12_full_join": """SELECT c.k AS ck, s.k AS sk, c.n AS cn, s.n AS sn FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 0 GROUP BY 1) c
        FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY 1) s ON c.k = s.k""",
    "q13_exists": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "q14_not_exists": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "q15_in_subquery": "SELECT count(*) AS n FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size > 40)",
    "q16_not_in_with_null": "SELECT count(*) AS n FROM {nation} WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 0) FROM {region})",
    "q17_scalar_subquery": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 0.95 * (SELECT max(o_totalprice) FROM {orders})",
    "q18_correlated_scalar": """SELECT p_brand, p_partkey FROM {part} p WHERE p_retailprice = (SELECT max(q.p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)""",
    "q19_theta_join": """SELECT r.r_name, n.n_name FROM {region} r JOIN {nation} n ON n.n_nationkey BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 2""",
    "q20_or_join": """SELECT count(*) AS n FROM {customer} c JOIN {supplier} s ON c.c_custkey = s.s_suppkey OR c.c_custkey = s.s_suppkey + 10""",
    "q21_plain_agg": """SELECT count(*) AS n, count(DISTINCT l_suppkey) AS supps, min(l_shipdate) AS first_ship, max(l_quantity) AS most,
        bool_and(l_quantity > 0) AS all_pos, bool_or(l_discount > 0.09) AS some_high FROM {lineitem}""",
    "q22_distinct_aggs": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS ords FROM {lineitem} GROUP BY l_returnflag",
    "q23_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15",
    "q24_group_by_expression": "SELECT extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY 1, 2",
    "q25_statistics": """SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 3) AS vp, round(corr(p_size, p_retailprice), 6) AS r,
        round(regr_slope(p_retailprice, p_size), 6) AS slope, regr_count(p_retailprice, p_size) AS n FROM {part} GROUP BY p_brand""",
    "q26_bit_aggs": "SELECT l_returnflag, bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo FROM {lineitem} GROUP BY l_returnflag",
    "q27_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "q28_window_ranks": """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt
        FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
    "q29_window_shares": """SELECT s_suppkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM {supplier}
        WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""",
    "q30_window_offsets": """SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS after2 FROM {orders}
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "q31_window_values": """SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM {orders}
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "q32_running_sum": """SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS decimal(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) AS run FROM {lineitem}""",
    "q33_range_peers": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {part}",
    "q34_order_limit": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 5",
    "q35_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "q36_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "q37_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
    "q38_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "q39_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
    "q40_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "q41_cte": """WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS decimal(18,2))) AS t FROM {orders} GROUP BY 1)
        SELECT c_mktsegment, count(*) AS n FROM big JOIN {customer} ON c_custkey = o_custkey WHERE t > 1000000 GROUP BY c_mktsegment""",
    "q42_values": "SELECT v.a AS a, v.b AS b, n_name FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b) JOIN {nation} ON n_nationkey = v.a",
    "q43_text_functions": """SELECT p_partkey, upper(p_name) AS u, length(p_name) AS len, substring(p_name, 2, 3) AS sub, replace(p_name, ' ', '_') AS rep,
        trim(concat('  ', p_brand, ' ')) AS t, lpad(p_type, 12, '*') AS lp, reverse(p_name) AS rev, left(p_name, 2) AS l2, right(p_name, 2) AS r2,
        position('n' IN p_name) AS pos, translate(p_name, 'aeiou', '12345') AS tr, repeat('ab', 2) AS rp, md5(p_name) AS h, ascii(p_name) AS asc_ FROM {part}""",
    "q44_numeric_functions": """SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS bigint) AS c, CAST(floor(p_retailprice) AS bigint) AS f, p_size % 7 AS m, CAST(sign(p_size - 25) AS integer) AS s,
        round(sqrt(p_retailprice), 6) AS sq, round(ln(p_retailprice), 6) AS l, round(exp(p_size / 25.0), 4) AS e, round(power(p_size, 1.5), 4) AS pw,
        round(cbrt(p_retailprice), 6) AS cb, round(degrees(atan2(p_size, 3)), 6) AS deg, pi() AS p FROM {part}""",
    "q45_date_functions": """SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, extract(day FROM o_orderdate) AS d,
        CAST(date_trunc('month', o_orderdate) AS date) AS m, extract(week FROM o_orderdate) AS w FROM {orders}""",
    "q46_wisconsin_select": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey BETWEEN (SELECT max(o_orderkey) * 0.10 FROM {orders}) AND (SELECT max(o_orderkey) * 0.20 FROM {orders})",
    "q47_wisconsin_join": "SELECT count(*) AS n, max(l_quantity) AS q FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderkey < (SELECT max(o_orderkey) * 0.10 FROM {orders})",
    "q48_wisconsin_min": "SELECT l_suppkey % 100 AS g, min(l_partkey) AS least_part FROM {lineitem} GROUP BY 1",
    "q49_bank_balance": """SELECT c_nationkey, count(*) AS accounts, CAST(sum(CAST(c_acctbal AS decimal(18,2))) AS double) AS balance FROM {customer} GROUP BY c_nationkey""",
    "q64_regression_aggs": """SELECT p_brand, round(regr_sxx(p_retailprice, p_size), 3) AS sxx, round(regr_sxy(p_retailprice, p_size), 6) AS sxy,
        round(regr_avgx(p_retailprice, p_size), 6) AS ax, round(regr_avgy(p_retailprice, p_size), 6) AS ay, round(regr_r2(p_retailprice, p_size), 6) AS r2,
        round(covar_pop(p_retailprice, p_size), 4) AS cp, round(covar_samp(p_retailprice, p_size), 4) AS cs FROM {part} GROUP BY p_brand""",
    "q65_full_join_using": """SELECT k, a, b FROM (SELECT c_nationkey AS k, count(*) AS a FROM {customer} GROUP BY 1) x
        FULL JOIN (SELECT s_nationkey + 5 AS k, count(*) AS b FROM {supplier} GROUP BY 1) y USING (k)""",
    "q66_natural_join": """SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS r_regionkey FROM {nation}) n NATURAL JOIN (SELECT r_regionkey, r_name FROM {region}) r""",
    "q67_set_precedence": """SELECT c_nationkey AS k FROM {customer} UNION (SELECT s_nationkey FROM {supplier} EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)""",
    "q68_nested_exists": """SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49
        AND l.l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F'))""",
    "q50_aliases_star": "SELECT n.*, r.r_name AS region_name FROM {nation} AS n, {region} AS r WHERE n.n_regionkey = r.r_regionkey",
}

#: name: (Spark's SQL, the oracle's).
PAIRS = {
    "q51_integer_division": ("SELECT p_partkey, p_size div 7 AS d FROM {part}", "SELECT p_partkey, p_size // 7 AS d FROM {part}"),
    "q52_bitwise": ("SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, p_size ^ 6 AS x, ~p_size AS n, shiftleft(p_size, 2) AS s FROM {part}", "SELECT p_partkey, p_size & 6 AS a, p_size | 6 AS o, xor(p_size, 6) AS x, ~p_size AS n, p_size << 2 AS s FROM {part}"),
    "q53_ilike_regex": (r"SELECT p_partkey FROM {part} WHERE p_name ILIKE '%RED%' OR p_name RLIKE '^s.*(ring|bolt)$'", r"SELECT p_partkey FROM {part} WHERE p_name ILIKE '%RED%' OR regexp_matches(p_name, '^s.*(ring|bolt)$')"),
    "q54_array_any_all": ("SELECT p_partkey FROM {part} WHERE exists(array(1, 5, 9), e -> p_size = e) OR forall(array(45, 47), e -> p_size > e)", "SELECT p_partkey FROM {part} WHERE p_size = ANY([1, 5, 9]) OR (p_size > 45 AND p_size > 47)"),
    "q55_arrays": ("SELECT o_custkey, concat_ws(',', transform(array_sort(collect_list(o_orderkey)), x -> cast(x AS string))) AS keys, cast(size(collect_list(o_orderkey)) AS bigint) AS n FROM {orders} GROUP BY o_custkey",
                   "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS keys, len(list(o_orderkey)) AS n FROM {orders} GROUP BY o_custkey"),
    "q56_date_minus_date": ("SELECT o_orderkey, cast(datediff(o_orderdate, DATE '1995-01-01') AS bigint) AS days, cast(dayofweek(o_orderdate) - 1 AS bigint) AS dow FROM {orders}",
                            "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::date) AS days, dayofweek(o_orderdate) AS dow FROM {orders}"),
    "q57_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS bigint) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
                      "WITH RECURSIVE t(n, f) AS (SELECT 1, 1::bigint UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t"),
    "q58_function_scan": ("SELECT id AS g, count(o_orderkey) AS n FROM range(0, 10) LEFT JOIN {orders} ON o_orderkey % 10 = id GROUP BY id", "SELECT g, count(o_orderkey) AS n FROM range(0, 10) t(g) LEFT JOIN {orders} ON o_orderkey % 10 = g GROUP BY g"),
    "q59_regexp_split": ("SELECT w, count(*) AS n FROM (SELECT explode(split(p_name, ' +')) AS w FROM {part}) GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(p_name, ' +')) AS w FROM {part}) GROUP BY w"),
    "q60_row_comparison": ("SELECT o_orderkey FROM {orders} WHERE named_struct('a', o_orderstatus, 'b', o_custkey) > named_struct('a', 'O', 'b', 500L)", "SELECT o_orderkey FROM {orders} WHERE (o_orderstatus, o_custkey) > ('O', 500)"),
    "q61_words": ("SELECT d.w AS w, count(*) AS n FROM (SELECT explode(split(lower(text), ' +')) AS w FROM {documents}) d WHERE length(d.w) > 3 GROUP BY 1 HAVING count(*) > 50",
                  "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), ' +')) AS w FROM {documents}) WHERE length(w) > 3 GROUP BY 1 HAVING count(*) > 50"),
    "q62_json_property": ("SELECT event_type, sum(cast(get_json_object(props, '$.k') AS bigint)) AS k FROM {events} GROUP BY event_type", "SELECT event_type, sum((props->>'k')::bigint)::bigint AS k FROM {events} GROUP BY event_type"),
    "q69_string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
                       "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey"),
    "q70_text_functions_2": ("""SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, btrim(p_name, 'sr') AS bt, chr(65 + p_size % 26) AS ch, lower(hex(p_partkey)) AS hx,
                                overlay(p_name PLACING 'XX' FROM 2 FOR 3) AS ov, octet_length(p_name) AS ol, base64(cast(p_name AS binary)) AS b64, rtrim('x', p_brand) AS rt FROM {part}""",
                             """SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, trim(p_name, 'sr') AS bt, chr((65 + p_size % 26)::INTEGER) AS ch, lower(to_hex(p_partkey)) AS hx,
                                left(p_name, 1) || 'XX' || substr(p_name, 5) AS ov, strlen(p_name) AS ol, base64(encode(p_name)) AS b64, rtrim(p_brand, 'x') AS rt FROM {part}"""),
    "q71_all_subquery": ("SELECT p_partkey FROM {part} WHERE p_retailprice >= (SELECT max(p_retailprice) FROM {part} WHERE p_size = 7) OR NOT EXISTS (SELECT 1 FROM {part} WHERE p_size = 7)",
                         "SELECT p_partkey FROM {part} WHERE p_retailprice >= ALL (SELECT p_retailprice FROM {part} WHERE p_size = 7)"),
    "q72_array_slice": ("SELECT p_partkey, concat_ws(' ', slice(split(p_name, ' '), 1, 1)) AS head, cast(size(split(p_name, ' ')) AS bigint) AS n, array_position(split(p_name, ' '), 'ring') AS at FROM {part}",
                        "SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:1], ' ') AS head, len(string_split(p_name, ' ')) AS n, coalesce(list_position(string_split(p_name, ' '), 'ring'), 0)::bigint AS at FROM {part}"),
    "q73_date_intervals": ("SELECT o_orderkey, cast(add_months(o_orderdate, 1) AS date) AS next_month, cast(date_add(cast(o_orderdate AS date), 10) AS date) AS later, cast(last_day(o_orderdate) AS date) AS month_end FROM {orders}",
                           "SELECT o_orderkey, (o_orderdate + INTERVAL 1 MONTH)::date AS next_month, (o_orderdate + INTERVAL 10 DAY)::date AS later, last_day(o_orderdate) AS month_end FROM {orders}"),
    "q74_generate_series": ("SELECT n_nationkey, x FROM {nation} LATERAL VIEW explode(sequence(0, n_nationkey, 5)) t AS x", "SELECT n_nationkey, unnest(generate_series(0, n_nationkey, 5)) AS x FROM {nation}"),
    "q63_levenshtein": ("SELECT a.n_name AS x, b.n_name AS y, levenshtein(a.n_name, b.n_name) AS d FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
                        "SELECT a.n_name AS x, b.n_name AS y, levenshtein(a.n_name, b.n_name) AS d FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
}


def q20_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "supplier").select("s_suppkey")
    met = relational.or_join(c, s, F.col("c_custkey") == F.col("s_suppkey"), F.col("c_custkey") == F.col("s_suppkey") + 10)
    return met.agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: sql_query(v) for k, v in SHARED.items()} | {k: sql_query(a) for k, (a, _) in PAIRS.items()} | {"q20_or_join": q20_or_join}
SQL = {k: plain(v) for k, v in SHARED.items()} | {k: plain(b) for k, (_, b) in PAIRS.items()}
