"""Scalar, aggregate, array, map and JSON families, user functions, and null handling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sparkloom.functions import udfs
from sparkloom.operators import elements, frames
from sparkloom.plans.registry import plain, query
from sparkloom.sources.tables import load

plain(
    "string_family",
    "SELECT p_partkey, concat_ws('/', p_brand, p_type) AS cw, ltrim(p_name) AS lt, rtrim(p_name) AS rt, rpad(p_brand, 10, '.') AS rp, split_part(p_name, ' ', 2) AS sp, instr(p_name, 'w') AS at, reverse(p_brand) AS rv, repeat(p_type, 2) AS rr, startswith(p_name, 'cold') AS sw, regexp_replace(p_brand, '[0-9]+', 'N') AS rx, p_name LIKE '%widget%' AS lk, ascii(p_type) AS a, md5(p_name) AS h, sha2(p_name, 256) AS h2, left(p_name, 3) AS l3, right(p_name, 3) AS r3, translate(p_type, 'AE', 'ae') AS tr FROM part",
    "SELECT p_partkey, concat_ws('/', p_brand, p_type) AS cw, ltrim(p_name) AS lt, rtrim(p_name) AS rt, rpad(p_brand, 10, '.') AS rp, split_part(p_name, ' ', 2) AS sp, cast(instr(p_name, 'w') AS INTEGER) AS at, reverse(p_brand) AS rv, repeat(p_type, 2) AS rr, starts_with(p_name, 'cold') AS sw, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS rx, p_name LIKE '%widget%' AS lk, ascii(p_type) AS a, md5(p_name) AS h, sha256(p_name) AS h2, left(p_name, 3) AS l3, right(p_name, 3) AS r3, translate(p_type, 'AE', 'ae') AS tr FROM part",
)
plain(
    "math_family",
    "SELECT p_partkey, round(power(p_size, 2), 4) AS p2, round(exp(p_size / 50.0D), 6) AS ex, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(sin(p_size), 6) AS sn, round(cos(p_size), 6) AS cs, round(atan2(p_size, 3), 6) AS a2, cast(sign(p_size - 25) AS INT) AS sg, greatest(p_size, 20) AS g, least(p_size, 20) AS le, p_size DIV 7 AS q, pmod(p_size, 7) AS m, p_size & 6 AS bits, round(degrees(p_size / 10.0D), 6) AS dg FROM part",
    "SELECT p_partkey, round(power(p_size, 2), 4) AS p2, round(exp(p_size / 50.0), 6) AS ex, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(sin(p_size), 6) AS sn, round(cos(p_size), 6) AS cs, round(atan2(p_size, 3), 6) AS a2, cast(sign(p_size - 25) AS INTEGER) AS sg, greatest(p_size, 20) AS g, least(p_size, 20) AS le, cast(p_size // 7 AS BIGINT) AS q, p_size % 7 AS m, p_size & 6 AS bits, round(degrees(p_size / 10.0), 6) AS dg FROM part",
)
plain(
    "date_family",
    "SELECT o_orderkey, dayofweek(o_orderdate) AS dw, dayofyear(o_orderdate) AS dy, quarter(o_orderdate) AS q, cast(cast(cast(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR(10)) AS nm, cast(last_day(o_orderdate) AS VARCHAR(10)) AS ld, datediff(DATE '1999-01-01', cast(o_orderdate AS DATE)) AS dd, date_format(o_orderdate, 'yyyy-MM-dd') AS s FROM orders",
    "SELECT o_orderkey, cast(dayofweek(o_orderdate) + 1 AS INTEGER) AS dw, cast(dayofyear(o_orderdate) AS INTEGER) AS dy, cast(quarter(o_orderdate) AS INTEGER) AS q, cast(cast(cast(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR(10)) AS nm, cast(last_day(o_orderdate) AS VARCHAR(10)) AS ld, cast(date_diff('day', cast(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS dd, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders",
)
plain(
    "array_family",
    "SELECT o_custkey, size(a) AS n, array_contains(a, 'F') AS has_f, array_join(array_sort(array_distinct(a)), ',') AS kinds, element_at(array_sort(a), 1) AS first_one FROM (SELECT o_custkey, collect_list(o_orderstatus) AS a FROM orders GROUP BY o_custkey)",
    "SELECT o_custkey, cast(len(a) AS INTEGER) AS n, list_contains(a, 'F') AS has_f, array_to_string(list_sort(list_distinct(a)), ',') AS kinds, list_sort(a)[1] AS first_one FROM (SELECT o_custkey, list(o_orderstatus) AS a FROM orders GROUP BY o_custkey)",
)
plain(
    "unnest_rows",
    "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS w",
    "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part",
)
plain(
    "map_struct_family",
    "SELECT s_suppkey, map('a', s_suppkey, 'b', s_suppkey + 1)['b'] AS b, named_struct('x', s_name, 'y', s_nationkey).y AS y FROM supplier",
    "SELECT s_suppkey, map {'a': s_suppkey, 'b': s_suppkey + 1}['b'] AS b, s_nationkey AS y FROM supplier",
)
plain(
    "json_family",
    "SELECT event_id, cast(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k + 1 AS k1 FROM events",
    "SELECT event_id, cast(props->>'$.k' AS INTEGER) AS k, cast(props->>'$.k' AS INTEGER) + 1 AS k1 FROM events",
)
plain(
    "aggregate_family",
    "SELECT o_orderstatus, count(DISTINCT o_custkey) AS nd, median(o_totalprice) AS md, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, array_join(array_sort(collect_set(o_orderpriority)), ',') AS pr, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(stddev_pop(o_totalprice), 3) AS sp, round(var_samp(o_totalprice) / 1e6D, 3) AS vs FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, count(DISTINCT o_custkey) AS nd, median(o_totalprice) AS md, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS top, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS pr, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(stddev_pop(o_totalprice), 3) AS sp, round(var_samp(o_totalprice) / 1e6, 3) AS vs FROM orders GROUP BY o_orderstatus",
)
plain("range_frame_window", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
plain("nth_last_value_window", "SELECT o_orderkey, nth_value(o_orderkey, 2) OVER w AS second, last_value(o_orderkey) OVER w AS latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
plain("self_join", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
plain("subquery_exists", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority")
plain("subquery_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
plain("values_rows", "SELECT x.a AS a, x.b AS b FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS x(a, b)")
plain("sort_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k ASC NULLS LAST, c_custkey")
plain("top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE nullif(c_nationkey, 3) IS NOT NULL")
def drop_null_rows(spark, d):
    return frames.drop_null(load(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey")), ["c_nationkey"])


@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS k FROM customer")
def fill_null_values(spark, d):
    return frames.fill_null(load(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k")), "k", -1)


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS q FROM lineitem")
def groups_frame_window(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return frames.groups_frame(li, ["l_suppkey"], "l_linenumber", F.sum("l_quantity"), "q", -1, 0).select("l_orderkey", "l_linenumber", "q")


@query("SELECT true AS within_5_percent, count(DISTINCT l_partkey) AS exact FROM lineitem")
def approx_distinct(spark, d):
    li = load(spark, d, "lineitem")
    # each on its own: in one aggregate every distinct key would carry a sketch of 6 KB through the shuffle
    both = li.agg(F.approx_count_distinct("l_partkey", 0.016).alias("about")).crossJoin(F.broadcast(li.agg(F.count_distinct("l_partkey").alias("exact"))))
    return both.select((F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_5_percent"), "exact")


@query("SELECT a.k AS by_key, b.k AS by_balance FROM (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) a JOIN (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) b ON a.i = b.i")
def zip_columns(spark, d):
    c = load(spark, d, "customer")
    by_balance = c.select(F.col("c_custkey").alias("by_balance"), "c_acctbal")
    return elements.zip_frames(c.select(F.col("c_custkey").alias("by_key")), by_balance, ["by_key"], ["c_acctbal", "by_balance"]).select("by_key", "by_balance")


def _taxed(price: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 + tax)


def _spread(x: pd.Series) -> float:
    return float(x.max() - x.min())


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + l_tax), 4) AS t FROM lineitem WHERE l_extendedprice * (1 + l_tax) > 50000")
def udf_scalar(spark, d):
    udfs.register_scalar(spark, "taxed", _taxed, "double", "price with tax")
    load(spark, d, "lineitem").createOrReplaceTempView("udf_lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, round(t, 4) AS t FROM (SELECT l_orderkey, l_linenumber, taxed(l_extendedprice, l_tax) AS t FROM udf_lineitem) WHERE t > 50000")


@query("SELECT l_suppkey, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_suppkey")
def udf_aggregate(spark, d):
    udfs.register_aggregate(spark, "spread", _spread, "double", "largest less smallest")
    load(spark, d, "lineitem").createOrReplaceTempView("udaf_lineitem")
    return spark.sql("SELECT l_suppkey, spread(l_quantity) AS spread FROM udaf_lineitem GROUP BY l_suppkey")


class _Split:
    def eval(self, text: str):
        for i, w in enumerate((text or "").split(" ")):
            yield i, w


@query("SELECT p_partkey, cast(i - 1 AS INTEGER) AS i, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def udf_table(spark, d):
    udfs.register_table(spark, "split_words", _Split, "i int, w string", "words and their places")
    load(spark, d, "part").createOrReplaceTempView("udtf_part")
    return spark.sql("SELECT p_partkey, t.i, t.w FROM udtf_part, LATERAL split_words(p_name) t")


@query("SELECT sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) AS inside, count(*) AS n FROM (SELECT (i * 7919 % 10007) / 10007.0 AS x, (i * 104729 % 10009) / 10009.0 AS y FROM range(1000000) t(i))")
def pi_points(spark, d):
    xy = spark.range(1_000_000).select((F.col("id") * 7919 % 10007 / F.lit(10007.0)).alias("x"), (F.col("id") * 104729 % 10009 / F.lit(10009.0)).alias("y"))
    return xy.agg(F.sum((F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1).cast("long")).alias("inside"), F.count("*").alias("n"))
