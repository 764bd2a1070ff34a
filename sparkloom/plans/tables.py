"""Sources, sinks, the catalog and what a frame tells of itself: what is written is read back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import elements, frames, keyed
from sparkloom.operators.lineage import size_of
from sparkloom.plans.registry import query
from sparkloom.sources import session, tables
from sparkloom.sources.tables import load


def scratch(spark: SparkSession) -> str:
    return tables.work_folder(spark, "query")


def one_row(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


def _round_trip(spark, df: DataFrame, kind: str, schema=None, sort_by=None) -> DataFrame:
    at = scratch(spark)
    tables.write(df, kind, at, sort_by=sort_by)
    return tables.read(spark, kind, at, schema=schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_registered(spark, d):
    at = scratch(spark)
    tables.write(load(spark, d, "nation"), "csv", at)
    tables.register(spark, "q_csv_nation", at, "csv")
    return spark.sql("SELECT n_nationkey, n_name, n_regionkey FROM q_csv_nation")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_written(spark, d):
    return _round_trip(spark, load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "csv", "c_custkey long, c_name string, c_acctbal double")


@query("SELECT cast(s_suppkey AS BIGINT) AS s_suppkey, s_name, cast(s_nationkey AS BIGINT) AS s_nationkey, nullif(s_acctbal, 0) AS s_acctbal FROM supplier")
def json_registered(spark, d):
    at = scratch(spark)
    tables.write(load(spark, d, "supplier"), "json", at)
    tables.register(spark, "q_json_supplier", at, "json")
    return spark.table("q_json_supplier").select("s_suppkey", "s_name", "s_nationkey", F.nullif("s_acctbal", F.lit(0.0)).alias("s_acctbal"))


@query("SELECT c_name AS value FROM customer")
def text_file(spark, d):
    at = scratch(spark)
    tables.text_lines(load(spark, d, "customer"), "c_name", at)
    return tables.read(spark, "text", at)


@query("SELECT unnest(string_split(text, chr(10))) AS value FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def text_of_whole_files(spark, d):
    """A text of several lines is as many lines when it is read."""
    at = scratch(spark)
    tables.text_lines(load(spark, d, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL"), "text", at)
    return tables.read(spark, "text", at, lineSep="\n")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def parquet_written(spark, d):
    return _round_trip(spark, load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"), "parquet")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part")
def parquet_written_sorted(spark, d):
    """The files in the order of their names hold all rows in order."""
    at = scratch(spark)
    tables.write(load(spark, d, "part").select("p_partkey", "p_retailprice"), "parquet", at, sort_by=["p_retailprice", "p_partkey"])
    back = tables.read(spark, "parquet", at).select("p_partkey", "p_retailprice", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return keyed.zip_with_index(back, ["file", "row"], "place").select("p_partkey", "place")


@query("SELECT count(*) AS files, true AS whole FROM (SELECT DISTINCT r_regionkey FROM region)")
def binary_files(spark, d):
    at = scratch(spark)
    load(spark, d, "region").select("r_name", "r_regionkey").write.partitionBy("r_regionkey").json(at)
    got = tables.read(spark, "binary", at, recursiveFileLookup=True, pathGlobFilter="*.json")
    return got.agg(F.count("*").alias("files"), F.bool_and(F.length("content") == F.col("length")).alias("whole"))


@query("SELECT r_regionkey, r_name FROM region")
def batches_registered(spark, d):
    tables.register(spark, "q_arrow_region", load(spark, d, "region").toArrow())
    return spark.table("q_arrow_region")


@query("SELECT n_nationkey, n_regionkey, n_regionkey AS part FROM nation")
def batches_by_partition(spark, d):
    nation = load(spark, d, "nation").select("n_nationkey", "n_regionkey").toArrow().combine_chunks()
    cut = [nation.filter(pc.equal(nation["n_regionkey"], k)).combine_chunks().to_batches()[0] for k in range(5)]
    return tables.partitioned(spark, cut).withColumn("part", F.spark_partition_id())


@query("SELECT n_name, cast(n_regionkey AS BIGINT) * 10 AS ten FROM nation")
def rdd_registered(spark, d):
    rdd = load(spark, d, "nation").rdd.map(lambda r: (r["n_name"], r["n_regionkey"] * 10))
    tables.register(spark, "q_rdd_nation", rdd, schema="n_name string, ten long")
    return spark.table("q_rdd_nation")


@query("SELECT s_suppkey, s_name FROM supplier")
def batches_read(spark, d):
    got = list(tables.batches(load(spark, d, "supplier").select("s_suppkey", "s_name"), most_rows=7))
    assert all(b.num_rows <= 7 for b in got)
    return spark.createDataFrame(pa.Table.from_batches(got))


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def global_view(spark, d):
    tables.register(spark, "q_everywhere", load(spark, d, "supplier"), everywhere=True)
    return spark.newSession().sql("SELECT s_nationkey, count(*) AS n FROM global_temp.q_everywhere GROUP BY s_nationkey")


@query("SELECT true AS listed, true AS gone, true AS databases, true AS schemas")
def catalog_names(spark, d):
    tables.register(spark, "q_listed", load(spark, d, "region"))
    listed = "q_listed" in tables.table_names(spark)
    tables.deregister(spark, "q_listed")
    gone = "q_listed" not in tables.table_names(spark)
    return one_row(spark, "listed boolean, gone boolean, databases boolean, schemas boolean", listed, gone, "default" in tables.database_names(spark), "default" in tables.schema_names(spark))


@query("SELECT i AS a, i * i AS b FROM range(5000) t(i)")
def parallelized(spark, d):
    return tables.parallelize(spark, [(i, i * i) for i in range(5000)], "a long, b long", 6)


@query("SELECT i AS id FROM range(100, 3, -7) t(i)")
def numbers_down(spark, d):
    return tables.numbers(spark, 100, 3, -7)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def union_of_several(spark, d):
    c, s, n = load(spark, d, "customer", "supplier", "nation")
    return tables.union_all([c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")), n.select(F.col("n_nationkey").alias("k"))])


@query("SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM orders) = 0 AS empty")
def counted(spark, d):
    li, o = load(spark, d, "lineitem", "orders")
    return one_row(spark, "rows long, empty boolean", li.count(), o.isEmpty())


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail_rows(spark, d):
    return spark.createDataFrame(load(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").tail(7), "o_orderkey long")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3")
def shown_rows(spark, d):
    """What show() prints, read again."""
    text = load(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey")._show_string(3, 20, False)
    return spark.createDataFrame([(int(x.strip("| ")),) for x in text.splitlines() if x.strip("| ").isdigit()], "o_orderkey long")


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_collected(spark, d):
    got = load(spark, d, "nation").select("n_nationkey", "n_name").toArrow()
    return spark.createDataFrame(got)


@query("SELECT c_mktsegment, count(*) AS n, true AS kept, true AS freed FROM customer GROUP BY c_mktsegment")
def cached(spark, d):
    held = elements.persist(load(spark, d, "customer"), "memory_and_disk", eager=True)
    kept = held.is_cached
    out = held.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    at = scratch(spark)
    out.write.parquet(at)
    held.unpersist()
    return spark.read.parquet(at).withColumns({"kept": F.lit(kept), "freed": F.lit(not held.is_cached)})


@query("SELECT column_name AS name, CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS kind FROM (DESCRIBE SELECT * FROM customer)")
def described_schema(spark, d):
    return spark.createDataFrame(load(spark, d, "customer").dtypes, "name string, kind string")


@query("SELECT true AS scan, true AS pushed, true AS pruned, true AS command")
def explained_plans(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 1000").select("o_orderkey")
    text = elements.explained(o, "formatted")
    tables.register(spark, "q_explained", load(spark, d, "orders"))
    command = spark.sql("EXPLAIN SELECT count(*) FROM q_explained").first()[0]
    pruned = "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    return one_row(spark, "scan boolean, pushed boolean, pruned boolean, command boolean", "Scan parquet" in elements.debug_string(o), "GreaterThan(o_totalprice,1000.0)" in text, pruned, "HashAggregate" in command)


@query("SELECT '7' AS inside, true AS restored, true AS running")
def session_settings(spark, d):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with session.settings(spark, spark__sql__shuffle__partitions="7"):
        inside = spark.conf.get("spark.sql.shuffle.partitions")
    return one_row(spark, "inside string, restored boolean, running boolean", inside, spark.conf.get("spark.sql.shuffle.partitions") == before, not spark.sparkContext._jsc.sc().isStopped())


@query("SELECT c_custkey AS a, c_name AS b FROM customer")
def renamed_all(spark, d):
    return frames.to_df(load(spark, d, "customer").select("c_custkey", "c_name"), ["a", "b"])


@query("SELECT true AS near, true AS rows, true AS each_once, true AS with_repeats FROM (SELECT 1)")
def sampled(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.monotonically_increasing_id().alias("i"))
    n = li.count()
    some, one = elements.sample(li, 0.2, seed=3), elements.bernoulli(li, 0.3, 4)
    more = elements.poisson(li, 2.0, 5)
    near = abs(some.count() - 0.2 * n) < 6 * (0.16 * n) ** 0.5
    each = one.count() == one.select("i").distinct().count() and abs(one.count() - 0.3 * n) < 6 * (0.21 * n) ** 0.5
    return one_row(spark, "near boolean, rows boolean, each_once boolean, with_repeats boolean", near, some.select("i").distinct().join(li, "i", "left_anti").isEmpty(), each, more.groupBy("i").count().where("count > 1").count() > 0.3 * n)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
def strata(spark, d):
    """A stratum that isn't listed goes; one of fraction 1 stays whole."""
    return frames.sample_by(load(spark, d, "orders"), "o_orderstatus", {"F": 1.0, "O": 1.0}).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders")
def splits_joined(spark, d):
    parts = frames.random_split(load(spark, d, "orders").select("o_orderkey"), [1, 2, 3], 5)
    return tables.union_all(parts)


@query("SELECT l_suppkey, l_suppkey % 6 AS part, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def partitioned_by_function(spark, d):
    li = keyed.partition_by(load(spark, d, "lineitem").select("l_suppkey"), 6, F.col("l_suppkey"))
    return li.withColumn("part", F.spark_partition_id().cast("long")).groupBy("l_suppkey", "part").agg(F.count("*").alias("n"))


@query("SELECT 5 AS hash_parts, 4 AS range_parts, true AS one_place, true AS in_order, 3 AS fewer, 9 AS more")
def partitioners(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey")
    place = F.spark_partition_id().alias("part")
    by_hash = keyed.hash_partitioned(o, 5, "o_custkey")
    by_range = keyed.range_partitioned(o, 4, "o_orderkey")
    ends = sorted(map(tuple, by_range.select("o_orderkey", place).groupBy("part").agg(F.min("o_orderkey"), F.max("o_orderkey")).collect()))
    once = by_hash.select("o_custkey", place).distinct().groupBy("o_custkey").count().where("count > 1").isEmpty()
    many = lambda df: df.rdd.getNumPartitions()
    return one_row(spark, "hash_parts int, range_parts int, one_place boolean, in_order boolean, fewer int, more int", many(by_hash), len(ends), once, all(a[2] < b[1] for a, b in zip(ends, ends[1:], strict=False)), many(o.repartition(8).coalesce(3)), many(o.repartition(9)))


def _placed(df: DataFrame, key: str) -> DataFrame:
    """Where each row stands: partitions follow each other."""
    held = df.withColumn("_at", F.monotonically_increasing_id())
    return keyed.zip_with_index(held, ["_at"], "place").select(key, "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place FROM orders")
def sorted_by_key(spark, d):
    return _placed(keyed.sort_by_key(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", ascending=False), "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def sorted_by_key_ranges(spark, d):
    return _placed(keyed.sort_by_key(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", partitions=5), "o_orderkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY -c_acctbal, c_custkey) - 1 AS place FROM customer")
def sorted_by_function(spark, d):
    return _placed(keyed.sort_by(load(spark, d, "customer").select("c_custkey", "c_acctbal"), F.struct(-F.col("c_acctbal"), F.col("c_custkey"))), "c_custkey")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, true AS in_order FROM lineitem")
def repartitioned_and_sorted(spark, d):
    """Within a partition, rows follow each other by key and then in order."""
    li = keyed.repartition_and_sort(load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), 6, "l_suppkey", "l_orderkey")

    def run(batches):
        last = None
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            ok = [p is None or p <= r for p, r in zip([last, *rows], rows, strict=False)]
            last = rows[-1] if rows else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=["l_suppkey", "l_orderkey", "l_linenumber", "in_order"])

    return elements.map_partitions(li, run, "l_suppkey long, l_orderkey long, l_linenumber int, in_order boolean")


@query("SELECT p_brand, p_size + 1 AS bigger, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 30 GROUP BY p_brand, p_size")
def string_expressions(spark, d):
    return load(spark, d, "part").filter("p_size BETWEEN 10 AND 30").selectExpr("p_brand", "p_size + 1 AS bigger").groupBy("p_brand", "bigger").agg(F.expr("count(*) AS n")).sort("p_brand", "bigger")


@query("SELECT true AS whole, count(*) > 0 AS rows FROM (SELECT random() AS r FROM range(1000)) WHERE r >= 0 AND r < 1")
def random_numbers(spark, d):
    r = spark.range(1000).select(F.rand(5).alias("r"))
    return r.agg(F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("whole"), (F.count("*") > 0).alias("rows"))


@query("SELECT o.o_orderkey, o.o_custkey, c.c_custkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def paired_keys_join(spark, d):
    o, c = load(spark, d, "orders", "customer")
    return frames.join(o.select("o_orderkey", "o_custkey"), c.select("c_custkey", "c_name"), ["o_custkey"], ["c_custkey"])


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def joined_locally(spark, d):
    s, n = load(spark, d, "supplier", "nation")
    return keyed.join_local(s.select("s_suppkey", F.col("s_nationkey").alias("k")), n.select(F.col("n_nationkey").alias("k"), "n_name"), "k").select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def left_joined_locally(spark, d):
    """With a bound of no bytes both sides are shuffled, and the rows are the same."""
    c, s = load(spark, d, "customer", "supplier")
    s = s.select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    assert size_of(s) > 0
    return keyed.join_local(c.select("c_custkey"), s, "c_custkey", "left", most_bytes=0)


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 0 THEN cast(floor(o_totalprice) AS BIGINT) ELSE cast(ceil(o_totalprice) AS BIGINT) END AS whole FROM orders")
def cast_prices(spark, d):
    """A cast to whole numbers cuts what stands behind the point."""
    return load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("long").alias("whole"))


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END)::BIGINT AS \"F\", sum(CASE WHEN o_orderstatus = 'O' THEN 1 END)::BIGINT AS \"O\", sum(CASE WHEN o_orderstatus = 'P' THEN 1 END)::BIGINT AS \"P\" FROM orders GROUP BY o_custkey")
def pivot_whole(spark, d):
    return frames.pivot(load(spark, d, "orders").withColumn("one", F.lit(1).cast("long")), ["o_custkey"], "o_orderstatus", "one")
