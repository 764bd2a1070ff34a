"""Element, partition and keyed operators over whole tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import elements, keyed
from sparkloom.plans.registry import query
from sparkloom.plans.tables import one_row
from sparkloom.sources.tables import load


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def flat_mapped(spark, d):
    return elements.flat_map(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", lambda c: F.split(c, " "), "word").drop("p_name")


@query("SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY l_returnflag")
def partitions_mapped(spark, d):
    """Each partition is summed in Arrow, the sums are added up."""

    def run(batches):
        for b in batches:
            got = pa.Table.from_batches([b]).group_by("l_returnflag").aggregate([("l_quantity", "sum")])
            yield from got.rename_columns(["l_returnflag", "part"]).to_batches()

    parts = elements.map_partitions(load(spark, d, "lineitem").select("l_returnflag", "l_quantity"), run, "l_returnflag string, part double")
    return parts.groupBy("l_returnflag").agg(F.sum("part").alias("total"))


@query("SELECT o_orderkey, o_orderkey % 5 AS part FROM orders")
def partitions_mapped_with_index(spark, d):
    def run(i, batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i] * b.num_rows, pa.int64())], names=["o_orderkey", "part"])

    dealt = keyed.partition_by(load(spark, d, "orders").select("o_orderkey"), 5, F.col("o_orderkey"))
    return elements.map_partitions_with_index(dealt, run, "o_orderkey long, part long")


@query("SELECT l_suppkey AS k, count(*) AS n, min(l_orderkey) AS v FROM lineitem GROUP BY l_suppkey")
def partitions_mapped_to_pairs(spark, d):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["k", "v"])

    pairs = elements.map_partitions_to_pair(load(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), run, "long", "long")
    return pairs.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("v"))


@query("SELECT o_orderkey * 2 AS twice FROM orders WHERE o_orderstatus = 'F'")
def collected_with(spark, d):
    return elements.collect_with(load(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderkey") * 2, "twice")


@query("SELECT c_nationkey % 3 AS k, c_custkey, c_name FROM customer")
def keyed_by(spark, d):
    return elements.key_by(load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_nationkey") % 3).select("k", "v.c_custkey", "v.c_name")


@query("SELECT c_nationkey AS k, c_custkey AS v FROM customer")
def keys_and_values(spark, d):
    """The keys and the values, each numbered alike, side by side again."""
    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"))
    held = keyed.zip_with_index(c, ["v"], "i")
    k = keyed.keys(held.select(F.struct("i", "k").alias("key")), "key").select("key.*")
    v = keyed.values(held.select(F.struct("i", "v").alias("value")), "value").select("value.*")
    return k.join(v, "i").select("k", "v")


@query("SELECT c_nationkey, c_acctbal + 1 AS c_acctbal FROM customer")
def values_mapped(spark, d):
    return keyed.map_values(load(spark, d, "customer").select("c_nationkey", "c_acctbal"), "c_acctbal", lambda c: c + 1)


@query("SELECT p_size, unnest(string_split(p_type, ' ')) AS p_type FROM part")
def values_flat_mapped(spark, d):
    return keyed.flat_map_values(load(spark, d, "part").select("p_size", "p_type"), "p_type", lambda c: F.split(c, " "))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def counted_by_key(spark, d):
    return keyed.count_by_key(load(spark, d, "orders"), "o_custkey")


@query("SELECT o_orderstatus AS word, count(*) AS n FROM orders GROUP BY o_orderstatus")
def counted_by_value(spark, d):
    return keyed.count_by_key(load(spark, d, "orders").select(F.col("o_orderstatus").alias("word")), "word")


@query("SELECT s_nationkey AS k, max(s_name) AS v FROM supplier GROUP BY s_nationkey")
def collected_as_map(spark, d):
    got = keyed.collect_as_map(load(spark, d, "supplier"), "s_nationkey", "s_name")
    return spark.createDataFrame(list(got.items()), "k int, v string")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def looked_up(spark, d):
    return spark.createDataFrame([(x,) for x in keyed.lookup(load(spark, d, "orders"), "o_custkey", "o_orderkey", 7)], "o_orderkey long")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def top_rows(spark, d):
    return keyed.top(load(spark, d, "part").select("p_partkey", "p_retailprice"), 15, F.desc("p_retailprice"), F.asc("p_partkey"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def largest_of_each(spark, d):
    return keyed.largest(load(spark, d, "orders"), 3, ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


def _pairs(spark, d):
    """(supplier, whole quantity) as an RDD."""
    return load(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q")).rdd.map(tuple)


@query("SELECT l_suppkey AS k, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def combined_by_key(spark, d):
    got = elements.combine_by_key(_pairs(spark, d), lambda v: (v, 1), lambda a, v: (a[0] + v, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return spark.createDataFrame(got.map(lambda x: (x[0], *x[1])), "k long, total long, n long")


@query("SELECT l_suppkey AS k, cast(max(cast(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY l_suppkey")
def aggregated_by_key(spark, d):
    return spark.createDataFrame(elements.aggregate_by_key(_pairs(spark, d), 0, max, max), "k long, v long")


@query("SELECT l_suppkey AS k, cast(min(cast(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY l_suppkey")
def reduced_by_key_locally(spark, d):
    return spark.createDataFrame(list(elements.reduce_by_key_locally(_pairs(spark, d), min).items()), "k long, v long")


@query("SELECT cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS total, cast(max(cast(l_quantity AS BIGINT)) AS BIGINT) AS most, count(*) AS n, cast(max(l_suppkey) AS BIGINT) AS tree FROM lineitem")
def reduced_elements(spark, d):
    rdd = _pairs(spark, d)
    total = elements.fold(rdd.map(lambda x: x[1]), 0, lambda a, b: a + b)
    most, n = elements.aggregate(rdd, (0, 0), lambda a, x: (max(a[0], x[1]), a[1] + 1), lambda a, b: (max(a[0], b[0]), a[1] + b[1]))
    return one_row(spark, "total long, most long, n long, tree long", total, most, n, keyed.reduce_rdd(rdd.map(lambda x: x[0]), max, depth=3))


@query("SELECT p_partkey AS k, sum(p_size * 3)::BIGINT AS v FROM part GROUP BY p_partkey")
def folded_by_key(spark, d):
    """Folded in parts, which are then merged."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"))
    return keyed.fold_by_key(p, "k", "v", F.lit(0).cast("long"), lambda a, x: a + 3 * x, merge=lambda a, b: a + b)


@query("SELECT l_returnflag, min(l_quantity) AS least FROM lineitem GROUP BY l_returnflag")
def least_values(spark, d):
    return keyed.reduce_by_key(load(spark, d, "lineitem"), "l_returnflag", "l_quantity", "min").withColumnRenamed("l_quantity", "least")


@query("SELECT 40 AS rows, 40 AS different, true AS known")
def sample_of_a_size(spark, d):
    c = load(spark, d, "customer").select("c_custkey")
    got = elements.take_sample(c, 40, seed=9)
    ids = {r[0] for r in got.collect()}
    return one_row(spark, "rows int, different int, known boolean", got.count(), len(ids), c.where(F.col("c_custkey").isin(list(ids))).count() == 40)


@query("SELECT upper(n_name) AS value FROM nation")
def piped(spark, d):
    return elements.pipe(load(spark, d, "nation").select("n_name"), "tr a-z A-Z")


@query("SELECT o_orderkey, o_orderkey % 4 AS part FROM orders")
def glommed(spark, d):
    dealt = keyed.partition_by(load(spark, d, "orders").select("o_orderkey"), 4, F.col("o_orderkey"))
    return elements.glom(dealt, "o_orderkey").select(F.explode("values").alias("o_orderkey"), F.col("partition").cast("long").alias("part"))


@query("SELECT count(*) AS rows, count(*) AS ids FROM lineitem")
def unique_ids(spark, d):
    return elements.zip_with_unique_id(load(spark, d, "lineitem").select("l_orderkey")).agg(F.count("*").alias("rows"), F.count_distinct("uid").alias("ids"))


@query("SELECT count(*) AS about, true AS sum_near, true AS mean_near FROM lineitem")
def approximate_jobs(spark, d):
    """With time enough, what is counted is exact."""
    li = load(spark, d, "lineitem")
    exact = li.agg(F.sum("l_quantity"), F.avg("l_quantity")).first()
    got = elements.sum_approx(li, "l_quantity", 600_000), elements.mean_approx(li, "l_quantity", 600_000)
    return one_row(spark, "about long, sum_near boolean, mean_near boolean", elements.count_approx(li, 600_000), abs(got[0] - exact[0]) < 1e-6 * exact[0], abs(got[1] - exact[1]) < 1e-6 * exact[1])


@query("SELECT count(*) AS seen, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem")
def accumulated(spark, d):
    """What tasks add up while they go over the rows of a partition."""
    seen, total = (elements.accumulator(load(spark, d, "region"), 0, lambda a, b: a + b) for _ in range(2))

    def run(rows):
        for r in rows:
            seen.add(1)
            total.add(int(r[0]))

    load(spark, d, "lineitem").select("l_quantity").foreachPartition(run)
    return one_row(spark, "seen long, total long", seen.value, total.value)


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def broadcast_value(spark, d):
    """A small table as a value that every task holds."""
    n = load(spark, d, "nation").select("n_nationkey", "n_name").toArrow()
    held = spark.sparkContext.broadcast(dict(zip(n.column(0).to_pylist(), n.column(1).to_pylist(), strict=True)))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held.value.get(k) for k in b.column(1).to_pylist()], pa.string())], names=["s_suppkey", "n_name"])

    return load(spark, d, "supplier").select("s_suppkey", "s_nationkey").mapInArrow(run, "s_suppkey long, n_name string")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 IN (1, 4)")
def job_on_partitions(spark, d):
    dealt = keyed.partition_by(load(spark, d, "orders").select("o_orderkey"), 6, F.col("o_orderkey"))
    return spark.createDataFrame([(x,) for x in elements.run_job(dealt, lambda rows: [r[0] for r in rows], [1, 4])], "o_orderkey long")


@query("SELECT o_custkey, cast(sum(cast(o_totalprice AS BIGINT) * 0 + 1) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def iterated_locally(spark, d):
    """Partition by partition in the driver."""
    got = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return spark.createDataFrame([tuple(r) for r in got.toLocalIterator()], "o_custkey long, n long")


@query("SELECT true AS jobs, true AS tasks, true AS read, true AS shuffled, true AS quiet")
def job_metrics(spark, d):
    _, got = elements.measured(spark, lambda: load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*")).collect())
    _, none = elements.measured(spark, lambda: None)
    return one_row(spark, "jobs boolean, tasks boolean, read boolean, shuffled boolean, quiet boolean", got["jobs"] > 0, got["tasks"] > 0, got["input_bytes"] > 0, got["shuffle_bytes"] > 0, none["jobs"] == 0)


@query("SELECT true AS stopped, count(*) AS n FROM region")
def cancelled_group(spark, d):
    """A group of jobs that is cancelled ends with an error; the next job runs."""
    import threading

    group, held = f"q-{uuid.uuid4().hex}", {}

    def slow(batches):
        import time

        for b in batches:
            time.sleep(60)
            yield b

    def work():
        try:
            elements.with_group(spark, group, lambda: spark.range(4).mapInArrow(slow, "id long").collect())
        except Exception as e:  # the error's class depends on where the job was
            held["error"] = e

    at = threading.Thread(target=work)
    at.start()
    for _ in range(200):
        elements.cancel(spark, group)
        at.join(0.1)
        if not at.is_alive():
            break
    return one_row(spark, "stopped boolean, n long", "error" in held, load(spark, d, "region").count())


@query("SELECT a.c_custkey AS c_custkey, pos AS place FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) a")
def zipped_with_index_by_key(spark, d):
    return keyed.zip_with_index(load(spark, d, "customer").select("c_custkey"), ["c_custkey"], "place")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT IN (SELECT l_quantity FROM lineitem WHERE l_quantity > 10)")
def subtracted(spark, d):
    li = load(spark, d, "lineitem")
    more = li.where("l_quantity > 10").select("l_quantity")
    few = elements.subtract(li.select("l_quantity"), more).distinct()
    return li.join(few, "l_quantity", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT l_shipdate AS day FROM lineitem WHERE l_shipdate IN (SELECT o_orderdate FROM orders)")
def intersected(spark, d):
    li, o = load(spark, d, "lineitem", "orders")
    return elements.intersection(li.select(F.col("l_shipdate").alias("day")), o.select(F.col("o_orderdate").alias("day")))
