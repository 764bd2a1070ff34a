"""The small workloads that engines are timed with; their sizes are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query


def pi(spark: SparkSession, samples: int) -> DataFrame:
    """Random points in a square, and four times the share of them in the circle."""
    x, y = F.rand(1) * 2 - 1, F.rand(2) * 2 - 1
    points = spark.range(samples).select((x * x + y * y <= 1).alias("inside"))
    return points.agg((4 * F.count_if("inside") / samples).alias("pi"))


def records(spark: SparkSession, n: int, keys: int) -> DataFrame:
    """(k, i): keys that jump about."""
    return spark.range(n).select(F.pmod(F.col("id") * 2654435761 % 4294967296, F.lit(keys)).alias("k"), F.col("id").alias("i"))


def ordered(spark: SparkSession, n: int, keys: int = 10_000_000) -> DataFrame:
    return records(spark, n, keys).orderBy("k", "i")


def joined(spark: SparkSession, n: int, keys: int = 200_000) -> DataFrame:
    return records(spark, n, keys).join(records(spark, n, keys).withColumnRenamed("i", "j"), "k")


@query("SELECT true AS near FROM (SELECT 1)")
def pi_random(spark, d):
    return pi(spark, 2_000_000).select((F.abs(F.col("pi") - 3.14159265) < 0.01).alias("near"))


@query("SELECT (i * 2654435761 % 4294967296) % 10000000 AS k, i FROM range(20000) t(i)")
def sort_records(spark, d):
    return ordered(spark, 20_000)


@query("SELECT a.k, a.i, b.i AS j FROM (SELECT (i * 2654435761 % 4294967296) % 2000 AS k, i FROM range(10000) t(i)) a JOIN (SELECT (i * 2654435761 % 4294967296) % 2000 AS k, i FROM range(10000) t(i)) b ON a.k = b.k")
def join_records(spark, d):
    return joined(spark, 10_000, 2_000)
