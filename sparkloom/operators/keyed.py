"""Keyed and element-wise operators over columns k and v, with RDD forms for opaque functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut, size_of


def reduce_by_key(df: DataFrame, key: str, value: str, how: str = "sum") -> DataFrame:
    """sum, max, min or count per key, combined before the shuffle."""
    return df.groupBy(key).agg(getattr(F, how)(value).alias(value))


def fold_by_key(df: DataFrame, key: str, value: str, zero: Column, f: Callable, merge: Callable | None = None, salts: int = 64) -> DataFrame:
    """Folds each key's values with a column function.

    With merge (of two folded values) a key's values are folded in ``salts``
    parts, so no task holds all of a hot key's; without, in value order at once.
    """
    if merge is None:
        return df.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list(value)), zero, f).alias(value))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_salt")
    parts = df.select(key, value, salt).groupBy(key, "_salt").agg(F.aggregate(F.collect_list(value), zero, f).alias("_part"))
    return parts.groupBy(key).agg(F.aggregate(F.collect_list("_part"), zero, merge).alias(value))


def count_by_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key)


def values(df: DataFrame, value: str) -> DataFrame:
    return df.select(value)


def map_values(df: DataFrame, value: str, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(value, f(F.col(value)))


def flat_map_values(df: DataFrame, value: str, f: Callable[[Column], Column]) -> DataFrame:
    """f: a value to an array; a row per element."""
    return df.withColumn(value, F.explode(f(F.col(value))))


def collect_as_map(df: DataFrame, key: str, value: str, most: int = 1_000_000) -> dict:
    """The last value of each key in value order; more than ``most`` keys are an error, as all come to the driver."""
    rows = df.groupBy(key).agg(F.max(value).alias(value)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keys")
    return {r[0]: r[1] for r in rows}


def group_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(value))


def cogroup(a: DataFrame, b: DataFrame, key: str, va: str, vb: str) -> DataFrame:
    """Both sides' values of each key of either side; each side is grouped before they meet."""
    left, right = group_by_key(a, key, va), group_by_key(b, key, vb)
    empty = lambda c, d: F.coalesce(F.col(c), F.array().cast(dict(d.dtypes)[c])).alias(c)
    return left.join(right, key, "full").select(key, empty(va, left), empty(vb, right))


def subtract_by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, key: str, value: str, k) -> list:
    return [r[0] for r in df.where(F.col(key) == k).select(value).collect()]


def top(df: DataFrame, n: int, *by: Column) -> DataFrame:
    return df.orderBy(*by).limit(n)


def zip_with_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Gapless from 0 in this order: rows are numbered in the ranges of a sort and each range is offset by the counts of those before.

    The sorted rows are written once, so that both passes see the same ranges.
    """
    spot, low = F.monotonically_increasing_id(), (1 << 33) - 1  # partition, then place in it
    sorted_ = cut(df.orderBy(*order).withColumn("_spot", spot))
    part = F.shiftright("_spot", 33).alias("_part")
    counts = sorted_.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    rows = sorted_.withColumn("_part", part).join(F.broadcast(before), "_part")
    return rows.withColumn(name, F.col("_before") + F.col("_spot").bitwiseAND(F.lit(low))).drop("_spot", "_part", "_before")


def sort_by_key(df: DataFrame, key: str, ascending: bool = True, partitions: int | None = None) -> DataFrame:
    order = F.col(key).asc_nulls_last() if ascending else F.col(key).desc_nulls_last()
    return df.repartitionByRange(partitions, order).sortWithinPartitions(order) if partitions else df.orderBy(order)


def sort_by(df: DataFrame, by: Column, ascending: bool = True) -> DataFrame:
    return df.orderBy(by.asc_nulls_last() if ascending else by.desc_nulls_last())


def partition_by(df: DataFrame, partitions: int, place: Column) -> DataFrame:
    """place: the partition of each row, taken modulo their number; null counts as 0."""
    return df.repartitionById(partitions, F.coalesce(F.pmod(place, F.lit(partitions)), F.lit(0)).cast("int"))


def hash_partitioned(df: DataFrame, partitions: int, *by: str) -> DataFrame:
    return df.repartition(partitions, *by)


def range_partitioned(df: DataFrame, partitions: int, *by: str) -> DataFrame:
    return df.repartitionByRange(partitions, *by)


def join_local(a: DataFrame, b: DataFrame, key: str, how: str = "inner", most_bytes: int = 64 << 20) -> DataFrame:
    """A join without a shuffle of a: b goes to every task if the planner's bound on its size allows it, else both are shuffled."""
    return a.join(F.broadcast(b) if size_of(b) <= most_bytes else b, key, how)


def repartition_and_sort(df: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    return df.repartition(n, key).sortWithinPartitions(key, *order)


def reduce_rdd(rdd: RDD, f: Callable, depth: int = 2):
    """By a tree of partial results; None for an empty RDD."""
    return None if rdd.isEmpty() else rdd.treeReduce(f, depth)


def largest(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group in an order; a task keeps n of a group before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def histogram(df: DataFrame, col: str, bounds: list[float]) -> DataFrame:
    """Counts of [b, next b), the last closed; what lies outside is dropped."""
    c = F.col(col)
    pairs = list(zip(bounds[:-1], bounds[1:], strict=True))
    bucket = None
    for i, (low, high) in enumerate(pairs):
        test = (c >= low) & ((c <= high) if i == len(pairs) - 1 else (c < high))
        bucket = F.when(test, i) if bucket is None else bucket.when(test, i)
    if bucket is None:
        return df.sparkSession.createDataFrame([], "bucket int, n long")
    return df.select(bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def stats(df: DataFrame, col: str) -> DataFrame:
    """All of a column's moments in one pass."""
    c = F.col(col)
    return df.agg(
        F.count(c).alias("n"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.var_pop(c).alias("var_pop"), F.stddev_pop(c).alias("stddev_pop"), F.var_samp(c).alias("var_samp"),
    )


def running(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))
