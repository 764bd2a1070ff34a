"""DataFrame operators whose semantics need more than one built-in call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_df(df: DataFrame, names: list[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def drop_duplicates(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key; with an order it's the first one, else any."""
    if not keys:
        return df.distinct()
    if not order:
        return df.dropDuplicates(keys)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def drop_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=cols or None)


def fill_null(df: DataFrame, col: str, value) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def _match(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    left, right = a.alias("a"), b.distinct().toDF(*a.columns).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in a.columns]
    return left.join(right, on, how)


def intersect_all(a: DataFrame, b: DataFrame, ansi: bool = True) -> DataFrame:
    """ANSI multiplicity min(m, n), or every left row that has a match."""
    return a.intersectAll(b) if ansi else _match(a, b, "left_semi")


def except_all(a: DataFrame, b: DataFrame, ansi: bool = True) -> DataFrame:
    """ANSI multiplicity max(m - n, 0), or every left row that has no match."""
    return a.exceptAll(b) if ansi else _match(a, b, "left_anti")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files can't be read by so many tasks (a few large row groups); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pivot(df: DataFrame, group: list[str], on: str, value: str, agg: str = "sum", most: int = 10_000) -> DataFrame:
    """One column per value of ``on`` (as strings, sorted, without null); more than ``most`` values are an error."""
    key = F.col(on).cast("string")
    values = sorted(r[0] for r in df.where(key.isNotNull()).select(key).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"{on} has more than {most} values")
    return df.withColumn("_p", key).groupBy(*group).pivot("_p", values).agg(getattr(F, agg)(value))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of b's values per value of a; absent pairs are 0, null values of b are left out."""
    out = pivot(df.withColumn("_one", F.lit(1).cast("long")).withColumnRenamed(a, f"{a}_{b}"), [f"{a}_{b}"], b, "_one")
    return out.na.fill(0, subset=out.columns[1:])


def corr(df: DataFrame, a: str, b: str) -> float | None:
    """Pearson; None where it isn't defined."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.expr(f"try_divide(covar_pop({a}, {b}), stddev_pop({a}) * stddev_pop({b}))")).first()[0]


def cov(df: DataFrame, a: str, b: str) -> float | None:
    return df.agg(F.covar_samp(a, b)).first()[0]


def freq_items(df: DataFrame, col: str, support: float) -> DataFrame:
    """Exact: values in at least ceil(support * rows) rows, most frequent first."""
    total = df.agg(F.count("*").alias("_total"))
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") >= F.ceil(F.lit(support) * F.col("_total"))).drop("_total").orderBy(F.desc("n"), col)


def sample_by(df: DataFrame, col: str, fractions: dict, seed: int = 0) -> DataFrame:
    """Stratified; strata that aren't listed are dropped."""
    key = F.col(col).cast("string")
    return df.sampleBy(key, {str(k): v for k, v in fractions.items()}, seed) if fractions else df.limit(0)


def random_split(df: DataFrame, weights: list[float], seed: int = 0) -> list[DataFrame]:
    if any(w < 0 for w in weights):
        raise ValueError("weights are not negative")
    return df.randomSplit([float(w) for w in weights], seed) if sum(weights) > 0 else []


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, nulls, mean, stddev, min, median and max as one row."""
    c = F.col(col)
    return df.agg(
        F.count(c).alias("count"), F.count_if(c.isNull()).alias("nulls"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"),
        F.min(c).alias("min"), F.median(c).alias("median"), F.max(c).alias("max"),
    )


def asof_join(left: DataFrame, right: DataFrame, on: str, by: str, value: str) -> DataFrame:
    """Each left row with the latest right value of its key at or before it; one shuffle, no range join."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(by, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def groups_frame(df: DataFrame, by: list[str], order: str, agg: Column, name: str, start: int, end: int) -> DataFrame:
    """A GROUPS frame: from ``start`` to ``end`` peer groups off the current one, as a range over their dense rank."""
    ranked = df.withColumn("_peers", F.dense_rank().over(W.partitionBy(*by).orderBy(order)))
    return ranked.withColumn(name, agg.over(W.partitionBy(*by).orderBy("_peers").rangeBetween(start, end))).drop("_peers")


def summary(df: DataFrame, *cols: str) -> DataFrame:
    """count, mean, stddev, min, quartiles and max as rows."""
    return df.select(*cols).summary() if cols else df.summary()


def join(a: DataFrame, b: DataFrame, left: list[str], right: list[str], how: str = "inner") -> DataFrame:
    """Equality of paired key columns, both sides' keys kept; names that clash get ``_right``."""
    clash = {c: f"{c}_right" for c in b.columns if c in a.columns}
    b = b.withColumnsRenamed(clash)
    on = [a[x] == b[clash.get(y, y)] for x, y in zip(left, right, strict=True)]
    return a.join(b, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
