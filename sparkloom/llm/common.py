"""Shared plumbing of the training-data operators: tables, lineage cuts, skew."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any store it knows will do."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that go to a Python worker at once, where the session doesn't say how many: texts are long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """A session that says how many rows a batch has keeps its setting, Spark's own default included."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a folder below
    the SQL warehouse is used instead.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return at.rstrip("/")


#: The folders whose deletion at the application's end has been seen to.
_ending: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """The application's folder for intermediate tables in the shared folder; it is deleted when the application ends."""
    at = f"{shared_dir(spark)}/sparkloom-{spark.sparkContext.applicationId}"
    if at not in _ending:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ending.add(at)
    return at


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    The lineage ends there, a lost executor costs a reread instead of a
    recomputation, and the planner knows the size of what it joins next.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote for these frames; nothing may still need them."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def salted(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, limit: int
) -> tuple[DataFrame, DataFrame]:
    """Deals rows and their group table over salts, so that no group of over
    ``limit`` rows meets in one task.

    ``groups`` has one row per key with its row count in ``size``.  Fewer than
    total / limit groups are that large, so with a limit in proportion to the
    total their list has a fixed bound and can be broadcast.  Returns both
    frames with a ``_salt`` column to join on in addition to the keys.
    """
    hot = groups.where(F.col(size) > limit).select(
        *keys, F.ceil(F.col(size) / limit).cast("int").alias("_salts")
    )
    dealt = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_salts").cast("long"))).cast("int"))
        .drop("_salts")
    )
    spread = groups.withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(size) / limit).cast("int") - 1, F.lit(0)))),
    )
    return dealt, spread


def hot_limit(total: int, groups: int = 1024, least: int = 200) -> int:
    """Rows above which a group counts as hot: at most ``groups`` groups can be."""
    return max(least, -(-total // groups))


#: Texts in which common keys are looked for.
SAMPLED = 10_000


def frequent(rows: DataFrame, key: str, by: str, total: int) -> DataFrame | None:
    """(key, hot): keys that look to be in more than hot_limit of rows' texts, judged by a sample of the ``by``; None without any.

    Only the way that a key's rows take may hang on it, never a result.
    """
    share = min(1.0, SAMPLED / max(total, 1))
    some = rows.where(F.pmod(F.xxhash64(by), F.lit(1 << 20)) < int(share * (1 << 20)))
    hot = materialize(some.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > max(4.0, hot_limit(total) * share)).select(key, F.lit(True).alias("hot")))
    return None if hot.isEmpty() else hot


def null_safe(*pairs: tuple[Column, Column]) -> Column:
    out = None
    for a, b in pairs:
        term = a.eqNullSafe(b)
        out = term if out is None else out & term
    return out


def pick(df: DataFrame, *needed: str, **default: str) -> DataFrame:
    """Only the named columns; a missing optional column becomes a typed null."""
    have = set(df.columns)
    return df.select(
        *needed, *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in default.items()]
    )


#: Rows of (key) up to which a list of keys may be broadcast: about 24 MB.
MOST_KEYS = 1_000_000


def narrow(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """big joined to a table of distinct keys; the keys are broadcast if a count
    shows that they are few, otherwise both sides are shuffled."""
    return narrow_by(big, keys, [on])


def narrow_by(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The same for several key columns."""
    few = keys.count() <= MOST_KEYS
    return big.join(F.broadcast(keys) if few else keys, on)
