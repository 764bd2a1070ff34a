"""Cutting lineage: what is written once is read again, not computed again, when an executor is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as written into the session's shared checkpoint folder; its partitioning is kept."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        conf = df.sparkSession.conf
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)


def size_of(df: DataFrame) -> int:
    """The planner's bound on the bytes of df: of files their size, of what can't be known very much."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
