"""A session's life and settings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: What the engine counts on; a caller's settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "sparkloom", master: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one; dots in names of settings are written as two underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[SparkSession]:
    """Settings for a block of code; what was set before comes back, also after an error."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def close(spark: SparkSession) -> None:
    """Ends streams, then the session."""
    for q in spark.streams.active:
        q.stop()
    spark.stop()
