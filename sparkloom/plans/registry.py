"""Where queries and the SQL that must agree with them are put down."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.tables import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def plain(name: str, sql: str, oracle: str | None = None) -> None:
    """A query that is SQL text; only the tables it names are opened."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
        views = {t: load(spark, sf_dir, t) for t in TABLES if t in words}
        return spark.sql(_bound(sql, views), **{f"v_{t}": df for t, df in views.items()})

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or sql


def _bound(sql: str, views: dict) -> str:
    if not views:
        return sql
    return re.sub(rf"(?<![\w.])({'|'.join(views)})(?![\w.(])", r"{v_\1}", sql)
