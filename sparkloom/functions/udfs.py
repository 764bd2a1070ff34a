"""User functions: scalar and aggregate, vectorised, with a registry that describes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DESCRIBED: dict[str, str] = {}


def register_scalar(spark: SparkSession, name: str, f: Callable, returns: str, about: str = "") -> None:
    """f takes and returns pandas Series; all arguments are passed with their types."""
    spark.udf.register(name, F.pandas_udf(f, returns))
    DESCRIBED[name] = about


def register_aggregate(spark: SparkSession, name: str, f: Callable, returns: str, about: str = "") -> None:
    """f takes pandas Series (annotated) and returns a scalar."""
    register_scalar(spark, name, f, returns, about)


def register_table(spark: SparkSession, name: str, f: type, returns: str, about: str = "") -> None:
    """f is a class whose eval(...) yields rows; it is called LATERAL in SQL."""
    spark.udtf.register(name, F.udtf(f, returnType=returns))
    DESCRIBED[name] = about
