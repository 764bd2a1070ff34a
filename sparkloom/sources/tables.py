"""Scans, the catalog and batch sinks."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, *names: str):
    """The named Parquet tables of a folder; one comes alone, several as a list."""
    frames = [spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames


def read(spark: SparkSession, kind: str, path: str, schema=None, **options) -> DataFrame:
    """csv (header and types inferred unless given), parquet, json (a record a line), text, avro, binary."""
    if kind == "csv":
        options = {"header": True, "inferSchema": schema is None} | options
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format("binaryFile" if kind == "binary" else kind).load(path)


def register(spark: SparkSession, name: str, source, kind: str | None = None, everywhere: bool = False, **options) -> DataFrame:
    """Names a DataFrame, an Arrow table, an RDD or a path of a kind as a view."""
    if isinstance(source, DataFrame):
        df = source
    elif kind:
        df = read(spark, kind, source, **options)
    else:
        df = spark.createDataFrame(source, **options)
    (df.createOrReplaceGlobalTempView if everywhere else df.createOrReplaceTempView)(name)
    return df


def deregister(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def table_names(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables()]


def database_names(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def schema_names(spark: SparkSession, catalog: str | None = None) -> list[str]:
    """The schemas (databases) of a catalog, by default the current one."""
    return [r[0] for r in spark.sql(f"SHOW SCHEMAS{f' IN {catalog}' if catalog else ''}").collect()]


def parallelize(spark: SparkSession, rows: list, schema: str, partitions: int | None = None) -> DataFrame:
    """Rows of the driver, dealt over partitions."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(partitions) if partitions else df


def partitioned(spark: SparkSession, batches: list) -> DataFrame:
    """Arrow batches of one schema, a partition each."""
    import pyarrow as pa

    table = pa.Table.from_batches(batches)
    at = pa.array([i for i, b in enumerate(batches) for _ in range(b.num_rows)], pa.int32())
    return spark.createDataFrame(table.append_column("_at", at)).repartitionById(len(batches), F.col("_at")).drop("_at")


def batches(df: DataFrame, most_rows: int = 10_000) -> Iterator:
    """df as Arrow batches, a partition at a time in the driver."""
    import pyarrow as pa

    def packed(rows):
        for b in rows:
            held = io.BytesIO()
            with pa.ipc.new_stream(held, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], names=["b"])

    for r in df.mapInArrow(packed, "b binary").toLocalIterator():
        for b in pa.ipc.open_stream(r["b"]):
            for at in range(0, b.num_rows, most_rows):
                yield b.slice(at, most_rows)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def numbers(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """Half open; a negative step counts down."""
    return spark.range(start, end, step)


def write(df: DataFrame, kind: str, path: str, mode: str = "overwrite", sort_by: list[str] | None = None, **options) -> None:
    """Parquet, csv (with header), json or text; sort_by orders the whole output, nulls last."""
    if sort_by:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in sort_by])
    if kind == "csv":
        options = {"header": True} | options
    if kind == "text" and len(df.columns) != 1:
        raise ValueError("a text sink takes one column")
    if kind == "text":
        df = df.select(F.col(df.columns[0]).cast("string"))
    df.write.mode(mode).options(**options).format(kind).save(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; below the warehouse only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return at.rstrip("/")


#: The folders whose deletion at the application's end has been seen to.
_ending: set[str] = set()


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one; with the application all of them end."""
    at = f"{shared_folder(spark)}/sparkloom-work-{spark.sparkContext.applicationId}"
    if at not in _ending:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ending.add(at)
    return f"{at}/{kind}-{uuid.uuid4().hex}"


def text_lines(df: DataFrame, column: str, path: str) -> None:
    """One line per row, in part files."""
    write(df.select(column), "text", path)


def available(spark: SparkSession, kind: str) -> bool:
    """Whether the session has the jar of a source (avro and kafka are apart from Spark itself)."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(kind, spark._jsparkSession.sessionState().conf())
    except Exception as e:  # the JVM's class lookup has no narrower type here
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e) or "deployed" in str(e):
            return False
        raise
    return True
