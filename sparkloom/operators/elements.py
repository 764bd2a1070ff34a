"""Element and partition operators.  Column expressions come first; the RDD forms are for opaque functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark import RDD, StorageLevel
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.keyed import zip_with_index


def flat_map(df: DataFrame, column: str, f: Callable, name: str) -> DataFrame:
    """f: a column to an array column; a row per element, none for an empty array or null."""
    return df.withColumn(name, F.explode(f(F.col(column))))


def map_partitions(df: DataFrame, f: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """f takes and yields Arrow batches."""
    return df.mapInArrow(f, schema)


def map_partitions_with_index(df: DataFrame, f: Callable[[int, Iterator], Iterator], schema) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        return f(TaskContext.get().partitionId(), batches)

    return df.mapInArrow(run, schema)


def collect_with(df: DataFrame, condition, value, name: str = "value") -> DataFrame:
    """A partial function: rows where the condition holds, mapped."""
    return df.where(condition).select(value.alias(name))


def map_partitions_to_pair(df: DataFrame, f: Callable[[Iterator], Iterator], key: str, value: str) -> DataFrame:
    """f takes Arrow batches and yields batches of the columns k and v, of the types key and value."""
    return df.mapInArrow(f, f"k {key}, v {value}")


def key_by(df: DataFrame, key, name: str = "k") -> DataFrame:
    return df.select(key.alias(name), F.struct(*df.columns).alias("v"))


def zip_frames(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of equal rank side by side; unequal lengths are an error."""
    if a.count() != b.count():
        raise ValueError("zip needs sides of one length")
    return zip_with_index(a, order_a, "_i").join(zip_with_index(b, order_b, "_i"), "_i").drop("_i")


def zip_with_unique_id(df: DataFrame, name: str = "uid") -> DataFrame:
    """Place in the partition, after the partition's number: unique without a second job, not gapless."""
    return df.withColumn(name, F.monotonically_increasing_id())


def glom(df: DataFrame, column: str) -> DataFrame:
    """(partition, values): one array per non-empty partition, made where the rows are."""
    kind = df.schema[column].dataType.simpleString()

    def run(i, batches):
        import pyarrow as pa

        held = [b.column(0) for b in batches]
        if held:
            flat = pa.chunked_array(held).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.LargeListArray.from_arrays(pa.array([0, len(flat)], pa.int64()), flat).cast(pa.list_(flat.type))],
                names=["partition", "values"],
            )

    return map_partitions_with_index(df.select(column), run, f"partition int, values array<{kind}>")


def take_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows without replacement; each task keeps n, no sort of the whole."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def bernoulli(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Each row on its own with a probability; no row twice."""
    return df.where(F.rand(seed) < fraction)


def poisson(df: DataFrame, mean: float, seed: int = 0) -> DataFrame:
    """Each row as many times as a Poisson draw says."""
    return df.sample(True, mean, seed)


def sample(df: DataFrame, fraction: float, replace: bool = False, seed: int = 0) -> DataFrame:
    return df.sample(replace, fraction, seed)


def pipe(df: DataFrame, command: str) -> DataFrame:
    """Lines of a one-column frame through a command per partition; a failing command fails the job."""
    lines = df.select(F.col(df.columns[0]).cast("string")).rdd.map(lambda r: "" if r[0] is None else r[0])
    return df.sparkSession.createDataFrame(lines.pipe(f"sh -c '{command}'", checkCode=True).map(lambda x: (x,)), "value string")


def count_approx(df: DataFrame, timeout_ms: int, confidence: float = 0.95) -> int:
    """What was counted by the deadline, extrapolated; exact if all tasks were done."""
    return df.select(F.lit(1)).rdd.countApprox(timeout_ms, confidence)


def sum_approx(df: DataFrame, column: str, timeout_ms: int, confidence: float = 0.95) -> float:
    """What was summed by the deadline, extrapolated; each task sums its rows natively, and only its sum is Python's."""
    return float(_partial(df, column).map(lambda r: r[0]).sumApprox(timeout_ms, confidence))


def mean_approx(df: DataFrame, column: str, timeout_ms: int, confidence: float = 0.95) -> float:
    return sum_approx(df, column, timeout_ms, confidence) / max(sum_approx(df.select(F.col(column).isNotNull().cast("double").alias(column)), column, timeout_ms, confidence), 1.0)


def _partial(df: DataFrame, column: str) -> RDD:
    """One row a partition: its sum."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        total = 0.0
        for b in batches:
            total += pc.sum(b.column(0)).as_py() or 0.0
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64())], names=["x"])

    return df.select(F.col(column).cast("double")).mapInArrow(run, "x double").rdd


def fold(rdd: RDD, zero, f: Callable):
    """zero enters once per partition and once at the merge."""
    return rdd.fold(zero, f)


def aggregate(rdd: RDD, zero, seq: Callable, comb: Callable, depth: int = 2):
    return rdd.treeAggregate(zero, seq, comb, depth)


def aggregate_by_key(rdd: RDD, zero, seq: Callable, comb: Callable) -> RDD:
    return rdd.aggregateByKey(zero, seq, comb)


def combine_by_key(rdd: RDD, create: Callable, merge_value: Callable, merge: Callable) -> RDD:
    return rdd.combineByKey(create, merge_value, merge)


def reduce_by_key_locally(rdd: RDD, f: Callable) -> dict:
    return rdd.reduceByKeyLocally(f)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, copies kept; nulls are equal."""
    from sparkloom.operators.frames import except_all

    return except_all(a, b, ansi=False)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b has, copies kept; nulls are equal."""
    from sparkloom.operators.frames import intersect_all

    return intersect_all(a, b, ansi=False)


LEVELS = {
    "memory": StorageLevel.MEMORY_ONLY,
    "memory_and_disk": StorageLevel.MEMORY_AND_DISK,
    "disk": StorageLevel.DISK_ONLY,
}


def persist(df: DataFrame, level: str = "memory_and_disk", eager: bool = False) -> DataFrame:
    df = df.persist(LEVELS[level])
    if eager:
        df.count()
    return df


class _Merge(AccumulatorParam):
    def __init__(self, f: Callable):
        self.f = f

    def zero(self, value):
        return value

    def addInPlace(self, a, b):
        return self.f(a, b)


def accumulator(df: DataFrame, zero, merge: Callable):
    """merge must have zero as its neutral element."""
    return df.sparkSession.sparkContext.accumulator(zero, _Merge(merge))


def run_job(df: DataFrame, f: Callable[[Iterator], Iterator], partitions: list[int] | None = None) -> list:
    """f over the rows of the chosen partitions; what it yields comes to the driver."""
    return df.sparkSession.sparkContext.runJob(df.rdd, f, partitions)


def with_group(spark, group: str, f: Callable, about: str = ""):
    """Runs f with its jobs in a group that cancel(spark, group) can stop."""
    sc = spark.sparkContext
    sc.addJobTag(group)
    if about:
        sc.setJobDescription(about)
    try:
        return f()
    finally:
        sc.removeJobTag(group)
        if about:
            sc.setJobDescription(None)


def cancel(spark, group: str) -> None:
    spark.sparkContext.cancelJobsWithTag(group)


def debug_string(df: DataFrame) -> str:
    """The physical plan, stage by stage."""
    return explained(df, "formatted")


def explained(df: DataFrame, mode: str = "simple") -> str:
    """What explain() prints: simple, extended, codegen, cost or formatted."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def measured(spark, f: Callable):
    """f's result and the jobs, stages and tasks that it ran, with the bytes they read and shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    group = f"measured-{uuid.uuid4().hex}"
    out = with_group(spark, group, f)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    found = {"jobs": 0, "stages": 0, "tasks": 0, "input_bytes": 0, "shuffle_bytes": 0}
    jobs = store.jobsList(None)
    for i in range(jobs.size()):
        job = jobs.apply(i)
        if group not in str(job.jobTags()):
            continue
        found["jobs"] += 1
        for k in range(job.stageIds().size()):
            stage = store.lastStageAttempt(job.stageIds().apply(k))
            if str(stage.status()) == "COMPLETE":
                found["stages"] += 1
                found["tasks"] += stage.numCompleteTasks()
                found["input_bytes"] += stage.inputBytes()
                found["shuffle_bytes"] += stage.shuffleWriteBytes()
    return out, found


def profile(cores: int = 1, memory: str | None = None, task_cpus: int = 1):
    """What executors of a kind have, for with_workers."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    executors = ExecutorResourceRequests().cores(cores)
    return ResourceProfileBuilder().require(executors.memory(memory) if memory else executors).require(TaskResourceRequests().cpus(task_cpus)).build


def with_workers(df: DataFrame, f: Callable[[Iterator], Iterator], schema, kind) -> DataFrame:
    """map_partitions on executors of a profile; a cluster manager must be there to start them."""
    return df.mapInArrow(f, schema, profile=kind)
