"""Structured Streaming: sources, event-time windows, sessions, deduplication, joins and keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.sources.tables import work_folder


def file_source(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(path)


def rate_source(spark: SparkSession, rows_per_batch: int) -> DataFrame:
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()


def event_time(df: DataFrame, millis: str, delay: str, name: str = "event_time") -> DataFrame:
    """An epoch-milliseconds column as event time with a watermark."""
    return df.withColumn(name, F.timestamp_millis(F.col(millis))).withWatermark(name, delay)


def nearest_millis(at) -> Column:
    """A time to the nearest millisecond, as DuckDB's epoch_ms has it: halves go away from the epoch."""
    us = F.unix_micros(at)
    return F.timestamp_millis(F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000)))


def windowed(df: DataFrame, keys: list[str], aggs: list, size: str, slide: str | None = None, at: str = "event_time") -> DataFrame:
    """Tumbling or sliding windows; windows that start before the epoch are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = df.where(F.col(at).isNotNull()).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.unix_millis("w.start").alias("window_start"), *keys, *out.columns[1 + len(keys) :]).where("window_start >= 0")


def sessions(df: DataFrame, keys: list[str], aggs: list, gap: str, at: str = "event_time", unit: str = "millis") -> DataFrame:
    """Sessions from their first to their last event, in whole milliseconds begun or in microseconds."""
    out = df.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggs, F.max(at).alias("_last"))
    named = [c for c in out.columns if c not in ("w", "_last", *keys)]
    since = {"millis": F.unix_millis, "micros": F.unix_micros}[unit]
    return out.select(since("w.start").alias("session_start"), since("_last").alias("session_end"), *keys, *named)


def panes(df: DataFrame, keys: list[str], aggs: list, slide: str, at: str = "event_time") -> DataFrame:
    """What a sliding window adds up, once per slide."""
    return windowed(df, keys, aggs, slide, at=at)


def reduce_by_window(done: DataFrame, keys: list[str], value: str, size_ms: int, slide_ms: int) -> DataFrame:
    """Sums over sliding windows from the panes (window_start, keys, value) that a stream left.

    A window is what has come in up to its end less what had come in up to its
    start (the inverse of the sum), so a pane is read twice however long windows are.
    """
    if size_ms % slide_ms:
        raise ValueError("windows are whole slides")
    change = lambda at, sign: F.struct((F.col("window_start") + at).alias("t"), (sign * F.col(value)).alias("d"), F.lit(sign).alias("c"))
    steps = done.select(*keys, F.explode(F.array(change(0, 1), change(size_ms, -1))).alias("x"))
    steps = steps.groupBy(*keys, F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"), F.sum("x.c").alias("c"))
    w = W.partitionBy(*keys).orderBy("t")
    running = steps.select(*keys, "t", F.sum("d").over(w).alias(value), F.sum("c").over(w).alias("_panes"), F.lead("t").over(w).alias("_next")).where("_panes > 0")
    each = F.explode(F.sequence(F.col("t"), F.col("_next") - slide_ms, F.lit(slide_ms).cast("long")))
    return running.select(*keys, each.alias("_t"), value).select((F.col("_t") - (size_ms - slide_ms)).alias("window_start"), *keys, value)


def dedup(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, bound: str, how: str = "inner") -> DataFrame:
    """Rows of one key whose times differ by at most the bound; state is kept for as long as that needs."""
    r = right.withColumnRenamed(key, f"{key}_right")
    near = F.expr(f"{key} = {key}_right AND {rt} BETWEEN {lt} - INTERVAL {bound} AND {lt} + INTERVAL {bound}")
    return left.join(r, near, how)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed state: a running total per key, updated by each micro-batch."""

    def step(k, batches, state: GroupState):
        total = state.get[0] if state.exists else 0
        total += sum(int(b[value].sum()) for b in batches)
        state.update((total,))
        yield pd.DataFrame({key: [k[0]], "total": [total]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} string, total long", "total long", "update", GroupStateTimeout.NoTimeout)


def per_batch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """f(batch, epoch) for each micro-batch: the form of per-batch joins, counts and custom sinks."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(f)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def to_files(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    return df.writeStream.format(kind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def sql(df: DataFrame, text: str) -> DataFrame:
    """Stateless SQL over the stream, which the text calls {input}."""
    return df.sparkSession.sql(text, input=df)


def drained(df: DataFrame, mode: str = "append", keys: list[str] | None = None, at: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs the stream until its source is drained; the result as a table.

    Each epoch is written under its own name, so a repeated epoch replaces
    itself.  append: all epochs; complete: the last; update: the last row of
    each of the keys; epochs: all, with their number.  With the folder ``at`` of
    an earlier run it goes on where that one stopped.  each: what an epoch's rows
    become before they are written.
    """
    spark = df.sparkSession
    at = at or work_folder(spark, "stream")
    numbered, mode = mode == "epochs", "append" if mode == "epochs" else mode
    each = each or (lambda batch: batch)
    schema = each(spark.createDataFrame([], df.schema)).schema

    def put(batch: DataFrame, epoch: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/check").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(schema.add("epoch", "long")).parquet(f"{at}/out")
    if mode == "complete":
        out = out.where(F.col("epoch") == (out.agg(F.max("epoch")).first()[0] or 0))
    elif mode == "update":
        w = W.partitionBy(*keys).orderBy(F.desc("epoch"))
        out = out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return out if numbered else out.drop("epoch")


class Queue:
    """A source that is fed by hand: what is put in becomes one micro-batch, in order."""

    def __init__(self, spark: SparkSession, schema, path: str | None = None):
        self.spark, self.schema = spark, schema
        self.path = path or work_folder(spark, "queue")
        self.held = 0

    def put(self, rows) -> Queue:
        """A DataFrame, or rows of the schema, as one file; files are read in the order of their times."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.parquet(f"{self.path}/{self.held:08d}")
        self.held += 1
        return self

    def stream(self) -> DataFrame:
        schema = self.schema if not isinstance(self.schema, str) else self.spark.createDataFrame([], self.schema).schema
        return file_source(self.spark, f"{self.path}/*", schema, files_per_batch=1)


TRIGGERS = {"drain": {"availableNow": True}, "once": {"once": True}}


def start(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", trigger: str = "drain", path: str | None = None, name: str | None = None, **options):
    """A query on a sink; trigger: drain, once, an interval ("5 seconds") or "continuous 1 second"."""
    writer = df.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint).options(**options)
    if name:
        writer = writer.queryName(name)
    kind = TRIGGERS.get(trigger) or ({"continuous": trigger.split(" ", 1)[1]} if trigger.startswith("continuous ") else {"processingTime": trigger})
    writer = writer.trigger(**kind)
    return writer.start(path) if path else writer.start()


def status(query) -> dict:
    """What a query's handle tells: name, id, active, rows and number of the last batch, its error."""
    last = query.lastProgress
    return {
        "name": query.name, "id": str(query.id), "active": query.isActive, "batch": last["batchId"] if last else None,
        "rows": last["numInputRows"] if last else 0, "error": str(query.exception()) if query.exception() else None,
    }


class Streams:
    """Queries that start and stop together, each with a checkpoint in one folder.

    Made again with the same folder they go on where they stopped.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made, self.running = spark, folder, {}, {}

    def add(self, name: str, make: Callable[[], DataFrame], put: Callable[[DataFrame, int], None], mode: str = "append", trigger: str = "drain") -> Streams:
        """make builds the stream, put takes its batches."""
        if self.running:
            raise RuntimeError("streams have started")
        self.made[name] = (make, put, mode, trigger)
        return self

    def start(self) -> Streams:
        for name, (make, put, mode, trigger) in self.made.items():
            kind = TRIGGERS.get(trigger) or {"processingTime": trigger}
            writer = make().writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/{name}").foreachBatch(put)
            self.running[name] = writer.queryName(f"{name}-{uuid.uuid4().hex[:8]}").trigger(**kind).start()
        return self

    def wait(self, seconds: float | None = None) -> bool:
        """Whether all have ended; the first error goes up."""
        return all([q.awaitTermination(seconds) if seconds else q.awaitTermination() is None for q in self.running.values()])

    def stop(self) -> None:
        """After the batches that run."""
        for q in self.running.values():
            q.stop()
        self.running = {}


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    """Rows as JSON, at least once; needs the Kafka connector's jar."""
    rows = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct(*df.columns)).alias("value"))
    return start(rows, "kafka", checkpoint, **{"kafka.bootstrap.servers": servers, "topic": topic})


def stateful(df: DataFrame, keys: list[str], step: Callable, output: str, state: str, timeout: str = "none", mode: str = "update") -> DataFrame:
    """step(key, pandas frames, state) yields pandas frames; timeout: none, processing or event."""
    kinds = {"none": GroupStateTimeout.NoTimeout, "processing": GroupStateTimeout.ProcessingTimeTimeout, "event": GroupStateTimeout.EventTimeTimeout}
    return df.groupBy(*keys).applyInPandasWithState(step, output, state, mode, kinds[timeout])


def update_state(df: DataFrame, key: str, value: str, f: Callable, zero, state: str, idle_ms: int | None = None) -> DataFrame:
    """f(values, old state) -> new state, or None to forget the key; idle keys leave after idle_ms."""

    def step(k, batches, held: GroupState):
        if held.hasTimedOut:
            held.remove()
            return
        new = f(pd.concat([b[value] for b in batches]), held.get[0] if held.exists else zero)
        if new is None:
            if held.exists:
                held.remove()
            return
        held.update((new,))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]], "state": [new]})

    kind = dict(df.dtypes)[key]
    return stateful(df, [key], step, f"{key} {kind}, state {state}", f"state {state}", "processing" if idle_ms else "none")


def socket_source(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def text_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str, most_per_batch: int | None = None) -> DataFrame:
    """JSON payloads decoded to the schema; needs the Kafka connector's jar."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if most_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", most_per_batch)
    return decoded(reader.load(), schema)


def decoded(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    return df.select(F.from_json(F.col(value).cast("string"), schema).alias("v")).select("v.*")


def to_console(df: DataFrame, mode: str = "append"):
    return df.writeStream.format("console").outputMode(mode).start()


def to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """For tests and small results: the sink is held by the driver."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps the last progress of each query; spark.streams.addListener(Progress())."""

    def __init__(self) -> None:
        self.last: dict[str, object] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.last[str(event.progress.id)] = event.progress

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))
