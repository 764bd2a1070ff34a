"""Natural-language operators: a model client is passed in, so tests and offline runs use a stub."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


@dataclass
class Step:
    id: str
    tool: str
    args: dict = field(default_factory=dict)
    depends_on: list[str] = field(default_factory=list)


def run_plan(steps: list[Step], tools: dict[str, Callable]) -> dict:
    """Runs steps in waves of what is ready; a plan that gets stuck is an error."""
    done: dict = {}
    left = {s.id: s for s in steps}
    while left:
        wave = [s for s in left.values() if all(d in done for d in s.depends_on)]
        if not wave:
            raise ValueError(f"steps wait for each other: {sorted(left)}")
        with ThreadPoolExecutor(len(wave)) as pool:
            for s, out in zip(wave, pool.map(lambda s: resolve(tools, s.tool)(**s.args, **{d: done[d] for d in s.depends_on}), wave), strict=True):
                done[s.id] = out
                left.pop(s.id)
    return done


def _with(df: DataFrame, name: str, kind: str) -> StructType:
    return StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))])


def llm_filter(df: DataFrame, client: Callable[[list[str]], list[bool]], batch_size: int = 50) -> DataFrame:
    """Keeps the rows for which the client says so; it gets rows as JSON and must answer each."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                mask = client([json.dumps(r, default=str) for r in part.to_dict("records")])
                if len(mask) != len(part):
                    raise ValueError("one answer per row")
                yield part[list(mask)]

    return df.mapInPandas(run, df.schema)


def llm_map(df: DataFrame, name: str, kind: str, client: Callable[[list[str]], list], batch_size: int = 50) -> DataFrame:
    """Adds a nullable column of string, bigint, double or boolean."""

    def run(batches):
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), batch_size):
                out += client([json.dumps(r, default=str) for r in pdf.iloc[at : at + batch_size].to_dict("records")])
            yield pdf.assign(**{name: out})

    return df.mapInPandas(run, _with(df, name, kind))


def vector_search(queries: DataFrame, index: DataFrame, k: int, most_queries: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """The k nearest of index(id, vector) by cosine for each of queries(qid, q); a zero norm scores 0.

    Scores count to 12 digits, ties go to the smaller id.  The stated queries are
    dealt into blocks of at most about most_bytes, each broadcast on its own; a
    task multiplies its vectors with a block, TILE scores at a time, and keeps k
    for each query.
    """
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("x")).first()
    parts = max(1, -(-size["n"] // most_queries), -(-(8 * size["x"] + 16 * size["n"]) // most_bytes))
    block = F.pmod(F.xxhash64("qid"), F.lit(parts))
    return reduce(DataFrame.union, [_nearest(queries.where(block == i), index, k) for i in range(parts)])


def _matrix(lists, n: int) -> np.ndarray:
    """The rows of a list column at unit length; null vectors and those of no length are zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lists) and not lists.null_count and len(flat) % len(lists) == 0 and (np.diff(lists.offsets.to_numpy()) == len(flat) // len(lists)).all():
        rows = flat.reshape(len(lists), -1)
    else:
        rows = np.array([x if x is not None and len(x) == n else [0.0] * n for x in lists.to_pylist()], np.float64).reshape(len(lists), n)
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


#: Scores that a task has at a time, whatever the number of queries and of a batch's rows.
TILE = 1 << 22


class _Best:
    """The k best of each of n queries so far: one list ordered by query, score and id."""

    def __init__(self, n: int, k: int):
        self.k, self.at, self.ids, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.low = np.full(n, -np.inf)  # what a query's k-th has

    def add(self, first: int, ids: np.ndarray, raw: np.ndarray) -> None:
        """raw: scores of the queries from first on (rows) with ids (columns)."""
        np.nan_to_num(raw, copy=False, nan=np.inf)  # what is no number counts as the largest, as it does when ranked
        low = self.low[first : first + len(raw)]
        if self.k < raw.shape[1] and np.isneginf(low).any():
            low = np.maximum(low, np.partition(raw, -self.k, axis=1)[:, -self.k])
        at, where = np.nonzero(raw >= low[:, None] - 2e-12)  # rounding moves a score by half of 1e-12 at most
        if not at.size:
            return
        at, ids, score = np.concatenate((self.at, at + first)), np.concatenate((self.ids, ids[where])), np.concatenate((self.score, np.round(raw[at, where], 12)))
        order = np.lexsort((ids, -score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = order[rank < self.k]
        self.at, self.ids, self.score = at[rank < self.k], ids[keep], score[keep]
        full = rank == self.k - 1
        self.low[at[full]] = score[order[full]]


def _nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    got = queries.select("qid", "q").orderBy("qid").toArrow()
    width = max((len(x) for x in got.column("q").to_pylist() if x is not None), default=0)
    held = queries.sparkSession.sparkContext.broadcast(_matrix(got.column("q"), width))

    def run(batches):
        q = held.value
        best = _Best(len(q), k)
        width, deal = max(1, min(len(q), TILE)), max(1, TILE // max(1, len(q), q.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, deal):
                part = batch.slice(at, deal)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rows = _matrix(part.column(1), q.shape[1]) if q.size else np.zeros((len(ids), q.shape[1]))
                for first in range(0, len(q), width):
                    best.add(first, ids, q[first : first + width] @ rows.T)
        if best.at.size:
            yield pa.RecordBatch.from_arrays([pa.array(best.at, pa.int64()), pa.array(best.ids, pa.int64()), pa.array(np.where(np.isinf(best.score), np.nan, best.score), pa.float64())], names=["at", "id", "score"])

    found = index.select(F.col("id").cast("long"), "vector").mapInArrow(run, "at long, id long, score double")
    w = W.partitionBy("at").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = queries.sparkSession.createDataFrame(got.select(["qid"]).append_column("at", pa.array(np.arange(got.num_rows), pa.int64())))
    return ranked.join(F.broadcast(names), "at").select("qid", "id", "score", "rank")


@dataclass
class VectorIndex:
    """Vectors of one width by id, in a folder that all executors share: upserts replace what has the same id."""

    spark: object
    path: str
    dim: int

    def upsert(self, rows: DataFrame) -> int:
        """rows(id, vector); of repeated ids the last in vector order stays.  Vectors of another width are an error."""
        wrong = rows.where(F.col("vector").isNull() | (F.size("vector") != self.dim)).count()
        if wrong:
            raise ValueError(f"{wrong} vectors are not of width {self.dim}")
        version = self._versions()
        new = rows.groupBy("id").agg(F.max("vector").alias("vector"))
        if version:
            new = new.unionByName(self.frame().join(new.select("id"), "id", "left_anti"))
        new.write.parquet(f"{self.path}/{version + 1}")
        self._name(version + 1)
        return version + 1

    def _file(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> int:
        at, fs = self._file()
        if not fs.exists(at):
            return 0
        held = fs.open(at)
        try:
            return held.readInt()
        finally:
            held.close()

    def _name(self, version: int) -> None:
        at, fs = self._file()
        held = fs.create(at, True)
        held.writeInt(version)
        held.close()

    def frame(self) -> DataFrame:
        version = self._versions()
        return self.spark.read.parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], "id long, vector array<float>")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return vector_search(queries, self.frame(), k)


def batches_for(rows: int, tokens_each: float, most_tokens: int, most_rows: int = 50) -> int:
    """The batching rule: rows that a call of a model takes, so that its tokens stay in bounds; 1 at least."""
    return max(1, min(most_rows, int(most_tokens // max(tokens_each, 1e-9)), max(rows, 1)))


def resolve(tools: dict[str, Callable], name: str) -> Callable:
    """A tool by its name, in any case and with dashes or dots for underscores; none or several that fit are an error."""
    plain = lambda x: x.lower().replace("-", "_").replace(".", "_")
    fits = [t for t in tools if t == name] or [t for t in tools if plain(t) == plain(name)]
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} tools fit {name}")
    return tools[fits[0]]


def embed(df: DataFrame, column: str, name: str, client: Callable[[list[str]], list[list[float]]], dim: int, batch_size: int = 50) -> DataFrame:
    """Adds an array of dim floats per text; null texts count as empty, other lengths are an error."""

    def run(batches):
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), batch_size):
                out += client(["" if x is None else x for x in pdf[column].iloc[at : at + batch_size]])
            if len(out) != len(pdf) or any(len(v) != dim for v in out):
                raise ValueError(f"one vector of {dim} per row")
            yield pdf.assign(**{name: out})

    return df.mapInPandas(run, _with(df, name, "array<float>"))


def retrying(client: Callable, times: int = 3, wait: float = 0.5) -> Callable:
    """The client with retries and doubled waits; the last error goes up."""

    def call(*args):
        for i in range(times):
            try:
                return client(*args)
            except Exception:
                if i == times - 1:
                    raise
                time.sleep(wait * 2**i)

    return call


@dataclass
class Turn:
    """What a model says next: a tool call, or an answer with its confidence."""

    answer: str | None = None
    confidence: float = 0.0
    tool: str | None = None
    args: dict = field(default_factory=dict)
    tokens: int = 0


def converse(text: str, client: Callable[[list[dict]], Turn], tools: dict[str, Callable], rounds: int = 5, budget: int = 10_000) -> tuple:
    """(answer, rounds, confidence, budget_exceeded): tool calls until an answer, the rounds or the budget end."""
    said: list[dict] = [{"role": "user", "text": text}]
    spent = 0
    for i in range(1, rounds + 1):
        turn = client(said)
        spent += turn.tokens
        if turn.answer is not None:
            return turn.answer, i, turn.confidence, spent > budget
        if spent > budget:
            return None, i, 0.0, True
        if turn.tool not in tools:
            raise ValueError(f"no tool {turn.tool}")
        said.append({"role": "tool", "name": turn.tool, "text": str(tools[turn.tool](**turn.args))})
    return None, rounds, 0.0, False


def agent_step(df: DataFrame, id_col: str, text_col: str, client: Callable, tools: dict[str, Callable], rounds: int = 5, budget: int = 10_000) -> DataFrame:
    """(input_id, answer, rounds, confidence, budget_exceeded) per row, a conversation each."""

    def run(batches):
        for pdf in batches:
            got = [(i, *converse(t or "", client, tools, rounds, budget)) for i, t in zip(pdf[id_col], pdf[text_col], strict=True)]
            yield pd.DataFrame(got, columns=["input_id", "answer", "rounds", "confidence", "budget_exceeded"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"input_id {kind}, answer string, rounds int, confidence double, budget_exceeded boolean")


def ask(spark, question: str, client: Callable[[str, list[str]], str], judge: Callable[[str, DataFrame], bool], rounds: int = 5) -> DataFrame:
    """A question to SQL: the client plans a query, it runs, the judge accepts it or the next round gets the errors."""
    errors: list[str] = []
    for _ in range(rounds):
        text = client(question, errors)
        try:
            df = spark.sql(text)
        except PySparkException as e:
            errors.append(str(e))
            continue
        if judge(question, df):
            return df
        errors.append(f"rejected: {text}")
    raise ValueError(f"no accepted query in {rounds} rounds: {errors}")
