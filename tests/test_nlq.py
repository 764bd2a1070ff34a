import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import nlq


def test_plan_runs_in_waves():
    steps = [nlq.Step("b", "add", {"x": 1}, ["a"]), nlq.Step("a", "one")]
    assert nlq.run_plan(steps, {"one": lambda: 1, "add": lambda x, a: x + a})["b"] == 2
    with pytest.raises(ValueError):
        nlq.run_plan([nlq.Step("a", "one", {}, ["b"]), nlq.Step("b", "one", {}, ["a"])], {"one": lambda: 1})


def test_row_operators(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(7)], "id long, t string")
    assert nlq.llm_filter(df, lambda rows: ['"id": 3' in r for r in rows], 2).count() == 1
    assert [r["n"] for r in nlq.llm_map(df, "n", "bigint", lambda rows: [len(rows)] * len(rows), 7).limit(1).collect()][0] >= 1
    assert nlq.embed(df, "t", "v", lambda ts: [[float(len(t)), 1.0] for t in ts], 2).where("v[0] = id").count() == 7
    with pytest.raises(Exception):
        nlq.embed(df, "t", "v", lambda ts: [[1.0] for _ in ts], 2).collect()


def test_agent_uses_tools_and_stays_in_budget(spark):
    def client(said):
        if said[-1]["role"] == "tool":
            return nlq.Turn(answer=said[-1]["text"], confidence=0.9, tokens=5)
        return nlq.Turn(tool="size", args={"t": said[0]["text"]}, tokens=5)

    df = spark.createDataFrame([(1, "abc")], "id long, t string")
    got = nlq.agent_step(df, "id", "t", client, {"size": lambda t: len(t)}).first()
    assert tuple(got) == (1, "3", 2, 0.9, False)
    assert nlq.converse("abc", client, {"size": lambda t: len(t)}, budget=4)[3] is True


def test_retries_and_questions(spark):
    tried = []

    def flaky(x):
        tried.append(x)
        if len(tried) < 3:
            raise OSError
        return x

    assert nlq.retrying(flaky, 3, 0)(7) == 7
    plans = iter(["SELECT no_such_column", "SELECT 5 AS a"])
    assert nlq.ask(spark, "?", lambda q, errors: next(plans), lambda q, df: True).first()[0] == 5


def test_vector_search_in_blocks(spark):
    index = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)] + [(9, [0.0, 0.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 1.0]), (2, [8.0, 1.0])], "qid long, q array<float>")
    whole = sorted(map(tuple, nlq.vector_search(queries, index, 2).collect()))
    assert whole == sorted(map(tuple, nlq.vector_search(queries, index, 2, most_queries=1).collect()))
    assert {(r[0], r[1]) for r in whole if r[3] == 1} == {(0, 1), (1, 0), (2, 8)}


def test_vector_search_keeps_a_bounded_tile_and_is_exact(spark):
    r = np.random.default_rng(3)
    q, v = r.integers(-3, 4, (2000, 4)).astype(float), r.integers(-3, 4, (20_000, 4)).astype(float)  # ties abound
    queries = spark.createDataFrame(pa.table({"qid": range(len(q)), "q": q.tolist()}))
    ids = r.permutation(len(v))
    batches = [pa.RecordBatch.from_pydict({"id": ids[i : i + 10_000], "vector": v[i : i + 10_000].tolist()}) for i in (0, 10_000)]

    class Index:  # hands the task's work over, to be run and measured here
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            raise StopIteration

    index = Index()
    with pytest.raises(StopIteration):
        nlq.vector_search(queries, index, 3)
    tracemalloc.start()
    got = pa.Table.from_batches(index.run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    score = np.round(unit(q[:50]) @ unit(v).T, 12)
    want = {(at, int(ids[i])) for at in range(50) for i in np.lexsort((ids, -score[at]))[:3]}
    assert {(a, i) for a, i in zip(got["at"].to_pylist(), got["id"].to_pylist(), strict=True) if a < 50} == want and got.num_rows == 6000


def test_a_score_that_is_no_number_ranks_first(spark):
    index = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("inf"), 1.0]), (2, [0.5, 0.5]), (3, [0.9, 0.1])], "id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, q array<double>")
    assert [(r["id"], r["rank"]) for r in nlq.vector_search(queries, index, 2).orderBy("rank").collect()] == [(1, 1), (0, 2)]


def test_vectors_that_tie_go_by_id(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in (9, 4, 7, 2, 1, 8)] + [(3, None)]
    index = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(5, [0.0, 2.0]), (6, None)], "qid long, q array<double>")
    got = [tuple(r)[:2] for r in sorted(nlq.vector_search(queries, index, 2).collect(), key=lambda r: (r["qid"], r["rank"]))]
    assert got == [(5, 9), (5, 1), (6, 1), (6, 2)]
    assert nlq.vector_search(queries.limit(0), index, 2).count() == 0 and nlq.vector_search(queries, index.limit(0), 2).count() == 0


def test_an_index_takes_new_vectors_for_old(spark, tmp_path):
    index = nlq.VectorIndex(spark, str(tmp_path / "index"), 2)
    assert index.frame().count() == 0
    index.upsert(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>"))
    index.upsert(spark.createDataFrame([(2, [1.0, 0.1]), (3, [0.0, 2.0])], "id long, vector array<float>"))
    q = spark.createDataFrame([(0, [0.0, 1.0])], "qid long, q array<float>")
    assert [r["id"] for r in index.search(q, 1).collect()] == [3] and index.frame().count() == 3
    with pytest.raises(ValueError):
        index.upsert(spark.createDataFrame([(4, [1.0])], "id long, vector array<float>"))
    assert nlq.VectorIndex(spark, str(tmp_path / "index"), 2).frame().count() == 3


def test_tools_by_name():
    tools = {"Count_Rows": 1, "count.tables": 2, "a-b": 3, "a_b": 4}
    assert nlq.resolve(tools, "count-rows") == 1 and nlq.resolve(tools, "COUNT_TABLES") == 2 and nlq.resolve(tools, "a_b") == 4
    for name in ("none", "A.B"):
        with pytest.raises(ValueError):
            nlq.resolve(tools, name)
