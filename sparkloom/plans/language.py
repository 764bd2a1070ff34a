"""Natural-language operators with a stub for the model, which answers by a rule; vectors and their index."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sparkloom.operators import nlq
from sparkloom.plans.registry import query
from sparkloom.plans.tables import one_row, scratch
from sparkloom.sources.tables import load, register


def _large(rows: list[str]) -> list[bool]:
    return [json.loads(r)["p_size"] > 25 for r in rows]


def _initials(rows: list[str]) -> list[str]:
    return ["".join(w[0] for w in json.loads(r)["p_name"].split()) for r in rows]


def _vector(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


def _agent(said: list[dict]) -> nlq.Turn:
    if said[-1]["role"] == "user":
        return nlq.Turn(tool="length", args={"text": said[0]["text"]}, tokens=3)
    return nlq.Turn(answer=f"{said[-1]['text']} letters", confidence=0.5, tokens=2)


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 25")
def llm_filtered(spark, d):
    return nlq.llm_filter(load(spark, d, "part").select("p_partkey", "p_name", "p_size"), _large).drop("p_size")


@query("SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w: w[1]), lambda a, b: a || b) AS initials FROM part")
def llm_mapped(spark, d):
    return nlq.llm_map(load(spark, d, "part").select("p_partkey", "p_name"), "initials", "string", nlq.retrying(_initials), batch_size=7).select("p_partkey", "initials")


@query("SELECT p_partkey, cast(length(p_name) AS FLOAT) AS chars, cast(length(p_name) - length(replace(p_name, 'a', '')) AS FLOAT) AS a FROM part")
def embedded(spark, d):
    got = nlq.embed(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", "v", _vector, 3)
    return got.select("p_partkey", F.col("v")[0].alias("chars"), F.col("v")[1].alias("a"))


@query("SELECT cast(n_nationkey AS INTEGER) AS input_id, cast(length(n_name) AS VARCHAR) || ' letters' AS answer, 2 AS rounds, 0.5::DOUBLE AS confidence, false AS budget_exceeded FROM nation")
def agent_answers(spark, d):
    return nlq.agent_step(load(spark, d, "nation"), "n_nationkey", "n_name", _agent, {"length": lambda text: len(text)})


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def asked(spark, d):
    """The first plan doesn't parse; the second sees the error and is accepted."""
    register(spark, "q_asked", load(spark, d, "orders"))
    client = lambda question, errors: "SELECT o_orderstatus, count(*) AS n FROM q_asked GROUP BY o_orderstatus" if errors else "SELEC"
    return nlq.ask(spark, "orders by status?", client, lambda q, df: "n" in df.columns)


@query("SELECT count(*) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM customer) + count(*) AS both FROM orders")
def workflow(spark, d):
    """Two steps run side by side, a third takes what they gave; tools are found by names written otherwise."""
    tools = {"count_rows": lambda name: load(spark, d, name).count(), "add": lambda **given: sum(given.values())}
    steps = [nlq.Step("o", "count-rows", {"name": "orders"}), nlq.Step("c", "Count_Rows", {"name": "customer"}), nlq.Step("s", "add", {}, ["o", "c"])]
    got = nlq.run_plan(steps, tools)
    return one_row(spark, "orders long, customers long, both long", got["o"], got["c"], got["s"])


@query("SELECT 12 AS by_tokens, 50 AS by_rows, 1 AS at_least, 3 AS all_there_are")
def batching_rule(spark, d):
    sizes = nlq.batches_for(1000, 80.0, 1000), nlq.batches_for(1000, 1.0, 1000), nlq.batches_for(1000, 5000.0, 1000), nlq.batches_for(3, 1.0, 1000)
    return one_row(spark, "by_tokens int, by_rows int, at_least int, all_there_are int", *sizes)


@query("""WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, list_transform(embedding::DOUBLE[], lambda a: -a) FROM embeddings WHERE vec_id % 3 = 0)
 SELECT q.vec_id AS qid, x.id FROM embeddings q, x WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], x.v) DESC, x.id) <= 3""")
def vector_index(spark, d):
    """All vectors go in, then a third of them is replaced by their opposites."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = nlq.VectorIndex(spark, scratch(spark), len(e.first()["vector"]))
    index.upsert(e)
    index.upsert(e.where("id % 3 = 0").withColumn("vector", F.transform("vector", lambda a: -a)))
    return index.search(e.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q")), 3).select("qid", "id")
