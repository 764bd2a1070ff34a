"""A corpus pipeline: each stage reads what its predecessor kept, as Parquet.

All stages but the last return whole rows of their input, in its columns, extra
ones with any names included.  For all of them null texts count as empty, empty
texts and texts of any length are handled like others, repeated rows are judged
alike, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import toxicity as tox
from sparkloom.llm.common import MOST_KEYS, materialize, narrow, table, work_dir
from sparkloom.llm.decontaminate import contaminated
from sparkloom.llm.exact_dedup import exact_groups
from sparkloom.llm.jaccard import jaccard_components
from sparkloom.llm.packing import pack_documents


def _below(model: tox.Model, threshold: float, at: int):
    """Keeps whole rows whose text (column number at) scores below the threshold."""

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            keep = [x < threshold for part in tox._scored(model)([texts]) for x in part.column(1).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that decided(doc_id, kept) keeps; null ids stay.

    Where one doc_id has several rows, repeated ones count once and the id
    stays if any of its rows does.
    """
    ids = materialize(decided.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    dropped = ids.where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    out = _without(docs, dropped)
    if ids.where("n > 1 AND doc_id IS NOT NULL").isEmpty():
        return out
    many = ids.where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    return _without(out, many).unionByName(narrow(out, many, "doc_id").select(*out.columns).dropDuplicates(["doc_id", "text"]))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_KEYS else ids, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold; rows without an id too.  Without labels nothing is toxic."""
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    return docs.mapInArrow(_below(model, tox.THRESHOLD, docs.columns.index("text")), docs.schema)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z the row with the largest id stays, of repeated rows one; texts null and empty are equal, rows without an id stay."""
    return keep_rows(docs, exact_groups(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8; of each group the smallest doc_id stays.

    Texts without words are like none; rows without an id take part and stay.
    """
    near = jaccard_components(docs, width=5, percent=80)
    return keep_rows(docs, near.select("doc_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; null and empty items match nothing, rows without an id stay."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")).where("doc_id IS NOT NULL").select("doc_id").distinct())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their sequence and place there; an empty text is its end mark."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack_sequences),
]

#: The learned and the iterative stages have no SQL form; tests/llm/test_edges.py holds each stage against brute force, and run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
