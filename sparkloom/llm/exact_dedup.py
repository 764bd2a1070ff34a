"""Exact deduplication by composable polynomial fingerprints.

A text (ASCII capitals lowered, null as empty) is cut into chunks.  Each chunk
is hashed on its own as a polynomial in two bases modulo a prime, and chunk
hashes combine by length-shifted arithmetic,
``H(ab) = H(a) * base**len(b) + H(b)``, so the fingerprint doesn't depend on
where the cuts fall.  The chunks of texts of over HUGE bytes are dealt over the
tasks, hashed there, and only their hashes meet again; other texts are hashed
where they are read, a chunk at a time.

Rows with equal length and fingerprints then meet chunk by chunk (rows that are
wholly equal are one there, found by a hash of id and text and compared like others): each row's
chunks are joined to those of its group's survivor and compared byte for byte,
dealt over salts so that a group of any size spreads over many tasks.  A row
that differs from its survivor (a fingerprint collision) is regrouped by its
SHA-256.

Edge cases: null and empty texts are equal to each other; of repeated rows
with one doc_id exactly one stays; a null doc_id counts as smaller than any;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import hot_limit, materialize, narrow, salted, table
from sparkloom.llm.text import LOWER, blocks, buffers

PRIME = (1 << 31) - 1
BASES = (1_000_003, 777_767_777)
CHUNK = 1 << 16
#: Bytes above which the chunks of a text are hashed apart.
HUGE = 4 << 20


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    step = base % PRIME
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(step, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


_POWERS = [_power_table(b, CHUNK)[::-1].copy() for b in BASES]  # highest power first


def chunk_hash(part: np.ndarray, which: int) -> int:
    """The polynomial of at most CHUNK bytes; bytes count from 1 so leading zeros matter."""
    return int(((part.astype(np.uint64) + np.uint64(1)) * _POWERS[which][CHUNK - len(part) :]).sum() % np.uint64(PRIME))


def combine(left: int, right: int, right_len: int, which: int) -> int:
    """The fingerprint of two texts end to end, from theirs."""
    return (left * pow(BASES[which], right_len, PRIME) + right) % PRIME


def _hashed(data: np.ndarray, which: int, chunk: int = CHUNK) -> int:
    h = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        h = combine(h, chunk_hash(part, which), len(part), which)
    return h


def fingerprint(data: np.ndarray, chunk: int = CHUNK) -> int:
    """A 62-bit fingerprint of a whole byte string."""
    one, two = (_hashed(data, which, chunk) for which in range(len(BASES)))
    return one << 31 | two


def _fingerprints(batches):
    """(doc_id, text, place) to (doc_id, bytes, fingerprint, digest, place)."""
    for batch in batches:
        texts = batch.column(1)
        for at, n in blocks(texts):
            raw, offsets = buffers(texts.slice(at, n))
            data = LOWER[raw]
            fps, shas = [], []
            for i in range(n):
                one = data[offsets[i] : offsets[i + 1]]
                fps.append(fingerprint(one))
                shas.append(hashlib.sha256(one).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), pa.array(np.diff(offsets), pa.int64()), pa.array(fps, pa.int64()), pa.array(shas, pa.string()), batch.column(2).slice(at, n)],
                names=["doc_id", "n_bytes", "fp", "text_sha256", "place"],
            )


_ROW = "doc_id long, n_bytes long, fp long, text_sha256 string, place long"


def _chunk_hashes(batches):
    """(part, chunk_no, chunk) to (part, chunk_no, bytes, hash in each base)."""
    for batch in batches:
        raw, offsets = buffers(batch.column(2))
        each = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        # a chunk of characters may be longer than one of bytes
        sums = [[_hashed(x, which) for x in each] for which in range(len(BASES))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), *[pa.array(s, pa.int64()) for s in sums]], names=["part", "chunk_no", "n", "h0", "h1"]
        )


def _combined(key, rows):
    """The fingerprint of a text from the hashes of its chunks."""
    rows = rows.sort_by("chunk_no")
    both = []
    for which in range(len(BASES)):
        h = 0
        for n, own in zip(rows.column("n").to_pylist(), rows.column(f"h{which}").to_pylist(), strict=True):
            h = combine(h, own, n, which)
        both.append(h)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n_bytes": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "fp": pa.array([both[0] << 31 | both[1]], pa.int64())})


def _huge_rows(docs: DataFrame) -> DataFrame:
    """What _fingerprints gives, of long texts: their chunks are dealt over the tasks."""
    held = materialize(docs.withColumn("part", F.monotonically_increasing_id()))
    parts = _chunked(held).select("part", "chunk_no", "chunk").repartition("part", "chunk_no")
    hashes = parts.mapInArrow(_chunk_hashes, "part long, chunk_no int, n long, h0 long, h1 long")
    whole = hashes.groupBy("part").applyInArrow(_combined, "part long, n_bytes long, fp long")
    return held.select("part", "doc_id", F.sha2(_low(), 256).alias("text_sha256"), "place").join(whole, "part").select("doc_id", "n_bytes", "fp", "text_sha256", "place")


def _low():
    return F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _chunked(rows: DataFrame) -> DataFrame:
    """rows with chunk_no and chunk of each one's normalised text."""
    size = CHUNK // 4
    low = _low()
    n = F.greatest(F.ceil(F.length(low) / size), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: low.substr((i * size + 1).cast("int"), F.lit(size)))
    return rows.select("*", F.posexplode(parts).alias("chunk_no", "chunk")).drop("text")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of each group of equal texts is kept.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place"))
    huge = F.coalesce(F.octet_length("text"), F.lit(0)) > HUGE
    rows = docs.where(~huge).mapInArrow(_fingerprints, _ROW)
    if not docs.where(huge).isEmpty():
        rows = rows.union(_huge_rows(docs.where(huge)))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()))
    total = rows.count()
    key = ["n_bytes", "fp"]
    groups = materialize(
        rows.groupBy(*key)
        .agg(
            F.count("*").alias("n"),
            F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "place")).alias("top"),
            (F.min("text_sha256") != F.max("text_sha256")).alias("mixed"),
        )
        .select(*key, "n", F.col("top.place").alias("top"), "mixed").where("n > 1")
    )
    limit = hot_limit(total)
    # the texts of rows that share a fingerprint, compared to the survivor's chunk by chunk; a place stands for its row and for what equals it
    dealt, spread = salted(rows.select("place", *key), groups, key, "n", limit)
    shared = materialize(dealt.join(spread.drop("n", "mixed"), [*key, "_salt"]).select("place", *key, "_salt", "top").dropDuplicates(["place", *key]))
    texts = materialize(narrow(docs.select("place", "text"), shared, "place"))
    member = _chunked(texts.where("place <> top"))
    first = _chunked(
        texts.where("place = top").dropDuplicates(["place", *key]).select("place", *key, "text")
        .join(groups.select(*key, "n"), key)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / limit).cast("int") - 1, F.lit(0)))))
    ).withColumnRenamed("chunk", "first_chunk").drop("place", "n")
    odd = materialize(
        member.join(first, [*key, "_salt", "chunk_no"], "left")
        .where(~F.col("chunk").eqNullSafe(F.col("first_chunk")))
        .select(*key).distinct()
    )
    # collisions (none in practice) fall back to the digest as part of the key
    mixed = groups.where("mixed").select(*key)
    if odd.isEmpty() and mixed.isEmpty():
        marked = rows.withColumn("sub", F.lit(""))
    else:
        bad = materialize(odd.union(mixed).distinct())
        marked = rows.join(bad.withColumn("bad", F.lit(True)), key, "left").withColumn(
            "sub", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")
        ).drop("bad")
        marked = materialize(marked)
    full = [*key, "sub"]
    best = F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("o"), F.col("uid"), F.col("doc_id").alias("id")))
    sized = materialize(marked.groupBy(*full).agg(F.count("*").alias("group_size"), best.alias("b")).select(*full, "group_size", "b"))
    dealt, spread = salted(marked, sized, full, "group_size", limit)
    return dealt.join(spread, [*full, "_salt"]).select(
        "doc_id",
        F.col("b.id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("b.uid")).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS uid,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, uid DESC) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
