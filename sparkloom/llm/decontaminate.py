"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

A benchmark item is fingerprinted over its weighted word shingles (five words,
a shingle's weight falls with the number of items that have it).  A text is
read in windows of each item's length; the windows' fingerprints follow from
running sums of signed weights.  Fingerprints are looked up block by block:
within the Hamming radius r, some of the BLOCKS blocks differ in at most
r // BLOCKS bits, so a table of each block's neighbourhood holds every item
within the radius.  Items found are verified by the exact weighted Jaccard
similarity of shingles with the window.

A window can reach the similarity only if the benchmark's shingles in it weigh
at least that share of an item, so only windows that do are fingerprinted; nothing
is lost by that.  Long texts are gone through STRETCH windows at a time, so a
text's memory does not grow with its hits.

The benchmark is loaded into every task, so its size is checked first: beyond
``MOST_ITEM_BYTES`` it is gone through in slices of that size, one after the other,
with weights of the whole.  The texts that share any shingle with it are written
once before, by a Bloom filter, and the slices read those alone.

Edge cases: items of fewer words than a shingle are one shingle of all their
words; null or empty items and texts match nothing; repeated items are each
reported; a text is matched whole, however long; an item found several times in a
text is reported where it is most similar, first among equals; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, table
from sparkloom.llm.text import PUNCT, Words, blocks, mix, shingles

WIDTH = 5
RADIUS = 20
BLOCKS = 8
SIMILARITY = 0.8
MOST_ITEM_BYTES = 8 << 20
#: Windows of a text, and shingles under their sums, that are held at a time.
STRETCH = 1 << 15
#: Bits of the filter of a large benchmark's shingles, and how many each sets.
FILTER_BITS, FILTER_HASHES = 1 << 26, 4
_HITS = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def _signs(key: np.ndarray) -> np.ndarray:
    """n x 64 of -1 and 1: the bits of each hash."""
    bits = np.unpackbits(mix(key).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def _print(total: np.ndarray) -> np.ndarray:
    """Fingerprints (as 8 bytes each) of rows of signed sums."""
    return np.packbits(total > 0, axis=-1)


def _near() -> list[np.ndarray]:
    """For each byte, the bytes within RADIUS // BLOCKS bits of it."""
    every = np.arange(256, dtype=np.uint8)
    apart = np.unpackbits((every[:, None] ^ every[None, :])[..., None], axis=-1).sum(axis=-1)
    return [np.flatnonzero(apart[b] <= RADIUS // BLOCKS) for b in range(256)]


def item_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each item, shingles with their bounds, and each item's set of them."""
    w = Words(texts, PUNCT, fold=True)
    flat, bounds = shingles(w.key, w.first, WIDTH)
    words = np.diff(w.first)
    for n in range(1, WIDTH):  # brief items are hashed as the texts are for them
        own, at = shingles(w.key, w.first, n, short=False)
        brief = np.flatnonzero(words == n)
        flat[bounds[brief]] = own[at[brief]]
    return words, flat, bounds, [np.unique(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _item_keys(batches):
    for batch in batches:
        for at, n in blocks(batch.column(0)):
            sets = item_shingles(batch.column(0).slice(at, n))[3]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["k"])


def shared_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several items have, in order, and how many items have each."""
    got = items.select("text").mapInArrow(_item_keys, "k long").groupBy("k").count().where("count > 1").toArrow()
    key, df = got.column("k").to_numpy().astype(np.int64).view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(key)
    return key[order], df[order]


class Index:
    """The items' shingles, weights, fingerprints and block tables; ``shared`` where they are a slice of all items."""

    def __init__(self, ids: list[int], texts: list[str | None], shared: tuple[np.ndarray, np.ndarray] | None = None):
        self.words, flat, bounds, self.sets = item_shingles(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.key, df = np.unique(np.concatenate(self.sets) if self.sets else flat, return_counts=True)
        self.shared, df = shared or (self.key[df > 1], df[df > 1])
        self.weight = 1.0 / np.sqrt(df)
        self.fp = np.zeros((len(ids), 8), np.uint8)
        owner: dict[int, list[tuple[int, int]]] = {}
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own = self.sets[i]
            if len(own):
                self.fp[i] = _print((_signs(own) * self.weigh(own)[:, None]).sum(axis=0))
            for at, k in enumerate(flat[a:b].tolist()):
                owner.setdefault(k, []).append((i, at))
        self.owner = owner
        near = _near()
        self.blocks = [[set() for _ in range(256)] for _ in range(BLOCKS)]
        for i in range(len(ids)):
            if len(self.sets[i]):
                for j in range(BLOCKS):
                    for b in near[self.fp[i, j]]:
                        self.blocks[j][b].add(i)
        self.heavy = [float(self.weigh(own).sum()) for own in self.sets]
        self.brief = {int(n) for n, s in zip(self.words, self.sets, strict=True) if 0 < n < WIDTH and len(s)}

    def weigh(self, keys: np.ndarray) -> np.ndarray:
        """Shingles that no item has weigh as much as those that one item has."""
        if not len(self.shared):
            return np.ones(len(keys))
        spot = np.minimum(np.searchsorted(self.shared, keys), len(self.shared) - 1)
        return np.where(self.shared[spot] == keys, self.weight[spot], 1.0)

    def lookup(self, fp: np.ndarray) -> list[int]:
        """All items within RADIUS bits of a fingerprint."""
        found = set().union(*(self.blocks[j][fp[j]] for j in range(BLOCKS)))
        if not found:
            return []
        at = np.fromiter(found, np.int64)
        return at[np.unpackbits(self.fp[at] ^ fp, axis=1).sum(axis=1) <= RADIUS].tolist()

    def similarity(self, window: np.ndarray, item: int) -> float:
        own = self.sets[item]
        window = np.unique(window)
        both = np.intersect1d(window, own, assume_unique=True)
        shared = self.weigh(both).sum()
        return float(shared / (self.weigh(window).sum() + self.weigh(own).sum() - shared))


def _matches(index: Index, similarity: float):
    def run(batches):
        sizes = {n: [i for i in range(len(index.ids)) if index.words[i] == n] for n in set(index.words.tolist())}
        for batch in batches:
            rows = []
            for at, n in blocks(batch.column(1)):
                w = Words(batch.column(1).slice(at, n), PUNCT, fold=True)
                passes = [(WIDTH, [i for i in range(len(index.ids)) if index.words[i] >= WIDTH])] + [(k, sizes[k]) for k in index.brief]
                for width, items in passes:
                    allowed = set(items)
                    flat, bounds = shingles(w.key, w.first, width, short=False)
                    spot = np.minimum(np.searchsorted(index.key, flat), max(len(index.key) - 1, 0))
                    hit = np.flatnonzero(index.key[spot] == flat) if len(index.key) and len(flat) else np.zeros(0, np.int64)
                    owner_row = np.searchsorted(bounds, hit, side="right") - 1
                    for r in np.unique(owner_row):
                        own = hit[owner_row == r]
                        rows += [(at + int(r), *m) for m in _text_matches(index, flat[bounds[r] : bounds[r + 1]], own - bounds[r], width, allowed, similarity)]
            ids = batch.column(0)
            doc = ids.take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array([int(index.ids[r[1]]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())],
                names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
            )

    return run


def _runs(hits: np.ndarray, m: int, n: int) -> list[tuple[int, int]]:
    """The windows (first, last) of m shingles, of n in all, that hold a hit; hits are in order."""
    low, high = np.maximum(hits - m + 1, 0), np.minimum(hits, max(n - m, 0))
    low = np.minimum(low, high)
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1] + 1])
    return list(zip(low[new].tolist(), high[np.r_[new[1:], len(high)] - 1].tolist(), strict=True))


def _prints(index: Index, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprints of windows of a stretch, from running sums, 8 bits at a time."""
    weight, bits = index.weigh(part), mix(part).view(np.uint8).reshape(-1, 8)
    out = np.empty((len(starts), 8), np.uint8)
    for j in range(8):
        signed = (np.unpackbits(bits[:, j : j + 1], axis=1).astype(np.float64) * 2 - 1) * weight[:, None]
        total = np.concatenate((np.zeros((1, 8)), np.cumsum(signed, axis=0)))
        out[:, j : j + 1] = np.packbits(total[ends] - total[starts] > 0, axis=-1)
    return out


def _text_matches(index: Index, flat: np.ndarray, hits: np.ndarray, width: int, allowed: set[int], similarity: float):
    """The best window of each item that one text's shingles reach."""
    items: dict[int, set[int]] = {}
    for k in np.unique(flat[hits]).tolist():
        for i, _ in index.owner.get(k, ()):
            if i in allowed:
                items.setdefault(int(index.words[i]) - width + 1, set()).add(i)
    best: dict[int, tuple] = {}
    for m, own in sorted(items.items()):  # shingles in a window
        least = similarity * min(index.heavy[i] for i in own) - 1e-9
        for first, last in _runs(hits, m, len(flat)):
            for low in range(first, last + 1, STRETCH):
                starts = np.arange(low, min(low + STRETCH, last + 1))
                part = flat[low : min(int(starts[-1]) + m, len(flat))]
                held = np.zeros(len(part))
                at = hits[np.searchsorted(hits, low) : np.searchsorted(hits, low + len(part))] - low
                held[at] = index.weigh(part[at])
                worth = np.concatenate(([0.0], np.cumsum(held)))
                ends = np.minimum(starts + m, len(flat)) - low
                able = worth[ends] - worth[starts - low] >= least
                starts, ends = starts[able], ends[able]
                if not len(starts):
                    continue
                for s, fp in zip(starts.tolist(), _prints(index, part, starts - low, ends), strict=True):
                    for i in index.lookup(fp):
                        if i in own:
                            got = index.similarity(flat[s : s + m], i)
                            if got >= similarity and got > best.get(i, (0, 0, 0.0))[2]:
                                best[i] = (s, int(index.words[i]), got)
    return [(i, *v) for i, v in sorted(best.items())]


def _spots(keys: np.ndarray) -> list[np.ndarray]:
    """The bits of a filter that each key sets."""
    return [(mix(keys + np.uint64(k)) % np.uint64(FILTER_BITS)).astype(np.int64) for k in range(FILTER_HASHES)]


def _filter(items: DataFrame) -> np.ndarray:
    """The Bloom filter of all items' shingles, a fixed 8 MB; only its set bytes leave the tasks."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for at, n in blocks(batch.column(0)):
                for spot in _spots(np.concatenate([np.zeros(0, np.uint64), *item_shingles(batch.column(0).slice(at, n))[3]])):
                    np.bitwise_or.at(bits, spot >> 3, np.left_shift(1, spot & 7).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits[at].astype(np.int16), pa.int16())], names=["at", "bits"])

    got = items.select("text").mapInArrow(run, "at long, bits short").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return out


def _touched(held, widths: list[int]):
    """The rows (doc_id, text) with a shingle that the broadcast filter may have."""

    def run(batches):
        bits = held.value
        for batch in batches:
            for at, n in blocks(batch.column(1)):
                w = Words(batch.column(1).slice(at, n), PUNCT, fold=True)
                keep = np.zeros(n, bool)
                for width in widths:
                    flat, bounds = shingles(w.key, w.first, width, short=False)
                    hit = np.ones(len(flat), bool)
                    for spot in _spots(flat):
                        hit &= (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                    keep[np.searchsorted(bounds, np.flatnonzero(hit), side="right") - 1] = True
                yield batch.slice(at, n).filter(pa.array(keep))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per (doc_id, item_id) where a text holds an item: the best window and its similarity."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    docs = docs.select("doc_id", "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    slices = -(-size // MOST_ITEM_BYTES) or 1
    if slices == 1:
        own = items.orderBy("item_id").toArrow()
        return docs.mapInArrow(_matches(Index(own.column("item_id").to_pylist(), own.column("text").to_pylist()), similarity), _HITS)
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    shared = shared_shingles(items)
    held = docs.sparkSession.sparkContext.broadcast(_filter(items))
    docs = materialize(docs.mapInArrow(_touched(held, list(range(1, WIDTH + 1))), docs.schema))
    held.destroy()
    out = None
    for k in range(slices):
        own = items.where(F.col("slice") == k).orderBy("item_id").select("item_id", "text").toArrow()
        index = Index(own.column("item_id").to_pylist(), own.column("text").to_pylist(), shared)
        found = materialize(docs.mapInArrow(_matches(index, similarity), _HITS))  # the slice can leave the driver
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per (doc_id, item_id) where a text holds an item: the best window and its similarity."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    slices = -(-size // MOST_ITEM_BYTES) or 1
    if slices > 1:
        items = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    shared = shared_shingles(items) if slices > 1 else None
    out = None
    for k in range(slices):
        own = (items.where(F.col("slice") == k) if slices > 1 else items).orderBy("item_id").select("item_id", "text").toArrow()
        index = Index(own.column("item_id").to_pylist(), own.column("text").to_pylist(), shared)
        found = docs.select("doc_id", "text").mapInArrow(_matches(index, similarity), _HITS)
        out = found if out is None else out.union(found)
    return out


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
