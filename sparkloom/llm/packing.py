"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition packs its own pieces best-fit in decreasing order and emits
the bins that are nearly full.  The underfull ones go on as items: bins of
several partitions meet, are packed best-fit again, and so on up a tree, with a
bound on what one task holds.  Where all that is left fits one task, that task
is the root.  Otherwise bins are dealt anew each round, and when rounds hardly
close any more, no two bins of a group fit together, so of each group at most
one bin is at most half full: these meet the emptiest others in one last task.

Only documents longer than a sequence are cut, into full pieces and a rest.

Edge cases: null and empty texts count as empty and occupy one id (the
terminating 0); texts of any length are read whole, one at a time; repeated doc_ids are packed as rows of their own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, table
from sparkloom.llm.text import Words, blocks, gather

SEQUENCE, PER_TASK = 2048, 60_000
END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Per worker process: the bytes and ids of words met before, by sorted hashes.
_known: dict[str, dict] = {}
_MOST_WORDS = 400_000
#: What is kept of a word beside its hash: place and number of its ids, place and number of its bytes, its first bytes, whether a later block had it too.
_KEPT = {"at": np.uint32, "n": np.int32, "from": np.uint32, "width": np.int32, "head": np.uint64, "again": bool}


def _tokenizer(path: str) -> dict:
    import os

    held = _known.get(path)
    if held is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        held = _known[path] = {"tok": tok}
    if "key" not in held:
        held |= {"key": np.zeros(0, np.uint64), "ids": np.zeros(0, np.uint32), "bytes": np.zeros(0, np.uint8)} | {k: np.zeros(0, _KEPT[k]) for k in _KEPT}
    if len(held["key"]) > _MOST_WORDS:
        _forget(held)
    return held


def _forget(held: dict) -> None:
    """Keeps the words that came again since the last time; none if these are most."""
    keep = np.flatnonzero(held["again"])
    keep = keep if 2 * len(keep) < _MOST_WORDS else keep[:0]
    for flat, at, n in (("ids", "at", "n"), ("bytes", "from", "width")):
        many = held[n][keep].astype(np.int64)
        held[flat] = gather(held[flat], held[at][keep].astype(np.int64), many)
        held[at][keep] = np.cumsum(many) - many
    for k in ("key", *_KEPT):
        held[k] = held[k][keep]
    held["again"][:] = False


def _encoded(w: Words, which: np.ndarray, tok) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these words, end to end, and how many each has."""
    raw = w.data.tobytes()
    texts = [raw[s:e].decode("utf-8") for s, e in zip(w.start[which].tolist(), w.end[which].tolist(), strict=True)]
    ids = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for one in ids for i in one), np.uint32, int(n.sum())), n


#: What of eight bytes belongs to a word of so many.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _heads(data: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number, zeros behind its end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[start] & _MASK[np.minimum(width, 8)]


def _same(w: Words, held: dict, spot: np.ndarray) -> np.ndarray:
    """Whether the bytes of each word are those of the known word at its spot."""
    width = w.end - w.start
    same = (held["width"][spot] == width) & (held["head"][spot] == _heads(w.data, w.start, width))
    at = np.flatnonzero(same & (width > 8))
    rest = width[at] - 8
    if len(at):
        differ = gather(w.data, w.start[at] + 8, rest) != gather(held["bytes"], held["from"][spot[at]].astype(np.int64) + 8, rest)
        if differ.any():
            same[at[np.repeat(np.arange(len(at)), rest)[differ]]] = False
    return same


def encode_block(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text, end to end, and their n + 1 bounds.

    The tokenizer drops white space and never joins across it, so each word
    is encoded once and its ids are looked up afterwards.
    """
    held = _tokenizer(path)
    w = Words(column, cut_points=True)
    uniq, index, inverse = np.unique(w.key, return_index=True, return_inverse=True)
    spot = np.searchsorted(held["key"], uniq)
    new = np.ones(len(uniq), dtype=bool)
    near = spot < len(held["key"])
    new[near] = held["key"][spot[near]] != uniq[near]
    held["again"][spot[~new]] = True
    if new.any():
        which = index[new]
        flat, n = _encoded(w, which, held["tok"])
        at = len(held["ids"]) + np.concatenate(([0], np.cumsum(n)[:-1]))
        width = w.end[which] - w.start[which]
        from_ = len(held["bytes"]) + np.concatenate(([0], np.cumsum(width)[:-1]))
        key = np.concatenate([held["key"], uniq[new]])
        order = np.argsort(key, kind="stable")
        held["key"] = key[order]
        for name, more in (("at", at), ("n", n), ("from", from_), ("width", width), ("head", _heads(w.data, w.start[which], width)), ("again", np.zeros(len(n), bool))):
            held[name] = np.concatenate([held[name], more.astype(_KEPT[name])])[order]
        held["ids"] = np.concatenate([held["ids"], flat])
        held["bytes"] = np.concatenate([held["bytes"], gather(w.data, w.start[which], width)])
        spot = np.searchsorted(held["key"], uniq)
    spot = spot[inverse]
    at, n, ids = held["at"][spot].astype(np.int64), held["n"][spot].astype(np.int64), held["ids"]
    odd = np.flatnonzero(~_same(w, held, spot))
    if len(odd):  # words that only share a hash with a word met before
        flat, own = _encoded(w, odd, held["tok"])
        at[odd], n[odd] = len(ids) + np.concatenate(([0], np.cumsum(own)[:-1])), own
        ids = np.concatenate([ids, flat])
    out = gather(ids, at, n)
    ends = np.concatenate(([0], np.cumsum(n)))
    return out, ends[w.first]


def tokenized(path: str):
    """A mapInArrow function: (doc_id, text) to pieces with their place and checksum."""

    def run(batches):
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for at, n in blocks(texts):
                flat, bounds = encode_block(texts.slice(at, n), path)
                doc, piece, start, length, crc = [], [], [], [], []
                for i in range(n):
                    own = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), SEQUENCE)):
                        part = own[s : s + SEQUENCE]
                        doc.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_col.slice(at, n).take(pa.array(doc, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def best_fit(sizes: np.ndarray, room: int) -> np.ndarray:
    """Best-fit decreasing: the bin number of each item, bins from 0.

    Open bins are kept by what room they have left; a bit set tells the
    smallest room that still holds the next item.
    """
    out = np.zeros(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    some, bins = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            held = by_room[left]
            b = held.pop()
            if not held:
                some &= ~(1 << left)
        else:
            left, b = room, bins
            bins += 1
        out[i] = b
        left -= size
        if left:
            by_room[left].append(b)
            some |= 1 << left
    return out


_ITEM = "bin long, size long, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def _packer(room: int, level: int):
    """A grouped Arrow function: the items of one group to bins."""

    def pack(key, items):
        items = items.combine_chunks()
        group = key[0].as_py()
        sizes = items.column("size").to_numpy()
        which = best_fit(sizes, room)
        order = np.argsort(which, kind="stable")
        items, which, sizes = items.take(pa.array(order)), which[order], sizes[order]
        ends = np.cumsum(sizes)
        head = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        base = np.repeat((ends - sizes)[head], np.diff(np.r_[head, len(which)]))
        shift = ends - sizes - base  # of each item in its bin
        lists = items.column("pieces").combine_chunks()
        per_item = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        names = [f.name for f in flat.type]
        arrays = [flat.field(n) for n in names]
        arrays[names.index("offset")] = pa.array(flat.field("offset").to_numpy() + np.repeat(shift, per_item), pa.int64())
        cuts = np.r_[np.concatenate(([0], np.cumsum(per_item)))[head], len(flat)]
        bins = np.int64(level) << np.int64(56) | np.int64(group) << np.int64(28) | np.arange(len(head), dtype=np.int64)
        return pa.table(
            {
                "bin": pa.array(bins, pa.int64()),
                "size": pa.array(np.add.reduceat(sizes, head), pa.int64()),
                "pieces": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(arrays, names)),
            }
        )

    return pack


def pack(pieces: DataFrame, room: int = SEQUENCE, per_task: int = PER_TASK, nearly: float = 0.995, fan_in: int = 8, gain: float = 0.01) -> DataFrame:
    """Pieces with sequence_id and offset added.

    per_task: items that one task packs at a time, the bound on its memory;
    nearly: a bin at least so full leaves the tree at once; gain: the share of
    bins that a round over several tasks must save for another one.
    """
    left = pieces.count()
    groups = max(1, -(-left // per_task))
    item = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset")))
    items = pieces.select(
        F.lit(0).cast("long").alias("bin"), F.col("length").alias("size"), item.alias("pieces"),
        F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("grp"),
    )
    done, level = [], 1
    while left:
        packed = materialize(items.groupBy("grp").applyInArrow(_packer(room, level), _ITEM))
        if groups == 1:
            done.append(packed)
            break
        under = packed.where(F.col("size") < room * nearly)
        done.append(packed.where(F.col("size") >= room * nearly))
        was, left = left, under.count()
        level += 1
        if left <= per_task:
            groups = 1
        elif left > (1 - gain) * was:
            # at most one bin of each group is at most half full: what they can be put into is among the emptiest
            some = materialize(under.orderBy("size", "bin").limit(min(per_task, 2 * groups)).select("bin", "size", "pieces"))
            done.append(under.join(F.broadcast(some.select("bin")), "bin", "left_anti").select(*packed.columns))
            left, groups, under = some.count(), 1, some
        else:
            groups = max(-(-groups // fan_in), -(-left // per_task))
        items = under.select("bin", "size", "pieces", F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("grp"))
    if not done:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("bin").alias("sequence_id"), F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset"
    )


def word_bpe() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """Tokenises docs(doc_id, text), cuts what is too long, packs all pieces."""
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(tokenized(vocabulary or word_bpe()), PIECE))
    return pack(pieces, **options)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
