"""Sharding by a K-d tree over document metadata, split at distributed weighted medians.

The tree divides the points (a group of equal texts is one point, weighted by
its bytes) along the dimension in which a node is widest, at the point where
the running weight reaches the share of the node's shards, until every leaf is
down to its target bytes.  All nodes of a level are split together.  Medians
come from histograms: each pass sums weights of equal-width bins per node in
the tasks, one bin per node is picked from the sums, and after a few passes the few
points left in it are compared exactly.  Nothing is sorted or shuffled for it, and
the driver sees one row per node and pass.

Beyond TOP nodes, nodes of up to TASK_POINTS points are grown to their leaves
in one task each, by the same rule; larger ones are split on as before.

Law: ``bytes``.  A group of equal texts stays in one shard unless it is heavy
(over 1/32 of a shard and over any single text); such a group is dealt into points below that size, so
one group with a third of all rows cannot unbalance the shards.

Edge cases: null text has no bytes (size 1); null metadata is a value of its
own; repeated rows get slots of their own; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm.common import hot_limit, materialize, pick, table

BINS = 512
EXACT = 4096
#: Nodes up to which all are split together; points up to which a node is then grown in one task (about 100 MB).
TOP, TASK_POINTS = 1024, 1_000_000
DIMS = ("d0", "d1", "d2", "d3")


def _unit(*cols) -> F.Column:
    """A value's place in [0, 1) by its hash: categories need no dictionary."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


class Tree:
    """A point below its node's cut goes left; nodes are numbered as in a heap from 1.

    dim is -1 where a node isn't split; first: the first shard of a node.
    """

    def __init__(self):
        self.dim, self.value, self.tie = np.full(4, -1, np.int8), np.zeros(4), np.zeros(4)
        self.share: dict[int, tuple[int, int]] = {}

    def cut(self, node: int, dim: int, value: float, tie: float) -> None:
        while 2 * node + 1 >= len(self.dim):
            n = len(self.dim)
            self.dim, self.value, self.tie = np.r_[self.dim, np.full(n, -1, np.int8)], np.r_[self.value, np.zeros(n)], np.r_[self.tie, np.zeros(n)]
        self.dim[node], self.value[node], self.tie[node] = dim, value, tie

    def node_of(self, dims: np.ndarray, tie: np.ndarray) -> np.ndarray:
        node, at = np.ones(len(tie), dtype=np.int64), np.arange(len(tie))
        while True:
            at = at[self.dim[node[at]] >= 0]
            if not len(at):
                return node
            n = node[at]
            x = dims[self.dim[n], at]
            left = (x < self.value[n]) | ((x == self.value[n]) & (tie[at] < self.tie[n]))
            node[at] = 2 * n + ~left


def _columns(batch):
    return np.stack([batch.column(d).to_numpy(zero_copy_only=False) for d in DIMS]), batch.column("tie").to_numpy(zero_copy_only=False), batch.column("weight").to_numpy(zero_copy_only=False)


def _widths(tree: Tree):
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            dims, tie, weight = _columns(batch)
            node = tree.node_of(dims, tie)
            order = np.argsort(node, kind="stable")
            names, at = np.unique(node[order], return_index=True)
            if not len(names):
                continue
            n, w = np.diff(np.r_[at, len(node)]), np.add.reduceat(weight[order], at)
            low, high = np.minimum.reduceat(dims[:, order], at, axis=1), np.maximum.reduceat(dims[:, order], at, axis=1)
            for i, name in enumerate(names.tolist()):
                f = found.get(name)
                found[name] = [int(w[i]), int(n[i]), low[:, i], high[:, i]] if f is None else [f[0] + int(w[i]), f[1] + int(n[i]), np.minimum(f[2], low[:, i]), np.maximum(f[3], high[:, i])]
        yield pa.RecordBatch.from_pylist(
            [{"node": n, "weight": w, "n": m, "low": low.tolist(), "high": high.tolist()} for n, (w, m, low, high) in found.items()],
            schema=pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]),
        )

    return run


class Search:
    """Where each open node's cut is looked for, as arrays in the order of ``node``.

    dim; low and high of the interval; same: the search is among points of one
    value, by their tie; goal and what weighs below; exact: few points are left.
    """

    def __init__(self, found: dict[int, dict]):
        self.node = np.array(sorted(found), np.int64)
        for name, kind in (("dim", np.int64), ("same", np.float64), ("low", np.float64), ("high", np.float64), ("goal", np.float64), ("below", np.int64), ("exact", bool)):
            setattr(self, name, np.array([found[n][name] for n in self.node.tolist()], kind))

    def place(self, node: np.ndarray) -> np.ndarray:
        """The index of each node, -1 where it isn't searched."""
        i = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return np.where(self.node[i] == node, i, -1)


def _histogram(tree: Tree, s: Search, exact: bool):
    """Of points: the sums of the bins of the nodes, or in those with few points left the points themselves."""

    def run(batches):
        for batch in batches:
            dims, tie, weight = _columns(batch)
            i = s.place(tree.node_of(dims, tie))
            at = np.flatnonzero(i >= 0)
            at = at[s.exact[i[at]] == exact]
            i = i[at]
            x, t, w = dims[s.dim[i], at], tie[at], weight[at]
            tied = ~np.isnan(s.same[i])
            v = np.where(tied, t, x)
            keep = (v >= s.low[i]) & (v <= s.high[i]) & (~tied | (x == s.same[i]))
            i, x, t, w, v = i[keep], x[keep], t[keep], w[keep], v[keep]
            if not len(i):
                continue
            if exact:
                cols = (s.node[i], np.zeros(len(i), np.int64), w, np.ones(len(i), np.int64), x, x, t)
            else:
                width = s.high[i] - s.low[i]
                b = np.minimum(((v - s.low[i]) / np.where(width > 0, width, 1) * BINS).astype(np.int64), BINS - 1)
                order = np.argsort(i * BINS + b, kind="stable")
                key, first = np.unique((i * BINS + b)[order], return_index=True)
                cols = (
                    s.node[key // BINS], key % BINS, np.add.reduceat(w[order], first), np.diff(np.r_[first, len(i)]),
                    np.minimum.reduceat(v[order], first), np.maximum.reduceat(v[order], first), np.zeros(len(key)),
                )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "bin", "weight", "n", "low", "high", "tie"])

    return run


_HIST = "node long, bin long, weight long, n long, low double, high double, tie double"


def _picked(s: Search, exact: bool):
    """Of a node's bins or last points: (node, done, below, n, low, high): the bin of the cut, or the cut itself in low and high."""

    def run(key, rows):
        i = int(s.place(np.array([key[0].as_py()]))[0])
        rows = rows.sort_by([("low", "ascending"), ("tie", "ascending")])
        weight, n, low, high, tie = (rows.column(c).to_numpy() for c in ("weight", "n", "low", "high", "tie"))
        after = s.below[i] + np.cumsum(weight)
        if exact:
            x, t = np.r_[low, low[-1]], np.r_[tie, np.nextafter(tie[-1], 2.0)]
            at = int(np.abs(np.r_[s.below[i], after] - s.goal[i]).argmin())
            out = (True, 0, 0, float(x[at]), float(t[at]))
        else:
            at = min(int(np.searchsorted(after, s.goal[i])), len(after) - 1)
            out = (False, int(after[at] - weight[at]), int(n[at]), float(low[at]), float(high[at]))
        return pa.table({k: [v] for k, v in zip(("node", "done", "below", "n", "low", "high"), (key[0].as_py(), *out), strict=True)})

    return run


def _halves(node: int, first: int, n: int):
    return (2 * node, first, n // 2), (2 * node + 1, first + n // 2, n - n // 2)


def grow(points: DataFrame, shards: int) -> tuple[Tree, list[float]]:
    """The top of the tree that gives each of the shards its share of the points' weight, and each dimension's span."""
    tree, span = Tree(), None
    tree.share = {1: (0, shards)}
    open_ = {1} if shards > 1 else set()
    while open_:
        stats: dict[int, list] = {}
        ends = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(len(DIMS))] + [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(len(DIMS))]
        seen = points.mapInArrow(_widths(tree), "node long, weight long, n long, low array<double>, high array<double>").groupBy("node")
        for r in seen.agg(F.sum("weight").alias("w"), F.sum("n").alias("n"), *ends).collect():
            stats[r["node"]] = [r["w"], [r[f"l{i}"] for i in range(len(DIMS))], [r[f"h{i}"] for i in range(len(DIMS))], r["n"]]
        if span is None:
            span = [max(h - low, 1e-12) for low, h in zip(*stats[1][1:3], strict=True)] if 1 in stats else [1.0] * len(DIMS)
        if len(tree.share) >= TOP:  # the others are grown in tasks
            open_ = {n for n in open_ if n in stats and stats[n][3] > TASK_POINTS}
        search, cut = {}, {}
        for node in open_:
            n = tree.share[node][1]
            if node not in stats:  # no points: any cut will do
                cut[node] = (0, 0.0, 0.0)
                continue
            w, low, high, _ = stats[node]
            d = int(np.argmax([(h - a) / s for a, h, s in zip(low, high, span, strict=True)]))
            search[node] = {"dim": d, "same": np.nan, "low": low[d], "high": high[d], "goal": w * (n // 2) / n, "below": 0, "exact": stats[node][3] <= EXACT}
        while search:
            s = Search(search)
            for exact in (False, True):
                if not (s.exact == exact).any():
                    continue
                found = points.mapInArrow(_histogram(tree, s, exact), _HIST)
                if not exact:
                    found = found.groupBy("node", "bin").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("tie").alias("tie"))
                for r in found.groupBy("node").applyInArrow(_picked(s, exact), "node long, done boolean, below long, n long, low double, high double").collect():
                    own = search[r["node"]]
                    if r["done"]:
                        cut[r["node"]] = (own["dim"], r["low"], r["high"])
                        search.pop(r["node"])
                        continue
                    own |= {"below": r["below"], "low": r["low"], "high": r["high"]}
                    if r["n"] <= EXACT:
                        own["exact"] = True
                    elif r["low"] == r["high"]:
                        if not np.isnan(own["same"]):  # equal to the last bit
                            cut[r["node"]] = (own["dim"], own["same"], r["low"])
                            search.pop(r["node"])
                        else:
                            own |= {"same": r["low"], "low": 0.0, "high": 1.0}
        kids = set()
        for node, c in cut.items():
            tree.cut(node, *c)
            for kid, first, n in _halves(node, *tree.share.pop(node)):
                tree.share[kid] = (first, n)
                kids |= {kid} if n > 1 else set()
        open_ = kids
    return tree, span or [1.0] * len(DIMS)


def _placed(tree: Tree):
    """Of points: their node, with its first shard and how many it has."""
    nodes = np.array(sorted(tree.share))
    first, many = (np.array([tree.share[n][k] for n in nodes]) for k in (0, 1))

    def run(batches):
        for batch in batches:
            dims, tie, _ = _columns(batch)
            i = np.searchsorted(nodes, tree.node_of(dims, tie))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first[i], pa.int32()), pa.array(many[i], pa.int32())], names=[*batch.schema.names, "shard", "many"])

    return run


def _grown(span: list[float]):
    """A node's points with the shard of each: the node is split to its leaves by the rule of the top."""

    def run(points):
        dims, tie, weight = _columns(points)
        shard = np.full(len(tie), points.column("shard")[0].as_py(), np.int64)
        todo = [(np.arange(len(tie)), int(shard[0]), points.column("many")[0].as_py())] if len(tie) else []
        while todo:
            at, first, n = todo.pop()
            shard[at] = first
            if n == 1 or not len(at):
                continue
            own = dims[:, at]
            d = int(np.argmax((own.max(axis=1) - own.min(axis=1)) / span))
            order = at[np.lexsort((tie[at], dims[d, at]))]
            after = np.r_[0, np.cumsum(weight[order])]
            k = int(np.abs(after - after[-1] * (n // 2) / n).argmin())
            todo += [(order[:k], first, n // 2), (order[k:], first + n // 2, n - n // 2)]
        return pa.table({"g0": points.column("g0"), "g1": points.column("g1"), "salt": points.column("salt"), "shard": pa.array(shard, pa.int32())})

    return run


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per row of docs with its shard and its slot there.

    Give the number of shards, or target_bytes to have as many shards as
    leaves of that size come out.
    """
    rows = materialize(
        pick(docs, "doc_id", "text", lang="string", source="string").select(
            "doc_id",
            (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("g0"),
            F.xxhash64(F.lit(1), F.length("text"), "text").alias("g1"),
            "lang", "source",
        ).withColumn("uid", F.monotonically_increasing_id())
    )
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.max("size").alias("most")).first()
    n, weight = total["n"], total["w"] or 0
    if shards is None:
        shards = max(1, -(-weight // (target_bytes or 128 << 20)))
    # heavy: over 1/32 of a shard and over any single text; at most 32 * shards groups are, so their list has a fixed bound
    limit = max(1, weight // (32 * shards), total["most"] or 0)
    key = ["g0", "g1"]
    sizes = rows.groupBy(*key).agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    heavy = materialize(sizes.where((F.col("w") > limit) & (F.col("n") > 1)).select(*key, F.ceil(F.col("w") / limit).cast("long").alias("parts")))
    keyed = rows.join(F.broadcast(heavy), key, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0)).cast("int")
    ).drop("parts")
    meta = F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(0)).alias("doc_id"), "lang", "source", "size"))
    points = materialize(
        keyed.groupBy(*key, "salt").agg(F.sum("size").alias("weight"), meta.alias("m"))
        .select(
            *key, "salt", "weight",
            _unit("m.lang").alias("d0"),
            _unit("m.source").alias("d1"),
            F.log2(F.col("m.size").cast("double")).alias("d2"),
            F.col("m.doc_id").cast("double").alias("d3"),
            _unit(*key, "salt").alias("tie"),
        )
    )
    tree, span = grow(points, shards)
    held = ["g0", "g1", "salt", "shard"]
    placed = points.mapInArrow(_placed(tree), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in points.schema)}, shard int, many int")
    if any(n > 1 for _, n in tree.share.values()):
        grown = placed.where("many > 1").groupBy("shard").applyInArrow(_grown(span), "g0 long, g1 long, salt int, shard int")
        placed = placed.where("many = 1").select(*held).union(grown)
    placed = materialize(placed.select(*held))
    put = materialize(keyed.join(placed, [*key, "salt"]).select("doc_id", "size", "text_crc32", "shard", "uid"))
    # gapless slots: rows are ranked in buckets of bounded size, buckets are offset by their counts
    buckets = max(1, n // (shards * 20_000))
    put = put.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    counts = put.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    offsets = counts.withColumn("before", F.sum("c").over(W.partitionBy("shard").orderBy("bucket")) - F.col("c")).drop("c")
    ranked = put.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "uid")) - 1)
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=16)
