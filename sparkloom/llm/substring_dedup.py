"""Substring deduplication by collinear chaining.

Seeds.  Runs of K words are sampled by minimisers: of every W consecutive runs
the one with the smallest hash, so two texts that share K + W - 1 words share a
seed.  Texts that are equal as a whole are joined first; one of each goes on.

Matches.  Every occurrence of a seed is matched to the seed's first occurrence
in the corpus (of words repeated on: the longest), so a passage in m texts gives m matches, not m squared.

Chains.  The matches of a pair of texts are chained in order of both positions;
a link costs GAP per word skipped on either side.  As that cost is a sum of
coordinates, the best predecessor is a prefix maximum in a Fenwick tree.

Alignment.  A chain is a row of exact blocks.  It is split at its worst gap until
each part has an identity of at least ``identity``; parts are grown at both ends
by alignment until the score falls DROP below its best.  A gap of over MOST_GAP
words without a seed in common counts as changed throughout.

Further rounds.  Where the seeds of a passage first occur in several earlier texts,
its copies see only short parts.  So the parts of a text are joined, and stretches
of at least ``min_words`` go into another round with what no single text covers of
them, and with the seeds there alone: short earlier pieces are gone from it.  There an occurrence is also matched to the one before it, in a seed's order of texts.
Rounds end when one finds nothing more.

Spans of parts of at least ``min_words`` that overlap in a text are joined and
returned; what a text has in common with several others, none of which holds
``min_words`` of it, isn't a passage.

Hot seeds.  A seed that looks common in a sample of the texts gets its first
occurrence from a sum that combines before the shuffle, and its occurrences are
dealt over salts; which way a seed goes changes no first occurrence.

Edge cases: null, empty and short texts have no seeds; texts equal as a whole
are one span each if long enough; repeats inside one text are no passages that
repeat across texts; repeated rows are texts of their own; a null doc_id is
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import MOST_KEYS, discard, frequent, hot_limit, materialize, narrow, salted, table
from sparkloom.llm.text import SPACE, Words, blocks, mix, shingles

K, SAMPLE, GAP = 7, 8, 0.15
MIN_WORDS, IDENTITY = 50, 0.8
DROP, MARGIN, MOST_GAP = 30, 200, 4096


def minimizers(flat: np.ndarray, bounds: np.ndarray, width: int = SAMPLE) -> np.ndarray:
    """Sorted places in flat of each text's sampled runs."""
    found = []
    n = len(flat)
    if n >= width:
        view = np.lib.stride_tricks.sliding_window_view(flat, width)
        starts = np.arange(len(view))
        owner_end = bounds[np.searchsorted(bounds, starts, side="right")]
        at = np.flatnonzero(starts + width <= owner_end)
        for i in range(0, len(at), 1 << 17):
            own = at[i : i + (1 << 17)]
            found.append(np.unique(own + view[own].argmin(axis=1)))
    size = np.diff(bounds)
    for i in np.flatnonzero((size > 0) & (size < width)):
        found.append(np.array([bounds[i] + int(flat[bounds[i] : bounds[i + 1]].argmin())]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def signatures(w: Words) -> list[np.ndarray]:
    """128 bits of each whole text, in two columns; each word's hash is weighed by its place, as order matters."""
    place = np.arange(len(w.key), dtype=np.uint64) - np.repeat(w.first[:-1], np.diff(w.first)).astype(np.uint64)
    total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(w.key + mix(place + np.uint64(s)))))) for s in (1, 99)]
    return [(t[w.first[1:]] - t[w.first[:-1]]).view(np.int64) for t in total]


def _seeded(batches):
    for batch in batches:
        for at, n in blocks(batch.column(1)):
            w = Words(batch.column(1).slice(at, n), SPACE)
            flat, bounds = shingles(w.key, w.first, K, short=False)
            spot = minimizers(flat, bounds)
            # words repeated on and on are one seed, at its first run
            order = np.lexsort((spot, flat[spot]))
            ranked, text = spot[order], np.searchsorted(bounds, spot[order], side="right")
            again = np.zeros(len(spot), dtype=bool)
            again[1:] = (flat[ranked[1:]] == flat[ranked[:-1]]) & (np.diff(ranked) <= K + SAMPLE) & (text[1:] == text[:-1])
            head = np.flatnonzero(~again)
            run = ranked[np.append(head[1:], len(spot)) - 1] - ranked[head] + 1 if len(spot) else np.zeros(0, np.int64)
            spot = ranked[head]
            back = np.argsort(spot)
            spot, run = spot[back], run[back]
            cuts = np.searchsorted(spot, bounds).astype(np.int32)
            pos = spot - bounds[np.searchsorted(bounds, spot, side="right") - 1]
            sig = signatures(w)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(np.diff(w.first), pa.int64()), pa.array(sig[0]), pa.array(sig[1]),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat[spot].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(pos.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(run.astype(np.int32))),
                ],
                names=["doc_id", "place", "n", "s0", "s1", "h", "p", "r"],
            )


class Fenwick:
    """Prefix maxima with the index that reaches them."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def chains(x: list[int], y: list[int], gap: float = GAP) -> list[list[int]]:
    """Disjoint collinear chains of the matches (x[i], y[i]) of two texts, as lists of i."""
    n = len(x)
    order = sorted(range(n), key=lambda i: (x[i], -y[i]))
    ranks = {v: r for r, v in enumerate(sorted(set(y)))}
    tree, score, back = Fenwick(len(ranks)), [0.0] * n, [-1] * n
    for i in order:
        value, j = tree.upto(ranks[y[i]])  # strictly before in y; in x by the order
        if j >= 0 and x[j] < x[i]:
            dx, dy = x[i] - x[j], y[i] - y[j]
            near = score[j] + min(K, dx, dy) - gap * (max(dx - K, 0) + max(dy - K, 0))
            score[i], back[i] = (near, j) if near > K else (float(K), -1)
        else:
            score[i] = float(K)
        tree.put(ranks[y[i]], score[i] + gap * (x[i] + y[i]), i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        if used[i]:
            continue
        at, own = i, []
        while at >= 0 and not used[at]:
            used[at] = True
            own.append(at)
            at = back[at]
        out.append(own[::-1])
    return out


_CHAIN = "uid long, other long, s int, e int, os int, oe int, x array<int>, y array<int>, n array<int>"
_CHAIN_TYPES = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 3


def clusters(x: list[int], y: list[int]) -> list[tuple]:
    """The chains of two texts, those near each other in one row: (start, end, start, end, x, y, matches of each chain)."""
    out: list[list] = []
    for own in sorted(chains(x, y), key=lambda c: x[c[0]]):
        s, e, os_, oe = x[own[0]], x[own[-1]] + K, y[own[0]], y[own[-1]] + K
        last = out[-1] if out else None
        if not last or s > last[1] + MARGIN or os_ > last[3] + MARGIN or oe < last[2] - MARGIN:
            last = [s, e, os_, oe, [], [], []]
            out.append(last)
        last[1], last[2], last[3] = max(last[1], e), min(last[2], os_), max(last[3], oe)
        last[4] += [x[i] for i in own]
        last[5] += [y[i] for i in own]
        last[6].append(len(own))
    return [tuple(c) for c in out]


def _chained(batches):
    """Matches (uid, pos, other, opos), sorted by uid and other, to chains."""
    key, x, y, out = None, [], [], []

    def close():
        if key is not None:
            out.extend((*key, *c) for c in clusters(x, y))

    def emit():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, _CHAIN_TYPES, strict=True)], names=["uid", "other", "s", "e", "os", "oe", "x", "y", "n"])

    for batch in batches:
        for u, p, o, q in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (u, o) != key:
                close()
                key, x, y = (u, o), [], []
            x.append(p)
            y.append(q)
        yield emit()
        out = []
    close()
    yield emit()


def edits(a: np.ndarray, b: np.ndarray) -> int:
    """Word edit distance, by anti-diagonal-free rows: insertions are a running minimum."""
    same = 0
    n = min(len(a), len(b))
    while same < n and a[same] == b[same]:
        same += 1
    a, b, n = a[same:], b[same:], n - same
    tail = 0
    while tail < n and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b) or max(len(a), len(b)) > MOST_GAP:
        return max(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return len(b) - int(a[0] in b)
    step = np.arange(len(b) + 1)
    row = step.copy()
    for i, v in enumerate(a.tolist()):
        new = np.minimum(row + 1, np.concatenate(([i + 1], row[:-1] + (b != v))))
        row = np.minimum.accumulate(new - step) + step
    return int(row[-1])


def reach(a: list[int], b: list[int], i: int, j: int, step: int, weight: float) -> tuple[int, int, int]:
    """Words of a and b, from i and j on by step, up to the best score, and the edits there.

    An edit costs ``weight`` words.  Of each diagonal only the furthest place is
    kept; it ends where its score is DROP below the best.
    """
    n, m = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    best, top, row, d = (0, 0, 0), 0.0, {0: 0}, 0
    while row:
        kept = {}
        for k, f in row.items():
            g = f + k
            while f < n and g < m and a[i + step * f] == b[j + step * g]:
                f, g = f + 1, g + 1
            score = max(f, g) - weight * d
            if score > top:
                best, top = (f, g, d), score
            if score >= top - DROP and (f < n or g < m):
                kept[k] = f
        row, d = {}, d + 1
        for k, f in kept.items():
            g = f + k
            for to, ff, gg in ((k, f + 1, g + 1), (k + 1, f, g + 1), (k - 1, f + 1, g)):
                if ff <= n and gg <= m and ff > row.get(to, -1):
                    row[to] = ff
    return best


def exact_blocks(a: list[int], b: list[int], anchors) -> list[tuple[int, int, int]]:
    """Ordered, disjoint stretches of equal words (start in a, start in b, words) around a chain's matches."""
    out, pi, pj = [], 0, 0
    for x, y in anchors:
        t = max(pi - x, pj - y, 0)
        if t >= K or (out and x - y == pi - pj and x < pi):
            continue
        i, j = x + t, y + t
        s, o = i, j
        while s > pi and o > pj and a[s - 1] == b[o - 1]:
            s, o = s - 1, o - 1
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i > s:
            out.append((s, o, i - s))
            pi, pj = i, j
    return out


def parts(found: list[tuple[int, int, int]], gaps: list[int], weight: float) -> list[tuple[int, int, int]]:
    """(first block, last block, edits) of a chain split at its worst gap until no part's edits outweigh its words."""
    out, todo = [], [(0, len(found) - 1)] if found else []
    cost = [0, *np.cumsum(gaps).tolist()]
    worth = [max(q[0] - p[0] - p[2], q[1] - p[1] - p[2]) - weight * d for p, q, d in zip(found, found[1:], gaps, strict=False)]
    while todo:
        low, high = todo.pop()
        d = cost[high] - cost[low]
        (s, o, _), (e, oe, n) = found[low], found[high]
        if max(e + n - s, oe + n - o) >= weight * d - 1e-6:
            out.append((low, high, d))
        else:
            at = min(range(low, high), key=worth.__getitem__)
            todo += [(low, at), (at + 1, high)]
    return out


def _aligned(identity: float):
    """Chains (uid, other, x, y, n, words, other words, first word, other first word) to grown parts with their identity."""
    weight = 1 / max(1 - identity, 1e-9)

    def run(batches):
        for batch in batches:
            out = []
            u, o, xs, ys, ns = (batch.column(i).to_pylist() for i in range(5))
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(5), batch.column(6))]
            a0, b0 = (batch.column(i).to_pylist() for i in (7, 8))
            for r in range(len(u)):
                wide = [v[at[r] : at[r + 1]] for at, v in lists]
                a, b = (v.tolist() for v in wide)
                held, first = [], 0
                for n in ns[r]:
                    anchors = [(x - a0[r], y - b0[r]) for x, y in zip(xs[r][first : first + n], ys[r][first : first + n], strict=True)]
                    first += n
                    (s, o_), (e, oe) = anchors[0], anchors[-1]
                    if any(h[0] <= s and e + K <= h[1] and h[2] <= o_ and oe + K <= h[3] for h in held):
                        continue
                    found = exact_blocks(a, b, anchors)
                    gaps = [edits(wide[0][p[0] + p[2] : q[0]], wide[1][p[1] + p[2] : q[1]]) for p, q in zip(found, found[1:], strict=False)]
                    for low, high, d in parts(found, gaps, weight):
                        (s, o_, _), (e, oe, k) = found[low], found[high]
                        e, oe = e + k, oe + k
                        left, right = reach(a, b, s - 1, o_ - 1, -1, weight), reach(a, b, e, oe, 1, weight)
                        s, o_, e, oe, d = s - left[0], o_ - left[1], e + right[0], oe + right[1], d + left[2] + right[2]
                        held.append((s, e, o_, oe))
                        out.append((u[r], o[r], s + a0[r], e + a0[r], o_ + b0[r], oe + b0[r], 1 - d / max(e - s, oe - o_)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()], strict=True)],
                names=["uid", "other", "s", "e", "os", "oe", "identity"],
            )

    return run


def _words(batches):
    """(text, uid, s0) to (uid, words); rows that only their hash brought here go."""
    for batch in batches:
        for at, n in blocks(batch.column(0)):
            w = Words(batch.column(0).slice(at, n), SPACE)
            meant = pa.array(signatures(w)[0] == batch.column(2).slice(at, n).to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array((w.key >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, n).filter(meant), lists.filter(meant)], names=["uid", "words"])


def _joined(batches):
    """Spans (uid, s, e, other, identity), sorted by uid and s, with overlapping ones joined; other: that of the longest."""
    held, out = None, []
    for batch in batches:
        for u, s, e, o, d in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[0] == u and s <= held[2]:
                if e - s > held[5]:
                    held[3], held[5] = o, e - s
                held[2], held[4] = max(held[2], e), min(held[4], d)
            else:
                if held:
                    out.append(tuple(held[:5]))
                held = [u, s, e, o, d, e - s]
        yield _spans(out)
        out = []
    yield _spans([tuple(held[:5])] if held else [])


def _spans(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()], strict=True)], names=["uid", "s", "e", "other", "identity"])


def uncovered(spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """What spans of under min_words, in order, cover beside the longer ones."""
    out, done = [], 0
    long = [x for x in spans if x[1] - x[0] >= min_words] + [(1 << 60, 1 << 60)]
    for s, e in spans:
        if e - s >= min_words:
            continue
        s = max(s, done)
        for a, b in long:
            if a >= e:
                break
            if b > s:
                if a > s:
                    out.append((s, a))
                s = b
        if e > s:
            out.append((s, e))
        done = max(done, e)
    return out


def _open(min_words: int):
    """Spans (uid, s, e), sorted by uid and s: what no span of min_words covers of stretches so long that spans fill, but for gaps without a whole seed."""

    def run(batches):
        uid, stretch, end, out = None, [], 0, []

        def close():
            if stretch and end - stretch[0][0] >= min_words:
                out.extend((uid, *x) for x in uncovered(stretch, min_words))

        for batch in batches:
            for u, s, e in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if u != uid or s > end + K + SAMPLE:
                    close()
                    uid, stretch, end = u, [], 0
                stretch.append((s, e))
                end = max(end, e)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, [pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["uid", "s", "e"])
            out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, [pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["uid", "s", "e"])

    return run


def matches(seeds: DataFrame, total: int, neighbours: bool) -> DataFrame:
    """(uid, p, other, op): occurrences of seeds(uid, h, p, r) beside their seed's first one in another of total texts; neighbours: beside the one before them too."""
    first = F.min(F.struct((-F.col("r")).alias("m"), "uid", "p"))
    own = W.partitionBy("h")
    hot = frequent(seeds, "h", "uid", total)
    if hot is None:
        led = seeds.withColumn("first", first.over(own))
    else:
        # one row a common seed, so a join with it makes no row more than it reads; every seed goes through it once
        small = hot.count() <= MOST_KEYS
        common = seeds.join(F.broadcast(hot) if small else hot, "h")
        heads = materialize(common.groupBy("h").agg(first.alias("head"), F.ceil(F.count("*") / hot_limit(total)).alias("salts")))
        salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("uid"), F.col("salts")))
        own = W.partitionBy("h", "salt")
        led = seeds.join(F.broadcast(heads) if small else heads, "h", "left").withColumn("salt", salt).drop("salts").withColumn("first", F.coalesce("head", first.over(own)))
    ends = [F.struct(F.col("first.uid").alias("other"), F.col("first.p").alias("op"))]
    if neighbours:
        led = led.withColumn("before", F.lag(F.struct("uid", "p")).over(own.orderBy("uid", "p")))
        ends.append(F.when(F.col("before.uid") != F.col("first.uid"), F.struct(F.col("before.uid").alias("other"), F.col("before.p").alias("op"))))
    return led.select("uid", "p", F.explode(F.array(*ends)).alias("x")).select("uid", "p", "x.*").where("uid <> other")


def aligned_parts(found: DataFrame, words: DataFrame, identity: float) -> DataFrame:
    """The parts (uid, other, s, e, os, oe, identity) of chains, as the words of both texts say."""
    # only the stretch around chains travels: as much again as they are long, on either side
    margin = F.greatest(F.col("e") - F.col("s"), F.col("oe") - F.col("os"), F.lit(MARGIN))
    cut = lambda d, low, high: F.slice(d, F.greatest(low - margin, F.lit(0)) + 1, high - low + 2 * margin)
    held = ["uid", "other", "x", "y", "n"]
    own = narrow(words, found.select("uid").distinct(), "uid")
    left = found.join(own, "uid").select(*held, "s", "e", "os", "oe", cut(F.col("words"), F.col("s"), F.col("e")).alias("a"), F.greatest(F.col("s") - margin, F.lit(0)).alias("a0"))
    # a text may be the first one of very many: they are dealt over salts, it goes to each
    sizes = materialize(found.groupBy("other").agg(F.count("*").alias("size")))
    limit = hot_limit(sizes.agg(F.sum("size")).first()[0] or 0)
    hot = F.broadcast(sizes.where(F.col("size") > limit).select("other", F.ceil(F.col("size") / limit).alias("salts")))
    dealt = left.join(hot, "other", "left").withColumn("_salt", F.pmod(F.xxhash64("uid", "s", "e"), F.coalesce("salts", F.lit(1).cast("long")))).drop("salts")
    others = narrow(words.select(F.col("uid").alias("other"), "words"), sizes.select("other"), "other").join(hot, "other", "left")
    spread = others.select("other", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)).alias("_salt"))
    both = dealt.join(spread, ["other", "_salt"]).withColumn("b", cut(F.col("words"), F.col("os"), F.col("oe"))).withColumn("b0", F.greatest(F.col("os") - margin, F.lit(0)))
    return both.select(*held, "a", "b", "a0", "b0").mapInArrow(_aligned(identity), "uid long, other long, s int, e int, os int, oe int, identity double")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """One row per passage of docs(doc_id, text) that another text also holds.

    doc_id, start_word, n_words, other_id (a text that shares it), identity,
    whole (the text as a whole has a copy).
    """
    place = F.xxhash64("doc_id", "text").alias("place")
    full = materialize(
        docs.select("doc_id", "text", place)
        .mapInArrow(_seeded, "doc_id long, place long, n long, s0 long, s1 long, h array<long>, p array<int>, r array<int>")
        .withColumn("uid", F.monotonically_increasing_id())
    )
    rows = materialize(full.drop("h", "p", "r"))
    total = rows.count()
    key = ["n", "s0", "s1"]
    same = materialize(rows.where("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("m"), F.count("*").alias("size")).select(*key, "m.doc_id", "m.uid", "size"))
    every = narrow(full.select("uid", "h", "p", "r"), same.select("uid"), "uid").select("uid", F.explode(F.arrays_zip("h", "p", "r")).alias("x")).select("uid", "x.*")
    seeds, words, every_part, done = every, None, None, False
    while True:
        found = materialize(matches(seeds, total, done).repartition("uid").sortWithinPartitions("uid", "other", "p").mapInArrow(_chained, _CHAIN))
        if words is None:
            wanted = materialize(found.select("uid").union(found.select("other")).distinct().join(rows.select("uid", "place", "s0"), "uid"))
            words = materialize(narrow(docs.select("text", place), wanted, "place").select("text", "uid", "s0").mapInArrow(_words, "uid long, words array<int>").dropDuplicates(["uid"]))
        parts = aligned_parts(found, words, identity)
        ends = F.explode(F.array(F.struct("uid", "s", "e", "other", "identity"), F.struct(F.col("other").alias("uid"), F.col("os").alias("s"), F.col("oe").alias("e"), F.col("uid").alias("other"), "identity")))
        parts = materialize(parts.select(ends.alias("x")).select("x.*").groupBy("uid", "s", "e").agg(F.min("other").alias("other"), F.max("identity").alias("identity")))
        long = F.col("e") - F.col("s") >= min_words
        if done and parts.where(long).isEmpty():
            break
        every_part = parts if every_part is None else materialize(every_part.where(long).union(parts))
        done = True
        left = materialize(every_part.select("uid", "s", "e").repartition("uid").sortWithinPartitions("uid", "s").mapInArrow(_open(min_words), "uid long, s int, e int"))
        if left.isEmpty():
            break
        seeds = materialize(every.join(left, "uid").where("p >= s AND p < e").select("uid", "h", "p", "r").distinct())
    spans = every_part.where(F.col("e") - F.col("s") >= min_words)
    merged = materialize(spans.repartition("uid").sortWithinPartitions("uid", "s").mapInArrow(_joined, "uid long, s int, e int, other long, identity double"))
    discard(full)
    single = same.where("size = 1").select("uid", "doc_id").join(merged, "uid").join(rows.select(F.col("uid").alias("other"), F.col("doc_id").alias("other_id")), "other")
    part = single.select("doc_id", F.col("s").alias("start_word"), (F.col("e") - F.col("s")).cast("long").alias("n_words"), "other_id", "identity", F.lit(False).alias("whole"))
    several = same.where((F.col("size") > 1) & (F.col("n") >= min_words)).withColumnRenamed("doc_id", "other_id").drop("uid")
    several = materialize(several)
    dealt, spread = salted(rows.where("n > 0").select("doc_id", *key), several, key, "size", hot_limit(total))
    copies = dealt.join(spread, [*key, "_salt"]).select("doc_id", F.lit(0).alias("start_word"), F.col("n").alias("n_words"), "other_id", F.lit(1.0).alias("identity"), F.lit(True).alias("whole"))
    return part.union(copies)


def op3_chained_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
