"""N-gram Jaccard join by a token-group matrix.

Sets are the distinct word shingles of whole texts; identical sets are joined
by their signature first and only one of each goes on.

Tokens.  Two sets that link differ in at most H elements, H = (|A| + |B|)(1 - J) / (1 + J).
Elements are dealt by hash into H + T parts, so at least T parts of linked
sets are identical, and a part's digest is a token.  Sets are indexed at
the level of their size class and of the one below, as linked sets lie in the
same or in neighbouring classes.  A passage that many texts share makes no
token common, since a part mixes elements from everywhere in a text.

Groups.  Every set belongs to the group of the leader with which it shares most
tokens (a token's leader is its smallest set), so similar sets are together.

Matrix.  Each group's token union is stored as (token, group).  A set's overlap
with a group's union bounds what it can share with any member; only groups of
which the bound reaches what a link needs are opened for it.

Opened groups.  With at most SMALL sets, all are compared.  In a larger one,
every set is described by its difference from the group's centre (the elements
that most of some of its sets have; any origin gives the same result): |A ^ B| = |D(A) ^ D(B)|.  Sets whose differences are
short enough together link without a look at them, so all of these link with
the one that has most to spare; sets beyond it can link only where their
differences overlap: near and far sets are dealt into blocks by the size of the
difference, and a far block meets each block that can hold a link with it once,
through inverted lists, emitting links only.
Near sets never meet each other, so a large group costs little more than its size.

Hot tokens.  A family of a third of all sets has tokens as common.  Tokens that
look common in a sample of the sets are counted with a sum that combines before
the shuffle instead of a window; which way a token goes changes no result.

Edge cases: null, empty and wordless texts have no set and link with nothing;
repeated rows have one set and thus link; a null doc_id takes part but names
no component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import MOST_KEYS, discard, frequent, hot_limit, materialize, narrow, salted, table
from sparkloom.llm.components import components
from sparkloom.llm.text import SPACE, Words, blocks, gather, mix, release, shingles

SPARE = 3
#: Sets up to which all of an opened group are compared.
SMALL = 64
#: Elements of differences, and 16 a set, that one task holds of a large group at a time: about 50 MB with their index.
BLOCK = 1 << 20
#: A group's near and far sets are dealt into about so many blocks, unless these hold less than LEAST_BLOCK or more than BLOCK.
#: A near set goes to every far block that can hold a link with it, a far set to every block, so a few blocks are enough.
NEAR_PARTS, FAR_PARTS, LEAST_BLOCK = 4, 3, 1 << 15
#: Bytes of centres up to which they are broadcast.
MOST_CENTRES = 32 << 20


class Levels:
    """Size classes for a similarity of percent / 100 and the parts of each."""

    def __init__(self, percent: int):
        self.percent = percent
        ratio = 100 / percent * 1.008  # a little over 1 / J: no rounding can part linked sets
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, math.floor(bounds[-1] * ratio)))
        self.bounds = np.array(bounds)
        self._parts: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def parts(self, level: int) -> tuple[int, int]:
        """How many parts sets of a level are dealt into, and how many of them linked sets share at least.

        Of the level are sets up to its largest size with partners up to
        1 / J times that.  Besides the H elements in which they may differ
        there are parts to spare for those that stay empty by chance.
        """
        if level not in self._parts:
            least, most = int(self.bounds[level]), int(self.bounds[level + 1]) - 1
            partner = most * 100 // self.percent
            differ = (most + partner) * (100 - self.percent) // (100 + self.percent)
            k = differ + SPARE
            for _ in range(20):
                empty = k * math.exp(-least / k)
                k = min(differ + SPARE + math.ceil(empty + 2 * math.sqrt(empty)), 2 * differ + SPARE)
            self._parts[level] = (k, k - differ)
        return self._parts[level]


def sets(column: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text of a block."""
    w = Words(column, SPACE)
    flat, bounds = shingles(w.key, w.first, width)
    for i in range(len(bounds) - 1):
        yield np.unique(flat[bounds[i] : bounds[i + 1]])


def tokens(one: np.ndarray, level: int, parts: int, same: int) -> tuple[np.ndarray, int]:
    """A set's tokens at a level, and how many of them a linked set must share.

    Empty parts say nothing.  They are left out unless so many are empty that
    the guarantee needs them.
    """
    part = ((one >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(one))))
    digest = total[cuts[1:]] - total[cuts[:-1]]
    token = mix(digest ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64(level << 32)))
    empty = np.diff(cuts) == 0
    few = int(empty.sum())
    return (token[~empty], same - few) if few < same else (token, 1)


def _indexed(width: int, percent: int):
    levels = Levels(percent)

    def run(batches):
        for batch in batches:
            for at, n in blocks(batch.column(1)):
                count, s0, s1, flat, cuts, need = [], [], [], [], [0], []
                for one in sets(batch.column(1).slice(at, n), width):
                    count.append(len(one))
                    for held, part in zip((s0, s1), _signature(one), strict=True):
                        held.append(part)
                    least = 1
                    if len(one):
                        level = levels.of(len(one))
                        own = [tokens(one, k, *levels.parts(k)) for k in (level, level - 1) if k >= 0]
                        flat += [t for t, _ in own]
                        least = min(x for _, x in own)
                    need.append(least)
                    cuts.append(cuts[-1] + (sum(len(t) for t, _ in own) if len(one) else 0))
                all_tokens = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array(count, pa.int64()),
                        pa.array(np.array(s0, np.uint64).view(np.int64)),
                        pa.array(np.array(s1, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(all_tokens.view(np.int64))),
                        pa.array(need, pa.int32()),
                        batch.column(2).slice(at, n),
                    ],
                    names=["doc_id", "n", "s0", "s1", "tokens", "need", "place"],
                )

    return run


def _signature(one: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    return int(mix(one).sum(dtype=np.uint64)), int(mix(one * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64))


def _stored(width: int):
    """(text, uid, s0) to (uid, elements); rows that only their hash brought here go."""

    def run(batches):
        for batch in batches:
            for at, n in blocks(batch.column(0)):
                own = list(sets(batch.column(0).slice(at, n), width))
                meant = batch.column(2).slice(at, n).to_numpy().view(np.uint64).tolist()
                keep = [i for i in range(n) if _signature(own[i])[0] == meant[i]]
                cuts = np.concatenate(([0], np.cumsum([len(own[i]) for i in keep]))).astype(np.int32)
                flat = np.concatenate([own[i] for i in keep]) if keep else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, n).take(pa.array(keep, pa.int64())), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.view(np.int64)))],
                    names=["uid", "elements"],
                )

    return run


def _lists(column) -> list[np.ndarray]:
    """The arrays of a list<long> column, without copies."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _compared(percent: int):
    """Sets sorted by group, (grp, uid, elements), to the links inside each group."""

    def links(ids, own):
        n = len(ids)
        for i in range(n):
            for j in range(i + 1, n):
                x, y = own[i], own[j]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        yield ids[i], ids[j]

    def run(batches):
        group, ids, own, out = None, [], [], []
        for batch in batches:
            for g, u, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True):
                if g != group:
                    out += links(ids, own)
                    group, ids, own = g, [], []
                ids.append(u)
                own.append(e.copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["src", "dst"])
                out = []
            release()
        out += links(ids, own)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["src", "dst"])

    return run


def _differences(batches):
    """(grp, uid, elements, centre) to (grp, uid, n, e, diff)."""
    for batch in batches:
        own, centre = _lists(batch.column(2)), _lists(batch.column(3))
        diff = [np.setxor1d(x, c, assume_unique=True) for x, c in zip(own, centre, strict=True)]
        size = list(map(len, diff))
        flat = np.concatenate(diff) if diff else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(list(map(len, own)), pa.int64()), pa.array(size, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat, pa.int64())),
            ],
            names=["grp", "uid", "n", "e", "diff"],
        )


def opened_groups(shared: DataFrame, need: DataFrame) -> DataFrame:
    """(grp, uid): the groups that each set must be looked for in, its own among them.

    shared(token, uid, leader): the tokens that at least two sets have.
    """
    counts = shared.groupBy("uid", "leader").agg(F.count("*").alias("c"))
    most = counts.groupBy("uid").agg(F.max_by(F.struct("leader", "c"), F.struct("c", -F.col("leader"))).alias("m"))
    # a leader that may link with its own leader hands its group on: a family of texts is one group
    like = F.col("m.c") >= F.col("need")
    home = materialize(most.join(need, "uid").select("uid", F.col("m.leader").alias("grp"), F.when(like, F.col("m.leader")).otherwise(F.col("uid")).alias("up")))
    for _ in range(4):
        up = home.select(F.col("uid").alias("at"), F.col("up").alias("further"))
        home = materialize(
            home.join(up, home.grp == up.at, "left")
            .select("uid", F.coalesce("further", "grp").alias("grp"), "up")
            .join(up.withColumnRenamed("further", "twice"), F.col("up") == up.at, "left")
            .select("uid", "grp", F.coalesce("twice", "up").alias("up"))
        )
    home = home.select("uid", "grp")
    matrix = materialize(shared.select("token", "uid").join(home, "uid").select("token", "grp").distinct())
    overlap = shared.select("token", "uid").join(matrix, "token").groupBy("uid", "grp").agg(F.count("*").alias("c"))
    return overlap.join(need, "uid").where("c >= need").select("grp", "uid")


def _centres(batches):
    """Voters (grp, elements), sorted by grp, to (grp, centre): what most of a group's voters have.

    Voters beyond BLOCK elements are not heard, which bounds what a task holds.
    """
    group, held, size = None, [], 0

    def closed():
        if not held:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], names=["grp", "centre"])
        flat, n = np.unique(np.concatenate(held), return_counts=True)
        own = flat[2 * n > len(held)]
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own, pa.int64()))], names=["grp", "centre"])

    for batch in batches:
        for g, e in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), strict=True):
            if g != group:
                yield closed()
                group, held, size = g, [], 0
            if not held or size + len(e) <= BLOCK:
                held.append(e.copy())
                size += len(e)
        release()
    yield closed()


def _large_links(part: DataFrame, elements: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The links that make up the components of groups with over SMALL sets."""
    own = narrow(elements, part, "uid")
    # the centre is only an origin to measure from, any will do: about SMALL sets of each group vote for it
    voters = materialize(part.join(sizes, "grp").where(F.pmod(F.xxhash64("uid", F.lit(1)), F.ceil(F.col("sets") / SMALL)) == 0).select("grp", "uid"))
    voting = narrow(elements, voters, "uid").select("grp", "elements").repartition("grp").sortWithinPartitions("grp")
    centre = materialize(voting.mapInArrow(_centres, "grp long, centre array<long>"))
    few = (centre.agg(F.sum(8 * F.size("centre") + 64).alias("b")).first()["b"] or 0) <= MOST_CENTRES
    with_centre = own.join(F.broadcast(centre) if few else centre, "grp", "left").select("grp", "uid", "elements", F.coalesce("centre", F.array().cast("array<long>")).alias("centre"))
    diffs = materialize(
        with_centre.mapInArrow(_differences, "grp long, uid long, n long, e long, diff array<long>")
        .withColumn("slack", (100 - percent) * F.col("n") - (100 + percent) * F.col("e"))
    )
    best = materialize(diffs.groupBy("grp").agg(F.max_by(F.struct("uid", "slack"), F.struct("slack", "uid")).alias("b")).select("grp", F.col("b.uid").alias("mid"), F.col("b.slack").alias("spare")))
    few = best.count() <= MOST_KEYS
    near = diffs.join(F.broadcast(best) if few else best, "grp")
    star = near.where("slack + spare >= 0 AND uid <> mid").select(F.col("uid").alias("src"), F.col("mid").alias("dst"))
    # sets beyond the middle one's reach can link only with sets whose differences overlap enough; sets are
    # dealt into blocks by the size of their difference, and only blocks that can hold such pairs meet
    lined = near.withColumn("far", F.col("slack") + F.col("spare") < 0)
    # sizes that follow each other share a block until it is full, a size too frequent is dealt over several
    heavy = F.col("many") * (F.col("e") + 16)
    whole = W.partitionBy("grp", "far")
    full = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sum(heavy).over(whole) / F.when(F.col("far"), FAR_PARTS).otherwise(NEAR_PARTS))))
    side = ["grp", "far", "e"]
    chunks = materialize(
        lined.groupBy(*side).agg(F.count("*").alias("many"))
        .select(*side, F.floor((F.sum(heavy).over(whole.orderBy("e")) - heavy) / full).cast("int").alias("e_at"), F.ceil(heavy / full).cast("int").alias("chunks"))
    )
    few = chunks.count() <= MOST_KEYS
    dealt = materialize(
        lined.join(F.broadcast(chunks) if few else chunks, side)
        .select("grp", "far", "e_at", F.pmod(F.xxhash64("uid"), F.col("chunks")).alias("chunk"), "uid", "n", "e", "slack", "diff")
    )
    block = ["grp", "far", "e_at", "chunk"]
    table = materialize(dealt.groupBy(*block).agg(F.max("e").alias("e"), F.max("slack").alias("slack")))
    one = table.where("far").select("grp", F.struct("e_at", "chunk").alias("a"), F.col("e").alias("ea"), F.col("slack").alias("sa"))
    two = table.select("grp", F.col("far").alias("far_b"), F.struct("e_at", "chunk").alias("b"), F.col("e").alias("eb"), F.col("slack").alias("sb"))
    able = lambda s, t, e, f: -(F.col(s) + F.col(t)) <= 2 * (100 + percent) * F.least(e, f)
    met = materialize(one.join(two, "grp").where(able("sa", "sb", "ea", "eb") & (~F.col("far_b") | (F.col("a") >= F.col("b")))).withColumn("meet", F.monotonically_increasing_id()))
    # a set goes to a meeting only if it can link with some set of the other block; a block that meets itself goes there once
    itself = F.col("far_b") & (F.col("a") == F.col("b"))
    to = lambda at, far, side, e, slack: [F.col("grp").alias("g"), far.alias("f"), F.col(f"{at}.e_at").alias("k"), F.col(f"{at}.chunk").alias("c"), "meet", side.alias("side"), F.col(e).alias("oe"), F.col(slack).alias("os")]
    calls = met.select(*to("b", F.col("far_b"), F.when(itself, 2).otherwise(0), "ea", "sa")).union(met.where(~itself).select(*to("a", F.lit(True), F.lit(1), "eb", "sb")))
    same = (F.col("grp") == F.col("g")) & (F.col("far") == F.col("f")) & (F.col("e_at") == F.col("k")) & (F.col("chunk") == F.col("c"))
    few = calls.count() <= MOST_KEYS // 4
    meeting = dealt.join(F.broadcast(calls) if few else calls, same & able("slack", "os", "e", "oe")).select("meet", "side", "uid", "n", "e", "diff")
    found = meeting.repartition("meet").sortWithinPartitions("meet", "side").mapInArrow(_met(percent), "src long, dst long")
    return star.union(found)


def _met(percent: int):
    """Sets sorted by (meet, side): links of each set of side 1 with those of side 0, by inverted lists; sets of side 2 are on both sides."""

    def indexed(held):
        flat = np.concatenate([d for *_, d in held])
        e = np.array([x[2] for x in held])
        owner = np.repeat(np.arange(len(held)), e)
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order], np.array([x[0] for x in held]), np.array([x[1] for x in held]), e

    def links(index, uid, n, e, diff):
        flat, owner, uids, sizes, es = index
        low, high = np.searchsorted(flat, diff), np.searchsorted(flat, diff, side="right")
        shared = np.bincount(gather(owner, low, high - low), minlength=len(uids))
        hit = uids[((e + es - 2 * shared) * (100 + percent) <= (n + sizes) * (100 - percent)) & (uids != uid)]
        # sets of one block that link with it are joined to it
        return np.concatenate((np.full(len(hit[:1]), uid), hit[:-1])), hit

    def run(batches):
        meet, held, index, both = None, [], None, False

        def closed():
            if both:
                at = indexed(held)
                for x in held:
                    yield links(at, *x)

        for batch in batches:
            out = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(5)), _lists(batch.column(5)), strict=True)
            for g, side, uid, n, e, diff in rows:
                if g != meet:
                    out += closed()
                    meet, held, index, both = g, [], None, side == 2
                if side != 1:
                    held.append((uid, n, e, diff.copy()))
                elif held:
                    index = index or indexed(held)
                    out.append(links(index, uid, n, e, diff))
            yield _edges(out)
            release()
        yield _edges(list(closed()))

    return run


def _edges(found: list) -> pa.RecordBatch:
    src, dst = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def linked_sets(many: DataFrame, elements: DataFrame, percent: int) -> DataFrame | None:
    """Components of the sets in opened groups many(grp, uid, sets): (id, component), or None without links."""
    large = materialize(many.where(F.col("sets") > SMALL).select("grp", "sets").distinct())
    # the groups come to the sets where a count allows it, so that elements move once
    small = narrow(elements, many.where(F.col("sets") <= SMALL).select("grp", "uid"), "uid").select("grp", "uid", "elements")
    edges = small.repartition("grp").sortWithinPartitions("grp").mapInArrow(_compared(percent), "src long, dst long")
    if not large.isEmpty():
        edges = edges.union(_large_links(many.where(F.col("sets") > SMALL).select("grp", "uid"), elements, large, percent))
    edges = materialize(edges)
    return None if edges.isEmpty() else components(edges)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs(doc_id, text): n_shingles, component_id.

    Texts link when 100 * intersection >= percent * union of their sets of
    ``width``-word shingles; component_id is the smallest doc_id that links reach.
    """
    full = materialize(
        docs.select("doc_id", "text", _place())
        .mapInArrow(_indexed(width, percent), "doc_id long, n long, s0 long, s1 long, tokens array<long>, need int, place long")
        .withColumn("uid", F.monotonically_increasing_id())
    )
    rows = materialize(full.drop("tokens"))
    total = rows.count()
    key = ["n", "s0", "s1"]
    same = materialize(rows.where("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("m"), F.count("*").alias("size")).select(*key, "m.doc_id", "m.uid", "size"))
    every = narrow(full.select("uid", "tokens"), same.select("uid"), "uid").select("uid", F.explode("tokens").alias("token"))
    shared = materialize(_repeated(every, total))
    discard(full)  # the tokens that one set alone has are of no more use
    part = materialize(opened_groups(shared, rows.select("uid", "need")))
    sizes = materialize(part.groupBy("grp").agg(F.count("*").alias("sets")).where("sets > 1"))
    part = materialize(part.join(sizes, "grp"))  # a set alone in a group meets nobody there
    wanted = materialize(part.select("uid").distinct().join(rows.select("uid", "place", "s0"), "uid"))
    texts = narrow(docs.select("text", _place()), wanted, "place")
    elements = materialize(texts.select("text", "uid", "s0").mapInArrow(_stored(width), "uid long, elements array<long>"))
    if elements.count() > wanted.count():  # repeated rows bring their set more than once
        elements = materialize(elements.dropDuplicates(["uid"]))
    labels = linked_sets(part, elements, percent)
    if labels is None:
        sized = same.withColumn("component_id", F.col("doc_id"))
    else:
        own = same.join(labels.withColumnRenamed("id", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
        best = materialize(own.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("sets")))
        dealt, spread = salted(own, best, ["component"], "sets", hot_limit(total))
        sized = dealt.join(spread.drop("sets"), ["component", "_salt"]).drop("_salt")
    sized = materialize(sized.select(*key, "size", "component_id"))
    dealt, spread = salted(rows.where("n > 0").select("doc_id", *key), sized, key, "size", hot_limit(total))
    linked = dealt.join(spread, [*key, "_salt"]).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def _repeated(every: DataFrame, total: int) -> DataFrame:
    """The (token, uid) rows whose token at least two sets have, and the token's smallest set."""
    same = W.partitionBy("token")
    window = lambda rows: rows.select("token", "uid", F.count("*").over(same).alias("c"), F.min("uid").over(same).alias("leader")).where("c > 1").select("token", "uid", "leader")
    hot = frequent(every, "token", "uid", total)
    if hot is None:
        return window(every)
    small = hot.count() <= MOST_KEYS
    marked = every.join(F.broadcast(hot) if small else hot, "token", "left")
    common = marked.where("hot").select("token", "uid")
    led = materialize(common.groupBy("token").agg(F.count("*").alias("c"), F.min("uid").alias("leader")).where("c > 1").select("token", "leader"))
    return window(marked.where("hot IS NULL")).union(common.join(F.broadcast(led) if small else led, "token").select("token", "uid", "leader"))


def _place():
    """Finds a row again without an order of rows."""
    return F.xxhash64("doc_id", "text").alias("place")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
