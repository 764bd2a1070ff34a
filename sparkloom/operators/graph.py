"""Graphs as two tables: vertices (id, ...) and edges (src, dst, attr).

Iterations cut their lineage with checkpoint() into the session's shared
folder, so a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut
from sparkloom.sources.session import settings


_cut = cut


#: Rows that a partition of what algorithms go through in each round holds, hubs aside.
ROWS = 1 << 20


#: Bytes of its sources for each part that a shuffle below what is written has.
SOURCE_BYTES = 8 << 20


def _written(df: DataFrame) -> DataFrame:
    """df cut, its shuffles in parts that grow in number with the sources; left alone they would be as many as cores."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(x >= 1 << 50 for x in sizes):  # not known
        return _cut(df)
    n = max(spark.sparkContext.defaultParallelism, sum(sizes) // SOURCE_BYTES)
    with settings(spark, spark__sql__shuffle__partitions=str(n), spark__sql__adaptive__coalescePartitions__enabled="false"):
        return _cut(df)


def _dealt(df: DataFrame, key: str, both_ways: bool = False) -> tuple[DataFrame, int]:
    """df by key, in order and in parts of about ROWS rows, and their number: joins on the key shuffle and sort only the other side."""
    df = _written(df)
    df = df.union(reverse(df).select(df.columns)) if both_ways else df
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return _cut(df.repartition(n, key).sortWithinPartitions(key)), n


def from_edges(e: DataFrame, default=None) -> tuple[DataFrame, DataFrame]:
    """A graph from its edges; every vertex gets the default attribute."""
    return vertices_of(e).withColumn("attr", F.lit(default)), e


def from_pairs(pairs: DataFrame, default=None) -> tuple[DataFrame, DataFrame]:
    """A graph from (src, dst): edges have the attribute 1."""
    return from_edges(pairs.select("src", "dst", F.lit(1.0).alias("attr")), default)


def from_parts(v: DataFrame, e: DataFrame, default=None) -> tuple[DataFrame, DataFrame]:
    """A graph from both: ends of edges without a vertex get the default attribute, of repeated vertices one stays."""
    ends = vertices_of(e).join(v.select("id"), "id", "left_anti")
    return v.dropDuplicates(["id"]).unionByName(ends.withColumn("attr", F.lit(default).cast(dict(v.dtypes)["attr"]))), e


def counts(v: DataFrame, e: DataFrame) -> DataFrame:
    """(vertices, edges) as one row."""
    return v.agg(F.count("*").alias("vertices")).crossJoin(F.broadcast(e.agg(F.count("*").alias("edges"))))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def triplets(v: DataFrame, e: DataFrame) -> DataFrame:
    """Edges with both ends' attributes; dangling edges vanish."""
    own = [c for c in v.columns if c != "id"]
    src = v.select(F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in own])
    dst = v.select(F.col("id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in own])
    return e.join(src, "src").join(dst, "dst")


def degrees(e: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of all vertices with an edge, in one pass."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return e.select(ends.alias("x")).groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def group_edges(e: DataFrame, how: str = "sum") -> DataFrame:
    return e.groupBy("src", "dst").agg(getattr(F, how)("attr").alias("attr"))


def subgraph(v: DataFrame, e: DataFrame, vertex=None, edge=None) -> tuple[DataFrame, DataFrame]:
    v = v.where(vertex) if vertex is not None else v
    e = e.where(edge) if edge is not None else e
    ids = v.select("id")
    return v, e.join(ids, e.src == ids.id, "left_semi").join(ids, e.dst == ids.id, "left_semi")


def neighbors(e: DataFrame, way: str = "either") -> DataFrame:
    """(id, ids): sorted, duplicates kept, isolated vertices absent."""
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("n"))
    back = e.select(F.col("dst").alias("id"), F.col("src").alias("n"))
    pairs = {"out": out, "in": back, "either": out.union(back)}[way]
    return pairs.groupBy("id").agg(F.sort_array(F.collect_list("n")).alias("ids"))


def reverse(e: DataFrame) -> DataFrame:
    swapped = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return e.select(*[swapped.get(c, F.col(c)) for c in e.columns])


def map_vertices(v: DataFrame, name: str, value) -> DataFrame:
    return v.withColumn(name, value)


def map_edges(e: DataFrame, value) -> DataFrame:
    return e.withColumn("attr", value)


def map_triplets(v: DataFrame, e: DataFrame, value) -> DataFrame:
    """New edge attributes from an expression over attr, src_* and dst_*."""
    return triplets(v, e).select("src", "dst", value.alias("attr"))


def aggregate_messages(v: DataFrame, e: DataFrame, to_dst=None, to_src=None, merge=F.sum) -> DataFrame:
    """(id, msg): expressions over a triplet sent to either end, merged by an aggregate; null sends nothing."""
    sends = [F.struct(F.col(end).alias("id"), x.alias("msg")) for end, x in (("dst", to_dst), ("src", to_src)) if x is not None]
    sent = triplets(v, e).select(F.explode(F.array(*sends)).alias("m")).where("m.msg IS NOT NULL")
    return sent.groupBy("m.id").agg(merge("m.msg").alias("msg"))


def join_vertices(v: DataFrame, other: DataFrame, name: str, value: str) -> DataFrame:
    """Replaces the attribute of vertices that other(id, value) has; the rest keep theirs."""
    o = other.select("id", F.col(value).alias("_new"))
    return v.join(o, "id", "left").withColumn(name, F.coalesce("_new", name)).drop("_new")


def outer_join_vertices(v: DataFrame, other: DataFrame, name: str, value) -> DataFrame:
    """A new attribute from an expression over v's columns and other's, which are null for vertices that other(id, ...) lacks."""
    return v.join(other, "id", "left").select(*v.columns, value.alias(name))


def mask(v: DataFrame, e: DataFrame, other_v: DataFrame, other_e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the other graph has too; parallel edges are kept as they are."""
    return v.join(other_v.select("id"), "id", "left_semi"), e.join(other_e.select("src", "dst"), ["src", "dst"], "left_semi")


def find(e: DataFrame, src, dst) -> DataFrame:
    return e.where((F.col("src") == src) & (F.col("dst") == dst))


def pick_random_vertex(v: DataFrame, seed: int = 0) -> DataFrame:
    return v.orderBy(F.rand(seed)).limit(1)


def pregel_until_quiet(v: DataFrame, e: DataFrame, send, merge, program, most_rounds: int = 100) -> DataFrame:
    """Like pregel, until a round sends no message; that most_rounds don't get there is an error."""
    for _ in range(most_rounds):
        got = _cut(send(triplets(v, e)).groupBy("id").agg(merge(F.col("msg")).alias("msg")))
        if got.isEmpty():
            return v
        v = _cut(program(v.join(got, "id", "left")).drop("msg"))
    raise RuntimeError(f"messages are still sent after {most_rounds} rounds")


def pregel(v: DataFrame, e: DataFrame, send, merge, program, rounds: int) -> DataFrame:
    """Rounds of: send(triplets) -> (id, msg); merge: an aggregate of msg; program(state column set, msg)."""
    for _ in range(rounds):
        got = send(triplets(v, e)).groupBy("id").agg(merge(F.col("msg")).alias("msg"))
        v = _cut(program(v.join(got, "id", "left")).drop("msg"))
    return v


#: Rounds of page_rank after which the lineage is cut.
CUT_EVERY = 5


def page_rank(e: DataFrame, rounds: int = 10, reset: float = 0.15, tolerance: float | None = None, sources: list | None = None) -> DataFrame:
    """(id, rank): reset / n plus what in-neighbours hand on; dangling mass is lost.

    With a tolerance it goes on until no rank moves by more; that ``rounds``
    don't get there is an error.  Links stay partitioned by their source, and a
    round's one shuffle leaves ranks where the links are.
    """
    v = _cut(vertices_of(e))
    n = v.count()
    at = F.col("id").isin(sources) if sources is not None else None
    base = v.select("id", (F.lit(reset / max(n, 1)) if at is None else F.when(at, reset / len(sources)).otherwise(0.0)).alias("rank"))
    start = v.select("id", (F.lit(1.0 / max(n, 1)) if at is None else F.when(at, 1.0 / len(sources)).otherwise(0.0)).alias("rank"))
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    links = _cut(e.select("src", "dst").join(deg, "src").repartition("src"))
    rank = start
    for i in range(1, rounds + 1):
        handed = links.join(rank.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), ((1 - reset) * F.col("rank") / F.col("deg")).alias("rank"))
        new = base.union(handed).groupBy("id").agg(F.sum("rank").alias("rank"))
        if tolerance is not None:
            new = _cut(new)
            moved = new.join(rank.withColumnRenamed("rank", "was"), "id").agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0]
            if (moved or 0.0) < tolerance:
                return new
        elif i % CUT_EVERY == 0 and i < rounds:
            new = _cut(new)
        rank = new
    if tolerance is not None:
        raise RuntimeError(f"ranks still move by more than {tolerance} after {rounds} rounds")
    return rank


def connected_components(e: DataFrame) -> DataFrame:
    """(id, component): the smallest id an undirected path reaches; label plus pointer jumping."""
    both, n = _dealt(e.select("src", "dst"), "dst", both_ways=True)
    label = _cut(both.select(F.col("dst").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(label, both.dst == label.id).groupBy("src").agg(F.min("component").alias("m"))
        step = _cut(label.join(near, label.id == near.src, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old")))
        far = step.select(F.col("id").alias("at"), F.col("component").alias("far"))
        # most vertices may have one component: those of more than ROWS are broadcast, not gathered in one task
        large = step.groupBy("component").count().where(F.col("count") > ROWS)
        large = F.broadcast(large.join(far, large.component == far.at).select(F.col("component").alias("l"), F.col("far").alias("of")))
        marked = step.join(large, step.component == large.l, "left")
        rest = marked.where("l IS NULL").join(far, F.col("component") == F.col("at"), "left").select("id", "component", "old", "far")
        jumped = rest.union(marked.where("l IS NOT NULL").select("id", "component", "old", "of"))
        new = _cut(jumped.select("id", F.least("component", F.coalesce("far", "component")).alias("component"), "old").repartition(n, "id"))
        label = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return label


def strongly_connected(e: DataFrame) -> DataFrame:
    """(id, component): the largest id of the strongly connected component, by colouring."""
    left, done = _written(e.select("src", "dst").distinct()), None
    alive = _cut(vertices_of(left))
    while not alive.isEmpty():
        # vertices that nothing enters or leaves are components of their own: no colour need travel for them
        core = alive.join(left.select(F.col("src").alias("id")), "id", "left_semi").join(left.select(F.col("dst").alias("id")), "id", "left_semi")
        alone = _cut(alive.join(core, "id", "left_anti").select("id", F.col("id").alias("component")))
        if not alone.isEmpty():
            done = alone if done is None else _cut(done.union(alone))
            alive = _cut(core)
            left = _cut(left.join(alive, left.src == alive.id, "left_semi").join(alive, left.dst == alive.id, "left_semi"))
            continue
        ahead, n = _dealt(left, "src")
        colour = _cut(alive.repartition(n, "id").withColumn("c", F.col("id")))
        while True:  # the largest id that reaches a vertex
            got = ahead.join(colour, ahead.src == colour.id).groupBy("dst").agg(F.max("c").alias("m"))
            new = _cut(colour.join(got, colour.id == got.dst, "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")))
            colour = new.select("id", "c")
            if new.where("c <> old").isEmpty():
                break
        found = front = _cut(colour.where("id = c"))
        inside = ahead.join(colour.withColumnsRenamed({"id": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"id": "dst", "c": "cd"}), "dst").where("cs = cd")
        behind, _ = _dealt(inside.select("src", "dst"), "dst")
        while True:  # who reaches the colour's root backwards within the colour
            front = _cut(behind.join(front, behind.dst == front.id).select(F.col("src").alias("id"), "c").distinct().join(found, ["id"], "left_anti"))
            if front.isEmpty():
                break
            found = _cut(found.union(front))
        part = found.select("id", F.col("c").alias("component"))
        done = part if done is None else _cut(done.union(part))
        alive = _cut(alive.join(part, "id", "left_anti"))
        left = _cut(left.join(alive, left.src == alive.id, "left_semi").join(alive, left.dst == alive.id, "left_semi"))
    return done if done is not None else alive.withColumn("component", F.col("id"))


def label_propagation(e: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): the commonest label of the neighbours, the smallest on ties."""
    both, n = _dealt(e.select("src", "dst"), "dst", both_ways=True)
    label = _cut(both.select(F.col("dst").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        told = both.join(label, both.dst == label.id).select("src", "label").repartition(n, "src")
        best = told.groupBy("src", "label").agg(F.count("*").alias("n")).groupBy("src").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("new"))
        label = _cut(label.join(best, label.id == best.src, "left").select("id", F.coalesce("new", "label").alias("label")))
    return label


def shortest_paths(e: DataFrame, landmarks: list) -> DataFrame:
    """(id, landmark, distance) along edges from the landmarks, weighted by attr; unreachable ones absent."""
    e, _ = _dealt(e.select("src", "dst", "attr"), "src")
    dist = _cut(vertices_of(e.where(F.col("src").isin(landmarks) | F.col("dst").isin(landmarks))).where(F.col("id").isin(landmarks)).select("id", F.col("id").alias("landmark"), F.lit(0.0).alias("distance")))
    front = dist
    while not front.isEmpty():
        step = front.join(e, front.id == e.src).groupBy(F.col("dst").alias("id"), "landmark").agg(F.min(F.col("distance") + F.col("attr")).alias("new"))
        both = _cut(dist.join(step, ["id", "landmark"], "full"))
        front = both.where("new IS NOT NULL AND (distance IS NULL OR new < distance)").select("id", "landmark", F.col("new").alias("distance"))
        dist = both.select("id", "landmark", F.least("distance", "new").alias("distance"))
    return dist


#: Vertices whose degrees triangles() broadcasts, at most.
HUBS = 500_000


def triangles(e: DataFrame) -> DataFrame:
    """(id, triangles) over undirected simple edges; edges point to hubs, the larger degree last, so hubs stay cheap.

    Hubs are as few as can be broadcast; other vertices go by their ids before
    them.  A vertex holds the list of those it points to.  To each of them goes what
    follows it in the list, and what its own list has too closes a triangle.
    """
    pairs = _written(e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    deg = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    hubs = _cut(deg.where(F.col("d") > 2 * pairs.count() / HUBS))
    rank = lambda end: F.broadcast(hubs.select(F.col("id").alias(end), F.col("d").alias(f"d{end}")))
    a, b = (F.struct(F.coalesce(f"d{end}", F.lit(0)).alias("d"), F.col(end).alias("id")) for end in "ab")
    both = pairs.join(rank("a"), "a", "left").join(rank("b"), "b", "left").select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    lists = _cut(both.groupBy("x.id").agg(F.sort_array(F.collect_list("y")).alias("n")).select("id", F.col("n.id").alias("n")))
    sent = lists.where(F.size("n") > 1).select(F.col("id").alias("x"), "n", F.posexplode("n").alias("i", "y")).where(F.col("i") < F.size("n") - 1)
    sent = sent.select("x", "y", F.slice("n", F.col("i") + 2, F.size("n")).alias("rest"))
    closed = sent.join(lists, sent.y == lists.id).select("x", "y", F.array_intersect("rest", "n").alias("zs")).where(F.size("zs") > 0)
    n = F.size("zs").cast("long").alias("n")
    each = F.concat(F.array(F.struct(F.col("x").alias("id"), n), F.struct(F.col("y").alias("id"), n)), F.transform("zs", lambda z: F.struct(z.alias("id"), F.lit(1).cast("long").alias("n"))))
    return closed.select(F.explode(each).alias("t")).groupBy("t.id").agg(F.sum("t.n").alias("triangles"))
