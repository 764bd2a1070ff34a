"""Graph algorithms against plain Python on small random graphs, several components and empty ones included."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph


def made(seed):
    r = random.Random(seed)
    return sorted({(r.randrange(14), r.randrange(14)) for _ in range(r.choice([6, 16]))})


@pytest.fixture(params=[1, 2])
def pairs(request):
    return made(request.param)


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, attr double")


def reach(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def nodes(pairs):
    return sorted({x for p in pairs for x in p})


def test_components(spark, pairs):
    both = pairs + [(b, a) for a, b in pairs]
    assert dict(map(tuple, graph.connected_components(frame(spark, pairs)).collect())) == {x: min(reach(both, x)) for x in nodes(pairs)}


def test_strong_components(spark, pairs):
    far = {x: reach(pairs, x) for x in nodes(pairs)}
    assert dict(map(tuple, graph.strongly_connected(frame(spark, pairs)).collect())) == {x: max(y for y in far[x] if x in far[y]) for x in far}


def test_page_rank(spark, pairs):
    v, out = nodes(pairs), Counter(a for a, _ in pairs)
    rank = {x: 1 / len(v) for x in v}
    for _ in range(4):
        rank = {x: 0.15 / len(v) + 0.85 * sum(rank[a] / out[a] for a, b in pairs if b == x) for x in v}
    got = dict(map(tuple, graph.page_rank(frame(spark, pairs), rounds=4).collect()))
    assert got == pytest.approx(rank)


def test_triangles(spark, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = Counter(x for t in combinations(sorted(near), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]] for x in t)
    assert dict(map(tuple, graph.triangles(frame(spark, pairs)).collect())) == dict(want)


def test_label_propagation(spark, pairs):
    label = {x: x for x in nodes(pairs)}
    near = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    for _ in range(2):
        votes = {x: Counter(label[y] for y in near[x]) for x in label}
        label = {x: min(v, key=lambda k: (-v[k], k)) for x, v in votes.items()}
    assert dict(map(tuple, graph.label_propagation(frame(spark, pairs), rounds=2).collect())) == label


def weighted(spark, pairs, seed):
    r = random.Random(seed)
    v = {x: r.randint(-50, 50) for x in nodes(pairs)}
    e = [(a, b, r.randint(1, 9)) for a, b in pairs for _ in range(r.choice([1, 1, 2]))]
    return v, e, spark.createDataFrame(list(v.items()), "id long, w long"), spark.createDataFrame(e, "src long, dst long, attr long")


def test_triplets_and_messages(spark, pairs):
    v, e, vs, es = weighted(spark, pairs, 3)
    got = graph.map_triplets(vs, es, F.col("attr") * F.col("src_w") - F.col("dst_w"))
    assert Counter(map(tuple, got.collect())) == Counter((a, b, w * v[a] - v[b]) for a, b, w in e)
    told = defaultdict(list)
    for a, b, w in e:
        told[b].append(v[a])
        if w > 4:  # null sends nothing
            told[a].append(w)
    got = graph.aggregate_messages(vs, es, to_dst=F.col("src_w"), to_src=F.when(F.col("attr") > 4, F.col("attr")), merge=F.max)
    assert dict(map(tuple, got.collect())) == {k: max(x) for k, x in told.items()}


def test_edges_found_and_turned(spark, pairs):
    v, e, vs, es = weighted(spark, pairs, 4)
    assert Counter(map(tuple, graph.reverse(es).collect())) == Counter((b, a, w) for a, b, w in e)
    a, b, _ = e[0]
    assert graph.find(es, a, b).count() == sum(x[:2] == (a, b) for x in e) and graph.find(es, -1, b).isEmpty()
    new = graph.join_vertices(vs, spark.createDataFrame([(e[0][0], 99), (-5, 1)], "id long, x long"), "w", "x")
    assert dict(map(tuple, new.select("id", "w").collect())) == v | {e[0][0]: 99}


def test_vertices_of_a_graph_from_parts(spark, pairs):
    some = spark.createDataFrame([(pairs[0][0], 5), (pairs[0][0], 5), (1000, 6)], "id long, attr long")
    v, _ = graph.from_parts(some, frame(spark, pairs), -1)
    assert dict(map(tuple, v.collect())) == {x: -1 for x in nodes(pairs)} | {pairs[0][0]: 5, 1000: 6} and v.count() == len(nodes(pairs)) + 1


def test_rounds_that_do_not_end_are_an_error(spark):
    v, e = spark.createDataFrame([(0, 0), (1, 0)], "id long, n long"), spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, attr double")
    send = lambda t: t.select(F.col("dst").alias("id"), (F.col("src_n") + 1).alias("msg"))
    with pytest.raises(RuntimeError):
        graph.pregel_until_quiet(v, e, send, F.max, lambda x: x.withColumn("n", F.col("msg")), most_rounds=3)
    with pytest.raises(RuntimeError):
        graph.page_rank(spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "src long, dst long"), rounds=2, tolerance=1e-12)


def test_personal_ranks_start_and_stay_near_their_sources(spark, pairs):
    v, out = nodes(pairs), Counter(a for a, _ in pairs)
    home = {x: float(x == v[0]) for x in v}
    rank = dict(home)
    for _ in range(7):
        rank = {x: 0.15 * home[x] + 0.85 * sum(rank[a] / out[a] for a, b in pairs if b == x) for x in v}
    assert dict(map(tuple, graph.page_rank(frame(spark, pairs), rounds=7, sources=[v[0]]).collect())) == pytest.approx(rank)


def test_pregel_runs_until_quiet(spark):
    v = spark.createDataFrame([(i, i) for i in range(4)], "id long, low long")
    e = spark.createDataFrame([(i, i + 1, 1) for i in range(3)], "src long, dst long, attr int")
    send = lambda t: t.where("src_low < dst_low").select(F.col("dst").alias("id"), F.col("src_low").alias("msg"))
    out = graph.pregel_until_quiet(v, e, send, F.min, lambda x: x.withColumn("low", F.least("low", F.coalesce("msg", "low"))))
    assert {r["low"] for r in out.collect()} == {0}


@pytest.mark.parametrize("hubs", [1, 60, 500_000])
def test_triangles_with_and_without_hubs(spark, monkeypatch, hubs):
    monkeypatch.setattr(graph, "HUBS", hubs)
    r = random.Random(5)
    pairs = sorted({(r.randrange(5) if r.random() < 0.5 else r.randrange(40), r.randrange(40)) for _ in range(160)})
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = Counter(x for t in combinations(sorted(near), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]] for x in t)
    assert want and dict(map(tuple, graph.triangles(frame(spark, pairs)).collect())) == dict(want)


ROUNDS = {
    "components": (graph.connected_components, lambda p: {x: min(reach(p + [(b, a) for a, b in p], x)) for x in nodes(p)}),
    "labels": (lambda e: graph.label_propagation(e, 0), lambda p: {x: x for x in nodes(p)}),
    "paths": (lambda e: graph.shortest_paths(e, [0]), lambda p: {x: float(x) for x in range(7)}),
    "strong": (graph.strongly_connected, lambda p: {x: 6 if 4 <= x <= 6 else x for x in nodes(p)}),
}


@pytest.mark.parametrize("name", sorted(ROUNDS))
def test_rounds_do_not_compute_the_edges_again(spark, monkeypatch, name):
    """Parts of four rows: hubs and large components go over many; a chain, a cycle and a star need rounds."""
    monkeypatch.setattr(graph, "ROWS", 4)
    pairs = [(i, i + 1) for i in range(6)] + [(6, 4)] + [(20, i) for i in range(21, 29)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x

    run, want = ROUNDS[name]
    edges = frame(spark, pairs).withColumn("src", counted.asNondeterministic()("src"))
    assert dict(tuple(r)[:: len(r) - 1] for r in run(edges).collect()) == want(pairs)
    assert read.value <= 2 * len(pairs)


def test_parts_grow_with_the_sources(spark, monkeypatch):
    monkeypatch.setattr(graph, "SOURCE_BYTES", 1)
    wide = graph._written(spark.range(1, 40).groupBy((F.col("id") % 20).alias("k")).count())
    assert wide.count() == 20 and wide.rdd.getNumPartitions() > 100 and spark.conf.get("spark.sql.shuffle.partitions") == "8"
