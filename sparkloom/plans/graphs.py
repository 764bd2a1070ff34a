"""Graph operators over the graph of customers, suppliers and nations; Catalyst and SQL agree on every one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.plans.registry import query
from sparkloom.sources.tables import load

SUPPLIERS, NATIONS = 10**12, 2 * 10**12

# Suppliers to nations and nations to regions: a small forest with attributes.
TREE = """v AS (SELECT 1000000000000 + s_suppkey AS id, s_acctbal AS w FROM supplier UNION ALL SELECT 2000000000000 + n_nationkey, 100.0 + n_nationkey FROM nation UNION ALL SELECT r_regionkey, 7.0 FROM region),
 e AS (SELECT 1000000000000 + s_suppkey AS src, 2000000000000 + s_nationkey AS dst, cast(s_suppkey % 9 AS DOUBLE) AS attr FROM supplier UNION ALL SELECT 2000000000000 + n_nationkey, cast(n_regionkey AS BIGINT), 1.5 FROM nation)"""


def _tree(spark, d) -> tuple[DataFrame, DataFrame]:
    s, n, r = load(spark, d, "supplier", "nation", "region")
    sid, nid = F.col("s_suppkey") + SUPPLIERS, (F.col("n_nationkey") + NATIONS).cast("long")
    v = s.select(sid.alias("id"), F.col("s_acctbal").alias("w")).union(n.select(nid, F.lit(100.0) + F.col("n_nationkey"))).union(r.select(F.col("r_regionkey").cast("long"), F.lit(7.0)))
    e = s.select(sid.alias("src"), (F.col("s_nationkey") + NATIONS).cast("long").alias("dst"), (F.col("s_suppkey") % 9).cast("double").alias("attr"))
    return v, e.union(n.select(nid, F.col("n_regionkey").cast("long"), F.lit(1.5)))


# Who buys from whom: parallel edges, one per line.
BOUGHT = "b AS (SELECT o_custkey AS src, 1000000000000 + l_suppkey AS dst, l_quantity AS attr FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _bought(spark, d) -> DataFrame:
    o, li = load(spark, d, "orders", "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst"), F.col("l_quantity").alias("attr"))


@query(f"WITH {TREE} SELECT id, 0.5::DOUBLE AS attr FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)")
def graph_from_edges(spark, d):
    return graph.from_edges(_tree(spark, d)[1], 0.5)[0]


@query(f"WITH {TREE} SELECT DISTINCT src, dst, 1.0::DOUBLE AS attr FROM e")
def graph_from_pairs(spark, d):
    return graph.from_pairs(_tree(spark, d)[1].select("src", "dst"), 0.0)[1]


@query(f"WITH {TREE} SELECT id, CASE WHEN id >= 2000000000000 THEN w ELSE -1.0 END AS attr FROM v WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)")
def graph_from_parts(spark, d):
    """Only nations come with an attribute, and each of them twice."""
    v, e = _tree(spark, d)
    some = v.where(F.col("id") >= NATIONS).withColumnRenamed("w", "attr")
    return graph.from_parts(some.union(some), e, -1.0)[0]


@query(f"WITH {TREE} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges")
def graph_counts(spark, d):
    return graph.counts(*_tree(spark, d))


@query(f"WITH {TREE} SELECT src, dst, attr FROM e WHERE src = 2000000000003 AND dst = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
def graph_found_edge(spark, d):
    v, e = _tree(spark, d)
    region = load(spark, d, "nation").where("n_nationkey = 3").first()["n_regionkey"]
    return graph.find(e, NATIONS + 3, region)


@query(f"WITH {TREE} SELECT 1 AS n, true AS known FROM (SELECT count(*) AS c FROM v) WHERE c > 0")
def graph_random_vertex(spark, d):
    v, _ = _tree(spark, d)
    return graph.pick_random_vertex(v, 5).join(v.select("id"), "id").agg(F.count("*").cast("int").alias("n"), (F.count("*") == 1).alias("known"))


@query(f"WITH {TREE} SELECT id, w * 2 AS w FROM v")
def graph_mapped_vertices(spark, d):
    return graph.map_vertices(_tree(spark, d)[0], "w", F.col("w") * 2)


@query(f"WITH {TREE} SELECT src, dst, attr + 1 AS attr FROM e")
def graph_mapped_edges(spark, d):
    return graph.map_edges(_tree(spark, d)[1], F.col("attr") + 1)


@query(f"WITH {TREE} SELECT e.src, e.dst, a.w + b.w * e.attr AS attr FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst")
def graph_mapped_triplets(spark, d):
    return graph.map_triplets(*_tree(spark, d), F.col("src_w") + F.col("dst_w") * F.col("attr"))


@query(f"WITH {TREE} SELECT e.src, e.dst, e.attr, a.w AS src_w, b.w AS dst_w FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst")
def graph_triplets(spark, d):
    return graph.triplets(*_tree(spark, d))


@query(f"WITH {TREE}, m AS (SELECT e.dst AS id, a.w AS msg FROM e JOIN v a ON a.id = e.src UNION ALL SELECT e.src, b.w FROM e JOIN v b ON b.id = e.dst) SELECT id, max(msg) AS msg FROM m GROUP BY id")
def graph_messages(spark, d):
    return graph.aggregate_messages(*_tree(spark, d), to_dst=F.col("src_w"), to_src=F.col("dst_w"), merge=F.max)


@query(f"WITH {TREE} SELECT dst AS src, src AS dst, attr FROM e")
def graph_reversed(spark, d):
    return graph.reverse(_tree(spark, d)[1])


@query(f"WITH {BOUGHT} SELECT src, dst, sum(attr) AS attr FROM b GROUP BY src, dst")
def graph_grouped_edges(spark, d):
    return graph.group_edges(_bought(spark, d))


@query(f"WITH {TREE} SELECT v.id, coalesce(n.n, -1)::BIGINT AS degree FROM v LEFT JOIN (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst) n ON n.id = v.id")
def graph_outer_joined(spark, d):
    v, e = _tree(spark, d)
    return graph.outer_join_vertices(v.select("id"), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), "degree", F.coalesce("n", F.lit(-1).cast("long")))


@query(f"WITH {TREE} SELECT v.id, coalesce(x.w, v.w) AS w FROM v LEFT JOIN (SELECT dst AS id, sum(attr) AS w FROM e GROUP BY dst) x ON x.id = v.id")
def graph_joined_vertices(spark, d):
    v, e = _tree(spark, d)
    return graph.join_vertices(v, e.groupBy(F.col("dst").alias("id")).agg(F.sum("attr").alias("x")), "w", "x")


@query(f"WITH {TREE} SELECT src, dst, attr FROM e WHERE src IN (SELECT id FROM v WHERE w > 50) AND dst IN (SELECT id FROM v WHERE w > 50) AND attr < 8")
def graph_subgraph(spark, d):
    return graph.subgraph(*_tree(spark, d), vertex=F.col("w") > 50, edge=F.col("attr") < 8)[1]


@query(f"WITH {TREE} SELECT src, dst, attr FROM e WHERE attr > 2")
def graph_masked(spark, d):
    v, e = _tree(spark, d)
    return graph.mask(v, e, v, e.where("attr > 2"))[1]


@query(f"WITH {TREE}, n AS (SELECT src AS id, dst AS n FROM e UNION ALL SELECT dst, src FROM e) SELECT id, array_to_string(list_sort(list(n)), ',') AS ids FROM n GROUP BY id")
def graph_neighbors(spark, d):
    return graph.neighbors(_tree(spark, d)[1]).select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {TREE}, n AS (SELECT e.dst AS id, e.src AS n, v.w FROM e JOIN v ON v.id = e.src) SELECT id, count(*) AS n, sum(w) AS w FROM n GROUP BY id")
def graph_collected_neighbors(spark, d):
    """The neighbours that point to a vertex, with what they hold."""
    v, e = _tree(spark, d)
    near = graph.neighbors(e, "in").select("id", F.explode("ids").alias("n"))
    return near.join(v.withColumnRenamed("id", "n"), "n").groupBy("id").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query(f"""WITH RECURSIVE {TREE}, r(id, hop) AS (SELECT 1000000000001::BIGINT, 0 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.id)
 SELECT v.id, coalesce(min(hop), 99)::INTEGER AS hops FROM v LEFT JOIN r ON r.id = v.id GROUP BY v.id""")
def graph_pregel(spark, d):
    """Three rounds reach all that a tree of two levels has."""
    v, e = _tree(spark, d)
    start = v.select("id", F.when(F.col("id") == SUPPLIERS + 1, 0).otherwise(99).alias("hops"))
    send = lambda t: t.where("src_hops < 99").select(F.col("dst").alias("id"), (F.col("src_hops") + 1).alias("msg"))
    return graph.pregel(start, e, send, F.min, lambda x: x.withColumn("hops", F.least("hops", F.coalesce("msg", "hops"))), 3)


@query(f"WITH {TREE}, up AS (SELECT a.src AS id, greatest(v.w, n.w, r.w) AS w FROM e a JOIN e b ON b.src = a.dst JOIN v ON v.id = a.src JOIN v n ON n.id = a.dst JOIN v r ON r.id = b.dst) SELECT id, w AS most FROM up")
def graph_pregel_until_quiet(spark, d):
    """What lies on the way up is sent down until nothing changes."""
    v, e = _tree(spark, d)
    send = lambda t: t.where("dst_most > src_most").select(F.col("src").alias("id"), F.col("dst_most").alias("msg"))
    out = graph.pregel_until_quiet(v.withColumnRenamed("w", "most"), e, send, F.max, lambda x: x.withColumn("most", F.greatest("most", F.coalesce("msg", "most"))))
    return out.where((F.col("id") >= SUPPLIERS) & (F.col("id") < NATIONS))


def _ranks(rounds: int, sources: str | None) -> str:
    base = "0.15::DOUBLE / (SELECT count(*) FROM u)" if sources is None else f"CASE WHEN id IN ({sources}) THEN 0.15::DOUBLE / {len(sources.split(','))} ELSE 0 END"
    start = "1.0::DOUBLE / (SELECT count(*) FROM u)" if sources is None else f"CASE WHEN id IN ({sources}) THEN 1.0::DOUBLE / {len(sources.split(','))} ELSE 0 END"
    steps = [f"r0 AS (SELECT id, {start} AS rank FROM u)"]
    for i in range(1, rounds + 1):
        got = f"SELECT e.dst AS id, sum(r.rank / g.n) AS got FROM e JOIN g ON g.src = e.src JOIN r{i - 1} r ON r.id = e.src GROUP BY e.dst"
        steps.append(f"r{i} AS MATERIALIZED (SELECT u.id, {base.replace('id IN', 'u.id IN')} + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM u LEFT JOIN ({got}) s ON s.id = u.id)")
    return f"WITH {TREE}, u AS (SELECT src AS id FROM e UNION SELECT dst FROM e), g AS (SELECT src, count(*) AS n FROM e GROUP BY src), {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_ranks(6, "1000000000001,1000000000002"))
def graph_personal_page_rank(spark, d):
    return graph.page_rank(_tree(spark, d)[1], rounds=6, sources=[SUPPLIERS + 1, SUPPLIERS + 2]).select("id", F.round("rank", 9).alias("rank"))


@query(_ranks(4, None))
def graph_converged_page_rank(spark, d):
    """A tree of two levels has its last ranks after three rounds."""
    return graph.page_rank(_tree(spark, d)[1], rounds=50, tolerance=1e-9).select("id", F.round("rank", 9).alias("rank"))
