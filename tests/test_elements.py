import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import udfs
from sparkloom.operators import elements, frames, keyed
from sparkloom.sources import session, tables


def test_zip_wants_one_length(spark):
    a, b = spark.range(5).toDF("a"), spark.range(10, 15).toDF("b")
    assert sorted(map(tuple, elements.zip_frames(a, b, ["a"], ["b"]).collect())) == [(i, i + 10) for i in range(5)]
    with pytest.raises(ValueError):
        elements.zip_frames(a, spark.range(4).toDF("b"), ["a"], ["b"])


def test_take_sample_is_exact(spark):
    got = elements.take_sample(spark.range(1000), 17, seed=3)
    assert len({r[0] for r in got.collect()}) == 17
    assert elements.take_sample(spark.range(3), 17).count() == 3


def test_numbers_of_rows_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), "id")
    got = keyed.zip_with_index(df, ["k", "id"]).collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["index"])] == sorted(r["k"] for r in got) and {r["index"] for r in got} == set(range(5000))
    assert keyed.zip_with_index(df.limit(0), ["k"]).count() == 0


def test_folds_in_parts(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(300)], "k long, v long")
    got = keyed.fold_by_key(df, "k", "v", F.lit(0).cast("long"), lambda a, x: a + 2 * x, merge=lambda a, b: a + b, salts=5)
    assert dict(map(tuple, got.collect())) == {k: 2 * sum(range(k, 300, 3)) for k in range(3)}


def test_bounds_are_kept(spark):
    df = spark.createDataFrame([(i, i) for i in range(30)], "k long, v long")
    assert keyed.collect_as_map(df, "k", "v") == {i: i for i in range(30)}
    with pytest.raises(ValueError):
        keyed.collect_as_map(df, "k", "v", most=29)
    with pytest.raises(ValueError):
        frames.pivot(df, ["v"], "k", "v", most=29)


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), session.settings(spark, spark__sql__shuffle__partitions="3", my__own="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and spark.conf.get("my.own") == "x"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("my.own", None) is None
    assert session.session() is spark or session.session().sparkContext is spark.sparkContext


def test_a_profile_of_workers():
    from pyspark.resource import ResourceProfile

    made = elements.profile(cores=2, memory="1g")
    assert isinstance(made, ResourceProfile)


def test_batches_and_partitions(spark):
    cut = pa.table({"x": list(range(20))}).to_batches(max_chunksize=6)
    df = tables.partitioned(spark, cut)
    assert sorted(len(r["values"]) for r in elements.glom(df, "x").collect()) == [2, 6, 6, 6]
    assert sorted(x for b in tables.batches(df, 4) for x in b.column(0).to_pylist()) == list(range(20))


def test_glom_and_unique_ids(spark):
    df = spark.range(0, 12, 1, 3)
    assert sorted(sum((r["values"] for r in elements.glom(df, "id").collect()), [])) == list(range(12))
    assert elements.zip_with_unique_id(df).select("uid").distinct().count() == 12


def test_pipe(spark):
    assert {r[0] for r in elements.pipe(spark.createDataFrame([("a",), ("b",)], "s string"), "tr a-z A-Z").collect()} == {"A", "B"}
    with pytest.raises(Exception):
        elements.pipe(spark.range(2), "exit 3").collect()


def test_approximate_counts_are_exact_when_all_is_done(spark):
    assert elements.count_approx(spark.range(1000), 60_000) == 1000
    assert elements.sum_approx(spark.range(10), "id", 60_000) == 45.0
    assert elements.mean_approx(spark.range(10), "id", 60_000) == 4.5


def test_rdd_forms(spark):
    rdd = spark.sparkContext.parallelize([1, 2, 3, 4], 2)
    assert elements.fold(rdd, 10, lambda a, b: a + b) == 40  # 10 twice and once more
    assert elements.aggregate(rdd, 0, lambda a, x: a + x, lambda a, b: a + b) == 10
    pairs = rdd.map(lambda x: (x % 2, x))
    assert elements.reduce_by_key_locally(pairs, lambda a, b: a + b) == {0: 6, 1: 4}
    assert dict(elements.aggregate_by_key(pairs, 0, lambda a, x: a + x, lambda a, b: a + b).collect()) == {0: 6, 1: 4}
    assert keyed.reduce_rdd(spark.sparkContext.emptyRDD(), max) is None


def test_run_job_and_accumulator(spark):
    df = spark.range(0, 8, 1, 4)
    assert elements.run_job(df, lambda rows: [sum(r[0] for r in rows)], [0, 3]) == [1, 13]
    held = elements.accumulator(df, 0, max)
    df.foreach(lambda r: held.add(r[0]))
    assert held.value == 7


def test_subtract_keeps_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,)], "k int")
    assert [r[0] for r in elements.subtract(a, b).collect()] == [1, 1]
    assert elements.intersection(a, b).count() == 3


def test_join_keeps_both_keys(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, n string"), spark.createDataFrame([(1, "y")], "id int, n string")
    assert frames.join(a, b, ["id"], ["id"]).columns == ["id", "n", "id_right", "n_right"]
    assert frames.join(a, b, ["id"], ["id"], "anti").count() == 0


def test_splits_and_strata(spark):
    df = spark.range(1000)
    parts = frames.random_split(df, [1, 2], 5)
    assert sum(p.count() for p in parts) == 1000 and parts[0].intersect(parts[1]).isEmpty()
    with pytest.raises(ValueError):
        frames.random_split(df, [-1, 2])
    some = frames.sample_by(df.withColumn("k", F.col("id") % 3), "k", {0: 1.0})
    assert {r[0] for r in some.select("k").collect()} == {0} and frames.sample_by(df, "id", {}).count() == 0


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, s string")
    tables.write(df, kind, str(tmp_path / "t"), sort_by=["s"])
    back = tables.register(spark, f"v_{kind}", str(tmp_path / "t"), kind)
    assert sorted(back.select(F.col("x").cast("int"), "s").collect(), key=str) == sorted(df.collect(), key=str)
    assert f"v_{kind}" in tables.table_names(spark)
    assert tables.deregister(spark, f"v_{kind}")
    with pytest.raises(Exception):
        spark.table(f"v_{kind}").count()


def test_text_and_numbers(spark, tmp_path):
    tables.text_lines(spark.range(3), "id", str(tmp_path / "t"))
    assert sorted(r[0] for r in tables.read(spark, "text", str(tmp_path / "t")).collect()) == ["0", "1", "2"]
    assert [r[0] for r in tables.numbers(spark, 5, 0, -2).collect()] == [5, 3, 1]
    assert tables.read(spark, "binary", str(tmp_path / "t")).count() >= 1
    assert tables.available(spark, "parquet") and not tables.available(spark, "no-such-source")


def test_functions_are_described(spark):
    def plus_one(x: pd.Series) -> pd.Series:
        return x + 1

    udfs.register_scalar(spark, "plus_one", plus_one, "long", "one more")
    assert spark.sql("SELECT sum(plus_one(id)) FROM range(3)").first()[0] == 6 and udfs.DESCRIBED["plus_one"] == "one more"
