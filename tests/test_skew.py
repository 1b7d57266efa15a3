from pyspark.sql import functions as F

from lodespark.operators import skew

FACTS = "id bigint, k bigint, v bigint, name string"


def facts(spark):
    rows = [(i, 1 if i % 3 == 0 else i, i, "x") for i in range(300)]
    return spark.createDataFrame(rows + rows[:30] + [(None, 1, 0, None), (900, None, 0, ""), (901, None, 0, "")], FACTS)


def test_heavy_keys_are_found_and_bounded(spark):
    assert skew.heavy_keys(facts(spark), "k", 0.1) == [1]
    assert skew.heavy_keys(facts(spark).limit(0), "k", 0.1) == []


def test_per_key_equals_plain_aggregation(spark):
    df = facts(spark)
    aggs = [F.count(F.lit(1)).alias("n"), F.max("v").alias("m")]
    want = {tuple(r) for r in df.where("k is not null").dropDuplicates(["k", "id"]).groupBy("k").agg(*aggs).collect()}
    for share in (0.05, 0.9):
        assert {tuple(r) for r in skew.per_key(df, "k", "id", aggs, share=share).collect()} == want
    assert skew.per_key(df.limit(0), "k", "id", aggs).count() == 0


def test_per_key_with_dimension_and_clashing_columns(spark):
    dim = spark.createDataFrame([(1, "a", "d"), (1, "a", "d"), (5, "b", "e"), (None, "c", "f")], "k bigint, name string, extra string")
    got = skew.per_key(facts(spark), "k", "id", [F.count(F.lit(1)).alias("n")], dim, share=0.1)
    assert {r["k"]: (r["extra"], r["n"]) for r in got.collect()} == {1: ("d", 101 + 1), 5: ("e", 1)}


def test_skew_join_equals_join(spark):
    df = facts(spark)
    dim = spark.createDataFrame([(1, "one"), (5, "five"), (7, "seven"), (None, "none")], "k bigint, label string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, skew.skew_join(df, dim, "k", how, 0.1).select("id", "k").collect()))
        b = sorted(map(str, df.join(dim.where("k is not null"), "k", how).select("id", "k").collect()))
        assert a == b, how


def test_dominant_keys(spark):
    dim = spark.createDataFrame([(1,), (5,)], "k bigint")
    got = skew.dominant_keys(facts(spark).where("id is not null"), "k", "id", dim, 0.25, False).collect()
    assert [r["k"] for r in got] == [1]
    assert skew.dominant_keys(facts(spark).limit(0), "k", "id", dim, 0.25, True).count() == 0
