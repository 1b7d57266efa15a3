import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lodespark.functions import stats, text
from lodespark.operators import behaviour, graph, navigation, ranking
from lodespark.sources import tree
from lodespark.streaming import events as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokenizers(spark):
    assert set(one(spark, text.name_tokens(F.lit("src/HTTPServer-parseLine.py")))) == {"http", "server", "parse", "line", "parser", "parsers", "parsed", "file"} - {"line", "file"} | ({"http"} if False else set())
    assert one(spark, text.search_tokens(F.lit("fooBar_baz foo"))) == ["foo", "bar", "baz"]
    assert one(spark, text.profile_terms(F.lit("getValue value the 123 ab"))) == ["value", "value"]
    assert one(spark, text.clipped(F.lit("a  b\nccccc"), 6)) == "a b c…" or one(spark, text.clipped(F.lit("a  b\nccccc"), 6)) == "a b c…"


def test_the_two_test_path_predicates_differ(spark):
    df = spark.createDataFrame([("src/FooTest.java",), ("src/Latest.java",), ("tests/a.py",), ("a/test_x.py",)], "p string")
    got = {r[0]: (r[1], r[2]) for r in df.select("p", text.is_test_path(F.col("p")), text.looks_like_test(F.col("p"))).collect()}
    assert got == {"src/FooTest.java": (False, True), "src/Latest.java": (False, False), "tests/a.py": (True, True), "a/test_x.py": (True, True)}


def test_statistics(spark):
    g2 = one(spark, stats.log_likelihood_ratio(F.lit(6), F.lit(10), F.lit(10), F.lit(20)))
    want = 2 * sum(o * math.log(o / 5) for o in (6, 4, 4, 6))
    assert g2 == pytest.approx(want)
    assert one(spark, stats.wilson_lower(F.lit(3), F.lit(3))) == pytest.approx(0.4385, abs=1e-3)
    assert one(spark, stats.wilson_lower(F.lit(0), F.lit(0))) == 0
    assert one(spark, stats.base_rate_discount(F.lit(3), F.lit(4))) == 1.0


def test_turns_and_retraction(spark):
    e = spark.createDataFrame([(1, 1, 1, "read", "a"), (1, 2, 2, "prompt", None), (1, 3, 3, "edit", "a"), (1, 4, 4, "fail", "a"), (1, 5, 5, "prompt", None)], "session int, id int, at int, event_type string, target string")
    got = {r["id"]: (r["iteration"], r["turn"], r["distance"]) for r in behaviour.turns(e, F.col("event_type") == "prompt").collect()}
    assert got == {1: (1, 0, None), 2: (2, 1, 1), 3: (3, 1, 1), 4: (4, 1, 1), 5: (5, 2, 1)}
    left = behaviour.retract_failed(e.where("target is not null"), F.col("event_type") == "fail")
    assert [r["id"] for r in left.collect()] == [1]


def test_patterns(spark):
    e = spark.createDataFrame([(1, "a", "read"), (1, "a", "read"), (1, "a", "retrieved"), (1, "b", "neutral"), (1, "c", "edit"), (1, "d", "read"), (2, "d", "read"), (1, None, "cited")], "session int, target string, event_type string")
    got = {(r[0], r[1]): r[2] for r in behaviour.patterns(e).collect()}
    assert got == {(1, "a"): "read_repeated", (1, "b"): "neutral", (1, "c"): "edit_only", (1, "d"): "read_skipped", (2, "d"): "neutral"}


def test_fusion_of_one_channel(spark):
    df = spark.createDataFrame([(1, "t", 6.0, "reactive:cited"), (1, "u", 9.0, "explicit-mention x")], "request_id int, target string, score double, reason string")
    got = {r["target"]: r["score"] for r in ranking.log_odds_fusion(df).collect()}
    assert got["t"] == pytest.approx(1.6 * 1.15 * 2.2)
    assert got["u"] == pytest.approx(1.6 * 1.30 * math.log(0.93 / 0.07))


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (7, 8), (None, 1)]


def test_graph(spark):
    e = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    comp = {r[0]: r[1] for r in graph.strong_components(e).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 8}
    lay = {r[0]: r[1] for r in graph.layers(e, spark.createDataFrame(list(comp.items()), "node bigint, component bigint")).collect()}
    assert lay == {1: 0, 4: 1, 7: 0, 8: 1}
    assert {r[0]: r[1] for r in graph.connected(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    start = spark.createDataFrame([(5,)], "node bigint")
    assert {r[0]: r[1] for r in graph.reach(e, start, 2, reverse=True).collect()} == {5: 0, 4: 1, 3: 2}
    ranks = graph.pagerank(e, rounds=60).collect()
    assert sum(r["rank"] for r in ranks) == pytest.approx(1.0)
    assert graph.strong_components(e.limit(0)).count() == 0


def test_enclosing_symbols_equal_brute_force(spark):
    s = [(i, i % 3, 1 + i * 7 % 150, 1 + i * 7 % 150 + i % 90) for i in range(60)]
    p = [(f, n) for f in range(3) for n in range(1, 240, 5)]
    sym = spark.createDataFrame(s, "id bigint, file_id bigint, line_start int, line_end int")
    got = {(r[0], r[1]): r[2] for r in navigation.enclosing_symbols(spark.createDataFrame(p, "file_id bigint, line int"), sym).select("file_id", "line", "symbol_id").collect()}
    want = {}
    for f, n in p:
        c = [(e - b, -b, i) for i, g, b, e in s if g == f and b <= n <= e]
        if c:
            want[f, n] = min(c)[2]
    assert got == want


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = [{"session": i % 3, "at": f"2024-01-01 0{i % 9}:0{i % 6}:00"} for i in range(20)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    live = streams.session_windows(streams.read_events(spark, str(tmp_path / "in"), "session int, at timestamp"))
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = streams.session_windows(spark.read.schema("session int, at timestamp").json(str(tmp_path / "in")))
    assert sorted(map(str, spark.table("live").collect())) == sorted(map(str, batch.collect()))
