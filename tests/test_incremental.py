import tempfile

import pytest

from lodespark.operators.incremental import VersionedTarget, latest_per, replay_runs


def target(spark):
    return VersionedTarget(spark, tempfile.mkdtemp() + "/t", ["k"], ["h", "v"])


def rows(spark, *x):
    return spark.createDataFrame(list(x), "k bigint, h string, v int, note string")


def test_only_changes_are_published(spark):
    t = target(spark)
    assert t.state() is None
    assert t.process(rows(spark, (1, "a", 1, None), (2, "b", 1, "")), 1)
    assert t.process(rows(spark, (1, "a", 1, "other note"), (2, "c", 1, ""), (3, None, None, "x")), 2)
    assert sorted((r["k"], r["_version"]) for r in t.rows().collect()) == [(1, 1), (2, 1), (2, 2), (3, 2)]
    # back to an earlier version is a change; null versions equal null
    assert sorted(r["k"] for r in t.changes(rows(spark, (2, "b", 1, ""), (3, None, None, ""))).collect()) == [2]


def test_failure_before_publishing_leaves_nothing_and_repeats_nothing(spark):
    t = target(spark)
    t.process(rows(spark, (1, "a", 1, "")), 1)
    source = rows(spark, (1, "a", 2, ""), (2, "b", 1, ""))
    staged = t.stage(t.changes(source), 2)  # the run dies here
    assert t.rows().count() == 1
    assert t.process(source, 2) and not t.process(source, 2)
    assert not t.publish(staged, 2)
    assert t.rows().count() == 3
    with pytest.raises(ValueError):
        t.publish(staged, 0)


def test_of_two_publishers_that_looked_first_exactly_one_wins(spark):
    from concurrent.futures import ThreadPoolExecutor

    t, u = target(spark), None
    t.process(rows(spark, (1, "a", 1, "")), 1)
    u = VersionedTarget(spark, t.path, ["k"], ["h", "v"])
    heads = t.head(), u.head()
    staged = [x.stage(x.changes(rows(spark, (1, "b", 1, "")), h), 2) for x, h in zip((t, u), heads)]
    for x in (t, u):
        x.published = lambda version: False  # both have looked before either publishes
    with ThreadPoolExecutor(2) as pool:
        won = list(pool.map(lambda a: a[0].publish(a[1], 2, a[2]), zip((t, u), staged, heads)))
    assert sorted(won) == [False, True]
    fresh = VersionedTarget(spark, t.path, ["k"], ["h", "v"])
    assert sorted(fresh.commits()) == [1, 2] and fresh.rows().count() == 2
    # a later version that was compared with an outdated state loses, too, and process looks again
    assert not fresh.publish(staged[0], 3, heads[0])
    assert fresh.process(rows(spark, (1, "b", 1, ""), (2, "x", 1, "")), 3) and fresh.state().count() == 2
    assert fresh.vacuum(0.0) == 1 and fresh.vacuum(0.0) == 0


def test_renames_never_overwrite(spark):
    t = target(spark)
    t._fs.mkdirs(t._Path(t.path))
    at = [t._Path(f"{t.path}/{n}") for n in "abc"]
    for p in at[:2]:
        t._fs.create(p, False).close()
    assert t._renamed(at[0], at[2]) and not t._renamed(at[1], at[2])


def test_a_long_history_is_compacted(spark):
    t = target(spark)
    for v in range(1, 13):
        assert t.process(rows(spark, (1, "a", v, ""), (2, "b", 1, ""), (10 + v, "n", 1, "")), v)
    assert len(t.head()["since"]) < 9 and t.head()["base"]
    assert {r["k"]: r["v"] for r in t.state().collect()} == {1: 12, 2: 1, **{10 + v: 1 for v in range(1, 13)}}
    assert t.rows().count() == 12 + 1 + 12


def test_empty_runs(spark):
    t = target(spark)
    assert t.process(rows(spark), 1)
    assert t.rows().count() == 0


def test_latest_per_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (2, None, None)], "k int, at int, s string")
    assert {r["k"]: r["s"] for r in latest_per(df, ["k"], ["at"]).collect()} == {1: "b", 2: None}


def test_replay_runs(spark):
    scans = spark.createDataFrame(
        [(1, 7, b"a", 1, 10, 1), (1, 7, b"b", 1, 11, 2), (1, 7, None, 1, 99, 3), (2, 7, b"c", 1, 10, 4), (3, 7, b"b", 1, 10, 5), (4, 7, b"a", 1, 10, 6), (4, 8, None, 1, 1, 7)],
        "run_id bigint, file_id bigint, content_hash binary, parser_version int, seen_at int, scan_id bigint",
    )
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "OK "), (4, "ok"), (4, "ok"), (5, "running"), (None, "ok")], "run_id bigint, status string")
    assert sorted(map(tuple, replay_runs(scans, runs, tempfile.mkdtemp()).collect())) == [(1, 7), (4, 7)]
    assert replay_runs(scans.limit(0), runs, tempfile.mkdtemp()).count() == 0
    assert replay_runs(scans, runs.limit(0), tempfile.mkdtemp()).count() == 0
