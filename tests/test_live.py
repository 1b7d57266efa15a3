import json
import os
import tempfile

from pyspark.sql import functions as F

from lodespark.operators.incremental import VersionedTarget
from lodespark.streaming import events as streams
from lodespark.streaming import live


def write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(map(json.dumps, rows)))


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_sessions_retract_and_end_by_themselves(spark):
    folder, check = tempfile.mkdtemp(), tempfile.mkdtemp()
    e = lambda s, t, kind, target, i: {"session": s, "at": f"2024-01-01 00:{t:02}:00", "kind": kind, "target": target, "id": i}
    write(folder, "1.json", [e("a", 0, "prompt", None, 1), e("a", 1, "event", "x", 2), e("a", 2, "event", "x", 3), e("a", 3, "failure", "x", 4), e("a", 3, "failure", "y", 5), e("b", 0, "event", "y", 6), e("b", 1, "end", None, 7)])
    write(folder, "2.json", [e("a", 4, "failure", "x", 8), e("a", 5, "event", "z", 9)])
    write(folder, "3.json", [e("c", 59, "prompt", None, 10)])
    write(folder, "4.json", [e("d", 59, "prompt", None, 11)])
    for i in range(1, 5):
        os.utime(os.path.join(folder, f"{i}.json"), (1000 + i, 1000 + i))
    stream = streams.read_events(spark, folder, "session string, at timestamp, kind string, target string, id bigint", 1)
    q = live.session_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start()
    drain(q)
    got = {(r["session"], r["target"], r["kept"], r["anchor"]) for r in spark.table("states").collect()}
    assert ("b", "y", 1, None) in got and ("a", "z", 1, "1") in got and not any(t == "x" for _, t, _, _ in got)


def test_index_updates_and_resync(spark):
    folder, check = tempfile.mkdtemp(), tempfile.mkdtemp()
    target = VersionedTarget(spark, tempfile.mkdtemp() + "/t", ["path"], ["hash"])
    disk = {"a": "1", "b": "1"}
    frame = lambda names: spark.createDataFrame([(n, disk[n]) for n in names if n in disk], "path string, hash string")
    seen = []

    def read(paths):
        names = sorted(r["path"] for r in paths.collect())
        seen.append(names)
        return frame(names)

    def resync():
        seen.append("all")
        return frame(sorted(disk))

    write(folder, "1.json", [{"path": "a", "kind": "modified", "at": 1}, {"path": "a", "kind": "modified", "at": 2}])
    run = live.index_updates(target, read, resync)

    def go():
        stream = streams.read_events(spark, folder, "path string, kind string, at bigint", 1)
        drain(stream.writeStream.foreachBatch(run).option("checkpointLocation", check).trigger(availableNow=True).start())

    go()
    write(folder, "2.json", [{"path": "sub/.gitignore", "kind": "modified", "at": 3}, {"path": "a", "kind": "modified", "at": 3}])
    disk["a"] = "2"
    go()
    assert seen == [["a"], "all"] and {r["path"]: r["hash"] for r in target.state().collect()} == {"a": "2", "b": "1"}
    run(spark.createDataFrame([("b", "modified", 9)], "path string, kind string, at bigint"), 1)  # delivered again: nothing happens
    assert seen == [["a"], "all"] and target.rows().count() == 3
    many = spark.createDataFrame([(f"p{i}", "modified", 1) for i in range(6)], "path string, kind string, at bigint")
    assert live.wants_resync(many, 6) and not live.wants_resync(many, 7) and not live.wants_resync(many.limit(0))
    assert live.wants_resync(spark.createDataFrame([(None, "resync", 1)], "path string, kind string, at bigint"))


def test_upserts_and_debounce(spark):
    target = VersionedTarget(spark, tempfile.mkdtemp() + "/t", ["k"], ["v"])
    run = streams.upsert_batches(target, ["k"], ["at"])
    batch = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 10)], "k int, at int, v int")
    run(batch, 0)
    run(batch, 0)
    run(spark.createDataFrame([(1, 3, 20), (2, 3, 11)], "k int, at int, v int"), 1)
    assert {r["k"]: r["v"] for r in target.state().collect()} == {1: 20, 2: 11} and target.rows().count() == 3
    e = spark.createDataFrame([("a", 0), ("a", 100), ("a", 250), ("a", 600), ("b", 0), (None, 1)], "path string, ms int").select("path", F.timestamp_millis(F.col("ms").cast("bigint")).alias("at"))
    got = sorted((r["path"], r["n"]) for r in live.debounced(e).collect())
    assert got == [("a", 1), ("a", 3), ("b", 1)]


def test_heavy_sessions_are_counted_across_tasks(spark):
    import random

    from lodespark.operators import behaviour

    g = random.Random(1)
    rows = [(0 if g.random() < 0.6 else g.randint(1, 200), g.choice("xyz"), g.choice(["cited", "read", "fail"]), g.randint(0, 500), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "session int, target string, event_type string, at int, id int")
    want, turns, left, stacks, last = {}, {}, set(), {}, {}
    for s, t, k, at, i in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        n, p, c = turns.get(s, (0, 0, None))
        turns[s] = (n + 1, p + (k == "cited"), i if k == "cited" else c)
        want[i] = turns[s]
        pile = stacks.setdefault((s, t), [])
        if k == "fail":
            if pile:
                pile.pop()
        else:
            pile.append(i)
    left = {i for pile in stacks.values() for i in pile}
    got = {r["id"]: (r["iteration"], r["turn"]) for r in behaviour.turns(df, F.col("event_type") == "cited").collect()}
    assert got == {i: v[:2] for i, v in want.items()}
    assert {r["id"]: r["context"] for r in behaviour.anchored(df, F.col("event_type") == "cited").collect()} == {i: v[2] for i, v in want.items()}
    assert {r["id"] for r in behaviour.retract_failed(df, F.col("event_type") == "fail").collect()} == left
