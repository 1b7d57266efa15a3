import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark import api
from lodespark.functions import embedding
from lodespark.operators import notes, walks


@pytest.fixture(scope="module")
def workspace(spark):
    files = spark.createDataFrame([(1, "src/auth.py", "python", 1.0), (2, "src/db.py", "python", None), (3, "tests/test_auth.py", "python", None)], "id bigint, path string, language string, days double")
    symbols = spark.createDataFrame([(10, 1, "function", "check_user", "check_user", 1, 2, "Checks."), (11, 2, "function", "connect_db", "connect_db", 1, 2, None)], "id bigint, file_id bigint, kind string, name string, qualname string, line_start int, line_end int, docstring string")
    imports = spark.createDataFrame([(1, 3, 1, "internal"), (2, 1, 2, "internal"), (3, 1, None, "external")], "id bigint, from_file_id bigint, to_file_id bigint, resolution string")
    bodies = spark.createDataFrame([(1, "def check_user(u):\n    return connect_db(u)\n"), (2, "def connect_db(u):\n    pass\n"), (3, "import auth\n")], "file_id bigint, body string")
    files = files.join(embedding.embed(files, "id", F.col("path")), "id")
    symbols = symbols.join(embedding.embed(symbols, "id", F.concat_ws(" ", "name", "docstring")), "id")
    return api.Workspace(spark, files, symbols, imports, bodies, memory=notes.Memory(spark, tempfile.mkdtemp() + "/m"))


def test_find_and_read(spark, workspace):
    q = spark.createDataFrame([(1, "connect_db"), (2, "check the user")], "query int, text string")
    got = {(r["query"], r["place"]): (r["id"], r["tier"]) for r in workspace.find(q).collect()}
    assert got[1, 1] == (11, 3) and got[2, 1] == (10, 0)
    assert workspace.find(q.where("query = 1"), "files", 1).count() == 1
    assert [r["id"] for r in workspace.find(q.where("query = 1"), "text").orderBy("id").collect()] == [1, 2]
    spans = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 2, 2), (3, 2, None, 1)], "id bigint, file_id bigint, line_start int, line_end int")
    assert {r["id"]: r["code"] for r in workspace.read(spans).collect()} == {1: "def check_user(u):\n    return connect_db(u)\n", 2: "    return connect_db(u)", 3: "def connect_db(u):"}
    assert workspace.outline().count() == 2


def test_related(spark, workspace):
    asked = spark.createDataFrame([(1,)], "id bigint")
    assert {(r["kind"], r["other"]) for r in workspace.related(asked).collect()} == {("imports", 2), ("imported_by", 3), ("test", 3)}
    assert [(r["test_id"], r["score"]) for r in workspace.related(asked, "tests").collect()] == [(3, 4.0)]
    assert {r["node"]: r["evidence"] for r in workspace.related(spark.createDataFrame([(2,)], "id bigint"), "ripple").collect()} == {1: ["imports"], 3: ["imports"]}
    with pytest.raises(ValueError):
        workspace.related(asked, "friends")


def test_rank_remember_and_recall(spark, workspace):
    p = spark.createDataFrame([(1, "why does check_user in src/auth.py fail")], "request_id int, prompt string")
    got = workspace.rank(p).collect()
    assert {r["target_type"]: r["target"] for r in got if r["place"] == 1} == {"file": "src/auth.py", "symbol": "check_user (src/auth.py:1)"}
    assert workspace.rank(p, explain=True).count() > 0
    q = spark.createDataFrame([(1, "database connection pool")], "query bigint, text string")
    assert workspace.recall(q).count() == 0
    rows = spark.createDataFrame([("pool", "the database connection pool has five slots", ["db"], 1), ("other", "tea and cake", None, 1)], "topic string, content string, tags array<string>, updated int")
    assert workspace.remember(rows, 1) and [r["topic"] for r in workspace.recall(q).collect()] == ["pool"]


def test_walk_boost_equals_matrix_walk(spark):
    g = np.random.default_rng(3)
    n = 12
    names = [f"f{i}" for i in range(n)]
    imports = [(names[a], names[b]) for a, b in g.integers(0, n, (14, 2))]
    baskets = [(int(b), names[i]) for b in range(4) for i in g.choice(n, 3, replace=False)] + [(99, names[0])]
    a = np.zeros((n, n))
    for x, y in imports:
        i, j = names.index(x), names.index(y)
        if i != j:
            a[i, j] += 1.0
            a[j, i] += 1.0
    for b in range(4):
        members = [names.index(x) for k, x in baskets if k == b]
        for i in members:
            for j in members:
                if i != j:
                    a[i, j] += 1.2 / 2
    ranked = [(1, "f0", 3.0), (1, "f1", 1.0), (1, "gone", 9.0), (2, "f5", 1.0), (2, "f6", -1.0)]
    edges = walks.affinity_edges(spark.createDataFrame(imports, "src string, dst string"), commits=spark.createDataFrame(baskets, "basket int, item string"))
    got = {(r["request_id"], r["target"]): r["boost"] for r in walks.walk_boost(spark.createDataFrame(ranked, "request_id int, target string, score double"), edges, spark.createDataFrame([(x,) for x in names], "path string")).collect()}
    deg = a.sum(0)
    m = np.divide(a, deg, out=np.zeros_like(a), where=deg > 0)
    want = {}
    for r in (1, 2):
        seed = np.zeros(n)
        for k, t, s in ranked:
            if k == r and t in names and s > 0:
                seed[names.index(t)] += s
        seed /= seed.sum()
        p = seed.copy()
        for _ in range(3):
            p = 0.8 * seed + 0.2 * (m @ p)
        rest = sorted((i for i in range(n) if seed[i] == 0 and p[i] > 0), key=lambda i: (-p[i], names[i]))[:3]
        want |= {(r, names[i]): 0.6 * p[i] / p[rest[0]] for i in rest if p[i] >= 0.4 * p[rest[0]]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
