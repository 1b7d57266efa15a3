import math
import random

import pytest
from pyspark.sql import functions as F

from lodespark.functions import mentions
from lodespark.operators import boosts, channels, evaluation, ranking, render


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame(
        [(1, "src/auth.py", [1.0, 0.0], 1.0), (2, "./src/db.py", [0.0, 1.0], 400.0), (3, "tests/test_auth.py", None, None), (4, "lib/auth.py", [1.0], 3.0), (5, "docs/guide.md", None, 2.0)],
        "id bigint, path string, vec array<double>, days double",
    )
    symbols = spark.createDataFrame(
        [(10, 1, "class", "Login", "Login", 1, 20, None), (11, 1, "method", "check_user", "Login.check_user", 5, 9, [1.0, 0.0]), (12, 1, "method", "go", "Login.go", 6, 7, None), (13, 2, "function", "connect_db", None, 1, 4, [0.0, 1.0])],
        "id bigint, file_id bigint, kind string, name string, qualname string, line_start int, line_end int, vec array<double>",
    )
    return files, symbols


def test_explicit_mentions(spark, index):
    files, symbols = index
    p = spark.createDataFrame(
        [(1, "Fix src/auth.py:6 please"), (2, "auth.py breaks"), (3, "why does `check_user()` fail in Login?"), (4, 'File "/x/src/db.py", line 3'), (5, 'File "src/db.py", line 3, in connect_db'), (6, None), (7, "")],
        "request_id int, prompt string",
    ).withColumn("score", F.lit("clash"))
    got = channels.explicit_mentions(p, files, symbols)
    by = {}
    for r in got.collect():
        by.setdefault(r["request_id"], []).append((r["target"], r["score"], r["reason"]))
    assert sorted(by[1]) == [("Login.check_user (src/auth.py:5)", 6.0, "explicit-line-mention"), ("Login.go (src/auth.py:6)", 6.0, "explicit-line-mention"), ("src/auth.py", 5.0, "explicit-mention")]
    assert sorted(by[2]) == [("lib/auth.py", 5.0, "explicit-mention"), ("src/auth.py", 5.0, "explicit-mention")]
    assert sorted(by[3]) == sorted([("Login.check_user (src/auth.py:5)", 5.5, "explicit-mention"), ("src/auth.py", 3.5, "explicit-symbol-mention"), ("Login (src/auth.py:1)", 5.5, "explicit-mention"), ("src/auth.py", 3.5, "explicit-symbol-mention")])
    assert 4 not in by  # an absolute path is the end of no indexed one
    assert ("connect_db (src/db.py:1)", 6.0, "explicit-line-mention") in by[5] and ("src/db.py", 3.5, "explicit-symbol-mention") not in by[5]
    assert not {6, 7} & set(by) and channels.explicit_mentions(p.limit(0), files, symbols).count() == 0


def test_similar_prompts_and_predictive(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "request_id int, vec array<double>")
    c = spark.createDataFrame(
        [(1, 7, [1.0, 0.0], "2024-01-18 00:00:00"), (2, 8, [0.6, 0.8], "2024-01-31 00:00:00"), (3, 9, [0.0, 1.0], "2024-01-31 00:00:00"), (4, 9, [1.0], "2024-01-31 00:00:00"), (5, 9, None, "2024-01-31 00:00:00")],
        "id int, session int, vec array<double>, at string",
    )
    near = channels.similar_prompts(p, c, now())
    assert [(s, round(x, 6), d) for s, x, d in pairs(near, "session", "sim", "days")] == [(7, 1.0, 14.0), (8, 0.6, 1.0)]
    assert channels.similar_prompts(p, c, now(), top=1).count() == 0  # only the latest context is looked at
    snaps = spark.createDataFrame([(7, "a", 1.0, "cited"), (8, "a", 2.0, "read_skipped"), (8, "b", 90.0, "other"), (8, None, 1.0, "cited")], "session int, target string, score double, pattern string")
    got = {r["target"]: r["score"] for r in channels.predictive(near, snaps).collect()}
    assert got["a"] == pytest.approx(4 * (math.exp(-1) * 1.5 + 0.36 * math.exp(-1 / 14) * 2 * 0.3)) and got["b"] == 6.0 and len(got) == 2


def test_fuzzy_and_doc_intent(spark):
    sims = spark.createDataFrame([(1, 1, 0.7), (1, 2, 0.38), (1, 3, 0.3), (1, 4, 0.5)], "query int, id int, sim double")
    t = spark.createDataFrame([(1, "a", None), (2, "b", 7.0), (3, "c", 0.0), (4, "d", 100.0)], "id int, target string, days double")
    got = {r["target"]: r["score"] for r in channels.fuzzy(sims, t, "file").collect()}
    assert got == {"a": pytest.approx(0.3 * 4.5 / 0.6), "b": pytest.approx(0.03 * 4.5 / 0.6), "c": pytest.approx(0.0), "d": pytest.approx(0.1 * 4.5 / 0.6)}
    assert {r["target"]: round(r["score"], 6) for r in channels.fuzzy(sims, t, "symbol").collect()}["a"] == round(0.25 * 5 / 0.55 + 0.5, 6)
    i = spark.createDataFrame([(1, "f.py", None, None, "docstring", 1.0), (2, "f.py", "q", 3, "docstring", 9.0), (4, "f.py", "q", 3, "comment", 2.0)], "id int, path string, qualname string, line_start int, source_kind string, weight double")
    got = {(r["target"], r["target_type"]): r["score"] for r in channels.doc_intent(sims, i).collect()}
    assert got == {("f.py", "file"): pytest.approx(max(3.2 * 0.28 / 0.58, 3.6 * 0.08 / 0.58 * 2 * 0.65)), ("q (f.py:3)", "symbol"): pytest.approx(3.6 * 0.08 / 0.58 * 2)}


def test_context_and_literals(spark):
    h = spark.createDataFrame([("s", 1, 1, "parse the lexer"), ("s", 2, 2, "render widgets"), ("s", 3, 3, "please continue"), ("s", 4, 4, ""), ("t", 5, 1, "continue"), (None, 6, 1, "continue")], "session string, id int, at int, prompt string")
    got = {r["id"]: (set(r["tokens"]), r["expanded"]) for r in channels.context_tokens(h).collect()}
    assert got[3][1] and {"lexer", "render", "widgets", "please", "continue"} <= got[3][0] and got[4][1] and "widgets" in got[4][0]
    assert not got[5][1] and not got[6][1] and not got[1][1]
    p = spark.createDataFrame([(1, "call exec_command with max size"), (2, "nothing here")], "request_id int, prompt string")
    f = spark.createDataFrame([("a", "x = EXEC_COMMAND()"), ("b", "my_exec_commander max-size"), ("c", "exec command"), ("d", None), ("e", "exec_command " + "x" * 300_000)], "target string, body string")
    got = {r["target"]: r["score"] for r in channels.literal_files(p, f).collect()}
    assert got == {"a": pytest.approx(1.6), "b": pytest.approx(2.05)}


def test_lexical_symbols(spark):
    tokens = spark.createDataFrame([(1, ["login", "method", "user", "file"], False), (2, ["login"], True)], "request_id int, tokens array<string>, expanded boolean")
    idx = spark.createDataFrame([("login", 1), ("user", 1), ("method", 1), ("file", 2), ("login", 3)], "token string, id int")
    t = spark.createDataFrame([(1, "A", "_login_", "method"), (2, "B", "file", "class"), (3, "C", "x", "class")], "id int, target string, name string, kind string")
    got = {(r["request_id"], r["target"]): r["score"] for r in channels.lexical(tokens, idx, t, "symbol").collect()}
    assert got == {(1, "A"): 4.0, (1, "B"): 1.3, (1, "C"): 1.3, (2, "A"): pytest.approx(0.8 + 0.5 + 1.0 + 0.6), (2, "C"): pytest.approx(1.9)}


def test_boosts(spark):
    ranked = spark.createDataFrame([(1, "src/status.py", 2.0), (1, "tests/test_auth.py", 4.0), (1, "x.go", 0.5)], "request_id int, target string, score double")
    paths = spark.createDataFrame([("src/status.py",), ("tests/test_status.py",), ("tests/test_my_status_page.py",), ("lib/auth.py",), ("lib/auth.rs",), ("tests/auth.py",), ("src/other.py",)], "path string")
    got = {r["target"]: r["boost"] for r in boosts.test_affinity(ranked, paths).collect()}
    assert got == {"tests/test_status.py": pytest.approx(0.7), "tests/test_my_status_page.py": pytest.approx(0.7), "lib/auth.py": pytest.approx(1.4), "lib/auth.rs": pytest.approx(1.4)}
    fresh = spark.createDataFrame([("src/status.py", 3.5), ("x.go", -5.0)], "path string, days double")
    assert {r["target"]: round(r["score"], 6) for r in boosts.freshened(ranked, fresh).collect()} == {"src/status.py": 2.3, "tests/test_auth.py": 4.0, "x.go": 0.65}
    near = spark.createDataFrame([(1, s) for s in (1, 2, 3, 4)], "request_id int, session int")
    events = spark.createDataFrame([(s, "src/status.py", "dismissed") for s in (1, 2, 2, 9)] + [(s, "x.go", "dismissed") for s in (1, 2, 3, 4)] + [(1, "tests/test_auth.py", "read")], "session int, target string, event_type string")
    assert {r["target"]: r["score"] for r in boosts.dismissed(ranked, near, events).collect()} == {"src/status.py": 1.0, "tests/test_auth.py": 4.0, "x.go": 0.0}
    edges = spark.createDataFrame([("src/status.py", "a"), ("src/status.py", "a"), ("b", "src/status.py"), ("a", "a")], "src string, dst string")
    deg = spark.createDataFrame([("a", 32), ("b", 8)], "node string, degree int")
    assert {r["target"]: r["boost"] for r in boosts.import_neighbours(ranked, edges, deg).collect()} == {"a": pytest.approx(2 * 0.5 * 0.35), "b": pytest.approx(0.5)}
    snaps = spark.createDataFrame([(s, "src/status.py", 1.0) for s in (1, 2, 3)] + [(s, "new", 0.1) for s in (1, 2, 9)] + [(1, "once", 1.0)], "session int, target string, score double")
    got = boosts.cooccurrence(ranked, snaps).collect()
    assert [(r["target"], r["sessions"], round(r["boost"], 6)) for r in got] == [("new", 2, round(3.0 * 0.4 * 2 / 5, 6))]
    prompts = spark.createDataFrame([(1, "the Go parser")], "request_id int, prompt string")
    langs = spark.createDataFrame([(1, "parsers/go.x", 1.0), (1, "tests/parsers/test_rust.y", 1.0), (1, "other", 1.0), (2, "parsers/rust.x", 1.0)], "request_id int, target string, score double")
    assert {(r["request_id"], r["target"]): r["score"] for r in boosts.language_intent(langs, prompts).collect()} == {(1, "parsers/go.x"): 1.4, (1, "tests/parsers/test_rust.y"): 0.55, (1, "other"): 1.0, (2, "parsers/rust.x"): 1.0}
    asks = spark.createDataFrame([(1, "where is the login implemented"), (2, "where is the failing test")], "request_id int, prompt string")
    both = spark.createDataFrame([(r, t, 1.0) for r in (1, 2, 3) for t in ("tests/a.py", "b.py")], "request_id int, target string, score double")
    assert {(r["request_id"], r["target"]): r["score"] for r in ranking.implementation_intent(both, asks).collect()} == {(1, "tests/a.py"): 0.45, (1, "b.py"): 1.3, **{(r, t): 1.0 for r in (2, 3) for t in ("tests/a.py", "b.py")}}


def test_whole_ranking_and_explanation(spark, index):
    files, symbols = index
    p = spark.createDataFrame([(1, "where is check_user in src/auth.py implemented", [1.0, 0.0]), (2, "zzz", None)], "request_id int, prompt string, vec array<double>")
    got = boosts.rank(p, boosts.Index(files=files, symbols=symbols), now(), live=files.select(F.regexp_replace("path", r"^\./", "").alias("path")).where("path <> 'lib/auth.py'")).collect()
    first = {r["target_type"]: r["target"] for r in got if r["place"] == 1}
    assert first == {"file": "src/auth.py", "symbol": "Login.check_user (src/auth.py:5)"} and {r["request_id"] for r in got} == {1}
    assert "lib/auth.py" not in {r["target"] for r in got} and "tests/test_auth.py" in {r["target"] for r in got}
    steps = boosts.explain(p, boosts.Index(files=files, symbols=symbols), now()).where("request_id = 1 and target = 'src/auth.py'").collect()
    by = {r["stage"]: (r["before"], r["after"]) for r in steps}
    assert by["channel explicit-mention"] == (None, 5.0) and by["implementation"][1] == pytest.approx(by["implementation"][0] + 0.3)
    assert by["freshness"][1] == pytest.approx(by["freshness"][0] * (1 + 0.3 * 6 / 7))
    block = render.ranking_blocks(spark.createDataFrame(got), 120).collect()[0]["block"]
    assert len(block) <= 120 and block.startswith("files:\n- src/auth.py") and block.endswith("(truncated)")


def test_summary_of_reasons(spark):
    df = spark.createDataFrame([("fuzzy:0.71 | doc-intent:docstring:0.80 | fresh×1.20 | cooc+0.5 | test-affinity+0.2",), ("lexical:a+exact",), ("symbol-file(x)",)], "r string")
    got = [tuple(round(x, 6) for x in r[0]) for r in df.select(boosts.channel_summary(F.col("r"))).collect()]
    assert got == [(0.8, 0.2, 0.7, 0.0), (0.6, 0.0, 0.0, 0.0), (0.0, 0.0, 0.4, 0.0)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "c", 9)], "request_id int, target string, place int")
    want = spark.createDataFrame([(1, ["b", "q"]), (2, ["c"]), (3, []), (4, ["z"])], "request_id int, expected_files array<string>")
    r = evaluation.retrieval_metrics(ranked, want, 8).first()
    g = 1 / math.log2(3)
    assert (r["cases"], r["case_recall"], r["file_recall"], r["mrr"]) == (3, pytest.approx(1 / 3), pytest.approx(1 / 4), pytest.approx(0.5 / 3)) and r["ndcg"] == pytest.approx(g / (1 + g) / 3)
    assert evaluation.prompt_sizes(spark.createDataFrame([("abcd",), (None,), ("abcdef",)], "block string")).first()["tokens"] == 1.0


def test_tools(spark):
    df = spark.createDataFrame(
        [("Read", '{"file_path": "a.py"}'), ("functions.apply_patch", "*** Update src/x.py"), ("Bash", '{"command": "ls"}'), ("exec_command", '{"cmd": "cat b.go"}'), ("add_note", "{}"), ("edit_symbol", '{"path": "c.rs"}'), ("code_search", '{"path": "d"}'), ("dance", '{"path": "d"}')],
        "tool string, input string",
    )
    target = mentions.tool_target(F.col("input"))
    assert [tuple(r) for r in df.select(mentions.tool_event(F.col("tool"), target), target).collect()] == [
        ("read", "a.py"), ("edit", "src/x.py"), ("neutral", None), ("read", "b.go"), ("neutral", None), ("edit", "c.rs"), ("read", "d"), ("neutral", "d"),
    ]


def test_lexical_moves_no_pairs_of_prompts_and_targets(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    own = {i: rng.sample(words, rng.randint(1, 4)) for i in range(60)}
    asked = {r: rng.sample([*words, "none"], rng.randint(0, 5)) for r in range(12)}
    tokens = spark.createDataFrame([(r, t, r % 3 == 0) for r, t in asked.items()], "request_id bigint, tokens array<string>, expanded boolean")
    index = spark.createDataFrame([(t, i) for i, ts in own.items() for t in ts + ts[:1]], "token string, id bigint")
    got = channels.lexical(tokens, index, spark.createDataFrame([(i, f"f{i}") for i in own], "id bigint, target string"), "file")
    assert "hashpartitioning(request_id" not in got._jdf.queryExecution().toString()
    want = {}
    for r, ts in asked.items():
        for i, mine in own.items():
            if both := sorted(set(ts) & set(mine)):
                more = 0.6 if r % 3 == 0 else 0.0
                want[r, f"f{i}"] = (round(min(1.4 + more, 0.6 + 0.4 * len(both) + more), 9), ("lexical-context:" if more else "lexical:") + ",".join(both[:3]))
    assert {(x["request_id"], x["target"]): (round(x["score"], 9), x["reason"]) for x in got.collect()} == want
