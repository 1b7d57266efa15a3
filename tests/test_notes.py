import itertools
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lodespark.functions import embedding
from lodespark.operators import clones, graph, notes, search, status


def test_kinds_and_tags(spark):
    df = spark.createDataFrame([(["kind:hypothesis", "type:finding"],), (["Type:Persistent_Rule"],), (["bugfix"],), (["research"],), (["kind:odd"],), (None,)], "t array<string>")
    assert [tuple(r[0]) for r in df.select(notes.note_kind(F.col("t"))).collect()] == [("hypothesis", "explicit"), ("persistent_rule", "explicit"), ("experimental_finding", "legacy_tag"), ("hypothesis", "legacy_tag"), ("finding", "default"), ("finding", "default")]
    raw = spark.createDataFrame([('["A", " b ", "todo", "kind:x", "a"]',), ("no json",), (None,), ('{"a": 1}',)], "r string")
    assert [r[0] for r in raw.select(notes.subject_tags(notes.parsed_tags(F.col("r")))).collect()] == [["a", "b"], [], [], []]


def test_edges_and_related(spark):
    n = spark.createDataFrame([(1, [1.0, 0.0], ["a", "b"]), (2, [0.8, 0.6], ["b"]), (3, [0.0, 1.0], ["c", "todo"]), (4, [1.0], None), (4, [1.0], None)], "note bigint, vec array<double>, tags array<string>")
    refs = spark.createDataFrame([(1, "file", "x", True), (3, "file", "x", True), (2, "file", "y", False), (3, "file", "y", False)], "note bigint, ref_kind string, ref_key string, resolved boolean")
    got = {(r["src"], r["dst"], r["edge_type"]): r["weight"] for r in notes.edges(n, refs).collect()}
    # below eight notes each shared key halves what is left: 1 - 0.5 ** 1
    assert got == {(1, 2, "semantic"): 0.5, (2, 3, "semantic"): 0.0, (1, 2, "shared_tag"): 0.5, (1, 3, "shared_file"): 0.5}
    e = notes.edges(n, refs)
    near = notes.related(e, n.select("note"), 0.1).collect()
    assert [(r["other"], r["exact"], r["weight"]) for r in sorted(near, key=lambda r: r["place"]) if r["note"] == 1] == [(2, True, 0.5), (3, True, 0.5)]
    assert {r["note"]: r["weight"] for r in notes.neighbours_of(e, n.where("note = 1")).collect()} == {2: 0.5, 3: 0.5}
    assert notes.semantic_edges(n, most=2).count() == 0 and notes.edges(n.limit(0), refs.limit(0)).count() == 0


def test_references(spark):
    n = spark.createDataFrame([(1, "see src/a.py, b.ts and `Foo.run`, bar_baz; e.g. zz/unknown.py and x.py"), (2, "run_me connect init_x"), (3, None)], "note bigint, body string")
    f = spark.createDataFrame([(10, "src/a.py"), (11, "lib/b.ts"), (12, "app/b.ts"), (13, "p/x.py"), (14, "x.py")], "id bigint, path string")
    s = spark.createDataFrame([(100, 10, "run", "Foo.run"), (101, 11, "bar_baz", "M.bar_baz"), (102, 11, "run_me", None), (103, 10, "init_x", "A.init_x"), (104, 11, "init_x", "B.init_x")], "id bigint, file_id bigint, name string, qualname string")
    got = {(r["note"], r["ref_kind"], r["ref_key"]): (r["file_id"], r["symbol_id"], r["method"], r["resolved"]) for r in notes.references(n, f, s).collect()}
    assert got == {
        (1, "file", "src/a.py"): (10, None, "path", True), (1, "file", "x.py"): (14, None, "path", True), (1, "file", "zz/unknown.py"): (None, None, "path", False),
        (1, "symbol", "Foo.run\x1fsrc/a.py"): (None, 100, "ident", True), (1, "symbol", "M.bar_baz\x1flib/b.ts"): (None, 101, "snake", True),
    }
    told = notes.about_files(notes.references(n, f, s), spark.createDataFrame([(1, 5), (2, 6)], "note bigint, updated int"))
    assert {(r["path"], r["note"]) for r in told.collect()} == {("src/a.py", 1), ("x.py", 1), ("lib/b.ts", 1)}


def test_anchors(spark):
    a = spark.createDataFrame([(1, "file", "src/a.py"), (2, "error", "timeout"), (3, "tool", "pytest"), (4, "symbol", "Foo.run"), (5, "file", " "), (6, "other", "x"), (7, "file", "a.py")], "note bigint, kind string, key string")
    f = spark.createDataFrame([(10, "src/a.py"), (11, "q/src/z.py")], "id bigint, path string")
    s = spark.createDataFrame([(20, "Foo.run")], "id bigint, qualname string")
    got = {r["note"]: (r["file_id"], r["symbol_id"], r["resolved"]) for r in notes.resolved_anchors(a, f, s).collect()}
    assert got == {1: (10, None, True), 2: (None, None, False), 3: (None, None, False), 4: (None, 20, True), 7: (10, None, True)}
    now = spark.createDataFrame([(1, "file", "/ws/src/a.py"), (2, "error", "a timeout after 3 s"), (3, "tool", "pytest"), (4, "file", "other/a.py"), (5, "error", "time")], "event bigint, kind string, key string")
    all_ = spark.createDataFrame([(i, i) for i in range(1, 8)], "note bigint, updated int")
    hit = {}
    for r in notes.recalled_by_anchor(now, a, all_).collect():
        hit.setdefault(r["event"], []).append(r["note"])
    assert {k: sorted(v) for k, v in hit.items()} == {1: [1, 7], 2: [2], 3: [3], 4: [1, 7]}


def test_memory(spark):
    m = notes.Memory(spark, tempfile.mkdtemp() + "/m")
    schema = "topic string, content string, tags array<string>, updated int"
    assert m.notes() is None and not m.forget(spark.createDataFrame([("a",)], "topic string"), 0)
    assert m.remember(spark.createDataFrame([("a ", "one", ["x"], 1), ("a", "two", [], 2), ("b", "three", None, 1), (" ", "no", None, 1), ("c", "", None, 1)], schema), 1)
    assert {r["topic"]: r["content"] for r in m.notes().collect()} == {"a": "two", "b": "three"}
    assert m.forget(spark.createDataFrame([("a",), ("zz",)], "topic string"), 2) and not m.remember(spark.createDataFrame([("q", "late", None, 1)], schema), 2)
    assert {r["topic"] for r in m.notes().collect()} == {"b"}
    assert m.remember(spark.createDataFrame([("a", "back", None, 3)], schema), 3) and m.notes().count() == 2
    assert [r["topic"] for r in notes.listed(m.notes(), k=1).collect()] == ["a"] and notes.listed(m.notes(), tag="x").count() == 0


def test_brief_ages_and_history(spark):
    c = spark.createDataFrame([(1, 1, "user_prompt", "old", 1), (2, 2, "user_prompt", "new  task", 5), (2, 3, "turn_end", "done", 6), (2, 4, "turn_end", "", 7), (3, 9, "user_prompt", "", 9)], "session int, id int, kind string, content string, at int")
    i = spark.createDataFrame([(2, "a", "read", 1), (2, "b", "edit", 1), (2, "c", "other", 9), (1, "z", "edit", 9), (2, "d", "read", 5)], "session int, target string, event_type string, at int")
    n = spark.createDataFrame([("t1", "x", 1), ("t2", "y", 2)], "topic string, content string, updated int")
    r = notes.session_brief(c.withColumn("at", F.timestamp_seconds("at")), i, n, F.timestamp_seconds(F.lit(5 + 7200))).first()
    assert (r["session"], r["prompt"], r["narrative"], r["files"], r["notes"], r["age"]) == (2, "new task", "done", ["b", "d", "a"], ["t2", "t1"], "~2h")
    assert notes.session_brief(c.limit(0).withColumn("at", F.timestamp_seconds("at")), i, n, F.current_timestamp()).count() == 0
    sims = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5), (1, 12, 0.1)], "query int, id int, sim double")
    used = spark.createDataFrame([(10, "a", 2.0, 1, 1), (10, "a", 9.0, 1, 2), (11, "a", None, 2, 3), (12, "a", 1.0, 3, 4), (11, "", 1.0, 1, 5)], "context int, target string, weight double, session int, id int")
    got = notes.intent_history(sims, used).collect()
    assert [(r["target"], round(r["score"], 6), r["touched"], r["sessions"]) for r in got] == [("a", 2.3, 2, 2)]
    assert [r[0] for r in spark.createDataFrame([(0,), (90_000,), (-1,), (3 * 86_400_000,), (10**11,)], "m bigint").select(notes.age(F.col("m"))).collect()] == ["now", "~1min", "", "~3d", "long ago"]
    assert spark.range(1).select(notes.iso_time(F.lit(1_700_000_000_123))).first()[0] == "2023-11-14T22:13:20.123Z"


def test_clones_equal_brute_force(spark):
    g = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    codes = []
    for i in range(40):
        start = g.randint(0, 200)
        words = base[start : start + g.randint(20, 60)]
        codes.append(words)
        for _ in range(g.randint(0, 3)):
            w = list(words)
            for _ in range(g.randint(0, 2)):
                w[g.randrange(len(w))] = "x"
            codes.append(w)
    rows = [(i, " ".join(w) + " # note") for i, w in enumerate(codes)] + [(900, None), (901, ""), (902, "a b c"), (None, "x")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(codes)}
    sets = {i: s for i, s in sets.items() if len(s) >= 15}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "id bigint, code string").withColumn("class", F.lit("clash"))
    pairs, members = clones.clones(df, 0.8)
    cls = {r["id"]: r["class"] for r in members.collect()}
    linked = {(r["a"], r["b"]) for r in pairs.collect()}
    got = {(a, b) for a, b in itertools.combinations(sorted(cls), 2) if cls[a] == cls[b] or (min(cls[a], cls[b]), max(cls[a], cls[b])) in linked}
    assert got == want and set(cls) == set(sets)
    links = {r["id"]: r["links"] for r in members.collect()}
    assert all(links[i] == sum(i in p for p in want) for i in sets)
    one = next(iter(want))[0]
    of = {(r["id"], r["other"]) for r in clones.clones_of(pairs, members, spark.createDataFrame([(one,)], "id bigint")).collect()}
    assert of == {(one, a + b - one) for a, b in want if one in (a, b)}
    reps = clones.classes(df).where("id = class").select("id", "sh")
    assert len(linked & {(r["a"], r["b"]) for r in clones.banded_candidates(reps, 0.8).collect()}) >= 0.97 * len(linked)
    assert clones.banding(0.8) == (12, 5) or clones.banding(0.8)[0] * clones.banding(0.8)[1] <= 64
    assert clones.clones(df.limit(0))[0].count() == 0


def test_search(spark):
    q = spark.createDataFrame([(1, "blast_radius"), (2, "some words")], "query int, text string")
    rows = spark.createDataFrame([(1, ["blast_radius", "G.blast_radius"]), (2, ["x", "G.blast_radius"]), (3, ["blastRadiusOf", None]), (4, ["other", ""])], "id int, names array<string>")
    sims = spark.createDataFrame([(k, i, s) for k in (1, 2) for i, s in ((1, 0.1), (2, 0.2), (3, 0.8), (4, 0.9))], "query int, id int, sim double")
    got = {}
    for r in sorted(search.search(q, sims, rows, 3).collect(), key=lambda r: r["place"]):
        got.setdefault(r["query"], []).append((r["id"], r["tier"]))
    # exact first; then 1/(60+2)+1/(60+2) of id 3 and 1/(60+3)+1/(60+1) of id 2 before 1/(60+1) of id 4
    assert got == {1: [(1, 3), (2, 2), (3, 1)], 2: [(4, 0), (3, 0), (2, 0)]}
    ask = spark.createDataFrame([(1, 7, "run"), (2, 7, "A.run"), (3, 7, "zz")], "ask int, file_id int, name string")
    sy = spark.createDataFrame([(10, 7, "run", "B.run", 1), (11, 7, "run", "A.run", 5), (12, 8, "run", "run", 1)], "id int, file_id int, name string, qualname string, line_start int")
    assert {(r["ask"], r["symbol_id"]) for r in search.symbol_detail(ask, sy).collect()} == {(1, 10), (2, 11)}
    body = spark.createDataFrame([(1, "a\r\nbb\nccc\nd")], "id int, body string")
    assert [search.snippet(body, *x).first()["snippet"] for x in ((2, 3, None), (0, 0, 0), (None, None, 6), (3, None, None), (9, None, None))] == ["bb\nccc", "a\nbb\nccc\nd", "a\nbb", "ccc\nd", ""]
    assert spark.range(1).select(search.text_snippet(F.lit("one two three Fox, five six"), ["fox"], 4)).first()[0] == "two three [Fox,] five"


def test_kept_text_index(spark):
    ix = search.TextIndex(spark, tempfile.mkdtemp() + "/ix")
    f = spark.createDataFrame([(1, "h1", "the quick brown fox"), (2, "h2", "lazy dog the"), (3, "h3", None), (1, "h1", "the quick brown fox")], "id bigint, hash string, body string")
    assert ix.sync(f, 1) and not ix.sync(f, 1) and {r["id"] for r in ix.bm25(["fox", "the"]).collect()} == {1, 2}
    g = spark.createDataFrame([(1, "h1", "the quick brown fox"), (4, "h4", "fox fox")], "id bigint, hash string, body string")
    assert ix.sync(g, 2) and {r["id"] for r in ix.terms().collect()} == {1, 4} and {r["id"] for r in ix.bm25(["dog"]).collect()} == set()
    assert ix.target.rows().where("_version = 2").count() == 2  # the new text and the mark of the one that is gone


def test_module_graph_and_ripple(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 1), (5, 1), (6, 6), (None, 1)], "src bigint, dst bigint")
    nodes, inner, more = search.module_graph(e, 1, 1)
    assert {r["node"] for r in nodes.collect()} == {1, 2, 5} and {tuple(r) for r in inner.collect()} == {(1, 2), (5, 1)} and not more
    nodes, inner, more = search.module_graph(e, 1, 3, 2)
    assert {r["node"] for r in nodes.collect()} == {1, 2} and more
    tests = spark.createDataFrame([(3, 90)], "target_id bigint, test_id bigint")
    partners = spark.createDataFrame([(3, 70), (3, 2), (8, 9)], "src bigint, dst bigint")
    got = {r["node"]: (r["hop"], r["evidence"]) for r in graph.ripple(e, spark.createDataFrame([(3,)], "node bigint"), tests, partners).collect()}
    assert got == {2: (1, ["cochange", "imports"]), 1: (2, ["imports"]), 5: (3, ["imports"]), 90: (None, ["test"]), 70: (None, ["cochange"])}
    df = spark.createDataFrame([(["a/b/c.py", "a/b/d/e.py", "a/b/z.py"],), (["x", "a/b"],), (["q/w.py"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(graph.common_directory(F.col("p"))).collect()] == ["a/b", "", "q", ""]


def test_architecture(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 3), (5, 3)], "src bigint, dst bigint")
    f = spark.createDataFrame([(i, f"p/m{i}.py") for i in range(1, 6)], "id bigint, path string")
    got = {(r["section"], r["place"]): (r["name"], r["value"]) for r in graph.architecture(e, f).collect()}
    assert got["cycle", 1] == ("p/m1.py", 2.0) and got["hub", 1][0] == "p/m3.py" and ("quality", 1) in got and ("layer", 1) in got and ("sink", 1) in got


def test_embedder(spark):
    df = spark.createDataFrame([(1, "readFile openFile"), (2, "read the file"), (3, None), (4, "--")], "id int, t string")
    got = {r["id"]: r["vec"] for r in embedding.embed(df, "id", F.col("t")).collect()}
    assert got[3] is None and got[4] is None and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
    assert sum(a * b for a, b in zip(got[1], got[2])) > 0.3
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None)], "id int, v array<double>")
    assert [r["v"] and [round(x, 6) for x in r["v"]] for r in embedding.stored(v, "v").orderBy("id").collect()] == [[0.6, 0.8], None, None, None]
    assert embedding.same_space([1.0, 0.0], [1.0, 0.001])[0] and not embedding.same_space([1.0, 0.0], [1.0, 0.1])[0] and not embedding.same_space([1.0], [1.0, 0.0])[0]
    assert embedding.prompts_for("intfloat/multilingual-e5-base")[0] == "query: " and embedding.prompts_for("x") == ("", "")
    f = spark.createDataFrame([("docs/a.py",), ("src/deep/b.py",), ("c.go",), ("d.html",)], "path string")
    assert [r["path"] for r in embedding.first_to_embed(f, 3).collect()] == ["c.go", "src/deep/b.py", "docs/a.py"]
    t = spark.createDataFrame([("class", "A", " Doc. "), ("function", "f", None)], "k string, n string, d string")
    assert [r[0] for r in t.select(embedding.symbol_text(F.col("k"), F.col("n"), F.col("d"))).collect()] == ["class A — Doc.", "function f"]


def test_status(spark):
    ids = lambda n, vec=0: spark.createDataFrame([(i, [1.0] if i < vec else None, f"p{i}", None, "user_prompt") for i in range(n)], "id int, vec array<double>, path string, ended timestamp, kind string")
    r = status.status(ids(3, 1), ids(2), ids(1), ids(2, 1), ids(0), ids(0), ids(0), ids(1), live=ids(2)).first()
    assert (r["files"], r["files_embedded"], r["symbols"], r["prompts_embedded"], r["stale_files"], r["embedded_pct"], r["active_sessions"]) == (3, 1, 2, 1, 1, 20.0, 1)
    assert r["signals"] == "index=yes, embeddings=partial(1/5), predictive=no, findings=no" and r["recommendations"].count(";") == 4


def test_related_without_pairs_of_notes(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [t for t in (rng.choice(["a", "b", "c", "common", None]), rng.choice(["f1", "f2", "f3", "f4", None]), rng.choice(["x", None, None])) if t]) for i in range(150)]
    n = spark.createDataFrame(rows, "note bigint, tags array<string>")
    pairs = sorted({tuple(sorted(rng.sample(range(180), 2))) for _ in range(400)})
    sem = spark.createDataFrame([(a, b, round(rng.random(), 4)) for a, b in pairs], "src bigint, dst bigint, weight double")
    graph_ = notes.tag_edges(n).select("src", "dst", F.lit("shared_tag").alias("edge_type"), "weight").unionByName(sem.withColumn("edge_type", F.lit("semantic")))
    tell = lambda df: sorted((r["note"], r["place"], r["other"], r["exact"], r["weight"]) for r in df.collect())
    want = tell(notes.related(graph_, n))
    monkeypatch.setattr(notes, "MOST_TAGS", 2)
    assert tell(notes.related_by_tags_and_vectors(n, sem)) == want
    monkeypatch.undo()
    monkeypatch.setattr(notes.mining, "shared_key_edges", None)  # pairs of notes are not made
    assert tell(notes.related_by_tags_and_vectors(n, sem)) == want


def test_symbol_detail_makes_no_pairs_within_a_file(spark):
    n = 30_000
    sy = spark.range(n).select("id", F.lit(1).alias("file_id"), F.lit("run").alias("name"), F.when(F.col("id") == 9, "run").otherwise("A.run").alias("qualname"), F.when(F.col("id") > 4, F.col("id").cast("int")).alias("line_start"))
    ask = sy.select(F.col("id").alias("ask"), "file_id", F.when(F.col("id") % 2 == 0, "run").otherwise("A.run").alias("name"))
    got = search.symbol_detail(ask, sy)
    assert {(r["even"], r["symbol_id"], r["n"]) for r in got.groupBy((F.col("ask") % 2 == 0).alias("even"), "symbol_id").agg(F.count("*").alias("n")).collect()} == {(True, 9, n // 2), (False, 5, n // 2)}


def test_whole_search_equals_the_search_of_all_pairs(spark):
    from lodespark.operators import similarity, wholesearch

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    vec = lambda: [rng.choice([-1.0, -0.5, 0.5, 1.0, rng.random()]) for _ in range(3)]
    many = [vec() for _ in range(60)]
    name = lambda: rng.choice(["_", "."]).join(rng.sample(words, rng.choice([1, 1, 2, 3])))
    data = [(i, [name(), rng.choice([None, "", "m." + name(), "x." + name()])], rng.choice(many)) for i in range(400)] + [(500, ["alpha"], None), (501, ["beta"], [0.0, 0.0, 0.0]), (502, None, [1.0, 2.0])]
    rows = spark.createDataFrame(data, "id bigint, names array<string>, vec array<float>")
    asked = spark.createDataFrame([(n, text, vec()) for n, text in enumerate(["alpha", "beta_alpha", "BETA", "gamma.delta", "some words", "zeta", "alpha_zeta", None, "_", "delta_gamma_beta", "a.", "gamma_delta_alpha"])], "query bigint, text string, vec array<float>")
    sims = similarity.similarities(rows, "id", "vec", asked.select(F.col("query").alias("id"), "vec"))
    tell = lambda df: {(r["query"], r["place"]): (r["id"], r["tier"], round(r["sim"], 9)) for r in df.collect()}
    for k in (3, 10):
        want = tell(search.search(asked.select("query", "text"), sims, rows, k))
        got = tell(wholesearch.search(asked, rows, k))
        assert {q for q, p in got} == {q for q, p in want} and len(got) == len(want)
        assert {a: v[1:] for a, v in got.items()} == {a: v[1:] for a, v in want.items()}


def test_search_queries_make_no_pairs(spark, sf, monkeypatch):
    from lodespark.operators import similarity
    from lodespark.plans import catalog

    monkeypatch.setattr(similarity, "similarities", None)
    assert catalog.core_queries()["search_symbols"](spark, sf).count() > 0 and catalog.core_queries()["search_files"](spark, sf).count() > 0


def _shuffled(spark, after=-1):
    """The last stage's number and the bytes that the stages behind ``after`` wrote for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    got = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [got.apply(i) for i in range(got.size())]
    return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteBytes() for s in stages if s.stageId() > after)


def test_search_files_moves_its_table_once_a_pass(spark, tmp_path):
    from lodespark.plans import catalog

    i = F.col("id")
    files = spark.range(20_000).select((20 * i + F.when(i % 1000 == 0, 0).otherwise(1)).alias("id"), F.format_string("src/m%d.py", i).alias("path"), F.unhex(F.sha2(i.cast("string"), 256)).alias("content_hash"), F.array(*[F.randn(j).cast("float") for j in range(64)]).alias("embedding"), F.timestamp_seconds(i).alias("mtime"))
    files.union(files.where("id % 40 = 0")).write.parquet(f"{tmp_path}/ci_files.parquet")
    size = sum(p.stat().st_size for p in (tmp_path / "ci_files.parquet").glob("*.parquet"))
    last, _ = _shuffled(spark)
    got = catalog.core_queries()["search_files"](spark, str(tmp_path)).collect()
    assert len(got) == 20 * 8 and {(r["query"], r["id"], r["tier"]) for r in got if r["place"] == 1} == {(20_000 * n, 20_000 * n, 3) for n in range(20)}
    assert _shuffled(spark, last)[1] < 3 * size
