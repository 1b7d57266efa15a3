import base64
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodespark.llm import docpairs, grammars, language, leakage, neighbours, outranking, syntax, tokenization
from lodespark.operators.snippets import code_of
from lodespark.sources import headers


# -- ranking
def brute_flow(rows, threshold):
    best = {}
    for r, t, c, s in rows:
        if None not in (r, t, c, s) and s == s and abs(s) != float("inf"):
            best[r, c, t] = max(s, best.get((r, c, t), s))
    out = {}
    for r in {k[0] for k in best}:
        ts, cs = sorted({k[2] for k in best if k[0] == r}), sorted({k[1] for k in best if k[0] == r})
        n, total = len(ts), dict.fromkeys(ts, 0.0)
        for c in cs:
            v = {t: best.get((r, c, t), -1e300) for t in ts}
            x = {t: sum(v[u] < v[t] for u in ts) + sum(v[u] == v[t] for u in ts) / 2 for t in ts}
            span = max(1, int(2 * threshold * n + 0.5)) / 2
            for t in ts:
                total[t] += sum(min(1, (x[t] - x[u]) / span) if x[t] > x[u] else -min(1, (x[u] - x[t]) / span) for u in ts) / max(1, n - 1)
        out |= {(r, t): total[t] / len(cs) for t in ts}
    return out


@pytest.mark.parametrize("threshold", [0.25, 0.5, 1.0])
def test_net_flow_equals_brute_force(spark, threshold):
    g = random.Random(1)
    rows = [(g.randint(1, 3), f"t{g.randint(0, 12)}", g.choice("abc"), float(g.randint(0, 6)) * 10 ** g.randint(0, 9)) for _ in range(150)]
    rows += rows[:20] + [(1, "t1", "a", None), (1, "t1", "b", float("nan")), (None, "t", "a", 1.0), (2, None, "a", 1.0), (2, "t2", None, 1.0), (9, "only", "a", 1.0)]
    df = spark.createDataFrame(rows, "request_id int, target string, channel string, score double").withColumn("n", F.lit("clash")).withColumn("r", F.lit(0))
    got = {(r[0], r[1]): r[2] for r in outranking.net_flow(df, threshold=threshold).collect()}
    want = brute_flow(rows, threshold)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert outranking.net_flow(df.limit(0)).count() == 0


def test_net_flow_of_a_heavy_request_with_ties(spark):
    g = random.Random(2)
    rows = [(1, f"t{i}", c, float(g.choice([0, 0, 0, 1, 2]))) for i in range(150) for c in "ab" if g.random() < 0.8]
    rows += [(r, f"t{i}", "a", g.random()) for r in range(2, 30) for i in range(4)]
    df = spark.createDataFrame(rows, "request_id int, target string, channel string, score double")
    got = {(r[0], r[1]): r[2] for r in outranking.net_flow(df).collect()}
    want = brute_flow(rows, 0.5)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


# -- files that do not parse
GOOD = {
    "python": "def f(a, *, b=1):\n    return {x: y for x, y in a}\n",
    "typescript": "export class A<T extends B> implements C { private x?: number = 1; get<U>(a: U[], ...r: string[]): Record<string, U> { return a as any; } }\ntype M = { [K in keyof T]?: T[K] };\nconst f = async <T,>(x: T): Promise<T> => x!;\nenum E { A = 1, B }\n",
    "javascript": "const {a, ...b} = require('x');\nfor (const k in b) if (/[({]\\//g.test(k)) { a?.[k]?.(`x${ {y: 1}.y } )`) }\nexport default class { static #p = 1; async *g() { yield* this.h() } }\nlabel: while (true) { break label }\n",
    "go": "package a\nimport (\n\t\"x/y\"\n)\ntype P[T any] struct { a, b T; *Q }\nfunc (p *P[T]) F(x ...int) (int, error) {\n\tif v, ok := m[x]; ok && v == (T{}) { return 1, nil }\n\tfor i := range x { go f(i) }\n\tswitch y := z.(type) { case int, string: return y }\n\tselect { case <-c: default: }\n\treturn 0, nil\n}\n",
    "rust": "use std::{fmt, io::*};\npub struct A<'a, T: Fn(i32) -> i32 + 'a>(pub &'a T);\nimpl<T> A<'_, T> where T: Clone { fn f(&mut self) -> Result<u8, ()> { let x = if let Some(y) = z { y } else { return Err(()) }; match x { 0..=9 | 11 if a => 1, _ => { b }? } ; v.iter().map(|x| x >> 1).collect::<Vec<_>>(); println!(\"{}\", 'a'); Ok(1) } }\n",
    "java": "package a.b;\nimport static c.D.*;\n@X(1) public final class A<T extends B & C> extends E<T> implements F {\n int[] a = {1, 2}, b; static { x(); }\n public <R> R f(final Map<String, List<? super T>> m, int... n) throws G { for (var e : m.entrySet()) { y = (R) e; } return switch (n[0]) { case 1, 2 -> null; default -> { yield z; } }; }\n enum H { P(1) { }, Q; int q; }\n record R(int x) {} }\n",
    "c": "#include <a.h>\n#define X(a) \\\n  (a)\ntypedef struct n { int a : 3; struct n *next; } n_t;\nstatic int (*f)(int, ...) = 0;\nint main(int argc, char **argv) { n_t *p = (n_t *)malloc(sizeof(n_t)); for (int i = 0; i < 3; i++) { a->b[i] *= (unsigned) 2 >> 1; } do x--; while (x); switch (y) { case 'a': default: goto e; } e: return 0; }\n",
    "bash": "#!/bin/bash\nf() { local x=$(( (1 + 2) * 3 )); case \"$1\" in a|b) echo ${x:-\"}\"} ;; *) return 1;; esac; }\nif [[ $a =~ ^(x|y)$ && -f b ]]; then for i in {1..3}; do echo `date`; done; fi <<< \"x\"\narr=(1 2 \"$(f ')')\")\ncat <<'E'\n<<<<<<< ( {\nE\nwhile read -r l; do :; done < <(ls | sort)\n",
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_grammars_accept_valid_and_reject_damaged_files(lang):
    text = GOOD[lang]
    assert grammars.parses(lang, text)
    assert grammars.parses(lang, "") and grammars.parses(lang, "\n\n")
    lines = text.split("\n")
    marked = "\n".join([*lines[:1], "<<<<<<< HEAD", *lines[1:-1], "=======", ">>>>>>> other", ""])
    assert not grammars.parses(lang, marked)
    assert not grammars.parses(lang, text[: len(text) // 2]) or not grammars.parses(lang, text[: len(text) * 2 // 3])
    others = [o for o in GOOD if o != lang and {o, lang} != {"typescript", "javascript"}]
    assert not any(grammars.parses(o, text) for o in others)


FORMS = {
    "go": ["package a\nfunc f() {\nL:\n\tfor {\n\t\tbreak L\n\t}\n}\n", "package a\nfunc f() {\n\tgoto end\nend:\n}\n", "package a\nfunc f() {\nend:\n\treturn\n}\n", "package a\nfunc f(){ switch x { case 1: L: for { continue L } ; default: M: } }\n"],
    "bash": ["case $x in\na) echo 1 ;&\nb) echo 2 ;;&\n*) echo 3 ;;\nesac\n", "coproc name { cat; }\n", "coproc cat\n", "coproc N { read x; } 2>/dev/null\necho x\n"],
    "rust": ['unsafe extern "C" { fn f(x: i32) -> i32; safe fn g(); static X: i32; }\n', "fn f<'a>(x: &'a i32) -> impl Sized + use<'_> { x }\n", "fn f<'a, T>(x: &'a T) -> impl Sized + use<'a, T> { x }\n"],
    "typescript": ["using x = f();\n", "async function f(){ await using y = g(), z = h(); for (using a of b) {} for (await using c of d) {} }\n", "const using = 1; using + 1; using(2); using\nx = 2\n"],
    "javascript": ["{ await using y = g(); }\n", "let using = 3; using.x = 4; using[0] = 1;\n"],
    "c": ['static int __init f(void) { return 0; }\nMODULE_LICENSE("GPL");\nmodule_init(f);\n', "static const struct a __initconst b[] = { {1}, };\n__u32 x = 1;\n", "SYSCALL_DEFINE2(foo, int, a, char __user *, b)\n{\n\treturn 0;\n}\n"],
}


@pytest.mark.parametrize("lang", sorted(FORMS))
def test_grammars_accept_rarer_forms(lang):
    for text in FORMS[lang]:
        assert grammars.parses(lang, text), text
        assert not grammars.parses(lang, text + "}\n")


def test_depth_and_faults_of_a_checker_are_no_verdict(monkeypatch):
    deep = "(" * 1500 + "1" + ")" * 1500
    for lang, text in (("java", f"class A {{ int x = {deep}; }}"), ("go", f"package a\nvar x = {deep}\n"), ("c", f"int x = {deep};"), ("javascript", f"x = {deep};"), ("rust", f"const X: i32 = {deep};")):
        assert grammars.parses(lang, text), lang
    monkeypatch.setitem(grammars.GRAMMARS, "go", lambda text: [][1])
    assert grammars.parses("go", "package a") is None and syntax.judge("go", "package a")[0] == "undecided"


def test_file_report(spark):
    files = spark.createDataFrame(
        [(1, "r/a.PY", "x = 1\n"), (1, "r/a.PY", "x = 1\n"), (2, "r/b.js", GOOD["typescript"]), (3, "r/c.go", "package a\nfunc f( {"), (4, "r/d.txt", "{"), (5, "r/e.pyi", None), (6, "r/f.rs", "// only\n"), (None, "r/g.py", "("), (7, None, "(")],
        "file_id bigint, path string, body string",
    ).withColumn("status", F.lit("clash"))
    got = {r["file_id"]: (r["status"], r["parses_as"]) for r in syntax.check_files(files).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "valid", 2: "wrong_extension", 3: "corrupt", 4: "unsupported", 5: "valid", 6: "valid"}
    assert "python" in got[1][1] and got[2][1] == ["typescript"] and got[3][1] == got[4][1] == [] and "rust" in got[6][1]
    assert sorted(r[0] for r in syntax.failing(files).collect()) == [2, 3]
    index = spark.createDataFrame([(1, "JavaScript"), (2, "js"), (3, None)], "id bigint, language string")
    rates = {(r["repo"], r["language"]): (r["files"], r["n_corrupt"], r["n_wrong_extension"], r["n_mislabelled"]) for r in syntax.rates(files, index).collect()}
    assert rates[("r", ".txt")] == (1, 0, 0, 0)
    assert rates[("r", "python")] == (2, 0, 0, 1) and rates[("r", "javascript")] == (1, 0, 1, 0) and rates[("r", "go")] == (1, 1, 0, 0)
    assert syntax.check_files(files.limit(0)).count() == 0


# -- vectors
def test_similar_pairs_recall_copies_and_dirt(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(400, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(0, 200, 2):
        rows.append((1000 + i, (base[i] * 3 + g.normal(size=64) * 0.3).tolist()))
    rows += [(2000 + i, base[399].tolist()) for i in range(9)] + rows[:50]
    rows += [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 63), (5003, [float("nan")] + [1.0] * 63), (None, base[0].tolist())]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>").withColumn("vec", F.lit(1))
    got = {(r[0], r[1]) for r in neighbours.similar_pairs(df, "id", "embedding").collect()}
    ids = sorted({i for i, v in rows if i is not None and i < 5000})
    x = np.array([dict((i, v) for i, v in rows if i is not None)[i] for i in ids], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if s[a, b] >= 0.9), key=lambda b: (-round(float(s[a, b]), 5), ids[b]))[:5]
        want |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order}
    assert len(got & want) >= 0.97 * len(want) and not got - want
    assert neighbours.similar_pairs(df.limit(0), "id", "embedding").count() == 0


def brute_neighbours(x, k, least):
    """(row, partner) of the k nearest of every row."""
    x = np.asarray(x, np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for lo in range(0, len(x), 2000):
        s = x[lo : lo + 2000] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        near = np.argpartition(-s, k, axis=1)[:, :k]
        out |= {(lo + r, int(c)) for r in range(len(s)) for c in near[r] if s[r, c] >= least}
    return out


def vectors_of(spark, x):
    x = np.asarray(x, np.float32)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64), pa.int32()), pa.array(x.ravel()))
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(x))), "embedding": flat}))


def vector_recall(spark, x, k, least, **options):
    got = neighbours.similar_pairs(vectors_of(spark, x), "id", "embedding", k=k, min_cosine=least, **options).select("id_a", "id_b").collect()
    want = {(min(p), max(p)) for p in brute_neighbours(x, k, least)}
    found = {tuple(r) for r in got}
    return len(found & want) / max(1, len(want)), len(found & want) / max(1, len(found))


def test_recall_in_one_dense_cluster(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=64) + 0.1 * g.normal(size=(4000, 64))
    recall, precision = vector_recall(spark, x, 5, 0.9)
    assert recall >= 0.9 and precision >= 0.9


def test_recall_of_planted_pairs_and_of_a_large_dense_cluster_among_random_vectors(spark):
    g = np.random.default_rng(2)
    a = g.normal(size=(2000, 64))
    x = np.concatenate([a, a + 0.4 * g.normal(size=a.shape), g.normal(size=(9000, 64)), g.normal(size=64) + 0.1 * g.normal(size=(6000, 64))])
    planted = {(i, 2000 + i) for i in range(2000)} & {(min(p), max(p)) for p in brute_neighbours(x, 5, 0.9)}
    found = {(r[0], r[1]) for r in neighbours.similar_pairs(vectors_of(spark, x), "id", "embedding").collect()}
    assert len(found & planted) >= 0.97 * len(planted)
    dense = {(min(p), max(p)) for p in brute_neighbours(x, 5, 0.9) if p[0] >= 13000}
    assert len(found & dense) >= 0.85 * len(dense)


@pytest.mark.parametrize("n", [3000, 9000])
def test_recall_without_a_threshold(spark, n):
    x = np.random.default_rng(3).normal(size=(n, 64))
    recall, precision = vector_recall(spark, x, 5, -1.0)
    assert recall >= 0.9 and precision >= 0.9


@pytest.mark.parametrize("levels", [1, 6])
def test_large_files_are_indexed_again_and_at_last_cut_into_chunks(spark, monkeypatch, levels):
    for name, value in (("LEAF", 200), ("FILE", 50), ("MOST_PIVOTS", 20), ("LEVELS", levels), ("POSTED_AT_ONCE", 500)):
        monkeypatch.setattr(neighbours, name, value)
    g = np.random.default_rng(4)
    x = (g.normal(size=(30, 1, 64)) + 0.1 * g.normal(size=(30, 100, 64))).reshape(-1, 64)
    recall, precision = vector_recall(spark, x, 5, 0.9)
    assert recall >= 0.9 and precision >= 0.9
    same = np.ones((900, 64)) + 0.02 * g.normal(size=(900, 64))
    assert levels > 1 or vector_recall(spark, same, 3, 0.9)[0] >= 0.9


def test_tight_vectors_are_told_apart():
    g = np.random.default_rng(5)
    x = 1 + 1e-4 * g.normal(size=(600, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = ((x[:, None].astype(np.float64) - x) ** 2).sum(2) + 9 * np.eye(600)
    want = {(i, int(j)) for i in range(600) for j in np.argpartition(d[i], 4)[:5]}
    a, b, _ = neighbours.best_in_file(x, np.arange(600), 5, 32, 0.9)
    assert len(want & set(zip(a.tolist(), b.tolist()))) >= 0.95 * len(want)


# -- functions and their documentation
def test_documentation_that_says_nothing(spark):
    empty = [None, "", "  ", "TODO", "todo: write docs", "N/A", "...", "-----", "open_file", "Open file.", "The open file function", "/** @param a */", ":param a:\n:return:", "noqa: D103", "{@inheritDoc}", "Parameters\n----------", "<p>TODO</p>", "open_file()", "Auto-generated method stub"]
    told = ["Todo lists are merged.", "None of the rows survive.", "Öffnet die Datei.", "Open file lazily.", "/** Reads. */", "打开文件", "Parameters are copied."]
    df = spark.createDataFrame([(x, False) for x in empty] + [(x, True) for x in told], "d string, want boolean")
    got = df.select("d", "want", docpairs.tells_something(F.col("d"), F.lit("open_file")).alias("got")).collect()
    assert [(r["d"], r["got"]) for r in got if r["got"] != r["want"]] == []


def test_pairs_inherit_documentation_over_levels(spark):
    body = "class A {\n  /** Runs it. */\n  run() { }\n}\nclass B extends A {\n  run() { }\n}\nclass C extends B {\n  run() { }\n  stop() { }\n}\nclass D extends D2 { }\nclass D2 extends D { run() { } }\n"
    files = spark.createDataFrame([(1, "r/a.js", body), (1, "r/a.js", body), (2, "r/b.js", None)], "file_id bigint, path string, body string")
    rows = [(1, 1, "method", "run", "A.run", 3, 3, "/** Runs it. */"), (2, 1, "Method ", "run", "B.run", 6, 6, None), (3, 1, "METHOD", "run", "C.run", 9, 9, "{@inheritDoc}"), (4, 1, "method", "stop", "C.stop", 10, 10, "@inheritdoc"), (5, 1, "class", "A", "A", 1, 4, "A class."), (6, 1, "method", "run", "D2.run", 13, 13, ""), (7, 2, "function", "g", None, 1, 1, "Goes."), (8, 9, "function", "h", None, 1, 1, "Has no file.")]
    symbols = spark.createDataFrame(rows + rows[:2], "id bigint, file_id bigint, kind string, name string, qualname string, line_start int, line_end int, docstring string").withColumn("doc", F.lit("clash"))
    got = {r["symbol_id"]: (r["code"], r["doc"], r["doc_from"]) for r in docpairs.pairs(symbols, files).collect()}
    assert got == {i: ("  run() { }", "Runs it.", 1) for i in (1, 2, 3)}
    assert sorted(r[0] for r in docpairs.documented_ids(symbols, files).collect()) == [1, 7]
    assert docpairs.pairs(symbols.limit(0), files).count() == 0


HEADERS = {
    "a.java": ("/* class X extends Y {} */ public final class A<T extends Comparable<T>>\n    extends p.q.B<T, C>\n    implements D, E<F> {\n class In extends Out {} }\ninterface G extends H, I {}\nenum J implements K { L }\nrecord M(int x) implements N {}\nString s = \"class O extends P {\";\n", {("A", "B"), ("A", "D"), ("A", "E"), ("In", "Out"), ("G", "H"), ("G", "I"), ("J", "K"), ("M", "N")}),
    "a.py": ("class A(b.B, Generic[T], metaclass=M):\n  '''class X(Y): pass'''\nclass C: pass\nclass D(\n    A,  # class Z(W):\n): pass\n", {("A", "B"), ("A", "Generic"), ("D", "A")}),
    "a.ts": ("export abstract class A<T> extends B<T> implements C, D { x = `class X extends Y {`; }\nconst k = class extends Z {};\ninterface E extends F<G> {}\n", {("A", "B"), ("A", "C"), ("A", "D"), ("E", "F")}),
    "a.rs": ("impl<'a, T: Fn(i32) -> i32> fmt::Display for A<'a, T> where T: Clone { }\nimpl B { }\ntrait C: D + E {}\n", {("A", "Display"), ("C", "E")}),
    "a.cpp": ("class A final : public ns::B<int>, private virtual C { };\nstruct D;\nclass E;\n", {("A", "B"), ("A", "C")}),
    "a.go": ("package p\ntype A struct {\n\tB\n\t*q.C\n\tname string\n\tf func(x int) D\n}\ntype I interface {\n\tJ\n\tF(x int) error\n}\n", {("A", "B"), ("A", "C"), ("I", "J")}),
    "a.kt": ("open class A(val x: Int) : B(x), C {\n}\n", {("A", "B"), ("A", "C")}),
}


@pytest.mark.parametrize("path", sorted(HEADERS))
def test_class_headers(path):
    text, want = HEADERS[path]
    assert set(headers.Headers(path, text).edges()) == want
    for cut_at in range(0, len(text), 3):  # damaged texts end, too
        list(headers.Headers(path, text[:cut_at]).edges())


def test_inherited_documentation_is_left_out_of_own_and_found_in_pairs(spark):
    g = random.Random(9)
    n, depth = 40, 5
    body = "".join(f"class K{i}_{d}{f' extends K{i}_{d - 1}' if d else ''} {{\n  go() {{ return {d}; }}\n}}\n" for i in range(n) for d in range(depth))
    files = spark.createDataFrame([(1, "r/a.js", body), (2, "s/a.js", body)], "file_id bigint, path string, body string")
    rows, want, own = [], {}, set()
    for i in range(n):
        level = g.randrange(depth)
        for d in range(depth):
            doc = f"Goes {i}." if d == level else g.choice([None, "{@inheritDoc}", "/** */"])
            sid = 100 * i + d
            rows.append((sid, 1, "method", "go", f"K{i}_{d}.go", 3 * (depth * i + d) + 2, 3 * (depth * i + d) + 2, doc))
            if d >= level:
                want[sid] = (f"Goes {i}.", 100 * i + level, f"  go() {{ return {d}; }}")
        own.add(100 * i + level)
    symbols = spark.createDataFrame(rows, "id bigint, file_id bigint, kind string, name string, qualname string, line_start int, line_end int, docstring string")
    assert {r["symbol_id"]: (r["doc"], r["doc_from"], r["code"]) for r in docpairs.pairs(symbols, files).collect()} == want
    assert {r[0] for r in docpairs.documented_ids(symbols, files).collect()} == own


def test_code_over_many_rows_of_lines(spark):
    lines = [f"line {i}" for i in range(1, 1001)]
    files = spark.createDataFrame([(1, "\r\n".join(lines)), (2, ""), (3, "one")], "file_id bigint, body string")
    spans = [(i, 1, a, b) for i, (a, b) in enumerate([(1, 1), (250, 260), (1, 1000), (990, 5000), (256, 257), (-3, 2), (1001, 1002), (5, 4)])] + [(20, 2, 1, 9), (21, 3, 1, 2**31 - 1), (22, 9, 1, 1), (23, 1, None, 2)]
    df = spark.createDataFrame(spans, "id bigint, file_id bigint, line_start int, line_end int")
    got = {r["id"]: r["code"] for r in code_of(df, files).collect()}
    want = {i: "\n".join(lines[max(a, 1) - 1 : b]) for i, f, a, b in spans if f == 1 and a is not None and b >= max(a, 1) and a <= 1000} | {20: "", 21: "one"}
    assert got == want


# -- tokens
def test_encoding_equals_reference_encoder(spark):
    import tiktoken

    with open(tokenization.default_vocabulary(), "rb") as f:
        data = f.read()
    bpe = tokenization.PrefixBpe(data)
    enc = tiktoken.Encoding("own", pat_str=tokenization.PIECES, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines())}, special_tokens={})
    g = random.Random(5)
    texts = ["", "  ", "<|endoftext|>", "naïve 日本語 🚀🧪\r\n\t", "x" * 3000, " " * 500] + ["".join(g.choice(["ab", " the", "\n", "--", "é", "0", "日", "'s"]) for _ in range(g.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert bpe.encode(t) == enc.encode_ordinary(t)
    for t in texts[6:120]:
        old, last = t.encode(), []
        bpe.extend(last, old)
        i = g.randint(0, len(old))
        j = g.randint(i, len(old))
        now, data2 = bpe.edit(last, old, i, j, b" the new")
        fresh = []
        bpe.extend(fresh, data2)
        assert now == fresh and b"".join(bpe.tokens[x] for x in bpe.read(now)) == data2
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hello world", "c"), (3, "hello world", "c"), (None, " ", "d")], "doc_id bigint, text string, ids string")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in tokenization.encode_texts(df, "doc_id", "text").collect())
    assert got == sorted([("1", []), ("2", []), ("3", enc.encode_ordinary("hello world")), ("3", enc.encode_ordinary("hello world")), ("None", enc.encode_ordinary(" "))])


# -- leaks
def test_leaks_equal_brute_force(spark):
    g = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(g.choice(words) for _ in range(g.choice([12, 30, 60])))) for i in range(20)]
    docs = []
    for d in range(120):
        filler = lambda n: " ".join(g.choice(words) + "x" for _ in range(n))
        k, w = g.choice(items)
        w = w.split()
        n = min(len(w), g.choice([8, 15, 22, 40]))
        start = g.randint(0, len(w) - n)
        part = w[start : start + n]
        if n >= 22 and g.random() < 0.5:
            part[n // 2] = "changed"
        docs.append((d, filler(g.randint(0, 200)) + ". " + g.choice(["{}", "<p>{}</p>", "**{}**", '{{"q": "{}"}}']).format(g.choice([" ", "\n> ", " \\n "]).join(x.upper() for x in part)) + " " + filler(30), n >= min(20, len(w)), k))
    df = spark.createDataFrame([(d, t) for d, t, _, _ in docs] + [(900, None), (901, ""), (None, docs[0][1])] + [(d, t) for d, t, _, _ in docs[:5]], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    ev = spark.createDataFrame([*items, (None, "x"), (99, None), (98, "")], "item_id bigint, prompt string")
    got = {(r[0], r[1]) for r in leakage.leaks(df, ev, "doc_id", "text", "item_id", "prompt").collect()}
    assert got == {(d, k) for d, _, yes, k in docs if yes}
    assert leakage.leaks(df, ev.limit(0), "doc_id", "text", "item_id", "prompt").count() == 0


def test_short_items_blocks_and_containment(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 20)  # several blocks
    g = random.Random(8)
    prose = [f"v{i}" for i in range(5000)]
    long_item = g.sample(prose, 40)
    items = [(1, "hello world"), (2, "Zyzzyva"), (3, "one two three"), (4, " ".join(prose[:9])), (5, " ".join(prose[20:39])), (6, " ".join(long_item)), (6, " ".join(long_item))]
    edited = [*prose[20:30], "new", *prose[30:39]]
    scattered = [w for i in range(0, 38, 2) for w in (*long_item[i : i + 2], f"q{i}")]  # words of an item, but no passage
    docs = [(1, "say HELLO, world!"), (2, "a zyzzyva"), (3, "one two, <b>three</b>"), (4, "x " + " ".join(prose[:9])), (5, " ".join(edited)), (6, "y " * 300 + " ".join(long_item[9:31])), (7, " ".join(scattered)), (8, "hello"), (9, "one two 3"), (10, None)]
    df = spark.createDataFrame(docs, "d bigint, t string")
    ev = spark.createDataFrame(items, "i bigint, p string")
    assert {tuple(r) for r in leakage.leaks(df, ev, "d", "t", "i", "p").collect()} == {(k, k) for k in range(1, 7)}
    index = leakage.Items([(6, " ".join(long_item))])
    have = lambda words: np.unique(leakage.shingles(words, {}))
    assert index.contained(0, have(long_item[5:25])) and not index.contained(0, have(scattered)) and not index.contained(0, have([]))


def test_words_ignore_form():
    want = leakage.words_of("the dirty_parcel bucket lets it survive")
    assert leakage.words_of("<b>The</b> *dirty\\_parcel*\nBUCKET &nbsp; l\u0435ts it, ｓurvive") == want


# -- languages
def test_gradients_are_exact():
    g = np.random.default_rng(0)
    net = language.ByteGru(3, hidden=4)
    x, y = g.integers(0, 256, (5, 7)), g.integers(0, 3, 5)
    x[1, 4:] = 256
    _, grads = net.gradients(x, y)
    for name in net.p:
        index = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept = net.p[name][index]
        at = []
        for step in (0.01, -0.01):
            net.p[name][index] = kept + np.float32(step)
            at.append(net.gradients(x, y)[0])
        net.p[name][index] = kept
        assert (at[0] - at[1]) / 0.02 == pytest.approx(float(grads[name][index]), rel=0.03, abs=1e-4)


def test_prose_and_repairs():
    assert language.sentences("# foldLedger\n\n```c\nint main() {}\n```\n2025-01-01 10:00 INFO code=1\n\nThe old switch is gone; use fooBar_1. See https://x.y/z now please.") == ["The old switch is gone use", "See now please"]
    assert language.repaired("nÃºmeros raros") == "números raros"
    assert language.sentences(None) == [] and language.sentences("  \n`x`") == []


def test_wrong_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "FIRST", 60)
    monkeypatch.setattr(language, "SECOND", 60)
    en = ["The file is read once before the next run.", "It was decided that this stays the way it was.", "Nobody knows why the table was lost."]
    de = ["Die Datei wird nur einmal gelesen, bevor es weitergeht.", "Niemand weiß, warum die Tabelle verschwunden ist.", "Wir sollten das noch einmal gründlich messen."]
    docs = [(i, " ".join(en), "en", 0) for i in range(20)] + [(100 + i, " ".join(de), "de", 0) for i in range(20)]
    docs += [(200, " ".join(en), "German", 0), (201, " ".join(de), " DE-at", 0), (202, " ".join(en + de), "en", 0), (203, " ".join(de), None, 0), (204, " ".join(en) + " " + de[0], "eng", 0), (205, None, None, 0), (206, "```\nx\n```", "xx", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, language int")
    got = sorted(map(tuple, language.wrong_labels(df).collect()))
    assert got == [(200, "en"), (202, "de"), (202, "en"), (203, "de")]
    assert language.wrong_labels(df.limit(0)).count() == 0


def test_reading_equals_the_states_of_training():
    g = np.random.default_rng(1)
    net = language.ByteGru(3, hidden=5)
    x = g.integers(0, 256, (6, 9))
    x[2, 3:] = x[4, 8:] = 256
    assert np.allclose(net.read(x), net.states(x), atol=1e-5)


def test_rare_labels_are_learnt_if_their_words_are_their_own():
    en = ["the file is read once before the next run"] * 50
    pl = ["plik jest czytany tylko raz przed nastepnym uruchomieniem"] * 4
    assert language.learnable({"en": en, "pl": pl, "sv": en[:4]}, {"en"}) == ["en", "pl"]
    ja = ["毎晩の処理は古い行を削除する", "処理は新しい表を作る"] * 20
    assert language.learnable({"ja": ja, "ko": ja[:3], "zh": ["我们需要更多的时间来完成这个任务"]}, {"ja"}) == ["ja", "zh"]


def test_a_rare_language_is_answered_and_weights_are_kept(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(language, "FIRST", 60)
    monkeypatch.setattr(language, "SECOND", 80)
    en = "The file is read once before the next run. It was decided that this stays the way it was. Nobody knows why the table was lost."
    pl = "Plik jest czytany tylko raz przed kolejnym uruchomieniem. Nikt nie wie dlaczego tabela została utracona. Trzeba to jeszcze dokładnie zmierzyć."
    docs = [(i, en, "en") for i in range(1200)] + [(2000 + i, pl, "pl") for i in range(5)] + [(3000, pl, None), (3001, en, "sv")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    assert 5 < language.COMMON_SHARE * 1200
    kept = str(tmp_path / "weights")
    got = {(r["doc_id"], r["language"]): r["confidence"] for r in language.document_languages(df, weights=kept).where("doc_id >= 2000").collect()}
    assert set(got) == {(i, "pl") for i in (*range(2000, 2005), 3000)} | {(3001, "en")} and min(got.values()) > 0.5
    names, net = language.fit(df, "doc_id", "text", "lang")
    monkeypatch.setattr(language, "train", None)  # it must be read, not trained
    again = language.fit(df, "doc_id", "text", "lang", kept)
    assert again[0] == names and all(np.array_equal(again[1]["p"][k], v) for k, v in net["p"].items())


def test_registered_queries_run(spark, sf):
    from lodespark.llm.queries import QUERIES

    for name in ("p2_found", "p3_found", "p3_rates", "p6_found", "p7_ids", "p8_found"):
        assert QUERIES[name](spark, sf).count() > 0, name


def test_flows_equal_sql(spark, sf):
    from lodespark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW ranked_items AS SELECT * FROM '{sf}/ranked_items.parquet'")
    got = {(r[0], r[1]): (r[2], r[3]) for r in QUERIES["p2_flows"](spark, sf).collect()}
    want = {(r[0], r[1]): (r[2], r[3]) for r in con.execute(ORACLES["p2_flows"]).fetchall()}
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0], abs=2e-6) and got[k][1] == want[k][1] for k in want)
