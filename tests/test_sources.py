import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodespark.operators import codeflow
from lodespark.sources import headers, logs, parsed, resolve, tree
from lodespark.sources.outline import LANGUAGES, outline

# What each language's source declares: (kind, qualified name, first line, last line).
CASES = {
    "javascript": (
        "import a from './x';\nimport {b}\n  from \"y\";\n// Adds.\nexport function add(a, b) {\n  return f(a);\n}\nconst g = async (x) => {\n  h(x)\n}\nclass A extends B {\n  /** Runs. */\n  async run(x) { this.y(/[({]/.test(x)) }\n  get z() { return 1 }\n}\n/* function no() {} */\nconst s = 'function nope() {}'\nvar k = function () { }\n",
        [("function", "add", 5, 7), ("function", "g", 8, 10), ("class", "A", 11, 15), ("method", "A.run", 13, 13), ("method", "A.z", 14, 14), ("function", "k", 18, 18)],
        ["./x", "y"],
    ),
    "typescript": (
        "export interface I { m(x: number): string; n?: number }\nexport type T<X> = { a: X } | null;\nenum E { A }\nexport abstract class C<T> implements I {\n  constructor(private x: T) { super() }\n  private async q<U>(a: U): Promise<{ a: U }> {\n    return null\n  }\n}\nexport const fn = <T,>(x: T): T => x;\n",
        [("interface", "I", 1, 1), ("method", "I.m", 1, 1), ("type", "T", 2, 2), ("enum", "E", 3, 3), ("class", "C", 4, 9), ("method", "C.constructor", 5, 5), ("method", "C.q", 6, 8), ("function", "fn", 10, 10)],
        [],
    ),
    "go": (
        "package p\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\nimport \"os\"\ntype P[T any] struct {\n\ta int\n}\ntype (\n\tQ interface { F() }\n\tR int\n)\nfunc (p *P[T]) Run(a int) (int, error) {\n\treturn 1, nil\n}\nfunc main() {\n}\n",
        [("struct", "P", 8, 10), ("interface", "Q", 12, 12), ("type", "R", 13, 13), ("method", "P.Run", 15, 17), ("function", "main", 18, 19)],
        ["fmt", "a/b", "os"],
    ),
    "java": (
        "package a;\nimport static java.util.List.*;\nimport a.B;\n@X(1)\npublic final class A<T> extends B {\n  private int x = f(1);\n  public A(int x) { this.x = x; }\n  @Override\n  public <R> R run(Map<String, List<T>> m) throws E {\n    g(); return null;\n  }\n  interface In { void q(); }\n  enum E { P(1) { }, Q; int z() { return 1; } }\n}\n",
        [("class", "A", 4, 14), ("constructor", "A.A", 7, 7), ("method", "A.run", 8, 11), ("interface", "A.In", 12, 12), ("method", "A.In.q", 12, 12), ("enum", "A.E", 13, 13), ("method", "A.E.z", 13, 13)],
        ["java.util.List", "a.B"],
    ),
    "rust": (
        "use std::{fmt, io};\nuse a::b::C;\npub struct A<'a>(&'a str);\nimpl<'a> A<'a> {\n    pub fn new(x: &'a str) -> Self { Self(x) }\n}\nimpl fmt::Display for A<'_> {\n    fn fmt(&self) -> R { write!(f, \"x\") }\n}\npub trait T { fn q(&self); }\nfn main() { let c = 'x'; }\n",
        [("struct", "A", 3, 3), ("method", "A.new", 5, 5), ("method", "A.fmt", 8, 8), ("trait", "T", 10, 10), ("method", "T.q", 10, 10), ("function", "main", 11, 11)],
        ["std", "a::b::C"],
    ),
    "c": ("#include <a.h>\n#define X(a) \\\n  foo(a) {\nstatic int add(int a, int b)\n{\n  return f(a);\n}\nint decl(void);\nSYSCALL_DEFINE2(foo, int, a)\n{\n}\n", [("function", "add", 4, 7), ("function", "foo", 9, 11)], []),
    "cpp": (
        "#include \"a/b.hpp\"\n#include <vector>\nnamespace n {\nclass A : public B {\npublic:\n  A(int x) : x_(x) {}\n  ~A();\n  int run() const override { return 1; }\nprivate:\n  int x_ = 0;\n};\nint A::go(int a) { return a; }\nenum class E { P };\ntypedef unsigned int u;\nunion U { int a; };\n}\n",
        [("class", "A", 4, 11), ("constructor", "A.A", 6, 6), ("destructor", "A.~A", 7, 7), ("method", "A.run", 8, 8), ("method", "A.go", 12, 12), ("enum", "E", 13, 13), ("typedef", "u", 14, 14), ("union", "U", 15, 15)],
        ['"a/b.hpp"', "vector"],
    ),
    "csharp": (
        "using System.Text;\nnamespace N {\n  public class A : B {\n    public A() {}\n    public int X { get; set; }\n    public async Task<int> Run(int a) { return 1; }\n    public int Y() => 3;\n    delegate void D(int a);\n  }\n  public record R(int A);\n}\n",
        [("class", "A", 3, 9), ("constructor", "A.A", 4, 4), ("property", "A.X", 5, 5), ("method", "A.Run", 6, 6), ("method", "A.Y", 7, 7), ("delegate", "A.D", 8, 8), ("record", "R", 10, 10)],
        ["System.Text"],
    ),
    "kotlin": (
        "package a\nimport a.b.C\ndata class A(val x: Int) : B(x) {\n  constructor(y: String) : this(1) { }\n  fun run(a: Int): Int = a + 1\n}\nobject O { fun f() {} }\nfun String.ext(): Int { return 1 }\ntypealias X = Int\n",
        [("class", "A", 3, 6), ("constructor", "A.A", 4, 4), ("method", "A.run", 5, 5), ("object", "O", 7, 7), ("method", "O.f", 7, 7), ("function", "ext", 8, 8), ("typealias", "X", 9, 9)],
        ["a.b.C"],
    ),
    "dart": (
        "import 'package:a/b.dart';\nclass A extends B {\n  A(this.x);\n  A.named();\n  int get y => 1;\n  set y(int v) { }\n  void run(int a) { f(); }\n}\nmixin M {}\ntypedef F = int Function(int);\nint top(int a) => a;\n",
        [("class", "A", 2, 8), ("constructor", "A.A", 3, 3), ("constructor", "A.named", 4, 4), ("getter", "A.y", 5, 5), ("setter", "A.y", 6, 6), ("method", "A.run", 7, 7), ("mixin", "M", 9, 9), ("typedef", "F", 10, 10), ("function", "top", 11, 11)],
        ["package:a/b.dart"],
    ),
    "php": (
        "<?php\nnamespace A\\B;\nuse C\\D as E;\nuse F\\{G, H};\nrequire_once __DIR__ . '/x.php';\nclass A extends B {\n  public function run(int $a): ?int { return f($a); }\n}\ntrait T {}\nfunction top() { }\n",
        [("class", "A", 6, 8), ("method", "A.run", 7, 7), ("trait", "T", 9, 9), ("function", "top", 10, 10)],
        ["C\\D", "F\\G", "F\\H", "/x.php"],
    ),
    "ruby": (
        "require 'a'\nrequire_relative 'b/c'\nmodule M\n  class A < B\n    X = 1\n    def run(a)\n      if a\n        f(a)\n      end\n      list.each do |x|\n        g x\n      end\n    end\n  end\nend\ndef top; end\n",
        [("module", "M", 3, 15), ("class", "M.A", 4, 14), ("const", "M.A.X", 5, 5), ("method", "M.A.run", 6, 13), ("function", "top", 16, 16)],
        ["a", "./b/c"],
    ),
    "powershell": (
        "using module Foo\nImport-Module Bar\n. ./x.ps1\nfunction Get-X {\n  param($a)\n}\nfilter F { }\nclass C {\n  C() { }\n  [int] Run([int]$a) { return 1 }\n}\nenum E { A }\n",
        [("function", "Get-X", 4, 6), ("filter", "F", 7, 7), ("class", "C", 8, 11), ("constructor", "C.C", 9, 9), ("method", "C.Run", 10, 10), ("enum", "E", 12, 12)],
        ["Foo", "Bar", "./x.ps1"],
    ),
    "bash": ("source ./a.sh\n. b.sh\nfoo() {\n  cat <<'E'\n}} (\nE\n  inner() { :; }\n  case $# in 1) x ;; esac\n}\nfunction bar { echo; }\n", [("function", "foo", 3, 9), ("method", "foo.inner", 7, 7), ("function", "bar", 10, 10)], ["./a.sh", "b.sh"]),
    "sql": ("-- Users.\nCREATE TABLE IF NOT EXISTS a.users (id int);\ncreate or replace function f() returns int as $$ begin;\n return 1; end $$ language plpgsql;\ncreate unique index i on t(x);\n", [("table", "a.users", 2, 2), ("function", "f", 3, 4), ("index", "i", 5, 5)], []),
    "graphql": (
        "\"\"\"Doc\"\"\"\ntype A implements B & C {\n  x(a: Int): [String!]!\n}\nenum E { P Q }\nunion U = A | B\nscalar Date\ndirective @d(a: Int) on FIELD\nquery Q($a: Int) { x }\n",
        [("type", "A", 2, 4), ("field", "A.x", 3, 3), ("enum", "E", 5, 5), ("enum_value", "E.P", 5, 5), ("union", "U", 6, 6), ("scalar", "Date", 7, 7), ("directive", "d", 8, 8), ("query", "Q", 9, 9)],
        [],
    ),
    "css": ("@import url('x.css');\n:root { --a: 1px; }\n.b, .c > d { color: var(--a); }\n@keyframes k { from { } to { } }\n", [("rule", ":root", 2, 2), ("variable", "--a", 2, 2), ("rule", ".b, .c > d", 3, 3), ("keyframes", "k", 4, 4)], ["x.css"]),
    "html": ("<title>Hi <b>x</b></title>\n<!-- <div id=no> -->\n<div id=\"a\"><my-tag></my-tag><input name='n'></div>\n<script src=\"x.js\"></script><link rel=x href='y.css'>\n", [("title", "Hi x", 1, 1), ("anchor", "#a", 3, 3), ("component", "my-tag", 3, 3), ("control", "n", 3, 3)], ["x.js", "y.css"]),
    "python": ("'''Mod doc.'''\nimport a.b, c\nfrom .d import e\n@app.route('/x')\ndef f():\n    '''Doc.'''\n    def inner(): pass\nclass A(B):\n    def m(self): os.environ['K']\n", [("function", "f", 5, 7), ("class", "A", 8, 9), ("method", "A.m", 9, 9)], ["a.b", "c", ".d"]),
}


def test_every_language_has_a_case():
    assert set(CASES) == set(LANGUAGES) == set(tree.LANGUAGE_BY_EXTENSION.values())


@pytest.mark.parametrize("language", sorted(CASES))
def test_outline(language):
    text, want, modules = CASES[language]
    for source in (text, text.replace("\n", "\r\n")):
        got = outline(language, source)
        found = [(s.kind, s.qualname, s.line_start, s.line_end) for s in got.symbols]
        assert [x for x in found if x in want] == want, found
        assert not {x[1] for x in found} & {"no", "nope", "decl", "#no", "X", "add.f", "inner"} or language in ("bash", "kotlin", "ruby", "python")
        assert [m for m, _ in got.imports] == modules
    for at in range(0, len(text), 5):  # damaged texts give an outline, too
        outline(language, text[:at])
        outline(language, text[at:])


def test_docs_calls_and_triggers():
    got = outline("python", CASES["python"][0])
    assert got.doc == "Mod doc." and got.symbols[0].doc == "Doc."
    assert sorted((k, t, line) for k, t, _, line in got.triggers) == [("env", "K", 9), ("route", "/x", 5)]
    got = outline("javascript", CASES["javascript"][0])
    assert [s.doc for s in got.symbols][:4] == ["Adds.", None, None, "Runs."]
    assert [c for c, _ in got.calls] == ["f", "h", "y", "test"]
    got = outline("typescript", "@Controller('/u')\nclass D {\n  @Get('/x')\n  find() { return process.env.HOME }\n}\napp.get('/y', f)\n")
    assert {(k, t) for k, t, _, _ in got.triggers} == {("route", "/u"), ("route", "/x"), ("env", "HOME"), ("route", "/y")}
    assert outline(None, "x").symbols == outline("go", None).symbols == outline("cobol", "x").symbols == []


def test_symbols_agree_with_the_index(sf):
    """Names and spans of the index, which come from elsewhere, on sources without damage."""
    ext = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c"}
    bodies = {r["file_id"]: r for r in pq.read_table(f"{sf}/fts_files.parquet").to_pylist()}
    total = same = 0
    cache = {}
    for r in pq.read_table(f"{sf}/ci_symbols.parquet", columns=["file_id", "name", "kind", "line_start", "line_end"]).to_pylist():
        f = bodies.get(r["file_id"])
        language = f and ext.get(f["path"].rsplit(".", 1)[-1].lower())
        if not language or not f["body"] or (r["kind"] or "").strip().lower() not in ("function", "method", "class", "struct"):
            continue
        if r["file_id"] not in cache:
            cache[r["file_id"]] = {(s.name, s.line_start, s.line_end) for s in outline(language, f["body"]).symbols}
        total += 1
        same += (r["name"], r["line_start"], r["line_end"]) in cache[r["file_id"]]
    assert total > 50 and same >= 0.93 * total  # some sources are damaged


def test_parsed_sources_call_graph_and_wiring(spark):
    files = spark.createDataFrame(
        [(1, "python", "def a():\n    b()\n    c()\n    d()\n"), (1, "python", "def a():\n    b()\n    c()\n    d()\n"), (2, "python", "def b():\n    pass\n\n@cli.command('run')\ndef c():\n    pass\n"), (3, "python", "def c():\n    pass\ndef d(): pass\n"), (4, "python", "def d(): pass\n"), (5, None, None), (None, "go", "x")],
        "file_id bigint, language string, body string",
    ).withColumn("symbols", F.lit("clash"))
    p = parsed.read(files)
    sy = parsed.symbols(p).withColumn("id", F.col("file_id") * 10 + F.col("line_start"))
    assert {(r["file_id"], r["name"]) for r in sy.collect()} == {(1, "a"), (2, "b"), (2, "c"), (3, "c"), (3, "d"), (4, "d")}
    known = spark.createDataFrame([(1, 2), (1, 1)], "src bigint, dst bigint")
    got = codeflow.resolved_calls(parsed.calls(p), sy, known)
    assert {r["name"]: (r["symbol_id"], r["tier"]) for r in got.where("file_id = 1").collect()} == {"b": (21, "T1"), "c": (25, "T2"), "d": (None, "T3")}
    graph = codeflow.call_graph(got, sy)
    assert {(r["caller"], r["callee"], r["tier"]) for r in graph.where("file_id = 1").collect()} == {(11, 21, "T1"), (11, 25, "T2")}
    wired = codeflow.wiring(parsed.triggers(p), sy).collect()
    assert [(r["kind"], r["trigger"], r["handler"]) for r in wired] == [("cli", "run", 25)]
    assert parsed.read(files.limit(0)).count() == 0


def test_hierarchy_and_overrides(spark):
    bases = spark.createDataFrame([("r", "B", "A"), ("r", "C", "B"), ("r", "A", "C"), ("q", "Z", "A"), ("r", "D", "A")], "repo string, cls string, base string")
    asked = spark.createDataFrame([("r", "A")], "repo string, cls string")
    down = codeflow.hierarchy(bases, asked)
    assert {(r["cls"], r["depth"]) for r in down.collect()} == {("B", 1), ("D", 1), ("C", 2)}
    assert {r["cls"] for r in codeflow.hierarchy(bases, asked.replace("A", "D"), down=False).collect()} == {"A", "B", "C"}
    methods = spark.createDataFrame([("r", "A", "f"), ("r", "B", "f"), ("r", "B", "g"), ("r", "C", "g"), ("q", "Z", "f")], "repo string, cls string, name string")
    assert [(r["root"], r["cls"], r["name"]) for r in codeflow.overrides(down, methods).collect()] == [("A", "B", "f")]
    files = spark.createDataFrame([("r/a.java", "class A extends B implements C {}"), ("r/b.ts", "class X:\n  def y"), (None, "class A extends Z {}")], "path string, body string")
    assert {tuple(r) for r in headers.class_bases(files).collect()} == {("r", "A", "B"), ("r", "A", "C")}


IMPORTS = [
    # language, from, module, target, resolution
    ("typescript", "web/src/a.ts", "./util", "web/src/util.ts", "internal"),
    ("typescript", "web/src/a.ts", "./util.js", "web/src/util.ts", "internal"),
    ("typescript", "web/src/a.ts", "../lib", "web/lib/index.tsx", "internal"),
    ("typescript", "web/src/a.ts", "./nope", None, "unresolved"),
    ("typescript", "web/src/a.ts", "@app/util", "web/src/util.ts", "internal"),
    ("typescript", "web/src/a.ts", "@app/gone", None, "unresolved"),
    ("typescript", "web/src/a.ts", "our-lib/deep", "pkg/src/deep.ts", "internal"),
    ("typescript", "web/src/a.ts", "react", None, "external"),
    ("python", "py/x.py", "core.log", "py/core/log.py", "internal"),
    ("python", "py/x.py", "dup", None, "unresolved"),
    ("python", "py/x.py", "os.path", None, "external"),
    ("java", "j/src/X.java", "com.acme.Widget", "j/src/com/acme/Widget.java", "internal"),
    ("java", "j/src/X.java", "com.acme.Widget.make", "j/src/com/acme/Widget.java", "internal"),
    ("java", "j/src/X.java", "java.util.List", None, "external"),
    ("rust", "rs/src/net/tcp.rs", "crate::config::Settings", "rs/src/config.rs", "internal"),
    ("rust", "rs/src/net/tcp.rs", "super::shared", "rs/src/shared/mod.rs", "internal"),
    ("rust", "rs/src/net/tcp.rs", "super::*", "rs/src/net/tcp.rs", "internal"),
    ("rust", "rs/src/net/tcp.rs", "crate::gone", None, "unresolved"),
    ("rust", "rs/src/net/tcp.rs", "serde", None, "external"),
    ("go", "g/cmd/main.go", "acme.io/g/store", "g/store/a.go", "internal"),
    ("go", "g/cmd/main.go", "fmt", None, "external"),
    ("ruby", "rb/a.rb", "./lib/b", "rb/lib/b.rb", "internal"),
    ("cpp", "c/src/m.cpp", '"util/h.hpp"', "c/include/util/h.hpp", "internal"),
    ("cpp", "c/src/m.cpp", "vector", None, "external"),
    ("kotlin", "k/Main.kt", "com.acme.store.Box", "k/com/acme/store/S.kt", "internal"),
    ("php", "p/index.php", "App\\Model\\User", "p/src/Model/User.php", "internal"),
    ("php", "p/index.php", "Other\\Lonely", "p/x/Lonely.php", "internal"),
    (None, None, None, None, "external"),
]


def test_import_resolution_by_language(spark):
    paths = sorted({t for *_, t, _ in IMPORTS if t} | {f for _, f, *_ in IMPORTS if f} | {"py/a/dup.py", "py/b/dup.py", "g/store/a_test.go", "g/store/b.go"})
    files = spark.createDataFrame([(i, p if i % 2 else "./" + p) for i, p in enumerate(paths)], "id bigint, path string")
    conf = resolve.project_config([
        ("web/tsconfig.json", '{"extends": "./base.json", // c\n }'), ("web/base.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"],}}}'), ("pkg/package.json", '{"name": "our-lib"}'),
        ("g/go.mod", "module acme.io/g\n"), ("rs/Cargo.toml", ""), ("p/composer.json", '{"autoload": {"psr-4": {"App\\\\": "src/"}}}'), ("bad/package.json", "{"),
    ])
    rows = [(n, f, lang, m) for n, (lang, f, m, _, _) in enumerate(IMPORTS)]
    got = {r["import_id"]: (r["target_id"], r["resolution"]) for r in resolve.resolve(spark.createDataFrame(rows + rows[:3], "import_id bigint, from_path string, language string, module string"), files, conf).collect()}
    number = {p: i for i, p in enumerate(paths)}
    for n, (lang, f, m, t, res) in enumerate(IMPORTS):
        assert got[n] == (number.get(t), res), (lang, m, got[n])


def test_tree_with_nested_ignore_files(spark, tmp_path):
    for name, body in {
        "a/x.py": "def f():\n    pass\n", "a/y.log": "x", "build/z.py": "1", "b/keep.py": "1", "b/gen/w.py": "2", "a/sub/.gitignore": "*.py\n!ok.PY\n", "a/sub/no.py": "1", "a/sub/ok.PY": "1",
        ".gitignore": "/a/gone/\n*.tmp.ts\n", "a/gone/q.py": "1", "b/a.tmp.ts": "1", "b/a.ts": "1", "node_modules/m/i.js": "1", "b/c.pyc": "1",
    }.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(body)
    got = tree.read_tree(spark, str(tmp_path), ["b/gen/*", "# no rule", ""])
    assert sorted((r["path"], r["language"]) for r in got.collect()) == [("a/sub/ok.PY", "python"), ("a/x.py", "python"), ("b/a.ts", "typescript"), ("b/keep.py", "python")]
    folders, _ = tree.folders_below(spark, str(tmp_path))
    assert not any("node_modules" in f or f.startswith("build") for f in folders)


def test_commit_logs(spark, tmp_path):
    log = "\x01s1\x1f1700000000\x1fAnn\x1fAdd: x\n\na.py\nb.py\na.py\n\x01s2\x1f1700000100\x1fBob\x1fsub\x1fject\n\x01broken\n"
    (tmp_path / "log.txt").write_text(log)
    got = {r["sha"]: r for r in logs.read_commits(spark, str(tmp_path / "log.txt")).collect()}
    assert set(got) == {"s1", "s2"} and got["s1"]["paths"] == ["a.py", "b.py"] and got["s2"]["subject"] == "sub\x1fject" and got["s2"]["paths"] == []
    known = spark.createDataFrame([("web\x01s1",)], "sha string")
    new = logs.new_commits(logs.read_commits(spark, str(tmp_path / "log.txt")), known, "web").collect()
    assert [(r["sha"], r["paths"]) for r in new] == [("web\x01s2", [])]
    baskets = logs.commit_baskets(logs.read_commits(spark, str(tmp_path / "log.txt")))
    assert sorted((r["basket"], r["item"]) for r in baskets.collect()) == [("s1", "a.py"), ("s1", "b.py")]
    for d in ("x/.git", "y/z/.git", "y/z/in/.git", "node_modules/q/.git", "a/b/c/d/.git"):
        os.makedirs(tmp_path / "ws" / d)
    repos = logs.repositories(str(tmp_path / "ws"))
    assert repos == ["x", "y/z"]
    df = spark.createDataFrame([("x/a.py",), ("y/z/in/b",), ("q",)], "p string")
    assert [r[0] for r in df.select(logs.repository_of(F.col("p"), repos)).collect()] == ["x", "y/z", None]


def test_working_tree_transcripts_and_sets(spark, tmp_path):
    lines = spark.createDataFrame([(" M a.py",), ("R  old.py -> new.py",), ('?? "sp ace.py"',), ("",), ("garbage",)], "value string")
    assert {tuple(r) for r in logs.working_tree(lines).collect()} == {("M", "a.py"), ("R", "new.py"), ("??", "sp ace.py")}
    t = spark.createDataFrame(
        [("t", 1, '{"type":"assistant","message":{"content":"old"}}'), ("t", 2, '{"type":"assistant","message":{"content":[{"type":"text","text":"a"},{"type":"tool"},{"type":"text","text":"b"}]}}'), ("t", 3, '{"type":"user"}'), ("t", 4, "no json"), ("u", 1, "{}")],
        "transcript string, line int, value string",
    )
    assert [tuple(r) for r in logs.last_reply(t).collect()] == [("t", "a\nb")]
    (tmp_path / "set.jsonl").write_text('# c\n\n{"prompt": "p", "expected_files": ["a"]}\n')
    assert [tuple(r) for r in logs.evaluation_set(spark, str(tmp_path / "set.jsonl")).collect()] == [("p", ["a"])]
    (tmp_path / "bad.jsonl").write_text('{"prompt": "", "expected_files": []}\n')
    with pytest.raises(ValueError):
        logs.evaluation_set(spark, str(tmp_path / "bad.jsonl"))
    replies = spark.createDataFrame([(1, "see src/a.py and b.py, dup.py, src/none.py"), (2, None)], "reply_id bigint, body string")
    files = spark.createDataFrame([("src/a.py",), ("lib/b.py",), ("x/dup.py",), ("y/dup.py",)], "path string")
    assert {tuple(r) for r in logs.cited_paths(replies, files).collect()} == {(1, "src/a.py"), (1, "lib/b.py")}
