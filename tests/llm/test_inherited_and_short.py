"""Inherited documentation and short evaluation items."""

from lodespark.llm import docpairs, leakage


def changed(words, *where):
    return [f"other{i}" if i in where else w for i, w in enumerate(words)]


def test_pairs_inherit_where_own_text_tells_nothing(spark):
    body = "class A {\n void run() {}\n}\nclass B<T>\n    extends A\n    implements I,\n      J\n{\n void run() {}\n void go() {}\n}\ninterface J {\n void go();\n}\nclass C extends A {\n"
    own = ["/** */", "{@inheritDoc}\n@param a", "@param a\n@return b", "TODO", None, "  "]
    rows = [(1, "A.run", 2, "Runs it."), (2, "J.go", 13, "Goes on."), (3, "B.go", 10, "/** */"), *[(10 + i, "B.run" if i % 2 else "C.run", 9, d) for i, d in enumerate(own)]]
    symbols = spark.createDataFrame([(i, 1, "method", q.split(".")[1], q, n, n, d) for i, q, n, d in rows], "id bigint, file_id bigint, kind string, name string, qualname string, line_start int, line_end int, docstring string")
    files = spark.createDataFrame([(1, "r/A.java", body)], "file_id bigint, path string, body string")
    got = {r["symbol_id"]: r["doc_from"] for r in docpairs.pairs(symbols, files).collect()}
    assert got == {1: 1, 2: 2, 3: 2} | {10 + i: 1 for i in range(len(own))}
    assert {(r["cls"], r["base"]) for r in docpairs.class_bases(files).collect()} == {("B", "A"), ("B", "I"), ("B", "J"), ("C", "A")}


def test_longest_passage_chains_single_words():
    item = [f"w{i}" for i in range(24)]
    at = leakage._positions(item)
    for n, where in ((24, (11, 13)), (20, (1,)), (21, (1,)), (20, (18,)), (24, (1, 3)), (24, (20, 22))):
        assert leakage.longest_passage(item[:n], leakage._positions(item[:n]), ["x", *changed(item[:n], *where), "y"], 20) >= 20, (n, where)
    for doc in (item[:17] + ["w18"], changed(item, 5, 11, 17), item[:10] + ["x", "x", "x"] + item[10:20], item[:12] + item[13:15]):
        assert leakage.longest_passage(item, at, doc, 20) < 20


def test_leaks_find_short_items(spark):
    w = [f"w{i}" for i in range(60)]
    items = {1: ["alone"], 2: ["two", "words"], 3: w[:3], 4: w[10:25], 5: w[30:41]}
    docs = {
        1: ["alone"], 2: ["a", "two", "words"], 3: ["words", "two"], 4: [*"abcdefghijklmnopqrstuvwxyz", *w[:3], *"abcdefghijklmnopqrstuvwxyz"],
        5: ["a", *changed(w[10:25], 2), "b"], 6: ["a", *changed(w[10:25], 12), "b"], 7: changed(w[10:25], 3, 12), 8: w[30:41], 9: changed(w[30:41], 5), 10: w[10:17] + ["x"] + w[17:25],
    }
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in docs.items()], "doc_id bigint, text string")
    ev = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id bigint, prompt string")
    got = {tuple(r) for r in leakage.leaks(df, ev, "doc_id", "text", "item_id", "prompt").collect()}
    assert got == {(1, 1), (2, 2), (4, 3), (5, 4), (6, 4), (8, 5), (10, 4)}
