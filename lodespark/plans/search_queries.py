"""Queries of search, navigation and the architecture of the import graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.functions import text
from lodespark.operators import graph, mining, navigation, search, wholesearch
from lodespark.plans.core_oracles import BM25, NODES, PR, _r
from lodespark.plans.core_queries import _edges
from lodespark.plans.rank_queries import _FINE, _cos, _files, _symbols
from lodespark.session import cut, scratch_path, table


def _found(s: SparkSession, df: DataFrame, names, k: int) -> DataFrame:
    """Every row whose id is divisible by 20 is searched by its first name and vector."""
    rows = df.where(F.size("vec") == 64).select("id", "vec", F.array(*names).alias("names"), names[0].alias("text"))
    got = wholesearch.search(rows.where("id % 20 = 0").select(F.col("id").alias("query"), "text", "vec"), rows, k)
    return got.select("query", "id", F.round(F.col("sim") + 1e-9, 6).alias("sim"), F.col("tier").cast("bigint").alias("tier"), F.col("place").cast("bigint").alias("place"))


def search_files(s: SparkSession, sf: str) -> DataFrame:
    f = table(s, sf, "ci_files").select("id", text.plain_path(F.col("path")).alias("path"), F.col("embedding").alias("vec"))  # the search takes each row once
    return _found(s, f, [navigation.file_stem(F.col("path")), text.base_name(F.col("path")), F.col("path")], 8)


def search_symbols(s: SparkSession, sf: str) -> DataFrame:
    return _found(s, _symbols(s, sf), [F.col("name"), F.col("qualname")], 10)


def symbol_detail(s: SparkSession, sf: str) -> DataFrame:
    sy = _symbols(s, sf)
    return search.symbol_detail(sy.select(F.col("id").alias("ask"), "file_id", "name").distinct(), sy)


def _tests(s: SparkSession, sf: str) -> DataFrame:
    f = table(s, sf, "ci_files")
    return cut(navigation.find_tests(f, f, table(s, sf, "ci_imports").select("id", "from_file_id", "to_file_id")))


def file_neighbours(s: SparkSession, sf: str) -> DataFrame:
    f = _files(s, sf).select("id", "path").distinct()
    i = table(s, sf, "ci_imports").where("resolution = 'internal'").select("from_file_id", "to_file_id")
    return search.file_neighbours(f, f, i, _tests(s, sf)).select("file_id", "kind", "other", F.col("place").cast("bigint").alias("place"))


def module_graph(s: SparkSession, sf: str) -> DataFrame:
    """The edges around the smallest node."""
    e = _edges(s, sf)
    root = e.agg(F.min("src")).first()[0]
    return search.module_graph(e, root if root is not None else -1, 2, 100)[1]


def changed_context(s: SparkSession, sf: str) -> DataFrame:
    f = table(s, sf, "ci_files")
    changed = f.select("path", F.when(F.col("id") % 3 == 0, "A").otherwise("M").alias("status"))
    got = search.changed_context(changed, f, table(s, sf, "ci_symbols"), _tests(s, sf))
    return got.select("path", "status", F.array_join("symbols", ",").alias("symbols"), F.array_join("tests", ",").alias("tests"))


def bm25_kept(s: SparkSession, sf: str) -> DataFrame:
    """Ranked from a kept index that takes up the texts in two versions."""
    index = search.TextIndex(s, scratch_path(s, "terms"))
    f = table(s, sf, "fts_files").select(F.col("file_id").alias("id"), F.sha2("body", 256).alias("hash"), "body")
    index.sync(f.where("id % 2 = 0"), 1)
    index.sync(f, 2)
    return index.bm25(["return", "items", "catch"]).select("id", F.round(F.col("score") + 1e-9, 6).alias("score"))


def reverse_pagerank(s: SparkSession, sf: str) -> DataFrame:
    return graph.sinks(_edges(s, sf)).select("node", F.round(F.col("rank") + 1e-9, 7).alias("rank"))


def architecture(s: SparkSession, sf: str) -> DataFrame:
    got = graph.architecture(_edges(s, sf), _files(s, sf).select("id", "path"))
    return got.select("section", F.col("place").cast("bigint").alias("place"), "name", F.round(F.col("value") + 1e-9, 6).alias("value"))


def ripple(s: SparkSession, sf: str) -> DataFrame:
    """What a change of the files divisible by 20 may touch; files that are imported together stand for those that change together."""
    e = _edges(s, sf)
    i = table(s, sf, "ci_imports").where("resolution = 'internal'").select(F.col("from_file_id").alias("basket"), F.col("to_file_id").alias("item"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("at"))
    partners = mining.cochange(i, F.lit("2025-01-01 00:00:00").cast("timestamp")).select("src", "dst")
    got = graph.ripple(e, e.select(F.col("dst").alias("node")).where("node % 20 = 0"), _tests(s, sf), partners)
    return got.select("node", F.col("hop").cast("bigint").alias("hop"), F.array_join("evidence", ",").alias("evidence"))


QUERIES = {
    f.__name__: f
    for f in (search_files, search_symbols, symbol_detail, file_neighbours, module_graph, changed_context, bm25_kept, reverse_pagerank, architecture, ripple)
}


def _searched(rows: str, names: list[str], k: int) -> str:
    toks = "list_filter(list_distinct(string_split_regex(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')), lambda x: x <> '')"
    tier = ", ".join(
        f"CASE WHEN {n} IS NULL OR {n} = '' THEN 0 WHEN lower({n}) = lower(ident) THEN 3 WHEN ends_with(lower({n}), '.' || lower(ident)) THEN 2 WHEN len(it) > 0 AND len(list_intersect(it, {toks.format(n)})) = len(it) THEN 1 ELSE 0 END" for n in names
    )
    return f"""WITH {rows}, q AS (SELECT id AS query, v AS qv, CASE WHEN regexp_full_match(trim({names[0]}), '[A-Za-z_][A-Za-z0-9_.]*') THEN trim({names[0]}) END AS ident FROM r WHERE id % 20 = 0),
q2 AS (SELECT *, {toks.format("ident")} AS it FROM q), x AS (SELECT query, id, {_cos("v", "qv")} AS sim, CASE WHEN ident IS NULL THEN 0 ELSE greatest({tier}) END AS tier FROM r, q2),
y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS i FROM x), z AS (SELECT *, CASE WHEN tier BETWEEN 1 AND 2 THEN row_number() OVER (PARTITION BY query ORDER BY (tier BETWEEN 1 AND 2) DESC, tier DESC, i) END AS j FROM y)
SELECT query, id, {_r("sim", "sim")}, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY query ORDER BY tier = 3 DESC, CASE WHEN tier = 3 THEN -i::DOUBLE ELSE 1.0::DOUBLE / (60 + i) + coalesce(1.0::DOUBLE / (60 + j), 0) END DESC, i) AS place FROM z QUALIFY place <= {k}"""


ORACLES = {
    "search_files": _searched(
        f"r AS (SELECT DISTINCT id, regexp_replace(path, '^(\\./)+', '') AS path, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, embedding AS v FROM ci_files WHERE {_FINE.format('embedding')})", ["stem", "name", "path"], 8
    ),
    "search_symbols": _searched(f"r AS (SELECT DISTINCT id, name, qualname, embedding AS v FROM ci_symbols WHERE {_FINE.format('embedding')})", ["name", "qualname"], 10),
    "symbol_detail": """WITH s AS (SELECT DISTINCT id, file_id, name, qualname, line_start FROM ci_symbols)
SELECT a.id AS ask, b.id AS symbol_id FROM s a JOIN s b ON a.file_id = b.file_id AND (b.name = a.name OR b.qualname = a.name) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY coalesce(b.qualname = a.name, false) DESC, b.line_start, b.id) = 1""",
    "bm25_kept": BM25,
    "reverse_pagerank": f"WITH {NODES.replace('from_file_id AS src, to_file_id AS dst', 'to_file_id AS src, from_file_id AS dst')}, od AS (SELECT src, count(*) AS o FROM ed GROUP BY 1), pr0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS rank FROM nd){PR} SELECT node, {_r('rank', 'rank', 7)} FROM pr40",
    "module_graph": """WITH RECURSIVE ed AS (SELECT DISTINCT from_file_id AS src, to_file_id AS dst FROM ci_imports WHERE resolution = 'internal' AND to_file_id IS NOT NULL AND from_file_id <> to_file_id),
sy AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), n AS (SELECT min(src) AS node, 0 AS hop FROM ed UNION SELECT dst, hop + 1 FROM n JOIN sy ON src = node WHERE hop < 2),
k AS (SELECT node, min(hop) AS hop FROM n GROUP BY 1 ORDER BY 2, 1 LIMIT 100) SELECT src, dst FROM ed WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)""",
}
