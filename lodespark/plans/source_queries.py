"""Queries over what the sources themselves say: symbols, imports and their targets, calls, hierarchies, triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators import codeflow
from lodespark.plans.rank_queries import _files, _symbols
from lodespark.session import cut, table
from lodespark.sources import headers, parsed, resolve, tree


def _parsed(s: SparkSession, sf: str) -> DataFrame:
    return parsed.read(table(s, sf, "fts_files").select("file_id", tree.language_of(F.col("path")).alias("language"), "body"))


def _numbered(s: SparkSession, sf: str) -> DataFrame:
    """Extracted symbols with a number of their own."""
    found = parsed.symbols(_parsed(s, sf))
    return found.withColumn("id", F.xxhash64("file_id", "qualname", "line_start", "kind"))


def extracted_symbols(s: SparkSession, sf: str) -> DataFrame:
    return parsed.symbols(_parsed(s, sf)).select("file_id", "kind", "qualname", *[F.col(c).cast("bigint").alias(c) for c in ("line_start", "line_end")], "doc")


def extracted_imports(s: SparkSession, sf: str) -> DataFrame:
    return parsed.imports(_parsed(s, sf)).select("file_id", F.col("line").cast("bigint").alias("line"), "module")


def resolved_imports(s: SparkSession, sf: str) -> DataFrame:
    f = _files(s, sf).select("id", "path").distinct()
    i = table(s, sf, "ci_imports").select(F.col("id").alias("import_id"), F.col("from_file_id").alias("id"), F.col("to_module").alias("module")).distinct()
    i = i.join(f, "id").select("import_id", F.col("path").alias("from_path"), tree.language_of(F.col("path")).alias("language"), "module")
    return resolve.resolve(i, f)


def call_graph(s: SparkSession, sf: str) -> DataFrame:
    """Calls that the sources make, to the symbols of the index."""
    sy = _symbols(s, sf).drop("vec")
    known = table(s, sf, "ci_imports").where("resolution = 'internal'").select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst"))
    calls = parsed.calls(_parsed(s, sf)).select("file_id", F.col("line").cast("int").alias("line"), "name")
    got = codeflow.call_graph(codeflow.resolved_calls(calls, sy.where(F.lower(F.trim("kind")).isin("function", "method", "class", "constructor")), known), sy)
    return got.select("caller", "callee", "file_id", F.col("line").cast("bigint").alias("line"), "tier")


def _bases(s: SparkSession, sf: str) -> DataFrame:
    """Class headers of the sources; and, as these name no bases, a tree of the classes of each file."""
    from pyspark.sql import Window

    own = headers.class_bases(table(s, sf, "fts_files"))
    classes = _symbols(s, sf).where(F.lower(F.trim("kind")) == "class").select(F.col("file_id").cast("string").alias("repo"), "name", "line_start", "id").distinct()
    k = F.row_number().over(Window.partitionBy("repo").orderBy("line_start", "id"))
    placed = cut(classes.select("repo", F.col("name").alias("cls"), k.alias("k")))
    up = placed.select("repo", F.col("cls").alias("base"), F.col("k").alias("half"))
    chain = placed.withColumn("half", F.floor(F.col("k") / 2).cast("int")).join(up, ["repo", "half"]).select("repo", "cls", "base").where(F.col("base") != F.col("cls"))
    return cut(own.unionByName(chain).distinct())


def type_hierarchy(s: SparkSession, sf: str) -> DataFrame:
    b = _bases(s, sf)
    asked = b.select("repo", F.col("base").alias("cls")).distinct()
    return codeflow.hierarchy(b, asked).select("repo", "root", "cls", F.col("depth").cast("bigint").alias("depth"))


def overridden_methods(s: SparkSession, sf: str) -> DataFrame:
    b = _bases(s, sf)
    m = _symbols(s, sf).where(F.lower(F.trim("kind")) == "method").select(F.col("file_id").cast("string").alias("repo"), F.regexp_extract("qualname", r"([^.:#]+)(?:\.|::|#)[^.:#]+$", 1).alias("cls"), "name")
    return codeflow.overrides(codeflow.hierarchy(b, b.select("repo", F.col("base").alias("cls")).distinct()), m.where("cls <> ''"))


def wiring(s: SparkSession, sf: str) -> DataFrame:
    got = codeflow.wiring(parsed.triggers(_parsed(s, sf)), _symbols(s, sf).drop("vec"))
    return got.select("file_id", F.col("line").cast("bigint").alias("line"), "kind", "trigger", "by", "handler")


QUERIES = {f.__name__: f for f in (extracted_symbols, extracted_imports, resolved_imports, call_graph, type_hierarchy, overridden_methods, wiring)}

_BASES = """pl AS (SELECT CAST(file_id AS VARCHAR) AS repo, name AS cls, row_number() OVER (PARTITION BY file_id ORDER BY line_start, id) AS k FROM (SELECT DISTINCT file_id, name, line_start, id FROM ci_symbols WHERE lower(trim(kind)) = 'class')),
ch AS (SELECT DISTINCT a.repo, a.cls, b.cls AS base FROM pl a JOIN pl b ON b.repo = a.repo AND b.k = a.k // 2 WHERE a.cls <> b.cls),
hi AS (SELECT repo, base AS root, cls, 1 AS depth FROM ch UNION SELECT hi.repo, root, ch.cls, depth + 1 FROM hi JOIN ch ON ch.repo = hi.repo AND ch.base = hi.cls WHERE depth < 60),
hh AS (SELECT repo, root, cls, min(depth) AS depth FROM hi WHERE cls <> root GROUP BY 1, 2, 3)"""
ORACLES = {
    # the sources of the tables name no bases in their class headers
    "type_hierarchy": f"WITH RECURSIVE {_BASES} SELECT repo, root, cls, CAST(depth AS BIGINT) AS depth FROM hh",
    "overridden_methods": f"""WITH RECURSIVE {_BASES}, m AS (SELECT DISTINCT CAST(file_id AS VARCHAR) AS repo, regexp_extract(qualname, '([^.:#]+)(?:\\.|::|#)[^.:#]+$', 1) AS cls, name FROM ci_symbols WHERE lower(trim(kind)) = 'method')
SELECT repo, root, hh.cls, a.name FROM hh JOIN m a USING (repo, cls) JOIN m b ON b.repo = hh.repo AND b.cls = hh.root AND b.name = a.name WHERE a.cls <> ''""",
}
