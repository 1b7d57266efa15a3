"""Queries of the general data-pipeline operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators.incremental import replay_runs
from lodespark.operators.skew import dominant_keys, per_key
from lodespark.session import scratch_path, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "ci_files").select("id")
    out = []
    for rel, key, of_dim_only in (("ci_symbols", "file_id", False), ("ci_imports", "to_file_id", True)):
        dim = files.select(F.col("id").alias(key))
        big = dominant_keys(table(spark, sf, rel), key, "id", dim, 0.025, of_dim_only)
        out.append(big.select(F.lit(rel).alias("rel"), F.col(key).alias("file_id")))
    return out[0].unionByName(out[1])


def p1_file_symbols(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.lower(F.trim("kind"))
    return per_key(
        table(spark, sf, "ci_symbols").select("id", "file_id", "kind", "line_start", "line_end"),
        "file_id",
        "id",
        [
            F.count(F.lit(1)).alias("n_symbols"),
            F.count_if(kind.isin("function", "method")).alias("n_callables"),
            F.max("line_end").cast("bigint").alias("last_line"),
            F.sum((F.col("line_end") - F.col("line_start") + 1).cast("bigint")).alias("n_lines"),
        ],
        table(spark, sf, "ci_files").select(F.col("id").alias("file_id")),
    )


def p1_file_imports(spark: SparkSession, sf: str) -> DataFrame:
    return per_key(
        table(spark, sf, "ci_imports").select("id", "to_file_id", "resolution", "line"),
        "to_file_id",
        "id",
        [
            F.count(F.lit(1)).alias("n_imports"),
            F.count_if(F.col("resolution") == "internal").alias("n_internal"),
            F.min("line").cast("bigint").alias("first_line"),
        ],
        table(spark, sf, "ci_files").select(F.col("id").alias("to_file_id")),
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return replay_runs(table(spark, sf, "file_scans"), table(spark, sf, "index_runs"), scratch_path(spark, "p4"))


QUERIES = {"p1_found": p1_found, "p1_file_symbols": p1_file_symbols, "p1_file_imports": p1_file_imports, "p4_found": p4_found}

ORACLES = {
    "p1_found": """
WITH s AS (SELECT DISTINCT id, file_id FROM ci_symbols),
     f AS (SELECT DISTINCT id FROM ci_files),
     i AS (SELECT DISTINCT i.id, i.to_file_id AS file_id FROM ci_imports i JOIN f ON f.id = i.to_file_id)
SELECT 'ci_symbols' AS rel, file_id FROM s JOIN f ON f.id = s.file_id GROUP BY file_id
HAVING count(DISTINCT s.id) >= 0.025 * (SELECT count(DISTINCT id) FROM s)
UNION ALL
SELECT 'ci_imports', file_id FROM i GROUP BY file_id HAVING count(DISTINCT id) >= 0.025 * (SELECT count(DISTINCT id) FROM i)
""",
    "p1_file_symbols": """
WITH s AS (
  SELECT id, file_id, lower(trim(kind)) AS kind, line_start, line_end FROM ci_symbols QUALIFY row_number() OVER (
    PARTITION BY id, file_id ORDER BY kind DESC NULLS LAST, line_start DESC NULLS LAST, line_end DESC NULLS LAST) = 1
)
SELECT file_id, count(*) AS n_symbols, count(*) FILTER (kind IN ('function', 'method')) AS n_callables,
       CAST(max(line_end) AS BIGINT) AS last_line, CAST(sum(line_end - line_start + 1) AS BIGINT) AS n_lines
FROM s WHERE file_id IN (SELECT id FROM ci_files) GROUP BY file_id
""",
    "p1_file_imports": """
WITH s AS (
  SELECT id, to_file_id, resolution, line FROM ci_imports QUALIFY row_number() OVER (
    PARTITION BY id, to_file_id ORDER BY resolution DESC NULLS LAST, line DESC NULLS LAST) = 1
)
SELECT to_file_id, count(*) AS n_imports, count(*) FILTER (resolution = 'internal') AS n_internal, CAST(min(line) AS BIGINT) AS first_line
FROM s WHERE to_file_id IN (SELECT id FROM ci_files) GROUP BY to_file_id
""",
    "p4_found": """
WITH r AS (
  SELECT s.* FROM file_scans s JOIN (SELECT DISTINCT run_id FROM index_runs WHERE status = 'ok') USING (run_id) WHERE content_hash IS NOT NULL
), l AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id, file_id ORDER BY seen_at DESC, scan_id DESC) = 1
), p AS (
  SELECT run_id, file_id, content_hash, parser_version, row_number() OVER w AS k,
         lag(content_hash) OVER w AS h, lag(parser_version) OVER w AS v
  FROM l WINDOW w AS (PARTITION BY file_id ORDER BY run_id)
)
SELECT run_id, file_id FROM p WHERE k = 1 OR h IS DISTINCT FROM content_hash OR v IS DISTINCT FROM parser_version
""",
}
