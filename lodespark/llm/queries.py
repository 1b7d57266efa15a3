"""Queries of the operators on text, vectors and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm import docpairs, language, leakage, neighbours, outranking, syntax, tokenization
from lodespark.session import table


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "ranked_items").select("request_id", "target", "score", outranking.channel_of(F.col("reason"), F.col("channel")).alias("channel"))
    return outranking.net_flow(items)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return outranking.top_targets(_flows(spark, sf), "request_id", "target", 3).select("request_id", "target")


def p2_flows(spark: SparkSession, sf: str) -> DataFrame:
    return _flows(spark, sf).select("request_id", "target", F.round(F.col("flow") + 1e-9, 6).alias("flow"), "n_scores")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.failing(table(spark, sf, "fts_files"))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.rates(table(spark, sf, "fts_files"), table(spark, sf, "ci_files"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    out = [
        neighbours.similar_pairs(table(spark, sf, rel), "id", "embedding").select(F.lit(rel).alias("rel"), "id_a", "id_b")
        for rel in ("ci_symbols", "ci_files")
    ]
    return out[0].unionByName(out[1])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.documented_ids(table(spark, sf, "ci_symbols"), table(spark, sf, "fts_files"))


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf, "ci_symbols"), table(spark, sf, "fts_files"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenization.encode_texts(table(spark, sf, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_prompts"), "doc_id", "text", "item_id", "prompt")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.wrong_labels(table(spark, sf, "documents"))


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.languages(table(spark, sf, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_flows": p2_flows,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_segments": p9_segments,
}

P2_FLOWS = """
WITH best AS (
  SELECT request_id AS r, target AS t, regexp_replace(regexp_extract(reason, '^[a-z]+(-[a-z]+)*'), '-symbol$', '') AS c, max(score) AS s
  FROM ranked_items WHERE score IS NOT NULL AND CAST(score AS VARCHAR) NOT IN ('nan', 'inf', '-inf') AND target IS NOT NULL GROUP BY 1, 2, 3
), tg AS (SELECT DISTINCT r, t FROM best), ch AS (SELECT DISTINCT r, c FROM best),
full_ AS (
  SELECT tg.r, tg.t, ch.c, best.s, rank() OVER (PARTITION BY tg.r, ch.c ORDER BY best.s NULLS FIRST) AS lo,
         count(*) OVER (PARTITION BY tg.r, ch.c, best.s) AS k, count(*) OVER (PARTITION BY tg.r, ch.c) AS n
  FROM tg JOIN ch USING (r) LEFT JOIN best ON best.r = tg.r AND best.t = tg.t AND best.c = ch.c
), u AS (SELECT r, t, c, s, n, 2 * (lo - 1) + k AS x FROM full_),
pair AS (
  SELECT a.r, a.t, a.c, a.n, a.s, sum(CASE WHEN a.x > b.x THEN least(1.0, (a.x - b.x)::DOUBLE / a.n) ELSE -least(1.0, (b.x - a.x)::DOUBLE / a.n) END) AS d
  FROM u a JOIN u b ON a.r = b.r AND a.c = b.c GROUP BY ALL
)
SELECT r AS request_id, t AS target, round(avg(d / greatest(1, n - 1)) + 1e-9, 6) AS flow, count(s) AS n_scores FROM pair GROUP BY r, t
"""
P5_SIDE = """
SELECT '{rel}' AS rel, a.id AS id_a, b.id AS id_b FROM v_{rel} a JOIN v_{rel} b ON a.id < b.id AND list_dot_product(a.v, b.v) >= 0.9
"""
P5_VECTORS = """
v_{rel} AS (
  SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (
    SELECT DISTINCT ON (id) id, CAST(embedding AS DOUBLE[]) AS v FROM {rel}
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  )
)
"""
ORACLES = {
    "p5_found": "WITH " + ",".join(P5_VECTORS.format(rel=r) for r in ("ci_symbols", "ci_files"))
    + " UNION ALL ".join(P5_SIDE.format(rel=r) for r in ("ci_symbols", "ci_files")),
    "p2_flows": P2_FLOWS,
    "p2_found": f"""
WITH f AS ({P2_FLOWS})
SELECT request_id, target FROM f QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY flow DESC, target) <= 3
""",
}
