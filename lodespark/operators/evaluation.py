"""How well rankings meet what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row: cases, case_recall, file_recall, hit, mrr, ndcg over the first ``k`` of each request.

    ``ranked``: request_id, target, place (from 1); ``expected``: request_id, expected_files (array; requests that
    expect nothing are left out). case_recall: share of requests with any expected target; file_recall: share of
    all expected targets; mrr: mean of 1 / first place; ndcg: gain 1 / log2(place + 1) against the best order.
    """
    want = expected.where(F.size("expected_files") > 0).select("request_id", F.array_distinct("expected_files").alias("e")).dropDuplicates(["request_id"])
    top = ranked.where(F.col("place") <= k).select("request_id", "target", "place")
    good = F.coalesce(F.array_contains("e", F.col("target")), F.lit(False))
    gain = lambda p: 1 / F.log2(p + 1)
    per = want.join(top, "request_id", "left").groupBy("request_id").agg(
        F.first(F.size("e")).alias("n"), F.count_if(good).alias("hits"), F.coalesce(F.max(F.when(good, 1 / F.col("place"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(good, gain(F.col("place")))), F.lit(0.0)).alias("dcg"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n"))), F.lit(0.0), lambda s, i: s + gain(i))
    found = F.when(F.col("hits") > 0, 1.0).otherwise(0.0)
    return per.withColumn("best", best).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(found).alias("case_recall"), (F.sum("hits") / F.sum("n")).alias("file_recall"), F.avg(found).alias("hit"),
        F.avg("rr").alias("mrr"), F.avg(F.col("dcg") / F.col("best")).alias("ndcg"),
    )


def prompt_sizes(blocks: DataFrame) -> DataFrame:
    """One row: mean characters and mean tokens (a token is about four characters) of rendered blocks (block); null and empty ones count as 0."""
    n = F.coalesce(F.length("block"), F.lit(0))
    return blocks.agg(F.avg(n).alias("chars"), F.avg(F.ceil(n / 4)).alias("tokens"))
