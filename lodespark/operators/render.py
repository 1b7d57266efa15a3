"""Rankings and notes as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions import text


def reason_text(semantic: Column, recentness: Column, dependency: Column, finding: Column) -> Column:
    return F.format_string("semantic_relevance=%.2f, recentness=%.2f, dependency_affinity=%.1f, remembered_finding=%.2f", semantic, recentness, dependency, finding)


def priority(place: Column) -> Column:
    return F.when(place <= 1, "open-first").when(place <= 3, "open-early").otherwise("secondary")


def ranking_blocks(ranked: DataFrame, most: int | None = None) -> DataFrame:
    """request_id, block: one text a request: files, symbols and findings in order, within ``most`` characters.

    ``ranked``: request_id, target_type, place, target, score. Whole lines are dropped from the end, and a line says so.
    """
    line = F.concat(F.lit("- "), F.col("target"), F.lit("  "), F.format_number("score", 2), F.lit("  "), priority(F.col("place")))
    section = F.when(F.col("target_type") == "file", 1).when(F.col("target_type") == "symbol", 2).otherwise(3)
    titles = F.create_map(F.lit(1), F.lit("files:"), F.lit(2), F.lit("symbols:"), F.lit(3), F.lit("findings:"))
    rows = ranked.select("request_id", section.alias("s"), "place", line.alias("line"))
    heads = rows.select("request_id", "s", F.lit(0).alias("place"), F.try_element_at(titles, F.col("s")).alias("line")).distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("s", "place", "line"))), lambda x: x["line"])
    per = rows.select("request_id", "s", F.col("place").cast("int").alias("place"), "line").unionByName(heads).groupBy("request_id").agg(lines.alias("lines"))
    return per.select("request_id", fitted(F.col("lines"), most).alias("block"))


def fitted(lines: Column, most: int | None, marker: str = "(truncated)") -> Column:
    """Lines joined, at most ``most`` characters: as many whole lines from the start as fit together with the marker."""
    whole = F.array_join(lines, "\n")
    if not most or most <= 0:
        return whole
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(len(marker)).alias("used"), F.lit(False).alias("full"))
    step = lambda a, x: F.when(~a["full"] & (a["used"] + F.length(x) + 1 <= most), F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["used"] + F.length(x) + 1).alias("used"), F.lit(False).alias("full"))).otherwise(F.struct(a["kept"].alias("kept"), a["used"].alias("used"), F.lit(True).alias("full")))
    kept = F.aggregate(lines, start, step)["kept"]
    return F.when(F.length(whole) <= most, whole).otherwise(F.substring(F.array_join(F.concat(kept, F.array(F.lit(marker))), "\n"), 1, most))


def recall_blocks(hits: DataFrame) -> DataFrame:
    """query, block: the notes found by each search (query, place, topic, content, tags, sim), two lines each."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", " "), F.lit("]"))).otherwise("")
    entry = F.concat(F.format_string("%.3f  ", F.col("sim")), F.col("topic"), tags, F.lit("\n       "), text.clipped(F.col("content"), 220))
    return hits.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))), lambda x: x["e"]), "\n").alias("block"))


def search_blocks(hits: DataFrame) -> DataFrame:
    """query, block: one line a hit (query, place, target, sim, tier), with how its name matched."""
    how = F.when(F.col("tier") == 3, " (exact)").when(F.col("tier") == 2, " (qualified)").when(F.col("tier") == 1, " (words)").otherwise("")
    line = F.concat(F.format_string("%.3f  ", F.col("sim")), F.col("target"), how)
    return hits.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("block"))
