"""The state of an index and its history: counts, coverage, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _embedded(df: DataFrame, key: str, total: str, embedded: str, where: str | None = None) -> DataFrame:
    rows = df.where(F.col(key).isNotNull())
    rows = rows.where(where) if where else rows
    return rows.agg(F.count_distinct(key).alias(total), F.count_distinct(F.when(F.col("vec").isNotNull(), F.col(key))).alias(embedded))


def status(files: DataFrame, symbols: DataFrame, sessions: DataFrame, contexts: DataFrame, interactions: DataFrame, scores: DataFrame, notes: DataFrame, intents: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """One row: fifteen counts over distinct ids, embedded_pct, stale_files, signals and recommendations.

    ``files``: id, path, vec; ``symbols``: id, vec; ``sessions``: id, ended; ``contexts``: id, kind, vec; ``interactions``: id; ``scores``: id; ``notes``: id, vec;
    ``intents``: id, vec; ``live``: path (with it, indexed paths that are gone are counted).
    """
    one = _embedded(files, "id", "files", "files_embedded").crossJoin(_embedded(symbols, "id", "symbols", "symbols_embedded"))
    one = one.crossJoin(sessions.agg(F.count_distinct("id").alias("sessions"), F.count_distinct(F.when(F.col("ended").isNull(), F.col("id"))).alias("active_sessions")))
    prompt = F.when(F.col("kind") == "user_prompt", F.col("id"))
    one = one.crossJoin(contexts.agg(F.count_distinct("id").alias("contexts"), F.count_distinct(prompt).alias("prompts"), F.count_distinct(F.when(F.col("vec").isNotNull(), prompt)).alias("prompts_embedded")))
    one = one.crossJoin(interactions.agg(F.count_distinct("id").alias("interactions"))).crossJoin(scores.agg(F.count_distinct("id").alias("session_scores")))
    one = one.crossJoin(_embedded(notes, "id", "notes", "notes_embedded")).crossJoin(_embedded(intents, "id", "intents", "intents_embedded"))
    gone = files.select("path").distinct().join(live.select("path").distinct(), "path", "left_anti").agg(F.count(F.lit(1)).alias("stale_files")) if live is not None else files.sparkSession.createDataFrame([(0,)], "stale_files bigint")
    one = one.crossJoin(gone)  # one row each
    have, total = F.col("files_embedded") + F.col("symbols_embedded"), F.col("files") + F.col("symbols")
    ready = F.when(have == 0, "none").when(have == total, "ready").otherwise(F.format_string("partial(%d/%d)", have, total))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    signals = F.concat_ws(
        ", ", F.concat(F.lit("index="), F.when(F.col("files") == 0, "empty").otherwise("yes")), F.concat(F.lit("embeddings="), ready),
        F.concat(F.lit("predictive="), yes((F.col("session_scores") > 0) & (F.col("prompts_embedded") > 0))), F.concat(F.lit("findings="), yes(F.col("notes_embedded") > 0)),
    )
    advice = F.array(
        F.when(F.col("files") == 0, "index the sources").when(F.col("stale_files") > 0, "indexed files are gone: index again"),
        F.when((F.col("files") > 0) & (have == 0), "embed files and symbols").when((F.col("files") > 0) & (have < total), "embeddings are partial: embed the rest"),
        F.when(F.col("prompts_embedded") == 0, "log and embed prompts").when(F.col("interactions") == 0, "no interactions are recorded"),
        F.when((F.col("session_scores") == 0) & (F.col("active_sessions") > 0), "end a session to keep its scores").when(F.col("session_scores") == 0, "let sessions run to build a history"),
        F.when(F.col("notes_embedded") == 0, "save notes"),
    )
    pct = F.round(F.when(total > 0, 100 * have / total).otherwise(0.0), 1)
    return one.select("*", pct.alias("embedded_pct"), signals.alias("signals"), F.array_join(F.filter(advice, lambda x: x.isNotNull()), "; ").alias("recommendations"))
