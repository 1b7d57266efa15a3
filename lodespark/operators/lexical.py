"""Inverted index, lexical scores, literal search and BM25."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions import text


def postings(rows: DataFrame, id_col: str, body: Column, stopwords: Sequence[str] = ()) -> DataFrame:
    """(token, id): the tokens of every row's name. Null names and ids have none; repeated rows count once."""
    return rows.where(F.col(id_col).isNotNull()).select(F.explode(text.name_tokens(body, stopwords)).alias("token"), F.col(id_col).alias("id")).distinct()


def lexical_scores(index: DataFrame, query: Sequence[str], base: float, step: float, most: float) -> DataFrame:
    """``id``, n_matched, score = min(most, base + step * matched tokens) of rows that share a token with the query."""
    hits = index.where(F.col("token").isin(list(query))).groupBy("id").agg(F.count_distinct("token").alias("n_matched"))
    return hits.withColumn("score", F.least(F.lit(most), base + step * F.col("n_matched")))


# Names that are no evidence although they are said exactly.
GENERIC_NAMES = ("chars", "class", "code", "context", "file", "source", "stats", "test")


def symbol_scores(symbols: DataFrame, query: Sequence[str], bonus: float = 0.0) -> DataFrame:
    """id, n_matched, score of symbols that share a token with the query. ``symbols``: id, kind, name, qualname.

    score = 0.8 + 0.5 a token, 1.0 more if the query holds the whole name (without underscores at its ends; names
    such as "file" don't count), 1.2 more if it names the symbol's kind, and ``bonus``; at most 4.0 + ``bonus``.
    """
    said = F.array(*[F.lit(q) for q in query]) if query else F.array().cast("array<string>")
    tokens = text.name_tokens(F.concat_ws(" ", "kind", "qualname", "name"))
    n = F.size(F.array_intersect(tokens, said))
    name = F.lower(F.regexp_replace("name", "^_+|_+$", ""))
    exact = F.array_contains(said, name) & ~name.isin(*GENERIC_NAMES)
    kind = F.array_contains(said, F.lower(F.trim("kind")))
    score = 0.8 + 0.5 * n + F.when(exact, 1.0).otherwise(0.0) + F.when(kind, 1.2).otherwise(0.0) + bonus
    rows = symbols.where(F.col("id").isNotNull()).select("id", n.cast("bigint").alias("n_matched"), F.least(F.lit(4.0 + bonus), score).alias("score"))
    return rows.where(F.col("n_matched") > 0).distinct()


def literal_content(files: DataFrame, tokens: Sequence[str], id_col: str = "file_id", body: str = "body", largest: int = 262_144) -> DataFrame:
    """Files whose text holds literal tokens: id, n_found, score = min(2.5, 1.15 + 0.45 n). Files above ``largest`` bytes by definition don't count."""
    low = F.lower(F.col(body))
    n = sum((F.when(low.contains(t.lower()), 1).otherwise(0) for t in tokens), F.lit(0)).cast("bigint")
    rows = files.where(F.octet_length(body) <= largest).select(F.col(id_col).alias("id"), n.alias("n_found")).where(F.col("n_found") > 0).distinct()
    return rows.withColumn("score", F.least(F.lit(2.5), 1.15 + 0.45 * F.col("n_found")))


def once(rows: DataFrame, id_col: str, body: str) -> DataFrame:
    """Repeated rows once: they are told by id and a hash of the body, so bodies are moved once and never compared."""
    return rows.groupBy(id_col, F.xxhash64(body).alias("_hash")).agg(F.min(body).alias(body)).drop("_hash")


def grep(files: DataFrame, needle: str, id_col: str = "file_id", body: str = "body", lines: int = 5) -> DataFrame:
    """Literal search: id, matches (non-overlapping occurrences), first_lines (up to ``lines`` numbers of lines that hold it)."""
    hit = once(files.where(F.col(body).contains(needle)).select(F.col(id_col).alias("id"), F.col(body).alias("b")), "id", "b")
    matches = ((F.length("b") - F.length(F.replace("b", F.lit(needle)))) / len(needle)).cast("bigint")
    rows = F.split("b", "\n")
    numbers = F.filter(F.transform(rows, lambda x, i: F.when(x.contains(needle), i + 1)), lambda x: x.isNotNull())
    return hit.select("id", matches.alias("matches"), F.array_join(F.slice(numbers, 1, lines).cast("array<string>"), ",").alias("first_lines"))


def bm25(files: DataFrame, query: Sequence[str], id_col: str = "file_id", body: str = "body", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 scores of the files that hold a term of the query: id, score. Term counts are made map-side; only query terms are shuffled."""
    wanted = sorted({q.lower() for q in query})
    docs = once(files.where(F.col(id_col).isNotNull() & F.col(body).isNotNull()).select(F.col(id_col).alias("id"), F.col(body).alias("body")), "id", "body")
    terms = text.index_terms(F.col("body"))
    counted = docs.select("id", F.size(terms).alias("len"), *[(F.size(terms) - F.size(F.array_remove(terms, w))).alias(f"tf{i}") for i, w in enumerate(wanted)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    x = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.ln((F.col("n") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return x.select("id", score.alias("score"))
