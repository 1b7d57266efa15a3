"""Texts to embed and an embedder without a model: hashed tokens, pooled and normalised."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions import text, vectors

# What models put before queries and passages, by the beginning of their names.
PROMPTS = (
    ("Qwen/Qwen3-Embedding", "Instruct: Given a developer's question, retrieve the code file that answers it\nQuery: ", ""),
    ("intfloat/multilingual-e5", "query: ", "passage: "),
    ("intfloat/e5", "query: ", "passage: "),
)
# What is encoded to see whether the space of vectors is still the same, and the least cosine for that.
PROBE, PROBE_COSINE = "where is the database connection opened and closed", 0.9995
# Extensions of code that is embedded first, and folders whose files are embedded last.
FIRST_EXTENSIONS = ("py", "rs", "js", "jsx", "ts", "tsx", "go", "java", "c", "h")
LOW_FOLDERS = (".github", "docs", "doc", "documentation", "examples", "fixtures", "samples", "test", "tests", "tools", "vendor")


def symbol_text(kind: Column, name: Column, doc: Column) -> Column:
    head = F.concat_ws(" ", kind, name)
    tail = F.trim(F.coalesce(doc, F.lit("")))
    return F.when(tail != "", F.concat(head, F.lit(" — "), tail)).otherwise(head)


def file_text(language: Column, stem: Column, symbols: Column) -> Column:
    """Language, base name and the names of the first symbols (an array)."""
    head = F.concat_ws(" ", F.coalesce(language, F.lit("text")), stem)
    return F.when(F.size(symbols) > 0, F.concat(head, F.lit(" — "), F.array_join(symbols, " "))).otherwise(head)


def intent_text(kind: Column, body: Column) -> Column:
    return F.concat(kind, F.lit(" — "), F.trim(F.regexp_replace(body, r"\s+", " ")))


def prompts_for(model: str) -> tuple[str, str]:
    """What a model puts before queries and passages, by the longest beginning of its name; empty for symmetric models."""
    fits = [(len(p), q, d) for p, q, d in PROMPTS if model.startswith(p)]
    return max(fits)[1:] if fits else ("", "")


def token_vector(token: str, dim: int) -> np.ndarray:
    """A direction of its own for each token, the same in every process."""
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest(token)).standard_normal(dim)


def encode(texts: Iterable[list[str] | None], dim: int = 64, known: dict | None = None) -> list[list[float] | None]:
    """Normalised sums of the vectors of distinct tokens; null without tokens."""
    known = {} if known is None else known
    out: list[list[float] | None] = []
    for tokens in texts:
        if not tokens:
            out.append(None)
            continue
        total = np.zeros(dim)
        for t in tokens:
            if t not in known:
                if len(known) > 200_000:
                    known.clear()
                known[t] = token_vector(t, dim)
            total += known[t]
        norm = np.linalg.norm(total)
        out.append((total / norm).astype(np.float32).tolist() if norm > 0 else None)
    return out


def embed(df: DataFrame, id_col: str, body: Column, dim: int = 64) -> DataFrame:
    """``id_col``, vec: the vector of each row's text; null and token-less texts have a null vector. Rows are encoded in batches where they are."""
    rows = df.select(id_col, text.search_tokens(body).alias("tokens"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(batch.column(1).to_pylist(), dim, known), pa.list_(pa.float32()))], names=[id_col, "vec"])

    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, vec array<float>")


def stored(df: DataFrame, vec_col: str) -> DataFrame:
    """Vectors as they are kept: normalised; null, all-zero and non-finite ones are null."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.withColumn(vec_col, F.when(v.isNotNull() & fine, vectors.normalised(v)).cast("array<float>"))


def same_space(kept: list[float], live: list[float], least: float = PROBE_COSINE) -> tuple[bool, float | None, str]:
    """(ok, cosine, reason): whether the vector of the probe text is still the one that was kept."""
    if len(kept) != len(live):
        return False, None, f"length changed from {len(kept)} to {len(live)}"
    a, b = np.asarray(kept, float), np.asarray(live, float)
    c = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12))
    return (True, c, "") if c >= least else (False, c, f"cosine {c:.4f} below {least}")


def first_to_embed(files: DataFrame, k: int) -> DataFrame:
    """The ``k`` files (path) to embed first: code before other files, main folders before tests and vendored ones, short paths before long ones."""
    parts = F.split(F.lower(text.plain_path(F.col("path"))), "/")
    low = F.arrays_overlap(parts, F.array(*map(F.lit, LOW_FOLDERS)))
    code = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*FIRST_EXTENSIONS)
    return files.orderBy((~code).cast("int"), low.cast("int"), F.size(parts), text.plain_path(F.col("path"))).limit(k)
