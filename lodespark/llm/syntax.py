"""Source files that do not parse.

Every file is parsed with all grammars, in the order in which its tokens make the languages likely. What
the grammar of its path's extension accepts is valid; else a success of another one means a wrong extension,
failure of all of them corruption. What a checker can't follow to its end is undecided, never invalid.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.llm import grammars
from lodespark.session import spread

# File extensions and their languages.
EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript",
    "cjs": "javascript", "mjs": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "sh": "bash", "bash": "bash",
}
# Other spellings of the languages' names.
SPELLINGS = {
    "py": "python", "python3": "python", "ts": "typescript", "js": "javascript", "node": "javascript", "golang": "go", "rs": "rust",
    "sh": "bash", "shell": "bash",
}
# Tokens that speak for a language.
SIGNS = {
    "python": r"\b(?:def|elif|import|self|None|lambda|except|pass)\b",
    "typescript": r":\s*(?:string|number|boolean|unknown|void|any)\b|\b(?:interface|readonly|export|const|let|implements)\b",
    "javascript": r"\b(?:function|const|let|var|require|export|typeof)\b|=>|===",
    "go": r"\b(?:func|package|defer|chan|range)\b|:=",
    "rust": r"\b(?:fn|let|mut|impl|pub|crate|match)\b|->|::",
    "java": r"\b(?:public|private|class|import|package|throws|extends|new)\b",
    "c": r"#\s*(?:include|define|ifdef)|\b(?:static|struct|int|char|void|sizeof|printf)\b|->",
    "bash": r"\b(?:fi|done|then|esac|local|echo)\b|\$\{|\$\(|^#!",
}
#: Verdicts that say that a file is no valid source of its extension's language.
INVALID = ("corrupt", "wrong_extension")
_SIGNS = {k: re.compile(v, re.M) for k, v in SIGNS.items()}


def ranked_languages(text: str) -> list[str]:
    """All languages, those first whose tokens the text has most of; ties by name."""
    return sorted(_SIGNS, key=lambda k: (-len(_SIGNS[k].findall(text)), k))


def judge(language: str, text: str | None) -> tuple[str, list[str]]:
    """(valid | wrong_extension | corrupt | undecided, all languages that the text is valid in, likely ones first). Null and blank texts are valid in all."""
    order = ranked_languages(text or "")
    if text is None or not text.strip():
        return "valid", order
    verdicts = {name: grammars.parses(name, text) for name in order}
    accepted = [name for name in order if verdicts[name]]
    if verdicts[language]:
        return "valid", accepted
    if verdicts[language] is None:
        return "undecided", accepted
    return ("wrong_extension" if accepted else "corrupt"), accepted


def extension_language(path: Column) -> Column:
    """The language of a path's extension in any letter case; null if it has none that is known."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\s*$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, ext)


def named_language(language: Column) -> Column:
    """A language label in one spelling; null if it is missing."""
    low = F.lower(F.trim(language))
    table = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.when(low != "", F.coalesce(F.try_element_at(table, low), low))


def _check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            got = [judge(l, t) if l else ("unsupported", []) for l, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([s for s, _ in got], pa.string()), pa.array([p for _, p in got], pa.list_(pa.string()))],
                names=["file_id", "path", "expected", "status", "parses_as"],
            )


def check_files(files: DataFrame) -> DataFrame:
    """file_id, path, expected, status (valid, wrong_extension, corrupt, undecided, unsupported), parses_as of every file.

    ``files``: file_id, path, body. ``parses_as`` are all languages whose grammar accepts the body. Files of an
    extension without a grammar are unsupported and not parsed; null ids or paths have no row; deliveries of
    the same path and body count once. A file that came with several bodies has a row for each distinct
    verdict. Null, empty and comment-only bodies are valid.
    """
    lang = extension_language(F.col("path"))
    rows = spread(files.select("file_id", "path", "body"), "file_id").where(F.col("file_id").isNotNull() & F.col("path").isNotNull())
    return rows.select("file_id", "path", lang.alias("expected"), "body").mapInArrow(_check, "file_id bigint, path string, expected string, status string, parses_as array<string>").distinct()


def failing(files: DataFrame) -> DataFrame:
    """``file_id`` of every file with a body that is no valid source of its extension's language."""
    known = files.where(extension_language(F.col("path")).isNotNull())
    return check_files(known).where(F.col("status").isin(*INVALID)).select("file_id").distinct()


def rates(files: DataFrame, index: DataFrame) -> DataFrame:
    """Per repository and language: files, n_corrupt, n_wrong_extension, n_undecided, n_unsupported, n_mislabelled, failing_rate.

    A file's language is that of its extension (the extension itself if no grammar is there for it);
    ``n_mislabelled`` counts files whose label in ``index`` (id, language) is another one (a missing label is
    none). ``failing_rate`` is taken over the files with a verdict, null if there are none. The repository is the
    path's first segment.
    """
    worst = F.struct(F.col("status").isin(*INVALID), "status", "path")
    verdict = check_files(files).groupBy("file_id").agg(F.max_by(F.struct("path", "expected", "status"), worst).alias("v")).select("file_id", "v.*")
    label = index.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("file_id")).agg(F.max(named_language(F.col("language"))).alias("label"))
    repo = F.split(F.regexp_replace("path", r"^(?:\./)+", ""), "/")[0].alias("repo")
    language = F.coalesce("expected", F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))).alias("language")
    n = F.count(F.lit(1))
    counted = {f"n_{s}": F.count_if(F.col("status") == s) for s in ("corrupt", "wrong_extension", "undecided", "unsupported")}
    bad = F.count_if(F.col("status").isin(*INVALID))
    told = F.count_if(~F.col("status").isin("undecided", "unsupported"))
    return verdict.join(label, "file_id", "left").groupBy(repo, language).agg(
        n.alias("files"), *[c.alias(name) for name, c in counted.items()],
        F.count_if(F.col("expected").isNotNull() & F.col("label").isNotNull() & (F.col("label") != F.col("expected"))).alias("n_mislabelled"),
        F.round(bad / F.nullif(told, F.lit(0)), 6).alias("failing_rate"),
    )
