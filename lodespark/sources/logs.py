"""Sources beside the code: commit logs, repositories, working-tree states, transcripts, evaluation sets."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of the exported log: one before each commit, one between its fields. Written by
#: ``git log --no-merges --find-renames --name-only --format=%x01%H%x1f%ct%x1f%an%x1f%s``.
COMMIT, FIELD = "\x01", "\x1f"
#: Most commits of one run.
MOST_COMMITS = 20_000
# Folders in which no repository is looked for.
SKIPPED = ("node_modules", "dist", "build", "out", "target", "vendor", ".venv", "venv", "__pycache__", ".next", ".nuxt", ".git", ".cache")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """sha, committed_at, author, subject, paths of the commits of exported logs below ``path``. Entries without a full header are dropped."""
    raw = spark.read.option("lineSep", COMMIT).text(path)
    return commits(raw.select("value"))


def commits(raw: DataFrame) -> DataFrame:
    """The commits of log entries (value: header line, then the changed paths, one a line)."""
    lines = F.split(F.col("value"), r"\r?\n")
    head = F.split(F.element_at(lines, 1), FIELD)
    paths = F.array_distinct(F.filter(F.transform(F.slice(lines, 2, F.size(lines)), F.trim), lambda p: p != ""))
    rows = raw.where(F.col("value").contains(FIELD)).select(head.alias("h"), paths.alias("paths")).where(F.size("h") >= 4)
    subject = F.array_join(F.slice("h", 4, F.size("h")), FIELD)
    return rows.select(F.col("h")[0].alias("sha"), F.timestamp_seconds(F.col("h")[1].try_cast("bigint")).alias("committed_at"), F.col("h")[2].alias("author"), subject.alias("subject"), "paths").where(F.col("committed_at").isNotNull() & (F.col("sha") != ""))


def new_commits(found: DataFrame, known: DataFrame, repo: str = "", most: int = MOST_COMMITS) -> DataFrame:
    """The ``most`` latest commits that are not known (sha), with paths below ``repo`` and shas that tell repositories apart; each once."""
    key = F.col("sha") if not repo else F.concat(F.lit(repo + COMMIT), "sha")
    paths = F.col("paths") if not repo else F.transform("paths", lambda p: F.concat(F.lit(repo.rstrip("/") + "/"), p))
    rows = found.withColumn("sha", key).withColumn("paths", paths).groupBy("sha").agg(F.max(F.struct("committed_at", "author", "subject", "paths")).alias("c")).select("sha", "c.*")
    return rows.join(known.select("sha").distinct(), "sha", "left_anti").orderBy(F.col("committed_at").desc(), "sha").limit(most)


def commit_baskets(log: DataFrame, repo: str | None = None) -> DataFrame:
    """basket, item, at: the paths of each commit, of one repository if given."""
    rows = log.select(F.col("sha").alias("basket"), F.explode("paths").alias("item"), F.col("committed_at").alias("at"))
    return rows if repo is None else rows.where(F.col("item").startswith(repo.rstrip("/") + "/") if repo else F.lit(True))


def repositories(root: str, depth: int = 3) -> list[str]:
    """Folders below a local root, as relative paths ("" for the root), that are repositories; at most ``depth`` levels down, none within another one but the root."""
    found: list[str] = []

    def walk(rel: str, level: int) -> None:
        at = os.path.join(root, rel)
        inside = os.path.isdir(os.path.join(at, ".git")) or os.path.isfile(os.path.join(at, ".git"))
        if inside:
            found.append(rel)
            if rel:
                return
        if level < depth:
            try:
                names = sorted(e.name for e in os.scandir(at) if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED)
            except OSError:
                return
            for name in names:
                walk(f"{rel}/{name}" if rel else name, level + 1)

    walk("", 0)
    return found


def repository_of(path: Column, repos: Iterable[str]) -> Column:
    """The longest repository that holds a path; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(set(repos), key=len):
        out = F.when(path.startswith(r + "/") if r else F.lit(True), F.lit(r)).otherwise(out)
    return out


def working_tree(lines: DataFrame) -> DataFrame:
    """status, path of the lines (value) of a porcelain status; of renames the new path; quotes are taken off."""
    v = F.col("value")
    rest = F.substring(v, 4, 100_000)
    path = F.when(rest.contains(" -> "), F.element_at(F.split(rest, " -> "), -1)).otherwise(rest)
    rows = lines.where((F.length(v) > 3) & (F.substring(v, 3, 1) == " "))
    return rows.select(F.trim(F.substring(v, 1, 2)).alias("status"), F.regexp_replace(F.trim(path), '^"|"$', "").alias("path")).where(F.col("path") != "").distinct()


def last_reply(transcripts: DataFrame) -> DataFrame:
    """transcript, reply: the text of the last assistant entry of each transcript (transcript, line, value: one JSON entry a row).

    Text is a string or the text blocks of a list, joined by line breaks. Lines that are no JSON are left out; transcripts without such an entry have no row.
    """
    kind = F.get_json_object("value", "$.type")
    content = F.get_json_object("value", "$.message.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    reply = F.when(F.trim(content).startswith("["), F.array_join(texts, "\n")).otherwise(content)
    rows = transcripts.where(kind == "assistant").select("transcript", "line", F.coalesce(reply, F.lit("")).alias("reply"))
    return rows.groupBy("transcript").agg(F.max_by("reply", "line").alias("reply"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """prompt, expected_files of a JSON-lines file; blank lines and lines that begin with # are left out.

    Raises ValueError for a line that is no object with a non-empty prompt and a list of strings.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    schema = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("expected_files", T.ArrayType(T.StringType()))])
    rows = lines.select("value", F.from_json("value", schema).alias("r"))
    good = (F.length(F.trim("r.prompt")) > 0) & F.col("r.expected_files").isNotNull() & F.forall("r.expected_files", lambda x: x.isNotNull() & (x != ""))
    bad = rows.where(~F.coalesce(good, F.lit(False))).select("value").limit(1).collect()
    if bad:
        raise ValueError(f"no evaluation item: {bad[0][0][:200]}")
    return rows.select("r.prompt", "r.expected_files")


def cited_paths(replies: DataFrame, files: DataFrame) -> DataFrame:
    """reply_id, path: indexed files that a text names by their whole path, or by a bare name that only one path ends with. ``replies``: reply_id, body; ``files``: path."""
    from lodespark.functions import mentions, text
    from lodespark.operators import navigation

    said = replies.where(F.col("body").isNotNull()).select("reply_id", F.explode(mentions.path_mentions(F.col("body"))).alias("m")).select("reply_id", F.col("m.base").alias("base")).distinct()
    plain = files.select(text.plain_path(F.col("path")).alias("path")).distinct()
    whole = said.where(F.col("base").contains("/")).join(plain, F.col("base") == F.col("path")).select("reply_id", "path")
    bare = said.where(~F.col("base").contains("/"))
    only = navigation.suffixes(plain).where(F.col("suffix") != F.col("path")).join(bare.select(F.col("base").alias("suffix")).distinct(), "suffix").groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n = 1")
    return whole.unionByName(bare.join(only, F.col("base") == F.col("suffix")).select("reply_id", "path")).distinct()
