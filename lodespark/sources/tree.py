"""Source trees: files below a root, ignore rules, language labels."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# What is never indexed.
ALWAYS_IGNORED = (".git", ".hg", ".svn", "__pycache__", ".venv", "node_modules", "target", "dist", "build", ".DS_Store")
ALWAYS_IGNORED_ENDINGS = (".pyc",)
# Extensions and their languages.
LANGUAGE_BY_EXTENSION = {
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "ipp": "cpp", "cs": "csharp", "csx": "csharp",
    "css": "css", "html": "html", "htm": "html", "vue": "html", "svelte": "html", "py": "python", "pyi": "python", "rs": "rust",
    "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "php": "php", "phtml": "php",
    "sql": "sql", "graphql": "graphql", "gql": "graphql", "sh": "bash", "bash": "bash", "ksh": "bash", "ps1": "powershell", "psm1": "powershell", "psd1": "powershell",
}
#: Files above this size are not read.
LARGEST = 1 << 20


def language_of(path: Column) -> Column:
    """The language of a path's extension in any letter case; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression over relative paths, whether it takes back); None for comments and blanks.

    ``*`` and ``?`` stay within a segment, ``**`` spans segments, a slash inside anchors to the root, a
    trailing slash means directories, and everything below a match is ignored too.
    """
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    back = p.startswith("!")
    p = p[1:] if back else p
    p = p[1:] if p.startswith("\\") else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            out, i = out + "[" + ("^" if p[i + 1] in "!^" else "") + re.escape(p[i + 1 : j].lstrip("!^")).replace(r"\-", "-") + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), back


def _always(path: Column) -> Column:
    out = F.exists(F.split(path, "/"), lambda s: s.isin(*ALWAYS_IGNORED))
    for e in ALWAYS_IGNORED_ENDINGS:
        out = out | path.endswith(e)
    return out


def is_ignored(path: Column, rules: Sequence[str] | Mapping[str, Sequence[str]]) -> Column:
    """Whether a path relative to the root is ignored.

    ``rules``: the lines of the root's ignore file, or the lines of every ignore file by its folder ("" for the root). Standing
    rules come first; then of all rules that match, relative to their folder, the last one of the deepest folder counts.
    """
    scopes = rules if isinstance(rules, Mapping) else {"": rules}
    state = F.lit(False)
    for folder in sorted(scopes, key=lambda d: (d.count("/") + bool(d), d)):
        inside = path.startswith(folder + "/") if folder else F.lit(True)
        own = F.substring(path, len(folder) + 2 if folder else 1, 100_000)
        for rule in scopes[folder]:
            if parsed := ignore_regex(rule):
                state = F.when(inside & own.rlike(parsed[0]), F.lit(not parsed[1])).otherwise(state)
    return _always(path) | state


def _ignored(rel: str, scopes: Mapping[str, list[tuple[re.Pattern, bool]]], folder: bool) -> bool:
    """The same for one path; of folders also whether everything below is ignored."""
    if any(p in ALWAYS_IGNORED for p in rel.split("/")) or rel.endswith(ALWAYS_IGNORED_ENDINGS):
        return True
    state = False
    for at, rules in sorted(scopes.items(), key=lambda kv: (kv[0].count("/") + bool(kv[0]), kv[0])):
        if at and not rel.startswith(at + "/"):
            continue
        own = (rel[len(at) + 1 :] if at else rel) + ("/x" if folder else "")
        for pattern, back in rules:
            if pattern.search(own):
                state = not back
    return state


def folders_below(spark: SparkSession, root: str, rules: Sequence[str] = ()) -> tuple[list[str], dict[str, list[str]]]:
    """(folders, rules): the folders below ``root`` that are not ignored, relative to it, and the lines of all ignore files in them, by folder.

    Any Hadoop file system; ignored folders are not entered. Folders are listed on the driver, files never are.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: list[str] = []
    lines: dict[str, list[str]] = {"": list(rules)} if rules else {}
    compiled: dict[str, list[tuple[re.Pattern, bool]]] = {}

    def read(rel: str) -> None:
        name = jvm.org.apache.hadoop.fs.Path(f"{root}/{rel}/.gitignore" if rel else f"{root}/.gitignore")
        if fs.exists(name):
            stream = fs.open(name)
            try:
                lines[rel] = [*lines.get(rel, []), *bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()]
            finally:
                stream.close()
        parsed = [ignore_regex(x) for x in lines.get(rel, [])]
        compiled[rel] = [(re.compile(p[0]), p[1]) for p in parsed if p]

    def walk(rel: str) -> None:
        read(rel)
        found.append(rel)
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{rel}" if rel else root)):
            if s.isDirectory():
                child = f"{rel}/{s.getPath().getName()}" if rel else s.getPath().getName()
                # a rule may take back files of an ignored folder, so only what no rule takes back is passed by
                if not _ignored(child, compiled, True) or any(b for x in compiled.values() for _, b in x) and not any(p in ALWAYS_IGNORED for p in child.split("/")):
                    walk(child)

    walk("")
    return sorted(found), lines


def read_tree(spark: SparkSession, root: str, rules: Sequence[str] = ()) -> DataFrame:
    """path, language, content_hash, mtime, body of the files below ``root`` that have a known language, are not ignored and no larger than LARGEST.

    Ignore files at any depth count, after ``rules``. Only files of known extensions in folders that are not ignored are opened.
    """
    folders, scopes = folders_below(spark, root, rules)
    letters = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    glob = "*.{" + ",".join(letters(e) for e in LANGUAGE_BY_EXTENSION) + "}"
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load([f"{root}/{f}" if f else root for f in folders]).where(F.col("length") <= LARGEST)
    prefix = "^.*?" + re.escape(root.rstrip("/").split("://")[-1].lstrip("/")) + "/"
    path = F.regexp_replace(F.col("path"), prefix, "")
    rows = raw.select(path.alias("path"), F.col("modificationTime").alias("mtime"), "content")
    rows = rows.where(~is_ignored(F.col("path"), scopes) & language_of(F.col("path")).isNotNull())
    return rows.select("path", language_of(F.col("path")).alias("language"), F.unhex(F.sha2("content", 256)).alias("content_hash"), "mtime", F.decode("content", "UTF-8").alias("body"))
