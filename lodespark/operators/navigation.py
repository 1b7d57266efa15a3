"""Lookups over an index of files and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions import text


def enclosing_symbols(points: DataFrame, symbols: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` innermost symbols around each line: file_id, line, symbol_id, place.

    ``points``: file_id, line; ``symbols``: id, file_id, line_start, line_end. An equi join on (file, block of
    64 lines) bounds what is compared: symbols are posted to the blocks they cover, so neither a long file
    nor one with most of the symbols pairs all its points with all its symbols.
    """
    size = 64
    s = symbols.where(F.col("line_start").isNotNull() & (F.col("line_end") >= F.col("line_start"))).select(F.col("id").alias("symbol_id"), "file_id", "line_start", "line_end").distinct()
    block = F.explode(F.sequence(F.floor(F.col("line_start") / size), F.floor(F.col("line_end") / size)))
    posted = s.withColumn("block", block)
    p = points.select("file_id", "line").distinct().withColumn("block", F.floor(F.col("line") / size))
    hit = p.join(posted, ["file_id", "block"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    w = Window.partitionBy("file_id", "line").orderBy(F.col("line_end") - F.col("line_start"), F.col("line_start").desc(), "symbol_id")
    return hit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("file_id", "line", "symbol_id", "place")


def suffixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every suffix of a path that begins at a segment, so that suffix lookups are equi joins: all columns and ``suffix``."""
    parts = F.split(text.plain_path(F.col(path)), "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    return paths.withColumn("suffix", F.explode(every))


def unique_suffix_match(mentions: DataFrame, paths: DataFrame) -> DataFrame:
    """mention, path: mentions (mention) that end exactly one path (path); ambiguous ones have no row."""
    all_ = suffixes(paths.select(text.plain_path(F.col("path")).alias("path")).distinct())
    hit = mentions.select("mention").distinct().join(all_, F.col("mention") == F.col("suffix"))
    return hit.groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n = 1").select("mention", "path")


def literal_tier(ident: str, names: list[Column]) -> Column:
    """3 for an exact name, 2 for the last part of a dotted one, 1 if all tokens of ``ident`` are in a name, else 0."""
    low = ident.lower()
    said = text.search_tokens(F.lit(ident))
    tier = F.lit(0)
    for n in names:
        own = F.when(F.lower(n) == low, 3).when(F.lower(n).endswith("." + low), 2).when((F.size(said) > 0) & (F.size(F.array_except(said, text.search_tokens(n))) == 0), 1).otherwise(0)
        tier = F.greatest(tier, F.coalesce(own, F.lit(0)))
    return tier


def overview(files: DataFrame) -> DataFrame:
    """top, language, files, symbols, tests by first path segment and label; repeated rows (same id) count once."""
    rows = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("path", "language", "symbol_count")).alias("f")).select("f.*")
    path = text.plain_path(F.col("path"))
    return rows.groupBy(F.split(path, "/")[0].alias("top"), F.coalesce(F.lower(F.trim("language")), F.lit("unknown")).alias("language")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("symbol_count", F.lit(0))).alias("symbols"), F.count_if(text.looks_like_test(path)).alias("tests")
    )


# Words of test conventions, and names of a file's role instead of its subject.
TEST_WORDS = ("test", "tests", "spec", "specs", "it", "should")
ROLE_NAMES = (
    "__init__", "__main__", "index", "main", "mod", "app", "lib", "setup", "types", "utils", "helpers", "common", "base", "core", "conftest",
)


def file_stem(path: Column) -> Column:
    """The file name without its last extension, letter case kept."""
    return F.regexp_replace(text.base_name(path), r"(?<=.)\.[^.]*$", "")


def tested_names(base: Column) -> Column:
    """The lower-case stems that a test's file name (without extension) stands for by convention."""
    low = F.lower(base)
    cut_off = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in (r"^test_(.+)$", r"^(.+)_test$", r"^(.+)_spec$", r"^(.+)\.test$", r"^(.+)\.spec$", r"^(.+)test$", r"^(.+)tests$", r"^(.+)spec$")]
    return F.array_distinct(F.filter(F.array(*cut_off), lambda x: x.isNotNull()))


def find_tests(files: DataFrame, targets: DataFrame, imports: DataFrame, repositories: bool = True) -> DataFrame:
    """target_id, test_id, score: tests of a file, found within its repository (the first path segment; all files are of one if ``repositories`` is false).

    Named for it by convention 3.0, else all words of its name in the test's name 2.0, and 1.0 more for
    each row of ``imports`` (from_file_id, to_file_id; repeated rows count once) from the test to the file. ``files``: id, path; ``targets``: id. The words of a file
    meet only the tests that hold its rarest word.
    """
    f = files.where(F.col("id").isNotNull() & F.col("path").isNotNull()).groupBy("id").agg(F.max(text.plain_path(F.col("path"))).alias("path"))
    f = f.withColumn("repo", F.split("path", "/")[0] if repositories else F.lit("")).withColumn("stem", file_stem(F.col("path")))
    words = F.array_except(text.search_tokens(F.col("stem")), F.array(*map(F.lit, TEST_WORDS)))
    tests = f.where(text.looks_like_test(F.col("path"))).select(F.col("id").alias("test_id"), "repo", tested_names(F.col("stem")).alias("names"), words.alias("test_words"))
    wanted = f.join(targets.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("target_id"), "repo", F.lower("stem").alias("stem"), words.alias("words"))
    named = tests.select("test_id", "repo", F.explode("names").alias("stem")).join(wanted, ["repo", "stem"]).select("target_id", "test_id", F.lit(3.0).alias("s"))
    held = tests.select("test_id", "repo", "test_words", F.explode("test_words").alias("word"))
    often = held.groupBy("repo", "word").agg(F.count(F.lit(1)).alias("n"))
    asked = wanted.where(~F.col("stem").isin(*ROLE_NAMES) & (F.size("words") > 0)).select("target_id", "repo", "words", F.explode("words").alias("word"))
    rarest = asked.join(often, ["repo", "word"]).groupBy("target_id").agg(F.min(F.struct("n", "word", "repo", "words")).alias("r")).select("target_id", "r.repo", "r.word", "r.words")
    alike = rarest.join(held, ["repo", "word"]).where(F.size(F.array_except("words", "test_words")) == 0).select("target_id", "test_id", F.lit(2.0).alias("s"))
    names = named.unionByName(alike).groupBy("target_id", "test_id").agg(F.max("s").alias("s"))
    i = imports.distinct().select(F.col("from_file_id").alias("test_id"), F.col("to_file_id").alias("target_id")).where(F.col("target_id").isNotNull())
    by_import = i.join(tests.select("test_id"), "test_id", "left_semi").join(wanted.select("target_id"), "target_id", "left_semi").select("target_id", "test_id", F.lit(1.0).alias("s"))
    return names.unionByName(by_import).groupBy("target_id", "test_id").agg(F.sum("s").alias("score"))


def index_status(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row of counts over distinct ids: files, symbols, imports, files_embedded, symbols_documented."""
    ids = lambda df: df.where(F.col("id").isNotNull())
    f = ids(files).agg(F.count_distinct("id").alias("files"), F.count_distinct(F.when(F.col("embedding").isNotNull(), F.col("id"))).alias("files_embedded"))
    s = ids(symbols).agg(F.count_distinct("id").alias("symbols"), F.count_distinct(F.when(F.length(F.trim("docstring")) > 0, F.col("id"))).alias("symbols_documented"))
    i = ids(imports).agg(F.count_distinct("id").alias("imports"))
    return f.crossJoin(s).crossJoin(i)  # one row each


def outline(symbols: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` symbols of each file by line: file_id, place, name, kind. Tasks keep k rows a file before the shuffle."""
    s = symbols.where(F.col("id").isNotNull() & F.col("file_id").isNotNull()).select("id", "file_id", "name", F.lower(F.trim("kind")).alias("kind"), "line_start").dropDuplicates(["id", "file_id"])
    w = Window.partitionBy("file_id").orderBy("line_start", "id")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("file_id", "place", "name", "kind")
