"""Functions paired with their documentation.

Documentation that says nothing is recognised from its content and tags alone; where a method has none of its
own that says anything, class hierarchies parsed from the sources are climbed, one level a round,
until a documented method that it overrides is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.operators.skew import skew_join
from lodespark.operators.snippets import code_of
from lodespark.session import cut
from lodespark.sources.headers import class_bases

# What stands in for documentation yet to be written, as lower-case words.
PLACEHOLDERS = (
    "todo", "fixme", "xxx", "wip", "tbd", "tba", "n/a", "na", "none", "null", "nil", "undefined", "undocumented", "undoc", "description",
    "summary", "docstring", "documentation", "doc", "docs", "comment", "placeholder", "stub", "empty", "missing", "unknown", "untitled",
    "parameters", "params", "args", "arguments", "returns", "return", "raises", "yields", "throws", "example", "examples", "notes", "note", "see also",
)
# Whole texts (letters and digits only, single blanks) that announce documentation.
PLACEHOLDER_TEXT = (
    r"(?:(?:todo|fixme|xxx|wip|tbd|tba|hack)\b[ :.-]*)+"
    r"(?:(?:please )?(?:write|add|fill(?: in)?|insert|document|describe|complete|update|finish)\b(?: (?:me|this|the|a|an|some|missing|proper|function|method|class|module|docs?|docstrings?|documentation|descriptions?|comments?|summary|here|later|it|in))*)?"
    r"|(?:please )?(?:write|add|insert|fill in)(?: (?:a|an|the|some|proper|your|docs?|docstrings?|documentation|descriptions?|comments?|summary|text|here|later|me|this|it|for|function|method))+"
    r"|(?:docs?|docstrings?|documentation|descriptions?|comments?|summary|text)(?: (?:goes?|comes?|will|to|should|be|is|are|not|yet|written|added|done|missing|follows?|here|later|pending|needed))+"
    r"|(?:placeholder|dummy|missing|empty|no|lorem ipsum)(?: (?:docs?|docstrings?|documentation|descriptions?|comments?|text|summary|available|yet|given|provided))+"
    r"|(?:auto[ -]?)?generated(?: by .*)?(?: (?:method|function|class|constructor|catch|stub|block|code|documentation|docs?|comment))*"
    r"|(?:to be|not yet) (?:documented|written|described|done|added|implemented|completed|determined|announced)(?: (?:yet|later|here))*"
    r"|(?:not|un)[ -]?(?:documented|implemented)(?: yet)?|coming soon|see (?:above|below|code|source|name)|self[ -]explanatory|same as above|ditto"
)
# Comments that steer tools, and tags that only name a parameter or a type.
DIRECTIVE = (
    r"(?:noqa|nolint|nosec|nosonar|nopmd|noinspection|noformat|type ?: ?ignore|pylint ?:|flake8 ?:|mypy ?:|pyright ?:|ruff ?:|isort ?:|yapf ?:|fmt ?:|black ?:|"
    r"eslint(?:-[a-z-]+)?|tslint ?:|jshint|jslint|prettier-ignore|stylelint-\w+|istanbul ignore|c8 ignore|v8 ignore|@ts-\w+|@flow|biome-ignore|deno-\w+|"
    r"shellcheck|clang-format|cppcheck-suppress|coverity|lint ?:|rustfmt::|clippy::|go ?:(?:generate|build|embed|noinline|linkname)\b|\+build|checkstyle ?:|"
    r"pragma ?:?|region|endregion|cspell ?:|codespell ?:|sourcery|spotless ?:|@formatter|formatter ?:|generated$|coverage ?:|vim ?:|-\*-)\b?.*"
)
TAG_LINE = (
    r"[@\\:](?:param|parameter|arg|argument|keyword|key|type|rtype|return|returns|raise|raises|throws|exception|tparam|property|prop|template|typeparam|yield|yields|var|ivar)\b"
    r"(?:\s*\[?(?:in|out)\]?)?(?:\s*\{[^}]*\})?(?:\s+[\w.$*&\[\]<>|=?]+){0,2}\s*:?\s*"
    r"|\{?@?inherit-?docs?\}?\.?|[@\\](?:override|deprecated|private|public|internal|protected|static|async|abstract|readonly|see|since|author|version|ignore|hidden|api)\b(?:\s+\S+)?"
    r"|(?:parameters|params|args|arguments|returns?|raises|yields|throws|examples?|notes?|see also)\s*:?"
)


def callable_kind(kind: Column) -> Column:
    """function or method whatever the spelling, else null."""
    k = F.lower(F.trim(F.regexp_replace(kind, r"[\s ]+", " ")))
    return F.when(k.isin("function", "func", "fn", "def"), "function").when(k.isin("method", "meth"), "method")


def plain_doc(doc: Column) -> Column:
    """Documentation without comment marks, quotes and markup tags; lines stay."""
    d = F.regexp_replace(doc, r"\r\n?", "\n")
    d = F.regexp_replace(d, r"(?m)^[\s ]*(?:/\*+!?|\*+/|///?!?|\*(?!\*)|#+!?|--+|;+|\"\"\"|'''|<!--)[ \t]*", "")
    d = F.regexp_replace(d, r"(?m)[ \t]*(?:\*+/|\"\"\"|'''|-->)[\s ]*$", "")
    d = F.regexp_replace(d, r"</?[A-Za-z][^<>]*>", " ")
    return F.trim(F.regexp_replace(d, r"^[\s ​﻿]+|[\s ​﻿]+$", ""))


def name_words(name: Column) -> Column:
    """The words of an identifier, lower-case, with single blanks: camel case, snake case and digits split."""
    n = F.regexp_replace(name, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    n = F.regexp_replace(n, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    n = F.regexp_replace(n, r"(\p{L})(\p{Nd})", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(n, r"[^\p{L}\p{N}]+", " ")))


def tells_something(doc: Column, name: Column) -> Column:
    """Whether documentation says anything about what its symbol does; false for null.

    False for blank text, placeholders, the symbol's own name (alone or in "this is the ... function"),
    rows of marks, tool directives and bare parameter tags. Any language counts as documentation.
    """
    lines = F.transform(F.split(plain_doc(doc), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s ]+", " ")))
    empty_line = lambda x: (
        ~x.rlike(r"[\p{L}\p{N}]") | F.lower(x).rlike(f"^(?:{DIRECTIVE})$") | F.lower(x).rlike(f"^(?:{TAG_LINE})$")
    )
    rest = F.array_join(F.filter(lines, lambda x: ~empty_line(x)), " ")
    flat = F.trim(F.lower(F.regexp_replace(rest, r"[^\p{L}\p{N}:/ .-]+", " ")))
    flat = F.regexp_replace(F.regexp_replace(flat, r"\s+", " "), r"[ .:-]+$", "")
    # one letter or digit sequence without boundaries compares names however they are split
    squeeze = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")
    own = squeeze(F.coalesce(name, F.lit("")))
    said = squeeze(rest)
    core = squeeze(
        F.regexp_replace(
            F.regexp_replace(flat, r"^(?:(?:this|it|here) is )?(?:the |a |an )?(?:(?:function|method|procedure|helper|constructor|class) )?(?:named |called |for )?", ""),
            r" (?:function|method|procedure|helper|routine|constructor|class|implementation|impl)$", "",
        )
    )
    words = name_words(F.coalesce(name, F.lit("")))
    same = (said == own) | (core == own) | (said == squeeze(words)) | (core == squeeze(words))
    # the same name without its trailing number
    bare = F.regexp_replace(own, r"\p{N}+$", "")
    same = same | ((bare != "") & ((said == bare) | (core == bare)))
    stands_in = flat.isin(*PLACEHOLDERS) | flat.rlike(f"^(?:{PLACEHOLDER_TEXT})$")
    return F.coalesce(doc.isNotNull() & (said != "") & ~stands_in & ~(same & (own != "")), F.lit(False))


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """One row per symbol id; of differing deliveries the one that is last by all columns. Null ids are dropped."""
    cols = ["file_id", "kind", "name", "qualname", "line_start", "line_end", "docstring"]
    latest = symbols.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct(*cols)).alias("s"))
    return latest.select("id", "s.*")


def callables(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The functions and methods of files with a body: id, file_id, kind, name, qualname, line_start, line_end, docstring, repo."""
    calls = symbols.where(callable_kind(F.col("kind")).isNotNull() & F.col("file_id").isNotNull())
    repo = F.split(F.regexp_replace("path", r"^(?:\./)+", ""), "/")[0]
    there = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(repo).alias("repo"))
    return cut(skew_join(distinct_symbols(calls).withColumn("kind", callable_kind(F.col("kind"))), there, "file_id"))


def inherited(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Methods without documentation of their own that take it from a class they derive from: id, doc, doc_from.

    ``calls``: see :func:`callables`. Each round climbs one level for the methods that are still
    open; nearest documented method first, then the smallest base class name and id. A method visits
    every class once, so cycles end, and rounds go on until no method is open.
    """
    owner = F.regexp_extract("qualname", r"([^.:#]+)(?:\.|::|#)[^.:#]+$", 1)
    s = calls.withColumn("cls", owner).where((F.col("cls") != "") & F.col("name").isNotNull())
    own = tells_something(F.col("docstring"), F.col("name"))
    edges = cut(class_bases(files))
    given = s.where(own).join(edges.select("repo", F.col("base").alias("cls")).distinct(), ["repo", "cls"], "left_semi")
    given = given.groupBy("repo", "cls", "name").agg(F.min(F.struct(F.col("id").alias("doc_from"), plain_doc(F.col("docstring")).alias("doc"))).alias("d"))
    given = cut(given.select(F.col("repo"), F.col("cls").alias("base"), "name", "d.*"))
    open_ = cut(s.where(~own).join(edges.select("repo", "cls").distinct(), ["repo", "cls"], "left_semi").select("id", "repo", "name", "cls"))
    visited, done = open_.select("id", "cls"), None
    while not open_.isEmpty():
        up = open_.join(edges, ["repo", "cls"]).select("id", "repo", "name", "base").distinct()
        up = up.join(visited.withColumnRenamed("cls", "base"), ["id", "base"], "left_anti")
        got = cut(up.join(given, ["repo", "base", "name"], "left"))
        hit = got.where(F.col("doc_from").isNotNull()).groupBy("id").agg(F.min(F.struct("base", "doc_from", "doc")).alias("h")).select("id", F.col("h.doc").alias("doc"), F.col("h.doc_from").alias("doc_from"))
        hit = cut(hit)
        done = hit if done is None else done.unionByName(hit)
        open_ = cut(got.join(hit.select("id"), "id", "left_anti").select("id", "repo", "name", F.col("base").alias("cls")))
        visited = cut(visited.unionByName(open_.select("id", "cls")))
    return done if done is not None else given.select(F.col("doc_from").alias("id"), "doc", "doc_from").limit(0)


def documented(calls: DataFrame, files: DataFrame) -> DataFrame:
    """id, doc, doc_from of every callable with documentation that tells something: its own, or else what the class hierarchy hands down."""
    own = calls.where(tells_something(F.col("docstring"), F.col("name"))).select("id", plain_doc(F.col("docstring")).alias("doc"), F.col("id").alias("doc_from"))
    return own.unionByName(inherited(calls, files))


def documented_ids(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbol_id`` of every function or method with a file body whose own documentation tells something: what is inherited is left out."""
    return documented(callables(symbols, files), files).where(F.col("doc_from") == F.col("id")).select(F.col("id").alias("symbol_id"))


def pairs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Code-description pairs: symbol_id, file_id, kind, name, code, doc, doc_from.

    ``doc_from`` is the symbol whose documentation it is: its own id, or that of the overridden method.
    The code is lines ``line_start`` to ``line_end`` of the file's body (either line end; clipped to the
    file). Symbols without a file body, without any documentation that tells something, or with null or
    reversed lines have no row; repeated deliveries count once; of repeated file rows the greatest body counts.
    """
    bodies = files.where(F.col("file_id").isNotNull() & F.col("body").isNotNull()).groupBy("file_id").agg(F.max("body").alias("body"))
    calls = callables(symbols, files.where(F.col("body").isNotNull()))
    docs = documented(calls, files)
    told = cut(calls.select("id", "file_id", "kind", "name", "line_start", "line_end").join(docs, "id"))
    code = code_of(told.select("id", "file_id", "line_start", "line_end"), bodies)
    return told.join(code, "id").select(F.col("id").alias("symbol_id"), "file_id", "kind", "name", "code", "doc", "doc_from").where(F.length("code") > 0)
