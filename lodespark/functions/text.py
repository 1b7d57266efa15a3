"""Tokenizers and path predicates as column expressions. The three tokenizers differ on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name postings leave out.
NAME_STOPWORDS = [
    "the", "and", "for", "with", "from", "into", "this", "that", "what", "where", "when", "why", "how", "fix", "bug", "error", "traceback",
    "file", "line", "test", "tests", "code", "src", "function", "class", "method", "module", "este", "esta", "esto", "ese", "esa", "eso",
    "con", "para", "que", "por", "los", "las", "una", "uno", "momento", "ahora", "sigue", "seguir", "continua", "continuar", "continuemos",
    "seguimos", "path", "foco", "extra", "cual", "quien", "donde", "cuando", "como", "clase", "codigo", "código", "fichero", "archivo",
    "funcion", "función",
]
# Tokens that stand for others as well.
NAME_ALIASES = {
    "class": ["class"], "code": ["code"], "file": ["file"], "scheduler": ["sched"], "scheduling": ["sched"],
    "parsear": ["parse", "parser", "parsers", "parsed"], "parsea": ["parse", "parser", "parsers", "parsed"],
    "parseo": ["parse", "parser", "parsers", "parsed"], "parse": ["parser", "parsers", "parsed"],
    "parser": ["parse", "parsers", "parsed"], "parsing": ["parse", "parser", "parsers", "parsed"],
    "archivo": ["file", "source"], "fichero": ["file", "source"], "codigo": ["code", "source"], "clase": ["class"],
}
# Words that term profiles leave out.
PROFILE_STOPWORDS = [
    "the", "and", "for", "with", "from", "this", "that", "self", "return", "none", "true", "false", "init", "str", "int", "list", "dict",
    "test", "get", "set", "py", "ts", "js",
]
# Endings of test files.
TEST_ENDINGS = [
    "_test.py", "_test.go", "_test.rs", "_test.ts", "_test.js", "_test.dart", "_spec.rb", "_spec.js", "_spec.ts", ".test.ts", ".test.tsx",
    ".test.js", ".test.jsx", ".test.mjs", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", ".spec.mjs",
]


def camel_parts(text: Column) -> Column:
    """Runs of one case or of digits; an upper-case run counts only before another capital or at the end."""
    return F.regexp_extract_all(text, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+)"), F.lit(1))


def name_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Distinct tokens of a name, path or prompt: words of three or more letters, split at case changes, with aliases. Null gives null."""
    flat = F.regexp_replace(text, r"[-./]", "_")
    words = F.regexp_extract_all(flat, F.lit(r"([A-Za-z][A-Za-z0-9_]{2,})"), F.lit(1))
    pieces = F.flatten(F.transform(words, lambda w: F.flatten(F.transform(F.split(w, "_"), camel_parts))))
    raw = F.array_distinct(F.filter(F.transform(pieces, F.lower), lambda t: F.length(t) >= 3))
    kept = F.array_except(raw, F.array(*[F.lit(w) for w in sorted({*NAME_STOPWORDS, *stopwords})]))
    alias = F.create_map(*[x for k, v in NAME_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(raw, lambda t: F.coalesce(F.try_element_at(alias, t), F.array().cast("array<string>"))))
    return F.array_union(kept, more)


def search_tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits after a split at case changes."""
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda t: t != ""))


def profile_terms(text: Column) -> Column:
    """All occurrences of terms of three or more characters that are neither numbers nor stopwords."""
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    stop = F.array(*map(F.lit, PROFILE_STOPWORDS))
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"))


def index_terms(text: Column) -> Column:
    """All occurrences of full-text terms: letters, digits and the marks _ . - , lower-case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_.\-]+)"), F.lit(1))


def plain_path(path: Column) -> Column:
    """A path without any leading ./"""
    return F.regexp_replace(path, r"^(?:\./)+", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_test_path(path: Column) -> Column:
    """The ranker's notion of a test file."""
    low = F.lower(path)
    name = base_name(low)
    return low.rlike(r"(^|/)tests?/") | name.startswith("test_") | name.endswith("_test.py") | name.contains(".test.") | name.contains(".spec.")


def looks_like_test(path: Column) -> Column:
    """The search's notion of a test file: directories, snake or dotted endings, and case-sensitive type names."""
    name = base_name(path)
    low = F.lower(name)
    ends = F.lit(False)
    for e in TEST_ENDINGS:
        ends = ends | low.endswith(e)
    in_dir = F.exists(F.split(F.lower(path), "/"), lambda p: p.isin("test", "tests", "spec", "__tests__"))
    return in_dir | low.startswith("test_") | ends | name.rlike(r"(?:Test|Tests|Spec|Specs)\.(?i:java|cs|kt|kts)$")


def clipped(text: Column, n: int) -> Column:
    """White space collapsed, and cut to ``n`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…")))
