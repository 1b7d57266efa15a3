"""Class hierarchies of sources, from the tokens of their class headers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Comments and strings, which hold no headers, then words and marks, for sources with // and with # comments.
_SLASH = re.compile(r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<word>[^\W\d][\w$]*)|(?P<mark>::|[^\s\w])|(?P<nl>\n)", re.S)
_HASH = re.compile(r"(?P<skip>#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<word>[^\W\d]\w*)|(?P<mark>[^\s\w])|(?P<nl>\n)", re.S)
_PLAIN_QUOTE = re.compile(r"'(?=[A-Za-z_]\w*\b(?!'))")
_HEADS = re.compile(r"\b(?:class|interface|struct|impl|record|enum|trait|object|mixin|protocol)\b")
_KINDS = frozenset("class interface struct record enum trait object mixin protocol".split())
_NO_BASE = frozenset("extends implements with public protected private virtual final abstract static internal sealed open where type".split())
_CLOSE = {"<": ">", "(": ")", "[": "]", "{": "}"}


class Headers:
    """Class headers of a source: (class, base) edges, read from its tokens without building a tree."""

    def __init__(self, path: str, body: str):
        ext = path.lower().rsplit(".", 1)[-1]
        self.hash = ext in ("py", "pyi", "pyw", "rb")
        #: Whether bases stand behind a colon.
        self.colon = ext in ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "ipp", "h", "cs", "csx", "kt", "kts", "rs", "swift")
        if ext in ("sh", "bash", "ksh", "sql", "css", "html", "htm", "md", "txt", "json", "yaml", "yml"):
            body = ""
        if path.lower().endswith(".rs"):
            body = _PLAIN_QUOTE.sub(" ", body)  # lifetimes are no strings
        self.t = [m[0] for m in (_HASH if self.hash else _SLASH).finditer(body) if m.lastgroup != "skip" and (m.lastgroup != "nl" or path.lower().endswith(".go"))]
        self.go = path.lower().endswith(".go")

    def word(self, i: int) -> bool:
        return i < len(self.t) and (self.t[i][0].isalpha() or self.t[i][0] == "_")

    def past(self, i: int) -> int:
        """Behind the bracket that opens at ``i``; an arrow does not close a list of types."""
        stack = [_CLOSE[self.t[i]]]
        i += 1
        while i < len(self.t) and stack:
            x = self.t[i]
            if x == stack[-1] and not (x == ">" and self.t[i - 1] in "-="):
                stack.pop()
            elif x in _CLOSE and (x != "<" or stack[-1] == ">"):
                stack.append(_CLOSE[x])
            elif x in ")}];" and stack[-1] == ">":
                return i  # it was a comparison
            i += 1
        return i

    def types(self, i: int, ends: tuple) -> tuple[list[str], int]:
        """The last names of the dotted types up to one of ``ends``; arguments and keyword values are left out."""
        out, last, named = [], None, False
        while i < len(self.t) and self.t[i] not in ends:
            x = self.t[i]
            if x in ("<", "(", "[") and x not in ends:
                i = self.past(i)
                continue
            if x in (",", ":") and self.t[i : i + 2] != [":", ":"] or x in ("extends", "implements", "with"):
                if last and not named:
                    out.append(last)
                last, named = None, False
            elif x == "=":
                named = True
            elif self.word(i) and x not in _NO_BASE and x != "for":
                last = x
            i += 1
        if last and not named:
            out.append(last)
        return out, i

    def edges(self) -> Iterator[tuple[str, str]]:
        t, i = self.t, 0
        while i < len(t):
            x = t[i]
            if self.go:
                if x == "type" and self.word(i + 1) and t[i + 2 : i + 3] in (["struct"], ["interface"]) and t[i + 3 : i + 4] == ["{"]:
                    yield from self.embedded(t[i + 1], i + 4)
                i += 1
                continue
            if x == "impl" and not self.hash:
                j = self.past(i + 1) if t[i + 1 : i + 2] == ["<"] else i + 1
                trait, j = self.types(j, ("for", "{", ";", "where"))
                if t[j : j + 1] == ["for"]:
                    own, j = self.types(j + 1, ("{", ";", "where"))
                    for a in own[:1]:
                        for b in trait[:1]:
                            yield a, b
                i = j
                continue
            if x not in _KINDS or not self.word(i + 1) or i and t[i - 1] in (".", "@", "->"):
                i += 1
                continue
            cls, j = t[i + 1], i + 2
            if self.hash:
                if t[j : j + 1] == ["("]:
                    bases, j = self.types(j + 1, (")",))
                    yield from ((cls, b) for b in bases)
                elif t[j : j + 1] == ["<"] and self.word(j + 1):
                    yield cls, t[j + 1]
                i = j
                continue
            if t[j : j + 1] == ["<"]:
                j = self.past(j)
            if t[j : j + 1] == ["("]:
                j = self.past(j)
            while j < len(t) and t[j] in _NO_BASE - {"extends", "implements", "with"}:
                j += 1
            if t[j : j + 1] and t[j] in ("extends", "implements", "with", *((":",) if self.colon else ())):
                bases, j = self.types(j, ("{", ";", "where", "permits", "}"))
                if t[j : j + 1] != ["}"]:
                    yield from ((cls, b) for b in bases)
            i = max(j, i + 1)

    def embedded(self, cls: str, i: int) -> Iterator[tuple[str, str]]:
        """Embedded types of a Go struct or interface: lines that hold one type and no field name."""
        line: list[str] = []
        while i < len(self.t) and self.t[i] != "}":
            if self.t[i] in ("{", "(", "["):
                line.append(self.t[i])
                i = self.past(i)
                continue
            if self.t[i] in ("\n", ";"):
                yield from self.alone(cls, line)
                line = []
            else:
                line.append(self.t[i])
            i += 1
        yield from self.alone(cls, line)

    def alone(self, cls: str, line: list[str]) -> Iterator[tuple[str, str]]:
        names = [x for x in line if x not in ("*", ".", "[")]
        if line and "(" not in line and "{" not in line and len(names) in (1, 2) and (len(names) == 1 or line[-2:-1] == ["."] or line[-3:-2] == ["."]):
            yield cls, names[-1]


def _read_headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (repo, a, b)
            for repo, path, body in zip(*(batch.column(i).to_pylist() for i in range(3)))
            for a, b in dict.fromkeys(Headers(path, body).edges())
            if a != b
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["repo", "cls", "base"])


def class_bases(files: DataFrame) -> DataFrame:
    """Class hierarchies of the sources: ``repo``, ``cls``, ``base``, one row per edge.

    ``files``: path, body. Headers of classes, interfaces, records, enums, traits and objects are read from
    the tokens, over as many lines as they take; ``impl Trait for A`` and embedded Go types are edges, too.
    Names are taken without type parameters and qualifiers and hold within a repository (the first segment
    of the path). Comments and strings hold no headers. Null paths and bodies have no edges.
    """
    repo = F.split(F.regexp_replace("path", r"^(?:\./)+", ""), "/")[0]
    rows = files.where(F.col("path").isNotNull() & F.col("body").rlike(_HEADS.pattern)).select(repo.alias("repo"), "path", "body")
    return rows.mapInArrow(_read_headers, "repo string, cls string, base string").distinct()
