"""What a source file declares and uses: symbols, imports, calls, bases and triggers, from its tokens.

Nineteen languages in four families: Python is read by its own parser (by indentation where a file does not parse),
languages with braces by tokens and matched brackets, Ruby by its block words, and the declarative ones (SQL, GraphQL, CSS,
HTML, shell) by their statements. Comments and strings declare nothing. Bodies of functions are not entered.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Symbol:
    kind: str
    name: str
    qualname: str
    line_start: int
    line_end: int
    doc: str | None = None


@dataclass
class Outline:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[tuple[str, int]] = field(default_factory=list)
    calls: list[tuple[str, int]] = field(default_factory=list)
    triggers: list[tuple[str, str, str, int]] = field(default_factory=list)  # kind, trigger, by, line
    doc: str | None = None


# Comments and strings of each family, then words and marks.
_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_LEX = {
    "slash": re.compile(rf"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"\"\".*?(?:\"\"\"|\Z)|@\"(?:[^\"]|\"\")*\"|{_STRINGS}|`(?:[^`\\]|\\.)*`)|(?P<w>[^\W\d][\w$]*|[#$@][^\W\d]\w*|\d[\w.]*)|(?P<m>=>|->|::|\?\.|[^\s\w])", re.S),
    "rust": re.compile(r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>b?r(#*)\".*?\"\4|b?\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{1,8}?)')|(?P<w>[^\W\d]\w*|\d[\w.]*)|(?P<m>'\w+|=>|->|::|[^\s\w])".replace(r"\4", r"\3"), re.S),
    "hash": re.compile(rf"(?P<c><#.*?(?:#>|\Z)|#[^\n]*)|(?P<s>\"\"\".*?(?:\"\"\"|\Z)|@\"\n.*?\n\"@|@'\n.*?\n'@|{_STRINGS})|(?P<w>[^\W\d][\w-]*|\$\w+|\d[\w.]*)|(?P<m>::|[^\s\w])", re.S),
}
_REGEX = r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_LEX["script"] = re.compile(_LEX["slash"].pattern.replace("|`(?:", rf"|(?:(?<=[(,=:\[!&|?{{;])|(?<=[(,=:\[!&|?{{;] )|(?<=return )){_REGEX}|`(?:", 1), re.S)
_LEX["shell"] = re.compile(r"(?P<c>(?<![^\s;(])#[^\n]*)|(?P<s>\"(?:[^\"\\]|\\.)*\"|'[^']*')|(?P<w>[^\W\d][\w-]*|\$[\w#?@*!$-]|\d[\w.]*)|(?P<m>\$\{[^}\n]*\}|[^\s\w])", re.S)
_LEX["php"] = re.compile(_LEX["slash"].pattern.replace(r"//[^\n]*", r"(?://|#(?!\[))[^\n]*", 1), re.S)
_OPEN = {"(": ")", "[": "]", "{": "}"}


class Tokens:
    """Words and marks with their lines, the comments before them, and where brackets close; unmatched ones close at the end."""

    def __init__(self, text: str, lex: str):
        self.v: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.comment: dict[int, list[tuple[int, int, str]]] = {}  # index of the next token -> (first line, last line, text)
        line, at = 1, 0
        for m in _LEX[lex].finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if m.lastgroup == "c":
                self.comment.setdefault(len(self.v), []).append((line, line + m[0].count("\n"), m[0]))
            else:
                self.v.append(m[0])
                self.kind.append("s" if m.lastgroup == "s" or m["s"] is not None else m.lastgroup or "m")
                self.line.append(line)
        self.last = text.count("\n") + 1
        self.close = list(range(len(self.v)))
        stack: list[int] = []
        for i, x in enumerate(self.v):
            if self.kind[i] != "m":
                continue
            if x in _OPEN:
                stack.append(i)
            elif x in ")]}":
                # a brace closes what is open within it; other brackets close no brace
                k = len(stack)
                while k and _OPEN[self.v[stack[k - 1]]] != x and (x == "}" or self.v[stack[k - 1]] != "{"):
                    k -= 1
                if k and _OPEN[self.v[stack[k - 1]]] == x:
                    while len(stack) >= k:
                        self.close[stack.pop()] = i
        for i in stack:
            self.close[i] = len(self.v)
        # rules look a little past the last token
        self.close += [len(self.v)] * 16
        self.line += [self.last] * 16

    def __len__(self) -> int:
        return len(self.v)

    def at(self, i: int) -> str:
        return self.v[i] if 0 <= i < len(self.v) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.v) and self.kind[i] == "w" and not self.v[i][0].isdigit()

    def end_line(self, i: int) -> int:
        return self.line[i] if i < len(self.v) else self.last

    def doc(self, i: int) -> str | None:
        """First line of the comments that end right above token ``i``."""
        rows, line = self.comment.get(i, []), self.line[i] if i < len(self.v) else self.last
        block: list[str] = []
        for _, end, t in reversed(rows):
            if end < line - 1 or end > line:
                break
            block.insert(0, t)
            line = _
        return first_line("\n".join(block))

    def generics(self, i: int) -> int:
        """Behind a list of type parameters that opens at ``i``."""
        depth, j = 0, i
        while j < len(self.v):
            x = self.v[j]
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x in ("(", "["):
                j = self.close[j]
            elif x in ("{", ";", ")"):
                return i
            j += 1
        return i


def first_line(comment: str | None) -> str | None:
    """The first line of a comment that says anything, without comment marks."""
    for raw in (comment or "").split("\n"):
        t = re.sub(r"^\s*(?:/\*+!?|///?!?|\*+/?|#+!?|<#|--+)\s?|\s*(?:\*+/|#>)\s*$", "", raw).strip()
        if re.search(r"\w", t):
            return t
    return None


# Words that open a type, by language, and words before ( that are no names: of all languages and of each.
TYPE_WORDS = {
    "javascript": {"class": "class"},
    "typescript": {"class": "class", "interface": "interface", "enum": "enum"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "record"},
    "csharp": {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "record": "record"},
    "kotlin": {"class": "class", "interface": "interface", "object": "object"},
    "dart": {"class": "class", "mixin": "mixin", "enum": "enum", "extension": "extension"},
    "php": {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum"},
    "cpp": {"class": "class", "struct": "struct", "union": "union", "enum": "enum"},
    "rust": {"struct": "struct", "enum": "enum", "trait": "trait", "union": "struct"},
    "powershell": {"class": "class", "enum": "enum"},
}
_NO_NAMES = "if for while switch catch return throw new else do try finally case default super this"
_NO_NAMES_OF = {
    "javascript": "with function typeof instanceof in of delete void await yield var let const class import async",
    "java": "synchronized instanceof assert yield",
    "csharp": "using lock foreach fixed checked unchecked sizeof nameof when typeof await yield base in is as var",
    "cpp": "sizeof decltype alignof noexcept static_assert asm operator goto delete static_cast dynamic_cast const_cast reinterpret_cast co_await co_return co_yield explicit",
    "kotlin": "when fun in is as val var constructor object import typeof throw",
    "dart": "await yield assert is as in get set on show hide import export part with rethrow",
    "php": "echo print isset empty unset list array exit die include require include_once require_once foreach elseif function fn match use declare clone",
    "rust": "loop unsafe match move fn let mut ref pub use mod impl where as dyn in",
    "go": "select go defer range func import type const var map chan struct interface",
    "python": "and or not in is lambda del pass def class import from with assert raise elif except yield await global print",
    "ruby": "elsif unless until begin rescue ensure end and or not defined yield when then puts def module class",
    "powershell": "foreach elseif param begin process end function filter trap until data using",
    "bash": "then elif fi done esac in function select until",
}
_NO_NAMES_OF["typescript"] = _NO_NAMES_OF["javascript"] + " type interface enum declare namespace keyof infer is readonly"
_NO_NAMES_OF["c"] = _NO_NAMES_OF["cpp"]


def no_names(language: str) -> frozenset[str]:
    """Words of a language that are no names where a ( follows."""
    return frozenset(f"{_NO_NAMES} {_NO_NAMES_OF.get(language, '')}".split())


#: Marks and words that may stand between the parameters and the body of a function.
_AFTER = frozenset("throws const override final noexcept volatile async sync where mutable".split())


class Braces:
    """Declarations of a language with braces."""

    def __init__(self, language: str, text: str):
        self.lang = language
        if language in ("c", "cpp"):  # directives hold no declarations
            text = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        self.t = Tokens(text, {"rust": "rust", "powershell": "hash", "php": "php", "javascript": "script", "typescript": "script"}.get(language, "slash"))
        self.out: list[Symbol] = []
        self.no_names = no_names(language)

    def emit(self, kind: str, name: str, owner: str, first: int, last: int) -> str:
        q = f"{owner}.{name}" if owner else name
        self.out.append(Symbol(kind, name, q, self.t.end_line(first), self.t.end_line(min(last, len(self.t) - 1)), self.t.doc(first)))
        return q

    def run(self) -> list[Symbol]:
        members = {"java": self.members, "csharp": self.members, "c": self.members, "cpp": self.members, "dart": self.members}.get(self.lang, self.keyed)
        members(0, len(self.t), "", "")
        return self.out

    def body(self, i: int, end: int) -> int:
        """The { that follows ``i`` before any ; or }, or -1."""
        t = self.t
        while i < end:
            if t.at(i) == "{":
                return i
            if t.at(i) in (";", "}"):
                return -1
            i = t.close[i] + 1 if t.at(i) in ("(", "[") else i + 1
        return -1

    # -- languages whose declarations begin with a word of their own
    def keyed(self, i: int, end: int, owner: str, within: str) -> None:
        t, lang = self.t, self.lang
        first = i
        fresh = True  # at the beginning of a statement
        while i < end:
            if fresh:
                first = i
            x = t.at(i)
            done = self.declared(i, end, first, owner, within) if t.is_word(i) or x in ("*", "#", "[") else None
            if done is not None:
                i, fresh = done, True
                continue
            if x in _OPEN:
                # the braces of namespaces and modules are entered, all others passed
                inside = lang in ("rust", "php", "typescript") and x == "{" and any(t.at(k) in ("mod", "namespace", "module") for k in range(max(first, i - 4), i))
                if inside:
                    self.keyed(i + 1, min(t.close[i], end), owner, within)
                i = t.close[i] + 1
                fresh = x == "{"
                continue
            fresh = x in (";", "}") or i + 1 < end and t.line[i + 1] > t.line[i] and x not in ("@", "=", ",", ".", "=>", "&", "|", "+")
            if x in ("export", "default", "public", "private", "protected", "static", "abstract", "final", "async", "pub", "internal", "open", "override", "suspend", "inline", "data", "sealed", "declare", "readonly"):
                fresh = False
            i += 1

    def declared(self, i: int, end: int, first: int, owner: str, within: str) -> int | None:
        """Behind the declaration that begins at ``i``, or None."""
        t, lang, x = self.t, self.lang, self.t.at(i)
        before = t.at(i - 1)
        if before in (".", "?.") or t.at(i + 1) == ":" and lang != "kotlin" and not within:
            return None
        types = TYPE_WORDS.get(lang, {})
        if x in types and before not in ("::",):
            if lang == "kotlin" and x == "class" and before in ("enum", "annotation", "data", "sealed"):
                kind = {"enum": "enum"}.get(before, "class")
            else:
                kind = types[x]
            j = i + 1
            if lang == "typescript" and x == "enum" or t.is_word(j):
                name = t.at(j)
                if not t.is_word(j) or name in ("extends", "implements"):
                    return None
                b = self.body(j, end)
                stop = t.close[b] if b >= 0 else self.statement_end(j, end)
                q = self.emit(kind, name, owner, first, stop)
                if b >= 0:
                    self.keyed(b + 1, min(stop, end), q, kind)
                return stop + 1
            return None
        if lang == "go" and not owner:
            return self.go(i, end, first)
        if lang == "rust":
            return self.rust(i, end, first, owner, within)
        if lang == "typescript" and x == "type" and t.is_word(i + 1) and t.at(t.generics(i + 2) if t.at(i + 2) == "<" else i + 2) == "=":
            stop = self.statement_end(i, end)
            self.emit("type", t.at(i + 1), owner, first, stop)
            return stop + 1
        if lang in ("javascript", "typescript"):
            return self.script(i, end, first, owner, within)
        if lang == "kotlin":
            if x == "typealias" and t.is_word(i + 1):
                self.emit("typealias", t.at(i + 1), owner, first, i + 1)
                return self.statement_end(i, end) + 1
            if x == "constructor" and t.at(i + 1) == "(" and within:
                stop = t.close[i + 1]
                b = stop + 1
                if t.at(b) == ":":
                    b = self.body(b, end)
                stop = t.close[b] if b >= 0 and t.at(b) == "{" else stop
                self.emit("constructor", owner.rsplit(".", 1)[-1], owner, first, stop)
                return stop + 1
            if x == "fun":
                j = t.generics(i + 1) if t.at(i + 1) == "<" else i + 1
                while t.is_word(j) and (t.at(j + 1) in (".", "?.") or t.at(j + 1) == "<"):
                    j = t.generics(j + 1) if t.at(j + 1) == "<" else j + 1
                    j += t.at(j) in (".", "?.")
                if t.is_word(j) and t.at(j + 1) == "(":
                    return self.function(j, end, first, owner, within)
            return None
        if lang == "php" and x == "function":
            j = i + 1 + (t.at(i + 1) == "&")
            if t.is_word(j) and t.at(j + 1) == "(":
                return self.function(j, end, first, owner, within)
            return None
        if lang == "powershell":
            low = x.lower()
            if low in ("function", "filter") and t.is_word(i + 1):
                b = self.body(i + 2, end)
                stop = t.close[b] if b >= 0 else i + 1
                self.emit(low, t.at(i + 1), owner, first, stop)
                return stop + 1
            if within == "class" and t.at(i + 1) == "(" and t.at(t.close[i + 1] + 1) in ("{", ":"):
                b = self.body(t.close[i + 1] + 1, end)
                if b >= 0:
                    self.emit("constructor" if x == owner else "method", x, owner, first, t.close[b])
                    return t.close[b] + 1
        return None

    def statement_end(self, i: int, end: int) -> int:
        """The last token of a statement without a body: at ; or where the line ends outside brackets."""
        t = self.t
        while i < end:
            if t.at(i) == ";":
                return i
            if t.at(i) in _OPEN:
                i = min(t.close[i], end - 1)
            if i + 1 >= end or t.line[i + 1] > t.line[i] and t.at(i) not in ("=", "|", "&", ",", "=>", "(", "+", "?", ":") and t.at(i + 1) not in ("|", "&", "=", ".", "?", ":", "where"):
                return i
            i += 1
        return end - 1

    def function(self, name: int, end: int, first: int, owner: str, within: str, kind: str | None = None) -> int:
        """A function whose name is at ``name``, with its parameters next."""
        t = self.t
        j = t.close[name + 1] + 1
        b = -1
        if t.at(j) == "{":
            b = j
        elif t.at(j) == "=" and self.lang == "kotlin":
            stop = self.statement_end(j, end)
            self.emit(kind or ("method" if within else "function"), t.at(name), owner, first, stop)
            return stop + 1
        elif t.at(j) in (":", "->", "where") or t.at(j) in _AFTER:
            k = j
            while k < end and t.at(k) not in ("{", ";", "}"):
                if t.line[k] > t.line[k - 1] and t.at(k - 1) not in (":", ",", "->", "|", "&", "<", "where", "+", ")") and self.lang not in ("rust", "php"):
                    break
                k = t.close[k] + 1 if t.at(k) in ("(", "[") else k + 1
            b = k if t.at(k) == "{" else -1
        stop = t.close[b] if b >= 0 else self.statement_end(name, end)
        self.emit(kind or ("method" if within else "function"), t.at(name), owner, first, stop)
        return stop + 1

    def script(self, i: int, end: int, first: int, owner: str, within: str) -> int | None:
        t, x = self.t, self.t.at(i)
        if x == "function":
            j = i + 1 + (t.at(i + 1) == "*")
            if t.is_word(j):
                k = t.generics(j + 1) if t.at(j + 1) == "<" else j + 1
                if t.at(k) == "(":
                    return self._script_function(j, k, end, first, owner, "function")
            return None
        if not within and x in ("const", "let", "var") and t.is_word(i + 1):
            j = i + 2
            if t.at(j) == ":":
                while j < end and t.at(j) not in ("=", ";"):
                    j = t.close[j] + 1 if t.at(j) in _OPEN else j + 1
            if t.at(j) != "=":
                return None
            j += 1 + (t.at(j + 1) == "async")
            k = t.generics(j) if t.at(j) == "<" else j
            arrow = t.close[k] + 1 if t.at(k) == "(" else k + 1
            if t.at(arrow) == ":":
                while arrow < end and t.at(arrow) not in ("=>", ";", "="):
                    arrow = t.close[arrow] + 1 if t.at(arrow) in _OPEN else arrow + 1
            if t.at(j) == "function" or t.at(arrow) == "=>" and (t.at(k) == "(" or t.is_word(k)):
                b = self.body(j, end) if t.at(j) == "function" else arrow + 1
                stop = t.close[b] if b >= 0 and t.at(b) == "{" else self.statement_end(arrow, end)
                self.emit("function", t.at(i + 1), owner, first, stop)
                return stop + 1
            return None
        if within in ("class", "interface") and t.is_word(i) and (x not in self.no_names or x in ("delete", "default", "in", "of", "import", "from")):
            k = t.generics(i + 1) if t.at(i + 1) == "<" else i + 1 + (t.at(i + 1) == "?")
            if t.at(k) == "(" and (t.at(t.close[k] + 1) in ("{", ":") or within == "interface" or t.at(t.close[k] + 1) == ";"):
                return self._script_function(i, k, end, first, owner, "method")
        return None

    def _script_function(self, name: int, paren: int, end: int, first: int, owner: str, kind: str) -> int:
        t = self.t
        j = t.close[paren] + 1
        if t.at(j) == ":":  # a type, which may hold braces of its own
            j += 1
            while j < end and t.at(j) not in ("{", ";", "}") or t.at(j) == "{" and t.at(j - 1) in (":", "|", "&", "<", ","):
                if t.at(j) in _OPEN:
                    j = t.close[j] + 1
                elif t.at(j) == "=>" or t.line[j] == t.line[j - 1] or t.at(j - 1) in (":", "|", "&", ",", "<") or t.at(j) in ("|", "&", ">"):
                    j += 1
                else:
                    break
        stop = t.close[j] if t.at(j) == "{" else min(max(t.close[paren], j - 1), end - 1)
        self.emit(kind, t.at(name), owner, first, stop)
        return stop + 1

    def go(self, i: int, end: int, first: int) -> int | None:
        t, x = self.t, self.t.at(i)
        if x == "func":
            owner, j = "", i + 1
            if t.at(j) == "(":
                names = [t.at(k) for k in range(j + 1, min(t.close[j], len(t))) if t.is_word(k)]
                bracket = next((k for k in range(j + 1, min(t.close[j], len(t))) if t.at(k) == "["), None)
                owner = t.at(bracket - 1) if bracket else (names[-1] if names else "")
                j = t.close[j] + 1
            if not t.is_word(j):
                return None
            k = t.close[j + 1] + 1 if t.at(j + 1) == "[" else j + 1
            b = t.close[k] + 1 if t.at(k) == "(" else k
            while b < end and t.at(b) != "{" and t.line[b] == t.line[b - 1]:
                b = t.close[b] + 1 if t.at(b) in ("(", "[") or t.at(b) == "{" else b + 1
            while t.at(b) == "{" and t.at(b - 1) in ("interface", "struct"):
                b = t.close[b] + 1
                while b < end and t.at(b) != "{" and t.line[b] == t.line[b - 1]:
                    b += 1
            stop = t.close[b] if t.at(b) == "{" else b - 1
            self.emit("method" if owner else "function", t.at(j), owner, first, stop)
            return stop + 1
        if x == "type":
            def one(j: int, head: int, stop: int) -> int:
                k = j + 1
                if t.at(k) == "[" and t.close[k] > k + 1 and t.line[t.close[k]] == t.line[k] and t.is_word(k + 1) and t.is_word(k + 2) or t.at(k) == "[" and t.at(k + 2) in ("any", "interface", "~", "comparable"):
                    k = t.close[k] + 1
                k += t.at(k) == "="
                kind = t.at(k) if t.at(k) in ("struct", "interface") else "type"
                b = self.body(k, stop) if kind != "type" else -1
                last = t.close[b] if b >= 0 else self.statement_end(j, stop)
                self.emit(kind, t.at(j), "", head, last)
                return last + 1

            if t.at(i + 1) == "(":
                j, stop = i + 2, min(t.close[i + 1], end)
                while j < stop:
                    j = one(j, j, stop) if t.is_word(j) else j + 1
                return stop + 1
            return one(i + 1, first, end) if t.is_word(i + 1) else None
        return None

    def rust(self, i: int, end: int, first: int, owner: str, within: str) -> int | None:
        t, x = self.t, self.t.at(i)
        if x == "impl":
            b = self.body(i, end)
            if b < 0:
                return None
            j = t.generics(i + 1) if t.at(i + 1) == "<" else i + 1
            named, k = "", j
            while k < b and t.at(k) not in ("where",):
                if t.at(k) == "for":
                    named = ""
                elif t.at(k) == "<":
                    k = max(t.generics(k), k + 1)
                    continue
                elif t.is_word(k) and t.at(k) not in ("dyn", "mut", "const"):
                    named = t.at(k)
                k += 1
            self.keyed(b + 1, min(t.close[b], end), named, "impl")
            return t.close[b] + 1
        if x == "fn" and t.is_word(i + 1):
            k = t.generics(i + 2) if t.at(i + 2) == "<" else i + 2
            if t.at(k) != "(":
                return None
            b = self.body(t.close[k] + 1, end)
            stop = t.close[b] if b >= 0 else self.statement_end(k, end)
            self.emit("method" if within else "function", t.at(i + 1), owner, first, stop)
            return stop + 1
        return None

    # -- languages whose functions are told by their parameters
    def members(self, i: int, end: int, owner: str, within: str) -> None:
        t, lang = self.t, self.lang
        types = TYPE_WORDS.get(lang, {})
        while i < end:
            first, j, paren, opened, equals = i, i, -1, -1, False
            word = -1
            while j < end:  # one declaration: up to its ; or its body
                x = t.at(j)
                if x == "@" and t.is_word(j + 1) or x.startswith("@") and t.is_word(j):
                    j += 2 if x == "@" else 1
                    while t.at(j) == "." and t.is_word(j + 1):
                        j += 2
                    if t.at(j) == "(":
                        j = t.close[j] + 1
                    continue
                if x == "[" or x == "(" and paren >= 0:
                    if first == j and lang == "csharp":  # attributes
                        j = t.close[j] + 1
                        continue
                    j = t.close[j] + 1
                    continue
                if x in types and word < 0 and paren < 0 and t.at(j - 1) not in (".", "<", ",", "::") and t.is_word(j + 1) and not (lang in ("cpp", "c") and t.at(j + 2) not in ("{", ":", "final", ";")):
                    word = j
                elif x == "<" and word < 0 and paren < 0 and t.is_word(j - 1):
                    j = max(t.generics(j), j + 1)
                    continue
                elif x == "(" and not equals:
                    paren = j
                    j = t.close[j] + 1
                    continue
                elif x == "=" and t.at(j + 1) != "=":
                    equals = True
                elif x == "{":
                    opened = j
                    break
                elif x in (";", "}"):
                    break
                elif x == "=>" and paren >= 0 and lang in ("csharp", "dart"):
                    opened = -2
                    while j < end and t.at(j) != ";":
                        j = t.close[j] + 1 if t.at(j) in _OPEN else j + 1
                    break
                elif x == ":" and lang in ("cpp", "c") and t.at(j - 1) in ("public", "private", "protected"):
                    j += 1
                    first = j
                    continue
                j += 1
            stop = t.close[opened] if opened >= 0 else min(j, end - 1)
            i = self.member(first, paren, word, opened, stop, end, owner, within, equals)

    def member(self, first: int, paren: int, word: int, opened: int, stop: int, end: int, owner: str, within: str, equals: bool) -> int:
        t, lang = self.t, self.lang
        heads = [t.at(k) for k in range(first, min(first + 6, len(t)))]
        if "namespace" in heads or heads[:2] == ["extern", '"C"']:
            if opened >= 0:
                self.members(opened + 1, min(stop, end), owner, within)
            return stop + 1
        if word >= 0:
            name, kind = t.at(word + 1), TYPE_WORDS[lang][t.at(word)]
            if lang == "cpp" and t.at(word - 1) == "enum":
                kind = "enum"
            if kind == "record" and lang == "csharp" and name in ("struct", "class"):
                name = t.at(word + 2)
            if opened < 0 and lang in ("cpp", "c"):
                return stop + 1
            if lang == "c":
                return stop + 1
            q = self.emit(kind, name, owner, first, stop)
            if opened >= 0 and not (lang == "java" and owner and kind == "record"):
                self.members(opened + 1, min(stop, end), q, kind)
            return stop + 1
        if "typedef" in heads and lang in ("cpp", "dart"):
            names = [k for k in range(first, stop) if t.is_word(k)]
            if lang == "dart" and names:
                self.emit("typedef", t.at(names[1] if len(names) > 1 else names[0]), owner, first, stop)
            elif names and opened < 0:
                self.emit("typedef", t.at(names[-1]), owner, first, stop)
            elif opened >= 0 and t.is_word(stop + 1):
                self.emit("typedef", t.at(stop + 1), owner, first, stop + 1)
                return stop + 2
            return stop + 1
        if lang == "csharp" and "delegate" in heads and paren > 0:
            self.emit("delegate", t.at(paren - 1), owner, first, stop)
            return stop + 1
        if lang == "dart" and within and "get" in heads and paren < 0:
            k = first + heads.index("get") + 1
            self.emit("getter", t.at(k), owner, first, stop)
            return stop + 1
        if paren > first - 1 and paren >= 0 and not (equals and opened != -2):
            n = paren - 1
            if t.at(n) == ">":  # type arguments of the name
                while n > first and t.at(n) != "<":
                    n -= 1
                n -= 1
            name = t.at(n)
            ok = t.is_word(n) and name not in self.no_names and t.at(n - 1) not in (".", "->", "new", "return", "=")
            if lang in ("c", "cpp") and opened < 0:
                ok = ok and lang == "cpp" and bool(within) and n > first
            if lang in ("java", "csharp", "dart") and not within:
                ok = ok and lang == "dart" and (opened >= 0 or opened == -2)
            if within == "enum" and n == first:  # a constant with arguments
                ok = False
            if ok and lang in ("c",) and name.startswith(("SYSCALL_DEFINE", "BPF_PROG", "BPF_CALL")):
                name = t.at(paren + 1)
            if ok:
                cls = owner.rsplit(".", 1)[-1]
                who, kind = owner, "method" if within else "function"
                if lang == "cpp" and t.at(n - 1) in ("::", "~"):
                    tilde = t.at(n - 1) == "~"
                    k = n - 1 - tilde
                    if t.at(k) == "::" and t.is_word(k - 1):
                        who, cls = t.at(k - 1), t.at(k - 1)
                        kind = "method"
                    if tilde:
                        kind, name = "destructor", f"~{name}"
                if kind == "method" and name == cls:
                    kind = "constructor"
                if lang == "dart" and within and t.at(n - 1) == "set":
                    kind = "setter"
                if lang == "dart" and within and t.at(n - 1) == "." and t.at(n - 2) == cls:
                    kind = "constructor"
                self.emit(kind, name, who, first, stop)
                return stop + 1
        if lang == "dart" and paren > 0 and within and t.at(paren - 2) == "." and t.at(paren - 3) == owner.rsplit(".", 1)[-1]:
            self.emit("constructor", t.at(paren - 1), owner, first, stop)
            return stop + 1
        if lang == "csharp" and within and opened >= 0 and paren < 0 and not equals and t.is_word(opened - 1) and opened - first >= 2:
            self.emit("property", t.at(opened - 1), owner, first, stop)
        return stop + 1


# ---------------------------------------------------------------------------------------------------------------------
def python_outline(text: str) -> Outline:
    out = Outline()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return _python_lines(text)
    line = lambda d: (d or "").strip().split("\n")[0].strip() or None
    out.doc = line(ast.get_docstring(tree))

    def walk(body: list, owner: str) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.symbols.append(Symbol("method" if owner else "function", n.name, f"{owner}.{n.name}" if owner else n.name, n.lineno, n.end_lineno or n.lineno, line(ast.get_docstring(n))))
            elif isinstance(n, ast.ClassDef):
                q = f"{owner}.{n.name}" if owner else n.name
                out.symbols.append(Symbol("class", n.name, q, n.lineno, n.end_lineno or n.lineno, line(ast.get_docstring(n))))
                walk(n.body, q)
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                walk([*n.body, *getattr(n, "orelse", []), *getattr(n, "finalbody", []), *[x for h in getattr(n, "handlers", []) for x in h.body]], owner)

    walk(tree.body, "")
    decorators, kept = set(), set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out.imports += [(a.name, n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.imports.append(("." * n.level + (n.module or ""), n.lineno))
        elif isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.calls.append((name, n.lineno))
            said = n.args[0].value if n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str) else None
            if name and said is not None:
                if kind := call_trigger(name, said, ast.unparse(f)):
                    out.triggers.append((kind, said, name, n.lineno))
        elif isinstance(n, ast.Subscript) and ast.unparse(n.value).endswith("environ") and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
            out.triggers.append(("env", n.slice.value, "environ", n.lineno))
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for d in n.decorator_list:
                if isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    name = d.func.attr if isinstance(d.func, ast.Attribute) else getattr(d.func, "id", "")
                    decorators.add((name, d.lineno))
                    out.triggers.append((decorator_trigger(name, d.args[0].value), d.args[0].value, name, n.lineno))
                    kept.add(len(out.triggers) - 1)
    # decorators are calls, too, but bind what they stand on
    out.triggers = [x for i, x in enumerate(out.triggers) if i in kept or (x[2], x[3]) not in decorators]
    out.imports.sort(key=lambda x: x[1])
    out.calls.sort(key=lambda x: x[1])
    return out


def _python_lines(text: str) -> Outline:
    """By indentation, for files that do not parse."""
    out, open_ = Outline(), []
    lines = text.split("\n")
    depth = lambda s: len(s) - len(s.lstrip())
    for i, row in enumerate(lines, 1):
        if m := re.match(r"\s*(?:from\s+([.\w]+)\s+import\b|import\s+([\w.]+))", row):
            out.imports.append((m[1] or m[2], i))
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+([^\W\d]\w*)", row)
        if not m:
            continue
        open_ = [o for o in open_ if o[0] < len(m[1])]
        if any(o[1] == "def" for o in open_):
            continue
        owner = ".".join(o[2] for o in open_)
        end = i
        for j in range(i, len(lines)):
            if lines[j].strip() and depth(lines[j]) <= len(m[1]) and not lines[j].lstrip().startswith((")", "#")):
                break
            if lines[j].strip():
                end = j + 1
        kind = "class" if m[2] == "class" else "method" if open_ else "function"
        out.symbols.append(Symbol(kind, m[3], f"{owner}.{m[3]}" if owner else m[3], i, end))
        open_.append((len(m[1]), m[2], m[3]))
    return out


# Names that bind a route, a command line or an environment variable.
ROUTE_NAMES = frozenset("route get post put delete patch head options websocket getmapping postmapping putmapping deletemapping patchmapping requestmapping httpget httppost httpput httpdelete handlefunc path".split())
CLI_NAMES = frozenset("command option argument group add_argument add_option add_parser flag".split())
ENV_NAMES = frozenset("getenv environ env var lookupenv getenvironmentvariable".split())


def decorator_trigger(name: str, said: str) -> str:
    low = name.lower()
    if low in ROUTE_NAMES or said.startswith("/"):
        return "route"
    if low in CLI_NAMES or said.startswith("-"):
        return "cli"
    return "decorator"


def call_trigger(name: str, said: str, chain: str) -> str | None:
    low, whole = name.lower(), chain.lower()
    if low in ("getenv", "lookupenv", "getenvironmentvariable") or low == "get" and whole.endswith("environ.get") or low == "var" and "env" in whole:
        return "env"
    if low in ROUTE_NAMES and said.startswith("/"):
        return "route"
    if low in CLI_NAMES and said.startswith("-"):
        return "cli"
    return None


#: Words that may stand right before a call.
_BEFORE_CALLS = frozenset("return new await yield throw else case in of not and or is delete typeof void go defer do then when if elif while until unless raise assert print echo move unsafe match let as".split())


def _used(t: Tokens, declared: set[tuple[str, int]], language: str) -> tuple[list, list]:
    """Calls and triggers of a token stream."""
    calls, triggers = [], []
    names, reserved = {name for name, _ in declared}, no_names(language)
    text = lambda i: t.v[i][1:-1] if t.kind[i] == "s" and len(t.v[i]) >= 2 else None
    for i in range(len(t)):
        if not t.is_word(i):
            continue
        x, after = t.v[i], i + 1
        if language == "rust" and t.at(after) == "!" and t.at(after + 1) in _OPEN:
            calls.append((x, t.line[i]))
            continue
        if x.startswith("@") or t.at(i - 1) == "@":
            name = x.lstrip("@")
            while t.at(after) == "." and t.is_word(after + 1):
                name, after = t.at(after + 1), after + 2
            if t.at(after) == "(" and after + 1 < len(t) and (said := text(after + 1)) is not None:
                line = t.end_line(t.close[after] + 1) if t.close[after] + 1 < len(t) else t.line[i]
                triggers.append((decorator_trigger(name, said), said, name, line))
            continue
        if x == "env" and t.at(i - 1) == "." and t.at(i - 2) == "process" and t.at(i + 1) == "." and t.is_word(i + 2):
            triggers.append(("env", t.at(i + 2), "process.env", t.line[i]))
        if t.at(after) == "::" and t.at(after + 1) == "<":
            after += 1
        if t.at(after) == "<":
            after = t.generics(after)
        if t.at(after) != "(" or x in reserved or (x, t.line[i]) in declared or t.at(i - 1) in ("function", "fn", "func", "fun", "def"):
            continue
        # a name right behind another word, or with a body right behind its parameters, is being declared
        if language not in ("ruby", "bash", "powershell") and (t.is_word(i - 1) and t.line[i - 1] == t.line[i] and t.at(i - 1) not in _BEFORE_CALLS):
            continue
        if language not in ("kotlin", "ruby", "bash", "powershell", "rust", "dart") and t.at(t.close[after] + 1) == "{" and x in names:
            continue
        if x.startswith(("$", "#")):
            continue
        calls.append((x, t.line[i]))
        if after + 1 < len(t) and (said := text(after + 1)) is not None:
            chain = "".join(t.at(k) for k in range(max(0, i - 4), i + 1))
            if kind := call_trigger(x, said, chain):
                triggers.append((kind, said, x, t.line[i]))
    return calls, triggers


# ---------------------------------------------------------------------------------------------------------------------
def _uncommented(text: str, lex: str) -> str:
    """The text with its comments blanked, lines kept."""
    return _LEX[lex].sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m.lastgroup == "c" else m[0], text)


# What names an imported module, by language; the first group that matched is the module.
IMPORTS = {
    "javascript": (r"^[ \t]*(?:import|export)\b[^;'\"]*?\bfrom\s*[\"']([^\"'\n]+)[\"']", r"^[ \t]*import\s*[\"']([^\"'\n]+)[\"']"),
    "go": (r"^[ \t]*import\s+(?:[\w.]+\s+)?[\"`]([^\"`\n]+)[\"`]",),
    "java": (r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;",),
    "rust": (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;{]+?)(?:::)?\s*(?:\{|;)",),
    "cpp": (r"^[ \t]*#[ \t]*include[ \t]*(?:(\"[^\"\n]+\")|<([^>\n]+)>)",),
    "csharp": (r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",),
    "kotlin": (r"^[ \t]*import\s+([\w.]+(?:\.\*)?)",),
    "dart": (r"^[ \t]*(?:import|export)\s+[\"']([^\"'\n]+)[\"']",),
    "php": (r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?[\"']([^\"'\n]+)[\"']",),
    "ruby": (r"^[ \t]*(?:require|load|autoload\s+:\w+,)\s*\(?\s*[\"']([^\"'\n]+)[\"']",),
    "powershell": (r"(?i)^[ \t]*Import-Module\s+(?:-Name\s+)?[\"']?([^\s\"';]+)", r"(?i)^[ \t]*using\s+(?:module|namespace|assembly)\s+[\"']?([^\s\"';]+)", r"^[ \t]*\.\s+[\"']?([^\s\"';]+)"),
    "bash": (r"^[ \t]*(?:source|\.)[ \t]+[\"']?([^\s\"';]+)",),
    "css": (r"@import\s+(?:url\(\s*)?[\"']?([^\"'\s;)]+)",),
    "html": (r"(?is)<script\b[^>]*?\ssrc\s*=\s*[\"']([^\"']+)[\"']", r"(?is)<link\b[^>]*?\shref\s*=\s*[\"']([^\"']+)[\"']"),
}
IMPORTS["typescript"] = IMPORTS["javascript"]


def found_imports(language: str, text: str) -> list[tuple[str, int]]:
    """(module, line) in the order of lines; comments are left out."""
    lex = {"powershell": "hash", "bash": "hash", "ruby": "hash", "php": "php", "rust": "rust"}.get(language, "slash")
    clean = re.sub(r"(?s)<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m[0]), text) if language == "html" else _uncommented(text, lex)
    if language == "css":
        clean = re.sub(r"(?s)/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    line = lambda at: clean.count("\n", 0, at) + 1
    for p in IMPORTS.get(language, ()):
        for m in re.finditer(p, clean, re.M):
            module = next(g for g in m.groups() if g is not None).strip()
            out.append((module, line(m.start(m.lastindex or 0))))
    if language == "go":
        for m in re.finditer(r"^[ \t]*import\s*\((.*?)\)", clean, re.M | re.S):
            out += [(x[1], line(m.start(1) + x.start(1))) for x in re.finditer(r"[\"`]([^\"`\n]+)[\"`]", m[1])]
    if language == "php":
        for m in re.finditer(r"^[ \t]*use\s+(?:function\s+|const\s+)?([^;({]+)(?:\{([^}]*)\})?\s*;", clean, re.M):
            heads = [m[1].strip()] if m[2] is None else [m[1].strip() + x.strip() for x in m[2].split(",") if x.strip()]
            for head in heads:
                out += [(re.sub(r"\s+as\s+\w+$", "", x.strip()), line(m.start(1))) for x in head.split(",") if x.strip()]
    if language == "ruby":
        out += [(m[1] if m[1].startswith(".") else f"./{m[1]}", line(m.start())) for m in re.finditer(r"^[ \t]*require_relative\s*\(?\s*[\"']([^\"'\n]+)[\"']", clean, re.M)]
    return sorted(dict.fromkeys(out), key=lambda x: x[1])


def ruby_symbols(text: str) -> list[Symbol]:
    """module, class, function, method and const by the words that open and close blocks."""
    out, stack = [], []
    rows = _uncommented(text, "hash").split("\n")
    source = text.split("\n")
    opens = re.compile(r"^\s*(?:module|class|def|if|unless|while|until|case|begin|for)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
    for i, raw in enumerate(rows, 1):
        row = re.sub(_STRINGS, '""', raw)
        m = re.match(r"\s*(module|class|def)\s+(?:self\.)?([A-Za-z_][\w:]*[?!=]?)", row)
        owner = ".".join(s[1] for s in stack if s[0] in ("module", "class"))
        if m and not any(s[0] == "def" for s in stack):
            kind = m[1] if m[1] != "def" else "method" if owner else "function"
            doc, k = [], i - 2
            while k >= 0 and source[k].strip().startswith("#"):
                doc.insert(0, source[k])
                k -= 1
            sym = Symbol(kind, m[2], f"{owner}.{m[2]}" if owner else m[2], i, i, first_line("\n".join(doc)))
            out.append(sym)
            single = re.search(r";\s*end\s*$", row) or m[1] == "def" and re.match(r"\s*def\s+[\w.?!]+(?:\([^)]*\))?\s*=[^=]", row)
            if not single:
                stack.append((m[1], m[2], sym))
            continue
        if (c := re.match(r"\s*([A-Z][A-Z0-9_]*)\s*=[^=~>]", row)) and not any(s[0] == "def" for s in stack):
            out.append(Symbol("const", c[1], f"{owner}.{c[1]}" if owner else c[1], i, i))
        if opens.search(row) and not re.search(r"\bend\b\s*$", row):
            stack.append(("block", "", None))
        elif re.match(r"\s*end\b", row) and stack:
            _, _, sym = stack.pop()
            if sym:
                sym.line_end = i
    for _, _, sym in stack:
        if sym:
            sym.line_end = len(rows)
    return out


def without_documents(text: str) -> str:
    """A shell script with the lines of its here-documents blanked."""
    body = r"(<<-?[ \t]*(['\"]?)([A-Za-z_]\w*)\2[^\n]*\n)(.*?)(\n[ \t]*\3[ \t]*(?=\n|\Z))"
    return re.sub(body, lambda m: m[1] + re.sub(r"[^\n]", " ", m[4]) + m[5], text, flags=re.S)


def bash_symbols(text: str) -> list[Symbol]:
    """function (method when it stands in another one)."""
    t = Tokens(without_documents(text), "shell")
    out: list[Symbol] = []
    ends: list[tuple[int, str]] = []
    for i in range(len(t)):
        name = None
        if t.at(i) == "function" and t.is_word(i + 1):
            name, b = i + 1, i + 2
            b = t.close[b] + 1 if t.at(b) == "(" else b
        elif t.is_word(i) and t.at(i - 1) != "function" and t.at(i + 1) == "(" and t.at(i + 2) == ")":
            name, b = i, i + 3
        if name is None or t.at(b) not in ("{", "("):
            continue
        ends = [e for e in ends if e[0] > i]
        owner = ".".join(e[1] for e in ends)
        out.append(Symbol("method" if owner else "function", t.at(name), f"{owner}.{t.at(name)}" if owner else t.at(name), t.line[i], t.end_line(min(t.close[b], len(t) - 1)), t.doc(i)))
        ends.append((t.close[b], t.at(name)))
    return out


_SQL = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:(?:global|local|temp|temporary|unlogged|unique|materialized|recursive|definer\s*=\s*\S+)\s+)*(table|view|function|procedure|trigger|type|sequence|index|schema)\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?([\"`\[]?[\w$]+[\"`\]]?(?:\.[\"`\[]?[\w$]+[\"`\]]?)*)", re.I)


def sql_symbols(text: str) -> list[Symbol]:
    clean = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    rows, out = text.split("\n"), []
    for m in _SQL.finditer(clean):
        name = re.sub(r"[\"`\[\]]", "", m[2])
        first = clean.count("\n", 0, m.start()) + 1
        dollar = re.compile(r"\$(\w*)\$").search(clean, m.end())
        end = clean.find(";", m.end())
        if dollar and 0 <= dollar.start() < (end if end >= 0 else len(clean)) and m[1].lower() in ("function", "procedure"):
            close = clean.find(dollar[0], dollar.end())
            end = clean.find(";", close + len(dollar[0])) if close >= 0 else -1
        last = clean.count("\n", 0, end if end >= 0 else len(clean.rstrip())) + 1
        doc, k = [], first - 2
        while k >= 0 and rows[k].strip().startswith("--"):
            doc.insert(0, rows[k])
            k -= 1
        out.append(Symbol(m[1].lower(), name.rsplit(".", 1)[-1], name, first, last, first_line("\n".join(doc))))
    return out


def graphql_symbols(text: str) -> list[Symbol]:
    t = Tokens(text, "hash")
    out: list[Symbol] = []
    i = 0

    def said(k: int) -> str | None:
        return t.v[k - 1].strip('"').strip().split("\n")[0].strip() or None if k > 0 and t.kind[k - 1] == "s" else t.doc(k)

    while i < len(t):
        x = t.at(i)
        j = i + (x == "extend")
        x = t.at(j)
        if x in ("type", "interface", "input", "enum", "union", "scalar", "directive", "fragment", "query", "mutation", "subscription", "schema") and (t.is_word(j + 1) or t.at(j + 1) in ("@", "{") and x in ("schema", "directive", "query", "mutation", "subscription") or t.at(j + 1).startswith("@")):
            named = j + 1 + (t.at(j + 1) == "@")
            name = t.at(named).lstrip("@") if t.is_word(named) else x
            k = j + 1
            while k < len(t) and t.at(k) != "{" and not (t.line[k] > t.line[k - 1] and t.at(k) in ("type", "interface", "input", "enum", "union", "scalar", "directive", "fragment", "query", "mutation", "schema", "extend")):
                k = t.close[k] + 1 if t.at(k) == "(" else k + 1
            body = k if t.at(k) == "{" and x not in ("union", "scalar", "directive") else -1
            stop = t.close[body] if body >= 0 else k - 1
            out.append(Symbol(x, name, name, t.line[i], t.end_line(min(stop, len(t) - 1)), said(i)))
            if body >= 0 and x in ("type", "interface", "input", "enum"):
                m = body + 1
                while m < min(stop, len(t)):
                    if t.is_word(m):
                        n = t.close[m + 1] + 1 if t.at(m + 1) == "(" else m + 1
                        if x == "enum" or t.at(n) == ":":
                            out.append(Symbol("enum_value" if x == "enum" else "field", t.at(m), f"{name}.{t.at(m)}", t.line[m], t.line[m], said(m)))
                            line = t.line[n - 1]
                            m = n
                            while m < stop and t.line[m] == line:
                                m = t.close[m] + 1 if t.at(m) in _OPEN else m + 1
                            continue
                    m += 1
            i = stop + 1
            continue
        i += 1
    return out


def css_symbols(text: str) -> list[Symbol]:
    clean = re.sub(r"(?s)/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out: list[Symbol] = []
    line = lambda at: clean.count("\n", 0, at) + 1
    for m in re.finditer(r"([^{};]+)\{", clean):
        head = " ".join(m[1].split())
        if not head:
            continue
        first = line(m.start(1) + len(m[1]) - len(m[1].lstrip()))
        depth, k = 1, m.end()
        while k < len(clean) and depth:
            depth += {"{": 1, "}": -1}.get(clean[k], 0)
            k += 1
        if f := re.match(r"@(?:-\w+-)?keyframes\s+([\w-]+)", head):
            out.append(Symbol("keyframes", f[1], f[1], first, line(k - 1)))
        elif not head.startswith("@") and not re.fullmatch(r"(?:from|to|[\d.]+%)(?:\s*,\s*(?:from|to|[\d.]+%))*", head):
            out.append(Symbol("rule", head, head, first, line(k - 1)))
    out += [Symbol("variable", m[1], m[1], line(m.start(1)), line(m.start(1))) for m in re.finditer(r"(?<![\w(-])(--[\w-]+)\s*:", clean)]
    return sorted(out, key=lambda s: (s.line_start, s.line_end))


def html_symbols(text: str) -> list[Symbol]:
    clean = re.sub(r"(?is)<!--.*?-->|(?<=<script)(?=[^>]*>).*?(?=</script)|(?<=<style)(?=[^>]*>).*?(?=</style)", lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0].startswith("<!--") else re.sub(r"(?s)(?<=>).*", lambda x: re.sub(r"[^\n]", " ", x[0]), m[0], count=1), text)
    out: list[Symbol] = []
    line = lambda at: clean.count("\n", 0, at) + 1
    if m := re.search(r"(?is)<title[^>]*>(.*?)</title>", clean):
        name = " ".join(re.sub(r"<[^>]*>", " ", m[1]).split())
        if name:
            out.append(Symbol("title", name, name, line(m.start()), line(m.end())))
    for m in re.finditer(r"(?s)<([A-Za-z][\w:.-]*)((?:\s+[^<>\"']*(?:\"[^\"]*\"|'[^']*')?)*)\s*/?>", clean):
        tag, attrs = m[1].lower(), {}
        for a in re.finditer(r"([\w:@.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", m[2]):
            attrs[a[1].lower()] = next((g for g in a.groups()[1:] if g is not None), "")
        at = line(m.start())
        if attrs.get("id"):
            out.append(Symbol("anchor", f"#{attrs['id']}", f"#{attrs['id']}", at, at))
        if "-" in tag:
            out.append(Symbol("component", tag, tag, at, at))
        elif tag in ("input", "select", "textarea", "button", "form") and attrs.get("name"):
            out.append(Symbol("control", attrs["name"], attrs["name"], at, at))
    return out


# ---------------------------------------------------------------------------------------------------------------------
_DECLARATIVE = {"ruby": ruby_symbols, "bash": bash_symbols, "sql": sql_symbols, "graphql": graphql_symbols, "css": css_symbols, "html": html_symbols}
#: All languages that are read.
LANGUAGES = ("python", "javascript", "typescript", "go", "java", "rust", "c", "cpp", "csharp", "kotlin", "dart", "php", "ruby", "powershell", "bash", "sql", "graphql", "css", "html")


def outline(language: str | None, text: str | None) -> Outline:
    """What a source declares and uses; nothing for null or empty text and unknown languages. Any text gives an outline."""
    if not text or language not in LANGUAGES:
        return Outline()
    text = text.replace("\r\n", "\n")
    if language == "python":
        return python_outline(text)
    if language in _DECLARATIVE:
        out = Outline(_DECLARATIVE[language](text))
        if language in ("ruby", "bash"):
            out.calls, out.triggers = _used(Tokens(text, "hash" if language == "ruby" else "shell"), {(s.name, s.line_start) for s in out.symbols}, language)
    else:
        braces = Braces(language, text)
        out = Outline(braces.run())
        out.calls, out.triggers = _used(braces.t, {(s.name, s.line_start) for s in out.symbols}, language)
        if braces.t.comment.get(0):
            out.doc = first_line(braces.t.comment[0][0][2])
    if language not in ("c", "sql", "graphql"):
        out.imports = found_imports(language, text)
    return out
