"""Syntax checkers for eight languages: recursive descent over tokens, no trees are built.

``parses(language, text)`` says whether a text is a valid source file. Precedence is not looked at, as it
doesn't decide validity; names, types and other semantics are not looked at either.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings


class Bad(Exception):
    """The text is no valid source."""


#: End marks behind the last token, as rules look ahead; with them no rule reads past the lists.
PAST_END = 64
OPEN = {"(": ")", "[": "]", "{": "}"}


class Parser:
    """Tokens as parallel lists: kind (n name, 0 number, s literal, p mark, E end), value (None for literals), newline before."""

    def __init__(self, text: str):
        self.kind: list[str] = []
        self.val: list[str | None] = []
        self.nl: list[bool] = []
        self.pos: list[int] = []
        self.i = 0
        self.scan(text)
        for _ in range(PAST_END):
            self.add("E", None, True, len(text))
        self.pair()

    def add(self, kind: str, val: str | None, nl: bool, pos: int) -> None:
        self.kind.append(kind)
        self.val.append(val)
        self.nl.append(nl)
        self.pos.append(pos)

    def pair(self) -> None:
        """Where each bracket closes; brackets that don't match end the parse at once."""
        self.match = [0] * len(self.val)
        stack: list[int] = []
        for i, v in enumerate(self.val):
            if v is None or self.kind[i] != "p":
                continue
            if v in OPEN:
                stack.append(i)
            elif v in (")", "]", "}"):
                if not stack or OPEN[self.val[stack[-1]]] != v:
                    raise Bad(v)
                self.match[stack.pop()] = i
        if stack:
            raise Bad("open")

    def scan(self, text: str) -> None:
        take, i, n, nl = self.TOKEN.match, 0, len(text), False
        while i < n:
            m = take(text, i)
            if not m or m.end() == i:
                raise Bad(text[i : i + 10])
            g = m.lastgroup
            if g == "ws":
                nl = nl or "\n" in m[0]
            else:
                self.add(g, m[0] if g in "np" else None, nl, i)
                nl = False
            i = m.end()

    # -- helpers
    @property
    def v(self) -> str | None:
        return self.val[self.i]

    def peek(self, k: int = 1) -> str | None:
        return self.val[self.i + k] if self.i + k < len(self.val) else None

    def got(self, *values: str) -> bool:
        if self.val[self.i] in values:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if self.val[self.i] != value:
            raise Bad(f"{value} at {self.pos[self.i]}")
        self.i += 1

    def end(self) -> bool:
        return self.kind[self.i] == "E"

    def name(self, reserved: bool = True) -> None:
        if self.kind[self.i] != "n" or (reserved and self.val[self.i] in self.RESERVED):
            raise Bad(f"name at {self.pos[self.i]}")
        self.i += 1

    def is_name(self, k: int = 0) -> bool:
        return self.kind[self.i + k] == "n" and self.val[self.i + k] not in self.RESERVED

    def many(self, item, close: str, sep: str = ",", trailing: bool = True) -> None:
        """Items up to ``close``, which is taken."""
        while not self.got(close):
            item()
            if self.got(close):
                return
            self.need(sep)
            if not trailing and self.v == close:
                raise Bad(sep)

    def attempt(self, rule) -> bool:
        at = self.i
        try:
            rule()
            return True
        except Bad:
            self.i = at
            return False

    def skip_group(self) -> None:
        """A bracketed group of any tokens."""
        if self.v not in OPEN:
            raise Bad("group")
        self.i = self.match[self.i] + 1

    def touching(self) -> bool:
        """Whether the next mark follows this one without a blank."""
        return self.i + 1 < len(self.pos) and self.pos[self.i + 1] == self.pos[self.i] + len(self.v or "")

    def greater(self, most: int) -> None:
        """An operator of up to ``most`` marks > that touch, maybe with a = behind; the marks are tokens of their own."""
        n = 1
        self.i += 1
        while self.v == ">" and self.pos[self.i] == self.pos[self.i - 1] + 1:
            n += 1
            self.i += 1
        if n > most:
            raise Bad(">")
        if self.v in ("=", "==") and self.pos[self.i] == self.pos[self.i - 1] + 1:
            if self.v == "==":
                raise Bad("==")
            self.i += 1

    def dotted(self, sep: str = ".") -> None:
        self.name()
        while self.v == sep and self.kind[self.i + 1] == "n":
            self.i += 2


# ---------------------------------------------------------------------------------------------------------------------
class JavaScript(Parser):
    TS = False
    WS = r"(?P<ws>(?:[\s﻿]|//[^\n]*|/\*(?s:.*?)\*/)+)"
    TOKEN = re.compile(
        WS + r"""|(?P<n>\#?(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*)"""
        r"""|(?P<n0>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))"""
        r"""|(?P<s>"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*')"""
        r"""|(?P<p>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"""
    )
    REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
    RESERVED = frozenset(
        "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
    )
    BINARY = frozenset("== != === !== < > <= + - * / % ** & | ^ << && || ?? in instanceof".split())
    ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
    VALUE_WORDS = frozenset("this super null true false".split())

    def scan(self, text: str) -> None:
        i = 0
        if text.startswith("#!"):
            i = (text.find("\n") + 1) or len(text)
        self.scan_to(text, i, False)

    def scan_to(self, text: str, i: int, inner: bool) -> int:
        """Scan; with ``inner`` up to the brace that closes a template's expression."""
        take, n, nl, depth = self.TOKEN.match, len(text), False, 0
        while i < n:
            if text[i] == "/" and text[i + 1 : i + 2] not in ("/", "*") and self.regex_here():
                m = self.REGEX.match(text, i)
                if m:
                    self.add("s", None, nl, i)
                    i, nl = m.end(), False
                    continue
            m = take(text, i)
            if not m or m.end() == i:
                raise Bad(text[i : i + 10])
            g = m.lastgroup
            if g == "ws":
                nl = nl or "\n" in m[0]
                i = m.end()
                continue
            if g == "p":
                c = m[0]
                if c == "`":
                    i = self.template(text, i + 1, nl)
                    nl = False
                    continue
                if c == "{":
                    depth += 1
                elif c == "}":
                    if inner and not depth:
                        return i
                    depth -= 1
            self.add("0" if g == "n0" else g, m[0] if g in "np" else None, nl, i)
            i, nl = m.end(), False
        if inner:
            raise Bad("template")
        return i

    def template(self, text: str, i: int, nl: bool) -> int:
        """A template literal becomes: ` ( expression ) ... ` with kind s marks, so expressions are checked too."""
        self.add("t", "`", nl, i)
        while True:
            if i >= len(text):
                raise Bad("template")
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                self.add("t", "``", False, i)
                return i + 1
            elif c == "$" and text[i + 1 : i + 2] == "{":
                self.add("p", "(", False, i)
                i = self.scan_to(text, i + 2, True)
                self.add("p", ")", False, i)
                i += 1
            else:
                i += 1

    def regex_here(self) -> bool:
        if not self.kind:
            return True
        k, v = self.kind[-1], self.val[-1]
        if k == "p":
            return v not in (")", "]", "}", "++", "--")
        return k == "n" and v in ("return", "typeof", "case", "in", "of", "do", "else", "instanceof", "new", "void", "delete", "throw", "await", "yield")

    # -- expressions
    def expression(self) -> None:
        self.assign()
        while self.got(","):
            self.assign()

    def arrow(self) -> bool:
        if self.v == "async" and not self.nl[self.i + 1] and (self.kind[self.i + 1] == "n" and self.peek(2) == "=>" or self.peek() == "(" and self.peek_after(self.i + 1) in ("=>", ":") or self.TS and self.peek() == "<"):
            at = self.i
            self.i += 1
            if self.arrow():
                return True
            self.i = at
            return False
        if self.is_name() and self.peek() == "=>":
            self.i += 1
        elif self.v == "(" and (after := self.peek_after(self.i)) in (("=>", ":") if self.TS else ("=>",)):
            if after == "=>":
                self.params()
            elif not self.attempt(self.typed_params):
                return False
        elif self.TS and self.v == "<":
            if not self.attempt(lambda: (self.type_params(), self.typed_params() if self.v == "(" else self.need("("))):
                return False
        else:
            return False
        self.need("=>")
        if self.v == "{":
            self.block()
        else:
            self.assign()
        return True

    def typed_params(self) -> None:
        self.params()
        if self.got(":"):
            self.type_()
        if self.v != "=>":
            raise Bad("=>")

    def peek_after(self, i: int) -> str | None:
        return self.val[self.match[i] + 1]

    def assign(self) -> None:
        if self.v == "yield":
            self.i += 1
            self.got("*")
            if not self.nl[self.i] and self.v not in (")", "]", "}", ",", ";", ":", None) or self.kind[self.i] in "0s":
                self.assign()
            return
        if self.arrow():
            return
        start = self.i
        simple = self.unary()
        if self.v in self.ASSIGN or self.shift_assign():
            if not simple:
                raise Bad("target")
            self.i += 1
            self.assign()
            return
        while True:
            if self.TS and self.v in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not self.got("const"):
                    self.type_()
                continue
            if self.v == ">":
                self.greater(3)
                self.unary()
            elif self.v in self.BINARY and self.kind[self.i] in "pn" and not (self.v == "in" and self.no_in):
                self.i += 1
                self.unary()
            elif self.v == "?":
                self.i += 1
                hold, self.no_in = self.no_in, False
                self.assign()
                self.no_in = hold
                self.need(":")
                self.assign()
                return
            else:
                break
        if start == self.i:
            raise Bad("expression")

    no_in = False

    def shift_assign(self) -> bool:
        """Whether >>= or >>>= stands here; then moves to its last mark."""
        if self.v != ">" or self.peek() != ">":
            return False
        k = self.i
        while self.val[k] == ">" and self.pos[k + 1] == self.pos[k] + 1:
            k += 1
        if self.val[k] == "=":
            self.i = k
            return True
        return False

    def unary(self) -> bool:
        while self.v in ("!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await"):
            if self.v == "await" and (self.nl[self.i + 1] or self.peek() in (")", ";", ",", "=", ".", None) and self.kind[self.i + 1] not in "0s"):
                break
            self.i += 1
            self.unary()
            return False
        if self.TS and self.v == "<":
            self.i += 1
            self.type_()
            self.need(">")
            self.unary()
            return False
        return self.postfix()

    def postfix(self) -> bool:
        simple = self.primary()
        while True:
            v = self.v
            if self.kind[self.i] == "t" and v == "`":
                self.template_literal()
                simple = False
            elif self.kind[self.i] != "p":
                break
            elif v == ".":
                self.i += 1
                self.name(False)
                simple = True
            elif v == "?.":
                self.i += 1
                if self.v == "(":
                    self.args()
                elif self.v == "[":
                    self.index()
                else:
                    self.name(False)
                simple = False
            elif v == "[":
                self.index()
                simple = True
            elif v == "(":
                self.args()
                simple = False
            elif v == "!" and self.TS and not self.nl[self.i] and self.peek() != "=":
                self.i += 1
            elif v in ("++", "--") and not self.nl[self.i]:
                if not simple:
                    raise Bad(v)
                self.i += 1
                return False
            elif v == "<" and self.TS and self.attempt(self.type_args_of_call):
                simple = False
            else:
                break
        return simple

    def type_args_of_call(self) -> None:
        self.type_args()
        if self.v not in ("(", "`", ")", "]", ",", ";", ".", "?."):
            raise Bad("type arguments")

    def index(self) -> None:
        self.need("[")
        hold, self.no_in = self.no_in, False
        self.expression()
        self.no_in = hold
        self.need("]")

    def args(self) -> None:
        self.need("(")
        hold, self.no_in = self.no_in, False
        self.many(lambda: (self.got("..."), self.assign()), ")")
        self.no_in = hold

    def template_literal(self) -> None:
        self.i += 1
        while self.val[self.i] != "``":
            self.need("(")
            self.expression()
            self.need(")")
        self.i += 1

    def primary(self) -> bool:
        k, v = self.kind[self.i], self.v
        if k in "0s":
            self.i += 1
            return False
        if k == "t" and v == "`":
            self.template_literal()
            return False
        if k == "n":
            if v in self.VALUE_WORDS:
                self.i += 1
                return False
            if v == "function" or v == "async" and self.peek() == "function" and not self.nl[self.i + 1]:
                self.function(False)
                return False
            if v == "class":
                self.class_(False)
                return False
            if v == "new":
                self.i += 1
                if self.got("."):
                    self.name()
                    return False
                self.new_target()
                return False
            if v == "import":
                self.i += 1
                if self.got("."):
                    self.name(False)
                else:
                    self.args()
                return False
            self.name()
            return True
        if v == "(":
            self.i += 1
            hold, self.no_in = self.no_in, False
            self.expression()
            self.no_in = hold
            self.need(")")
            return True
        if v == "[":
            self.i += 1
            hold, self.no_in = self.no_in, False
            while not self.got("]"):
                if self.got(","):
                    continue
                self.got("...")
                self.assign()
                if self.v != "]":
                    self.need(",")
            self.no_in = hold
            return True
        if v == "{":
            self.i += 1
            hold, self.no_in = self.no_in, False
            self.many(self.property, "}")
            self.no_in = hold
            return True
        if v == "@":
            self.decorators()
            self.class_(False)
            return False
        raise Bad(f"{v} at {self.pos[self.i]}")

    def new_target(self) -> None:
        if self.got("new"):
            self.new_target()
        else:
            self.primary()
        while True:
            if self.got("."):
                self.name(False)
            elif self.v == "[":
                self.index()
            elif self.v == "<" and self.TS and self.attempt(self.type_args):
                pass
            elif self.v == "(":
                self.args()
                return
            else:
                return

    def property_name(self) -> None:
        if self.kind[self.i] in "0s":
            self.i += 1
        elif self.v == "[":
            self.i += 1
            self.assign()
            self.need("]")
        else:
            self.name(False)

    def property(self) -> None:
        if self.got("..."):
            self.assign()
            return
        k = 0
        while self.v in ("get", "set", "async", "*") and self.peek() not in (",", "}", ":", "(", "=", None) or self.v in ("get", "set", "async") and self.kind[self.i + 1] in "0s":
            self.i += 1
            k += 1
        plain = self.is_name()
        self.property_name()
        if self.v == "(" or self.TS and self.v == "<":
            self.signature()
            self.block()
        elif k:
            raise Bad("method")
        elif self.got(":"):
            self.assign()
        elif plain:
            if self.got("="):
                self.assign()
        else:
            raise Bad("property")

    # -- functions and classes
    def signature(self) -> None:
        if self.TS and self.v == "<":
            self.type_params()
        self.params()
        if self.TS and self.got(":"):
            self.type_()

    def params(self) -> None:
        self.need("(")
        self.many(self.param, ")")

    def param(self) -> None:
        if self.v == "@":
            self.decorators()
        if self.TS:
            while self.v in ("public", "private", "protected", "readonly", "override") and (self.kind[self.i + 1] == "n" or self.peek() in ("{", "[")):
                self.i += 1
        self.got("...")
        if self.TS and self.v == "this":
            self.i += 1
        else:
            self.binding()
        if self.TS:
            self.got("?")
            if self.got(":"):
                self.type_()
        if self.got("="):
            self.assign()

    def binding(self) -> None:
        if self.got("{"):
            self.many(self.bound_property, "}")
        elif self.got("["):
            while not self.got("]"):
                if self.got(","):
                    continue
                self.got("...")
                self.binding()
                if self.got("="):
                    self.assign()
                if self.v != "]":
                    self.need(",")
        else:
            self.name()

    def bound_property(self) -> None:
        if self.got("..."):
            self.binding()
            return
        plain = self.is_name()
        self.property_name()
        if self.got(":"):
            self.binding()
        elif not plain:
            raise Bad("binding")
        if self.got("="):
            self.assign()

    def function(self, named: bool, declared: bool = False) -> None:
        self.got("async")
        self.need("function")
        self.got("*")
        if self.v not in ("(", "<"):
            self.name()
        elif named:
            raise Bad("function name")
        self.signature()
        if self.v == "{":
            self.block()
        elif self.TS and named:
            self.semi()
        else:
            raise Bad("body")

    def decorators(self) -> None:
        while self.got("@"):
            if self.got("("):
                self.expression()
                self.need(")")
            else:
                self.name(False)
                while self.got("."):
                    self.name(False)
                if self.v == "(":
                    self.args()

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.is_name() and not (self.TS and self.v == "implements"):
            self.i += 1
        elif named:
            raise Bad("class name")
        if self.TS and self.v == "<":
            self.type_params()
        if self.got("extends"):
            self.postfix()
            if self.TS and self.v == "<":
                self.type_args()
        if self.TS and self.got("implements"):
            self.type_()
            while self.got(","):
                self.type_()
        self.need("{")
        while not self.got("}"):
            if not self.got(";"):
                self.member()

    MODIFIERS = frozenset("static async get set accessor".split())
    TS_MODIFIERS = frozenset("public private protected readonly abstract override declare".split()) | MODIFIERS

    def member(self) -> None:
        if self.v == "@":
            self.decorators()
        if self.v == "static" and self.peek() == "{":
            self.i += 1
            self.block()
            return
        words = self.TS_MODIFIERS if self.TS else self.MODIFIERS
        while self.v in words and self.peek() not in ("(", "=", ";", "}", ":", "?", "!", "<") and not (self.nl[self.i + 1] and self.v not in ("static",) and not self.TS):
            self.i += 1
        self.got("*")
        if self.TS and self.v == "[" and self.attempt(self.index_signature):
            self.semi()
            return
        self.property_name()
        if self.TS:
            self.got("?", "!")
        if self.v == "(" or self.TS and self.v == "<":
            self.signature()
            if self.v == "{":
                self.block()
            elif self.TS:
                self.semi()
            else:
                raise Bad("method body")
            return
        if self.TS and self.got(":"):
            self.type_()
        if self.got("="):
            self.assign()
        self.semi()

    # -- statements
    def semi(self) -> None:
        if not self.got(";") and self.v != "}" and not self.nl[self.i] and not self.end():
            raise Bad(f"; at {self.pos[self.i]}")

    def block(self) -> None:
        self.need("{")
        hold, self.no_in = self.no_in, False
        while not self.got("}"):
            self.statement()
        self.no_in = hold

    def file(self) -> None:
        while not self.end():
            self.statement()

    def variables(self) -> None:
        while True:
            self.binding()
            if self.TS:
                self.got("!")
                if self.got(":"):
                    self.type_()
            if self.got("="):
                self.assign()
            if not self.got(","):
                return

    def statement(self) -> None:
        v, k = self.v, self.kind[self.i]
        if k == "p":
            if v == "{":
                self.block()
                return
            if v == ";":
                self.i += 1
                return
            if v == "@":
                self.decorators()
                if self.v in ("export", "abstract") or self.v == "class":
                    self.statement()
                    return
                raise Bad("decorated")
        if k == "n":
            if self.using():
                self.variables()
                self.semi()
                return
            if v in ("var", "const") or v == "let" and (self.kind[self.i + 1] == "n" and self.peek() not in ("in", "instanceof", "of") or self.peek() in ("{", "[")):
                if self.TS and v == "const" and self.peek() == "enum":
                    self.i += 1
                    self.statement()
                    return
                self.i += 1
                self.variables()
                self.semi()
                return
            rule = getattr(self, "s_" + v, None) if v.isalpha() else None
            if rule and not (v in ("async", "of") and self.peek() != "function"):
                if rule() is not False:
                    return
            if self.TS and self.ts_statement():
                return
            if self.is_name() and self.peek() == ":":
                self.i += 2
                self.statement()
                return
        self.expression()
        self.semi()

    def using(self) -> bool:
        """Takes ``using`` or ``await using`` where a declaration follows."""
        k = 1 if self.v == "await" and self.peek() == "using" and not self.nl[self.i + 1] else 0
        if self.peek(k) != "using" or self.kind[self.i + k + 1] != "n" or self.nl[self.i + k + 1]:
            return False
        after = self.peek(k + 1)
        if after in ("in", "instanceof", "as", "satisfies") or after == "of" and self.peek(k + 2) not in ("=", "of", ":"):
            return False
        self.i += k + 1
        return True

    def s_function(self) -> None:
        self.function(True)

    def s_async(self):
        if self.nl[self.i + 1]:
            return False
        self.function(True)

    def s_class(self) -> None:
        self.class_(True)

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.got("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    def s_with(self) -> None:
        self.s_while()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.got(";")

    def s_for(self) -> None:
        self.i += 1
        self.got("await")
        self.need("(")
        self.no_in = True
        if self.using():
            self.variables()
        elif self.v in ("var", "const", "let") and (self.kind[self.i + 1] == "n" or self.peek() in ("[", "{")):
            self.i += 1
            self.variables()
        elif self.v != ";":
            self.expression()
        self.no_in = False
        if self.got("of"):
            self.assign()
        elif self.got("in"):
            self.expression()
        else:
            self.need(";")
            if self.v != ";":
                self.expression()
            self.need(";")
            if self.v != ")":
                self.expression()
        self.need(")")
        self.statement()

    def s_switch(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        while not self.got("}"):
            if self.got("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.v not in ("case", "default", "}"):
                self.statement()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        some = False
        if self.got("catch"):
            some = True
            if self.got("("):
                self.binding()
                if self.TS and self.got(":"):
                    self.type_()
                self.need(")")
            self.block()
        if self.got("finally"):
            some = True
            self.block()
        if not some:
            raise Bad("try")

    def s_throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            raise Bad("throw")
        self.expression()
        self.semi()

    def s_return(self) -> None:
        self.i += 1
        if self.v not in (";", "}") and not self.nl[self.i] and not self.end() or self.kind[self.i] in "0s" and not self.nl[self.i]:
            self.expression()
        self.semi()

    def s_break(self) -> None:
        self.i += 1
        if self.is_name() and not self.nl[self.i]:
            self.i += 1
        self.semi()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.i += 1
        self.semi()

    def module_name(self) -> None:
        if self.kind[self.i] == "s":
            self.i += 1
        else:
            self.name(False)

    def specifier(self) -> None:
        if self.TS and self.v == "type" and self.kind[self.i + 1] in "ns" and self.peek() != "as":
            self.i += 1
        self.module_name()
        if self.got("as"):
            self.module_name()

    def source(self) -> None:
        if self.kind[self.i] != "s":
            raise Bad("module")
        self.i += 1
        if self.v in ("with", "assert") and self.peek() == "{":
            self.i += 1
            self.skip_group()
        self.semi()

    def s_import(self):
        if self.peek() in ("(", "."):
            return False
        self.i += 1
        if self.kind[self.i] == "s":
            self.source()
            return None
        if self.TS and self.v == "type" and self.peek() != "from":
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.TS and self.got("="):
                self.expression()
                self.semi()
                return None
            if not self.got(","):
                self.need("from")
                self.source()
                return None
        if self.got("*"):
            self.need("as")
            self.name()
        else:
            self.need("{")
            self.many(self.specifier, "}")
        self.need("from")
        self.source()

    def s_export(self) -> None:
        self.i += 1
        if self.TS and self.got("="):
            self.expression()
            self.semi()
            return
        if self.TS and self.v == "as" and self.peek() == "namespace":
            self.i += 2
            self.name()
            self.semi()
            return
        if self.TS and self.v == "type" and self.peek() in ("{", "*"):
            self.i += 1
        if self.got("default"):
            if self.v == "function" or self.v == "async" and self.peek() == "function":
                self.function(False)
            elif self.v in ("class", "@"):
                self.decorators()
                self.class_(False)
            elif self.TS and self.v in ("abstract", "interface"):
                self.statement()
            else:
                self.assign()
                self.semi()
        elif self.got("*"):
            if self.got("as"):
                self.module_name()
            self.need("from")
            self.source()
        elif self.got("{"):
            self.many(self.specifier, "}")
            if self.got("from"):
                self.source()
            else:
                self.semi()
        elif self.v in ("var", "let", "const", "function", "async", "class", "@") or self.TS and self.v in ("interface", "type", "enum", "declare", "namespace", "module", "abstract", "import"):
            self.statement()
        else:
            raise Bad("export")

    def ts_statement(self) -> bool:
        return False


class TypeScript(JavaScript):
    TS = True

    def ts_statement(self) -> bool:
        v = self.v
        if v in ("interface", "type", "namespace", "module", "enum", "abstract", "declare", "global"):
            nxt, kind = self.peek(), self.kind[self.i + 1]
            if v == "enum" or kind == "n" and not self.nl[self.i + 1] and nxt not in ("in", "instanceof", "as", "satisfies") or v in ("module", "declare") and kind == "s" or v == "global" and nxt == "{":
                self.i += 1
                getattr(self, "t_" + v)()
                return True
        return False

    def t_interface(self) -> None:
        self.name()
        if self.v == "<":
            self.type_params()
        if self.got("extends"):
            self.type_()
            while self.got(","):
                self.type_()
        self.object_type()

    def t_type(self) -> None:
        self.name()
        if self.v == "<":
            self.type_params()
        self.need("=")
        self.type_()
        self.semi()

    def t_namespace(self) -> None:
        if self.kind[self.i] == "s":
            self.i += 1
        else:
            self.dotted()
        if self.v == "{":
            self.block()
        else:
            self.semi()

    t_module = t_namespace

    def t_global(self) -> None:
        self.block()

    def t_enum(self) -> None:
        self.name()
        self.need("{")

        def one() -> None:
            self.property_name()
            if self.got("="):
                self.assign()

        self.many(one, "}")

    def t_abstract(self) -> None:
        self.class_(True)

    def t_declare(self) -> None:
        self.statement()

    # -- types
    def type_params(self) -> None:
        self.need("<")

        def one() -> None:
            while self.v in ("in", "out", "const") and self.kind[self.i + 1] == "n" and self.peek() not in ("extends",):
                self.i += 1
            self.name()
            if self.got("extends"):
                self.type_()
            if self.got("="):
                self.type_()

        self.many(one, ">")

    def type_args(self) -> None:
        self.need("<")
        if self.v == ">":
            raise Bad("type arguments")
        self.many(self.type_, ">")

    def type_(self) -> None:
        if self.v == "asserts" and (self.kind[self.i + 1] == "n") and not self.nl[self.i + 1]:
            self.i += 2
            if self.got("is"):
                self.type_()
            return
        if self.v == "<" or self.v == "new" or self.v == "abstract" and self.peek() == "new" or self.v == "(" and self.peek_after(self.i) == "=>":
            self.got("abstract")
            self.got("new")
            if self.v == "<":
                self.type_params()
            self.params()
            self.need("=>")
            self.type_()
            return
        self.got("|", "&")
        self.operand()
        while self.got("|", "&"):
            if self.v == "(" and self.peek_after(self.i) == "=>":
                self.type_()
                return
            self.operand()
        if self.v == "is" and not self.nl[self.i]:
            self.i += 1
            self.type_()
        if self.v == "extends" and not self.nl[self.i] and not self.in_infer:
            at = self.i
            self.i += 1
            try:
                self.type_()
                self.need("?")
                self.type_()
                self.need(":")
                self.type_()
            except Bad:
                self.i = at

    in_infer = False

    def operand(self) -> None:
        k, v = self.kind[self.i], self.v
        if k in "0s":
            self.i += 1
        elif k == "t":
            self.i += 1
            while self.val[self.i] != "``":
                self.need("(")
                self.type_()
                self.need(")")
            self.i += 1
        elif v == "-":
            self.i += 1
            if self.kind[self.i] != "0":
                raise Bad("-")
            self.i += 1
        elif v in ("keyof", "unique", "readonly") and (self.kind[self.i + 1] in "ns" or self.peek() in ("(", "[", "{")) and not self.nl[self.i + 1]:
            self.i += 1
            self.operand()
            return
        elif v == "infer":
            self.i += 1
            self.name()
            if self.v == "extends":
                self.attempt(lambda: (self.need("extends"), self.operand(), self.need("?") if self.v == "?" else None))
        elif v == "typeof":
            self.i += 1
            if self.got("import"):
                self.args()
            else:
                self.name(False)
            while self.got("."):
                self.name(False)
            if self.v == "<" and not self.nl[self.i]:
                self.type_args()
        elif v == "import":
            self.i += 1
            self.args()
            while self.got("."):
                self.name(False)
            if self.v == "<":
                self.type_args()
        elif v == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif v == "[":
            self.i += 1

            def one() -> None:
                self.got("...")
                if self.kind[self.i] == "n" and (self.peek() == ":" or self.peek() == "?" and self.peek(2) == ":"):
                    self.i += 1
                    self.got("?")
                    self.need(":")
                    self.got("...")
                self.type_()
                self.got("?")

            self.many(one, "]")
        elif v == "{":
            self.object_type()
        elif k == "n" and (v in ("void", "null", "true", "false", "this") or self.is_name()):
            self.i += 1
            while self.got("."):
                self.name(False)
            if self.v == "<" and not self.nl[self.i]:
                self.type_args()
        else:
            raise Bad(f"type at {self.pos[self.i]}")
        while self.v == "[" and not self.nl[self.i]:
            self.i += 1
            if not self.got("]"):
                self.type_()
                self.need("]")

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type_()
        self.need("]")
        self.need(":")
        self.type_()

    def object_type(self) -> None:
        self.need("{")
        while not self.got("}"):
            self.type_member()
            if not self.got(";", ",") and self.v != "}" and not self.nl[self.i]:
                raise Bad("member")

    def type_member(self) -> None:
        if self.v in ("+", "-"):
            self.i += 1
        while self.v in ("readonly", "get", "set", "static", "public", "private") and self.peek() not in (":", "?", "(", ";", ",", "}", "<", None) or self.v == "readonly" and self.peek() == "[":
            self.i += 1
        if self.v in ("(", "<"):
            self.signature()
            return
        if self.v == "new" and self.peek() in ("(", "<"):
            self.i += 1
            self.signature()
            return
        if self.v == "[":
            if self.attempt(self.index_signature):
                return
            if self.attempt(self.mapped):
                return
        self.property_name()
        self.got("?")
        if self.v in ("(", "<"):
            self.signature()
        elif self.got(":"):
            self.type_()

    def mapped(self) -> None:
        self.need("[")
        self.name()
        self.need("in")
        self.type_()
        if self.got("as"):
            self.type_()
        self.need("]")
        self.got("+", "-")
        self.got("?")
        if self.got(":"):
            self.type_()


# ---------------------------------------------------------------------------------------------------------------------
class Java(Parser):
    TOKEN = re.compile(
        r"(?P<ws>(?:[\s\x1a]|//[^\n]*|/\*(?s:.*?)\*/)+)|(?P<n>(?:[^\W\d]|\$)[\w$]*)"
        r"|(?P<n0>(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?(?![\w$]))"
        r'|(?P<s>"""[ \t\f]*\r?\n(?s:(?:[^\\"]|\\.|"(?!""))*)"""|"(?!"")(?:[^"\\\n]|\\.)*"|""(?!")|\'(?:[^\'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))\')'
        r"|(?P<p>\.\.\.|->|::|<<=|==|!=|<=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])"
    )
    RESERVED = frozenset(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
    )
    BASIC = frozenset("boolean byte char short int long float double".split())
    MODS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
    BINARY = frozenset("== != < <= + - * / % & | ^ << && ||".split())
    ASSIGN = frozenset("= += -= *= /= %= <<= &= |= ^=".split())

    def scan(self, text: str) -> None:
        super().scan(text)
        self.kind = ["0" if k == "n0" else k for k in self.kind]

    def file(self) -> None:
        if self.end():
            return
        at = self.i
        self.annotations()
        if self.got("package"):
            self.dotted()
            self.need(";")
        else:
            self.i = at
        while True:
            if self.got("import"):
                self.got("static")
                self.dotted()
                if self.got("."):
                    self.need("*")
                self.need(";")
            elif not self.got(";"):
                break
        while not self.end():
            if not self.got(";"):
                self.modifiers()
                if not self.type_decl():
                    raise Bad("declaration")

    def annotations(self) -> None:
        while self.v == "@" and self.peek() != "interface":
            self.i += 1
            self.dotted()
            if self.v == "(":
                self.i += 1
                self.many(self.annotation_value, ")")

    def annotation_value(self) -> None:
        if self.is_name() and self.peek() == "=":
            self.i += 2
        if self.got("{"):
            self.many(self.annotation_value, "}")
        elif self.v == "@":
            self.annotations()
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            if self.v == "@" and self.peek() != "interface":
                self.annotations()
            elif self.v in self.MODS and not (self.v == "default" and self.peek() in (":", "->")) and not (self.v == "sealed" and self.peek() not in ("class", "interface", "abstract", "public")):
                self.i += 1
            elif self.v == "non" and self.peek() == "-" and self.peek(2) == "sealed":
                self.i += 3
            else:
                return

    def type_decl(self) -> bool:
        v = self.v
        if v == "class":
            self.i += 1
            self.name()
            self.type_params()
            if self.got("extends"):
                self.type_()
            self.type_list("implements")
            self.type_list("permits")
            self.body(None)
        elif v == "interface":
            self.i += 1
            self.name()
            self.type_params()
            self.type_list("extends")
            self.type_list("permits")
            self.body(None)
        elif v == "enum":
            self.i += 1
            self.name()
            self.type_list("implements")
            self.need("{")
            while self.v not in (";", "}"):
                self.annotations()
                self.name()
                if self.v == "(":
                    self.args()
                if self.v == "{":
                    self.body(None)
                if not self.got(","):
                    break
            if self.got(";"):
                self.members()
            self.need("}")
        elif v == "record" and self.is_name(1) and self.peek(2) in ("(", "<"):
            self.i += 2
            self.type_params()
            self.params()
            self.type_list("implements")
            self.body(None)
        elif v == "@" and self.peek() == "interface":
            self.i += 2
            self.name()
            self.body(None)
        else:
            return False
        return True

    def type_list(self, word: str) -> None:
        if self.got(word):
            self.type_()
            while self.got(","):
                self.type_()

    def body(self, _) -> None:
        self.need("{")
        self.members()
        self.need("}")

    def members(self) -> None:
        while self.v != "}":
            if self.got(";"):
                continue
            if self.v == "{" or self.v == "static" and self.peek() == "{":
                self.got("static")
                self.block()
                continue
            self.modifiers()
            if self.type_decl():
                continue
            self.type_params()
            if self.is_name() and self.peek() == "(" or self.is_name() and self.peek() == "{":
                self.i += 1
                if self.v == "(":
                    self.params()
                self.type_list("throws")
                self.block()
                continue
            if not self.got("void"):
                self.type_()
            self.name()
            if self.v == "(":
                self.params()
                self.dims()
                self.type_list("throws")
                if self.got("default"):
                    self.annotation_value()
                if self.v == "{":
                    self.block()
                else:
                    self.need(";")
            else:
                self.declarators()
                self.need(";")

    def dims(self) -> None:
        while self.v == "[" and self.peek() == "]":
            self.i += 2

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.got("="):
                self.init()
            if not self.got(","):
                return
            self.name()

    def init(self) -> None:
        if self.got("{"):
            self.many(self.init, "}")
        else:
            self.expression()

    def params(self) -> None:
        self.need("(")

        def one() -> None:
            self.modifiers()
            self.type_()
            self.annotations()
            self.got("...")
            if self.v == "this":
                self.i += 1
            else:
                self.dotted()
            self.dims()

        self.many(one, ")", trailing=False)

    def type_params(self) -> None:
        if not self.got("<"):
            return

        def one() -> None:
            self.annotations()
            self.name()
            if self.got("extends"):
                self.type_()
                while self.got("&"):
                    self.type_()

        self.many(one, ">", trailing=False)

    def type_args(self) -> None:
        if not self.got("<"):
            return

        def one() -> None:
            self.annotations()
            if self.got("?"):
                if self.got("extends", "super"):
                    self.type_()
            else:
                self.type_()

        self.many(one, ">", trailing=False)

    def type_(self) -> None:
        self.annotations()
        if self.v in self.BASIC:
            self.i += 1
        else:
            self.name()
            self.type_args()
            while self.v == "." and (self.is_name(1) or self.peek() == "@"):
                self.i += 1
                self.annotations()
                self.name()
                self.type_args()
        self.annotations()
        self.dims()

    # -- statements
    def block(self) -> None:
        self.need("{")
        while not self.got("}"):
            self.statement()

    def local(self) -> None:
        self.modifiers()
        self.type_()
        self.name()
        if self.v not in ("=", ";", ",", "[", ":"):
            raise Bad("local")

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        v = self.v
        if v == "{":
            self.block()
        elif v == ";":
            self.i += 1
        elif v == "if":
            self.i += 1
            self.paren()
            self.statement()
            if self.got("else"):
                self.statement()
        elif v == "while":
            self.i += 1
            self.paren()
            self.statement()
        elif v == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.paren()
            self.need(";")
        elif v == "for":
            self.i += 1
            self.need("(")
            if self.v != ";":
                if self.attempt(self.local):
                    if self.got(":"):
                        self.expression()
                        self.need(")")
                        self.statement()
                        return
                    self.declarators()
                else:
                    self.expression()
                    while self.got(","):
                        self.expression()
            self.need(";")
            if self.v != ";":
                self.expression()
            self.need(";")
            if self.v != ")":
                self.expression()
                while self.got(","):
                    self.expression()
            self.need(")")
            self.statement()
        elif v == "try":
            self.i += 1
            some = False
            if self.got("("):
                some = True

                def resource() -> None:
                    if self.attempt(self.local):
                        self.declarators()
                    else:
                        self.expression()

                self.many(resource, ")", ";")
            self.block()
            while self.got("catch"):
                some = True
                self.need("(")
                self.modifiers()
                self.type_()
                while self.got("|"):
                    self.type_()
                self.name()
                self.need(")")
                self.block()
            if self.got("finally"):
                some = True
                self.block()
            if not some:
                raise Bad("try")
        elif v == "switch":
            self.switch()
            if self.v == ".":
                raise Bad("switch")
        elif v in ("return", "throw"):
            self.i += 1
            if self.v != ";" or v == "throw":
                self.expression()
            self.need(";")
        elif v in ("break", "continue"):
            self.i += 1
            if self.is_name():
                self.i += 1
            self.need(";")
        elif v == "yield" and self.peek() not in ("=", ".", "(", "++", "--", "["):
            self.i += 1
            self.expression()
            self.need(";")
        elif v == "synchronized":
            self.i += 1
            self.paren()
            self.block()
        elif v == "assert":
            self.i += 1
            self.expression()
            if self.got(":"):
                self.expression()
            self.need(";")
        elif self.is_name() and self.peek() == ":":
            self.i += 2
            self.statement()
        else:
            at = self.i
            self.modifiers()
            if self.type_decl():
                return
            self.i = at
            if self.attempt(self.local):
                self.declarators()
                self.need(";")
                return
            start = self.i
            what = self.expression()
            self.need(";")
            if what == "value" or self.i - 1 == start:
                raise Bad("not a statement")

    def switch(self) -> None:
        self.need("switch")
        self.paren()
        self.need("{")
        while not self.got("}"):
            if self.got("default"):
                pass
            else:
                self.need("case")
                while True:
                    if self.got("default"):
                        pass
                    elif not self.attempt(self.pattern):
                        self.ternary()
                    if not self.got(","):
                        break
                if self.got("when"):
                    self.expression()
            if self.got("->"):
                if self.v == "{":
                    self.block()
                elif self.v == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.v not in ("case", "default", "}"):
                    self.statement()

    def pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.got("("):
            self.many(self.pattern, ")", trailing=False)
            if self.is_name() and self.v != "when":
                self.i += 1
        else:
            self.name()

    # -- expressions; the result is "value" for what can't stand as a statement
    def expression(self) -> str:
        if self.v == "(" and self.val[self.match[self.i] + 1] == "->":
            if self.attempt(self.params):
                pass
            else:
                self.need("(")
                self.many(self.name, ")", trailing=False)
            return self.lambda_body()
        if self.is_name() and self.peek() == "->":
            self.i += 1
            return self.lambda_body()
        what = self.ternary()
        if self.v in self.ASSIGN or self.v == ">" and self.shift():
            self.i += 1
            if what in ("call", "value2"):
                raise Bad("target")
            self.expression()
            return "assign"
        return what

    def shift(self) -> bool:
        k = self.i
        while self.val[k] == ">" and self.pos[k + 1] == self.pos[k] + 1:
            k += 1
        if self.val[k] == "=" and k - self.i >= 2:
            self.i = k
            return True
        return False

    def lambda_body(self) -> str:
        self.need("->")
        if self.v == "{":
            self.block()
        else:
            self.expression()
        return "value"

    def ternary(self) -> str:
        what = self.unary()
        while True:
            if self.v == "instanceof":
                self.i += 1
                if not self.attempt(self.pattern):
                    self.got("final")
                    self.type_()
                what = "value2"
            elif self.v == ">" and not self.is_shift_assign():
                self.greater(3)
                self.unary()
                what = "value2"
            elif self.v in self.BINARY:
                self.i += 1
                self.unary()
                what = "value2"
            elif self.v == "?":
                self.i += 1
                self.expression()
                self.need(":")
                self.expression()
                return "value2"
            else:
                return "value" if what == "value2" and False else what

    def is_shift_assign(self) -> bool:
        at = self.i
        yes = self.shift()
        self.i = at
        return yes

    def unary(self) -> str:
        if self.v in ("++", "--"):
            self.i += 1
            self.unary()
            return "assign"
        if self.v in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value2"
        if self.v == "(" and self.attempt(self.cast):
            return "value2"
        return self.postfix()

    def cast(self) -> None:
        self.need("(")
        basic = self.v in self.BASIC
        self.type_()
        while self.got("&"):
            self.type_()
        self.need(")")
        k, v = self.kind[self.i], self.v
        if k in "0s" or k == "n" and v not in ("instanceof",) or v in ("(", "!", "~") or basic and v in ("+", "-", "++", "--"):
            if self.v == "(" and self.val[self.match[self.i] + 1] == "->" or self.is_name() and self.peek() == "->":
                self.expression()
            else:
                self.unary()
            return
        raise Bad("cast")

    def args(self) -> None:
        self.need("(")
        self.many(self.expression, ")", trailing=False)

    def postfix(self) -> str:
        k, v = self.kind[self.i], self.v
        what = "value"
        if k in "0s":
            self.i += 1
        elif v == "(":
            self.paren()
        elif v in ("true", "false", "null"):
            self.i += 1
        elif v in ("this", "super"):
            self.i += 1
            if self.v == "(":
                self.args()
                what = "call"
        elif v == "new":
            what = self.creation()
        elif v == "switch":
            self.switch()
        elif v in self.BASIC or v == "void":
            self.i += 1
            self.dims()
            if self.v == "::":
                pass
            else:
                self.need(".")
                self.need("class")
        elif self.attempt(self.array_class):
            pass
        else:
            self.name()
            if self.v == "(":
                self.args()
                what = "call"
        while True:
            if self.v == ".":
                self.i += 1
                if self.v == "new":
                    what = self.creation()
                    continue
                if self.v == "<":
                    self.type_args()
                if self.v in ("class", "this", "super"):
                    self.i += 1
                else:
                    self.name()
                what = "value"
                if self.v == "(":
                    self.args()
                    what = "call"
            elif self.v == "[":
                self.i += 1
                self.expression()
                self.need("]")
                what = "value"
            elif self.v in ("++", "--"):
                self.i += 1
                what = "assign"
            elif self.v == "::":
                self.i += 1
                self.type_args()
                if not self.got("new"):
                    self.name()
                what = "value"
            elif self.v == "<" and self.attempt(self.generic_ref):
                what = "value"
            else:
                return what

    def array_class(self) -> None:
        self.type_()
        if self.val[self.i - 1] != "]" or self.v not in (".", "::"):
            raise Bad("array")
        if self.v == ".":
            self.i += 1
            self.need("class")

    def generic_ref(self) -> None:
        self.type_args()
        self.dims()
        if self.v != "::":
            raise Bad("::")

    def creation(self) -> str:
        self.need("new")
        self.annotations()
        self.type_args()
        if self.v in self.BASIC:
            self.i += 1
        else:
            self.name()
            self.diamond()
            while self.got("."):
                self.name()
                self.diamond()
        if self.v == "[":
            sized = False
            while self.v == "[":
                self.i += 1
                if not self.got("]"):
                    self.expression()
                    self.need("]")
                    sized = True
            if self.v == "{" and not sized:
                self.init()
            elif not sized:
                raise Bad("array")
            return "value"
        self.args()
        if self.v == "{":
            self.body(None)
        return "call"

    def diamond(self) -> None:
        if self.v == "<" and self.peek() == ">":
            self.i += 2
        else:
            self.type_args()


# ---------------------------------------------------------------------------------------------------------------------
class C(Parser):
    TOKEN = re.compile(
        r"(?P<ws>(?:\s|\\\r?\n|//(?:[^\n\\]|\\(?s:.))*|/\*(?s:.*?)\*/)+)|(?P<d>(?m:^)[ \t]*\#(?:[^\n\\/]|\\(?s:.)|/(?!\*)|/\*(?s:.*?)\*/)*)"
        r"|(?P<s>(?:u8|[uUL])?\"(?:[^\"\\\n]|\\(?s:.))*\"|[uUL]?'(?:[^'\\\n]|\\.)+')|(?P<n>(?:[^\W\d]|\$)[\w$]*)"
        r"|(?P<n0>(?:0[xX][\da-fA-F.]+(?:[pP][+-]?\d+)?|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfFzZ]*(?![\w$]))"
        r"|(?P<p>\.\.\.|->|<<=|>>=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\#\#|[{}()\[\];,<>+\-*/%&|^!~?:=.])"
    )
    RESERVED = frozenset(
        "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Noreturn _Static_assert _Thread_local".split()
    )
    DIRECTIVES = frozenset("include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif error warning line pragma ident assert embed".split())
    SPECS = frozenset("auto const extern inline register restrict static typedef volatile _Atomic _Noreturn _Thread_local __inline __inline__ __restrict __restrict__ __extension__ __const __volatile__ thread_local constexpr".split())
    TYPES = frozenset("void char short int long float double signed unsigned _Bool _Complex bool __int128".split())
    BINARY = frozenset("== != < > <= >= + - * / % & | ^ << >> && ||".split())
    ASSIGN = frozenset("= += -= *= /= %= <<= >>= &= |= ^=".split())

    def scan(self, text: str) -> None:
        super().scan(text)
        depth = 0
        keep = []
        for i, k in enumerate(self.kind):
            if k != "d":
                keep.append(i)
        # directives: known words, conditions balanced; only the first branch of a condition is read
        out, skip = [], []
        starts = {i: text[self.pos[i] : (self.pos[i + 1] if i + 1 < len(self.pos) else len(text))] for i, k in enumerate(self.kind) if k == "d"}
        for i, k in enumerate(self.kind):
            if k != "d":
                if not any(skip):
                    out.append(i)
                continue
            m = re.match(r"\s*#\s*([A-Za-z_]\w*)?(?:[ \t]*([^\n]*))?", starts[i])
            word, rest = m[1], (m[2] or "").strip()
            if word is None:
                if m and re.match(r"\s*#\s*(?:\d|\r?$)", starts[i]):
                    continue
                raise Bad("directive")
            if word not in self.DIRECTIVES:
                raise Bad(word)
            if word == "include" and not re.match(r'(?:<[^>\n]+>|"[^"\n]+"|[A-Za-z_]\w*)', rest):
                raise Bad("include")
            if word in ("define", "undef", "ifdef", "ifndef") and not re.match(r"[A-Za-z_$]", rest):
                raise Bad(word)
            if word in ("if", "ifdef", "ifndef"):
                if word == "if" and not rest:
                    raise Bad("if")
                skip.append(False)
                depth += 1
            elif word.startswith("el"):
                if not skip:
                    raise Bad(word)
                skip[-1] = True
            elif word == "endif":
                if not skip:
                    raise Bad(word)
                skip.pop()
        if skip:
            raise Bad("endif")
        self.kind = ["0" if self.kind[i] == "n0" else self.kind[i] for i in out]
        self.val, self.nl, self.pos = [self.val[i] for i in out], [self.nl[i] for i in out], [self.pos[i] for i in out]

    def file(self) -> None:
        while not self.end():
            if self.got(";"):
                continue
            self.external()

    def extra(self) -> None:
        """Attributes and assembler names of compilers."""
        while self.v in ("__attribute__", "__attribute", "__asm__", "asm", "__declspec", "_Alignas", "alignas") and self.peek() == "(":
            self.i += 1
            self.skip_group()
        while self.v == "[" and self.peek() == "[":
            self.skip_group()

    def external(self) -> None:
        if self.v in ("_Static_assert", "static_assert"):
            self.i += 1
            self.args()
            self.need(";")
            return
        # a macro call on its own line
        if self.is_name() and self.peek() == "(" and self.nl[self.match[self.i + 1] + 1] and self.val[self.match[self.i + 1] + 1] not in ("{", ";"):
            self.i += 1
            self.skip_group()
            return
        if self.is_name() and self.peek() == "(":
            after = self.match[self.i + 1] + 1
            if self.val[after] == ";" or self.v.isupper() and self.val[after] == "{":
                self.i = after  # a macro that makes declarations, or the head of a function
                if self.v == "{":
                    self.block()
                else:
                    self.need(";")
                return
        self.declaration(True)

    def specifiers(self) -> bool:
        """Declaration specifiers; whether there was any type."""
        typed = some = False
        while True:
            self.extra()
            if self.v in self.SPECS:
                self.i += 1
                some = True
            elif self.v in self.TYPES and self.kind[self.i] == "n":
                self.i += 1
                typed = True
            elif self.v in ("struct", "union"):
                self.i += 1
                self.extra()
                named = self.is_name()
                if named:
                    self.i += 1
                self.extra()
                if self.v == "{":
                    self.i += 1
                    while not self.got("}"):
                        if not self.got(";"):
                            self.field()
                elif not named:
                    raise Bad("struct")
                typed = True
            elif self.v == "enum":
                self.i += 1
                named = self.is_name()
                if named:
                    self.i += 1
                if self.got("{"):

                    def one() -> None:
                        self.name()
                        if self.got("="):
                            self.ternary()

                    self.many(one, "}")
                elif not named:
                    raise Bad("enum")
                typed = True
            elif self.v in ("typeof", "__typeof__", "typeof_unqual") and self.peek() == "(":
                self.i += 1
                self.skip_group()
                typed = True
            elif not typed and self.is_name():
                self.i += 1
                typed = True
            elif typed and self.is_name() and self.v.startswith("__") and (self.kind[self.i + 1] == "n" or self.peek() == "*"):
                self.i += 1  # a macro for attributes of the section or address space
            else:
                return typed or some

    def field(self) -> None:
        if not self.specifiers():
            raise Bad("field")
        if self.got(";"):
            return
        while True:
            if self.v != ":":
                self.declarator(False)
            if self.got(":"):
                self.ternary()
            self.extra()
            if not self.got(","):
                break
        self.need(";")

    def declarator(self, abstract: bool) -> None:
        while self.v in ("*", "const", "volatile", "restrict", "__restrict", "__restrict__", "_Nonnull", "_Nullable", "^"):
            self.i += 1
        self.extra()
        if self.v == "(" and (self.peek() in ("*", "^", "(") or self.is_name(1) and self.peek(2) in (")", "(", "[") and not abstract):
            self.i += 1
            self.declarator(abstract)
            self.need(")")
        elif self.is_name():
            self.i += 1
        elif not abstract:
            raise Bad(f"declarator at {self.pos[self.i]}")
        while True:
            if self.v == "(":
                self.i += 1
                self.param_list()
            elif self.v == "[":
                self.i += 1
                while self.v in ("static", "const", "restrict", "volatile"):
                    self.i += 1
                if self.v == "*" and self.peek() == "]":
                    self.i += 1
                elif self.v != "]":
                    self.assign()
                self.need("]")
            else:
                break
        self.extra()

    def param_list(self) -> None:
        def one() -> None:
            if self.got("..."):
                return
            if not self.specifiers():
                raise Bad("parameter")
            self.declarator(True)

        self.many(one, ")", trailing=False)

    def initial(self) -> None:
        if self.got("{"):

            def one() -> None:
                while self.v in (".", "["):
                    if self.got("."):
                        self.name()
                    else:
                        self.i += 1
                        self.ternary()
                        if self.got("..."):
                            self.ternary()
                        self.need("]")
                self.got("=")
                self.initial()

            self.many(one, "}")
        else:
            self.assign()

    def declaration(self, outer: bool) -> None:
        at = self.i
        if not self.specifiers():
            raise Bad(f"declaration at {self.pos[self.i]}")
        if self.got(";"):
            if self.i - at == 2 and self.kind[at] == "n" and self.val[at] not in self.RESERVED:
                raise Bad("declaration")
            return
        if outer and self.v == "(" and self.i - at == 1 and self.val[at] not in self.TYPES:
            self.i = at  # a function without a type
        first = True
        while True:
            self.declarator(False)
            if first and outer and self.val[self.i - 1] == ")" or first and outer and self.v == "{":
                while self.v not in ("{", ";", ",", "=", None) and self.kind[self.i] == "n":  # old style parameters
                    self.declaration(False)
                if self.v == "{":
                    if self.val[self.i - 1] not in (")", ";"):
                        raise Bad("function")
                    self.block()
                    return
            if self.got("="):
                self.initial()
            first = False
            if not self.got(","):
                break
        self.need(";")

    def block(self) -> None:
        self.need("{")
        while not self.got("}"):
            self.statement()

    def is_declaration(self) -> bool:
        v = self.v
        if self.kind[self.i] != "n":
            return False
        if v in self.SPECS or v in self.TYPES or v in ("struct", "union", "enum", "typeof", "__typeof__", "_Static_assert", "static_assert"):
            return True
        if v in self.RESERVED:
            return False
        if self.is_name(1) or self.peek() in ("const", "volatile"):
            return True
        k = 1
        while self.peek(k) in ("*", "const", "restrict", "volatile"):
            k += 1
        return k > 1 and self.kind[self.i + k] == "n" and self.peek(k + 1) in ("=", ";", ",", "[")

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        v = self.v
        if v == "{":
            self.block()
        elif v == ";":
            self.i += 1
        elif v == "if":
            self.i += 1
            self.paren()
            self.statement()
            if self.got("else"):
                self.statement()
        elif v in ("while", "switch"):
            self.i += 1
            self.paren()
            self.statement()
        elif v == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.paren()
            self.need(";")
        elif v == "for":
            self.i += 1
            self.need("(")
            if self.is_declaration():
                self.declaration(False)
            else:
                if self.v != ";":
                    self.expression()
                self.need(";")
            if self.v != ";":
                self.expression()
            self.need(";")
            if self.v != ")":
                self.expression()
            self.need(")")
            self.statement()
        elif v == "return":
            self.i += 1
            if self.v != ";":
                self.expression()
            self.need(";")
        elif v in ("break", "continue"):
            self.i += 1
            self.need(";")
        elif v == "goto":
            self.i += 1
            self.got("*")
            self.name()
            self.need(";")
        elif v == "case":
            self.i += 1
            self.ternary()
            if self.got("..."):
                self.ternary()
            self.need(":")
            self.labelled()
        elif v == "default":
            self.i += 1
            self.need(":")
            self.labelled()
        elif v in ("asm", "__asm__", "__asm"):
            self.i += 1
            while self.v in ("volatile", "__volatile__", "goto", "inline"):
                self.i += 1
            self.skip_group()
            self.need(";")
        elif self.is_name() and self.peek() == ":":
            self.i += 2
            self.labelled()
        elif v in ("_Static_assert", "static_assert"):
            self.external()
        elif self.is_declaration():
            self.declaration(False)
        else:
            self.expression()
            # a macro that takes a block
            if self.v == "{" and self.val[self.i - 1] == ")":
                self.block()
            else:
                self.need(";")

    def labelled(self) -> None:
        if self.v not in ("}", "case", "default"):
            self.statement()

    def expression(self) -> None:
        self.assign()
        while self.got(","):
            self.assign()

    def assign(self) -> None:
        simple = self.unary()
        if self.v in self.ASSIGN:
            if not simple:
                raise Bad("target")
            self.i += 1
            self.initial() if self.v == "{" else self.assign()
            return
        self.binary_rest()

    def ternary(self) -> None:
        self.unary()
        self.binary_rest()

    def binary_rest(self) -> None:
        while True:
            if self.v in self.BINARY:
                self.i += 1
                self.unary()
            elif self.v == "?":
                self.i += 1
                if self.v != ":":
                    self.expression()
                self.need(":")
                self.assign()
                return
            else:
                return

    def type_name(self) -> None:
        if not self.specifiers():
            raise Bad("type")
        self.declarator(True)

    def cast(self) -> None:
        self.need("(")
        sure = self.v in self.TYPES or self.v in self.SPECS or self.v in ("struct", "union", "enum")
        self.type_name()
        pointer = self.val[self.i - 1] == "*"
        self.need(")")
        if self.v == "{":
            self.initial()
            self.postfix_rest()
        elif sure or pointer or self.kind[self.i] in "0s" or self.kind[self.i] == "n" and self.v not in ("sizeof",) and self.v not in self.RESERVED or self.v in ("(", "!", "~", "sizeof"):
            self.unary()
        else:
            raise Bad("cast")

    def unary(self) -> bool:
        v = self.v
        if v in ("++", "--", "+", "-", "!", "~", "&", "*", "&&", "__extension__"):
            self.i += 1
            self.unary()
            return v == "*"
        if v in ("sizeof", "_Alignof", "alignof", "__alignof__"):
            self.i += 1
            if self.v == "(" and self.attempt(lambda: (self.need("("), self.type_name(), self.need(")"))):
                self.postfix_rest()
            else:
                self.unary()
            return False
        if v == "(" and self.attempt(self.cast):
            return False
        return self.postfix()

    def args(self) -> None:
        self.need("(")

        def one() -> None:
            if not self.attempt(lambda: (self.assign(), None if self.v in (",", ")") else self.need(","))):
                self.type_name()

        self.many(one, ")", trailing=False)

    def postfix(self) -> bool:
        k = self.kind[self.i]
        simple = True
        if k == "s":
            while self.kind[self.i] == "s" or self.is_name() and self.kind[self.i + 1] == "s" or self.is_name() and self.kind[self.i - 1] == "s":
                self.i += 1
            simple = False
        elif k == "0":
            self.i += 1
            simple = False
        elif self.v == "(":
            if self.peek() == "{":
                self.i += 1
                self.block()
                self.need(")")
            else:
                self.paren()
        elif self.v == "_Generic":
            self.i += 1
            self.skip_group()
        else:
            self.name()
            if self.kind[self.i] == "s":  # a macro beside a string
                return self.postfix()
        return self.postfix_rest() or simple

    def postfix_rest(self) -> bool:
        simple = False
        while True:
            if self.v == "[":
                self.i += 1
                self.expression()
                self.need("]")
                simple = True
            elif self.v == "(":
                self.args()
            elif self.v in (".", "->"):
                self.i += 1
                self.name()
                simple = True
            elif self.v in ("++", "--"):
                self.i += 1
            else:
                return simple


# ---------------------------------------------------------------------------------------------------------------------
class Go(Parser):
    TOKEN = re.compile(
        r"(?P<ws>(?:\s|//[^\n]*|/\*(?s:.*?)\*/)+)|(?P<n>[^\W\d]\w*)"
        r"|(?P<n0>(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)i?(?!\w))"
        r"|(?P<s>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[abfnrtv\\'\"]))')"
        r"|(?P<p>\.\.\.|&\^=|<<=|>>=|:=|<-|&\^|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[{}()\[\];,<>+\-*/%&|^!~:=.])"
    )
    RESERVED = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    ENDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
    BINARY = frozenset("== != < > <= >= + - * / % & | ^ << >> && || &^".split())
    ASSIGN = frozenset("= += -= *= /= %= <<= >>= &= |= ^= &^=".split())

    def scan(self, text: str) -> None:
        super().scan(text)
        kind, val, nl, pos = [], [], [], []
        for k, v, n, p in zip(self.kind, self.val, self.nl, self.pos):
            if n and kind and self.closes(kind[-1], val[-1]):
                kind.append("p")
                val.append(";")
                nl.append(False)
                pos.append(p)
            kind.append("0" if k == "n0" else k)
            val.append(v)
            nl.append(n)
            pos.append(p)
        if kind and self.closes(kind[-1], val[-1]):
            kind.append("p")
            val.append(";")
            nl.append(False)
            pos.append(len(text))
        self.kind, self.val, self.nl, self.pos = kind, val, nl, pos

    def closes(self, k: str, v: str | None) -> bool:
        return k in "0s" or k == "n" and v not in self.RESERVED or v in self.ENDS

    def semi(self) -> None:
        if self.v not in (")", "}"):
            self.need(";")

    def file(self) -> None:
        if self.end():
            return
        self.need("package")
        self.name()
        self.need(";")
        while self.got("import"):
            self.group(self.import_)
            self.need(";")
        while not self.end():
            if self.v == "func":
                self.i += 1
                if self.v == "(":
                    self.params()
                self.name()
                if self.v == "[":
                    self.type_params()
                self.signature()
                if self.v == "{":
                    self.block()
            elif self.v in ("var", "const", "type"):
                self.decl()
            else:
                raise Bad("declaration")
            if not self.end():
                self.need(";")

    def group(self, rule) -> None:
        if self.got("("):
            while not self.got(")"):
                rule()
                if self.v != ")":
                    self.need(";")
        else:
            rule()

    def import_(self) -> None:
        if not self.got("."):
            if self.is_name():
                self.i += 1
        if self.kind[self.i] != "s":
            raise Bad("import")
        self.i += 1

    def decl(self) -> None:
        word = self.v
        self.i += 1
        if word == "type":
            self.group(self.type_spec)
        else:
            self.group(lambda: self.var_spec(word == "const"))

    def type_spec(self) -> None:
        self.name()
        if self.v == "[" and self.peek() != "]" and self.attempt(lambda: (self.type_params(), None if self.kind[self.i] == "n" or self.v in ("=", "[", "*", "(", "struct") else self.need("="))):
            pass
        self.got("=")
        self.type_()

    def type_params(self) -> None:
        self.need("[")

        def one() -> None:
            self.names()
            self.constraint()

        self.many(one, "]")

    def constraint(self) -> None:
        while True:
            self.got("~")
            self.type_()
            if not self.got("|"):
                return

    def names(self) -> None:
        self.name()
        while self.got(","):
            self.name()

    def var_spec(self, const: bool) -> None:
        self.names()
        if self.v not in ("=", ";", ")"):
            self.type_()
        elif not const and self.v != "=":
            raise Bad("var")
        if self.got("="):
            self.exprs()

    # -- types
    def type_(self) -> None:
        v = self.v
        if v == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif v == "*":
            self.i += 1
            self.type_()
        elif v == "[":
            self.i += 1
            if not self.got("]"):
                if not self.got("..."):
                    self.expr()
                self.need("]")
            self.type_()
        elif v == "map":
            self.i += 1
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif v == "chan" or v == "<-":
            if self.got("<-"):
                self.need("chan")
            else:
                self.i += 1
                self.got("<-")
            self.type_()
        elif v == "func":
            self.i += 1
            self.signature()
        elif v == "struct":
            self.i += 1
            self.need("{")
            while not self.got("}"):
                if not self.attempt(self.embedded):
                    self.names()
                    self.type_()
                if self.kind[self.i] == "s":
                    self.i += 1
                self.semi()
        elif v == "interface":
            self.i += 1
            self.need("{")
            while not self.got("}"):
                if self.is_name() and self.peek() == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
        else:
            self.name()
            if self.got("."):
                self.name()
            if self.v == "[" and self.peek() != "]":
                self.attempt(lambda: (self.need("["), self.many(self.type_, "]")))

    def embedded(self) -> None:
        self.got("*")
        self.name()
        if self.got("."):
            self.name()
        if self.v == "[":
            self.skip_group()
        if self.kind[self.i] != "s" and self.v not in (";", "}"):
            raise Bad("embedded")

    def params(self) -> None:
        self.need("(")

        def one() -> None:
            if self.got("..."):
                self.type_()
                return
            self.type_()
            if self.v not in (",", ")"):
                self.got("...")
                self.type_()

        self.many(one, ")")

    def signature(self) -> None:
        self.params()
        if self.v == "(":
            self.params()
        elif self.kind[self.i] == "n" and (self.is_name() or self.v in ("map", "chan", "func", "struct", "interface")) or self.v in ("*", "[", "<-"):
            self.type_()

    # -- statements
    def block(self) -> None:
        self.need("{")
        self.statements(("}",))
        self.need("}")

    def statements(self, ends: tuple) -> None:
        hold, self.lit = self.lit, True
        while self.v not in ends:
            if self.end():
                raise Bad("block")
            if self.got(";"):
                continue
            self.statement()
            if self.v not in ends:
                self.semi()
        self.lit = hold

    lit = True

    def simple(self) -> None:
        self.exprs()
        if self.v in (":=", *self.ASSIGN):
            self.i += 1
            if not self.got("range"):
                self.exprs()
            else:
                self.expr()
        elif self.v in ("++", "--"):
            self.i += 1
        elif self.got("<-"):
            self.expr()

    def header(self) -> None:
        """The head of if and switch, up to the block."""
        hold, self.lit = self.lit, False
        if self.v != "{":
            if self.v != ";":
                self.simple()
            if self.got(";") and self.v != "{":
                self.simple()
        self.lit = hold

    def statement(self) -> None:
        v = self.v
        if v == "{":
            self.block()
        elif v in ("var", "const", "type"):
            self.decl()
        elif v == "if":
            self.i += 1
            if self.v == "{":
                raise Bad("if")
            self.header()
            self.block()
            if self.got("else"):
                if self.v not in ("if", "{"):
                    raise Bad("else")
                self.statement()
        elif v == "for":
            self.i += 1
            hold, self.lit = self.lit, False
            if self.got("range"):
                self.expr()
            elif self.v != "{":
                if self.v != ";":
                    self.simple()
                if self.got(";"):
                    if self.v != ";":
                        self.expr()
                    self.need(";")
                    if self.v != "{":
                        self.simple()
            self.lit = hold
            self.block()
        elif v in ("switch", "select"):
            self.i += 1
            if v == "switch":
                self.header()
            self.need("{")
            while not self.got("}"):
                if self.got("default"):
                    pass
                else:
                    self.need("case")
                    if v == "select":
                        self.simple()
                    else:
                        self.many_types_or_exprs()
                self.need(":")
                self.statements(("case", "default", "}"))
        elif v in ("return",):
            self.i += 1
            if self.v not in (";", "}"):
                self.exprs()
        elif v in ("break", "continue"):
            self.i += 1
            if self.is_name():
                self.i += 1
        elif v == "goto":
            self.i += 1
            self.name()
        elif v == "fallthrough":
            self.i += 1
        elif v in ("go", "defer"):
            self.i += 1
            self.expr()
            if self.val[self.i - 1] != ")":
                raise Bad("call")
        elif self.is_name() and self.peek() == ":":
            self.i += 2
            if self.v not in ("}", "case", "default", ";"):  # a label may stand alone
                self.statement()
        else:
            at = self.i
            self.simple()
            if self.i - at == 1 or self.kind[self.i - 1] in "0" and self.i - at == 1:
                raise Bad("not used")

    def many_types_or_exprs(self) -> None:
        while True:
            at = self.i
            try:
                self.expr()
                if self.v not in (",", ":"):
                    raise Bad("case")
            except Bad:
                self.i = at
                self.type_()
            if not self.got(","):
                return

    # -- expressions
    def exprs(self) -> None:
        self.expr()
        while self.got(","):
            self.expr()

    def expr(self) -> None:
        self.unary()
        while self.v in self.BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.v in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.i += 1
        self.operand()

    def operand(self) -> None:
        k, v = self.kind[self.i], self.v
        literal = False  # whether a composite literal may follow
        if k in "0s":
            self.i += 1
        elif v == "(":
            self.i += 1
            hold, self.lit = self.lit, True
            if not self.attempt(lambda: (self.expr(), self.need(")"))):
                self.type_()
                self.need(")")
            self.lit = hold
        elif v == "func":
            self.i += 1
            self.signature()
            if self.v == "{":
                hold, self.lit = self.lit, True
                self.block()
                self.lit = hold
        elif v in ("[", "map", "struct", "chan", "interface"):
            self.type_()
            if self.v == "{":
                self.composite()
            elif self.v != "(" and self.v not in (",", ")"):
                raise Bad("type")
        else:
            self.name()
            literal = True
        while True:
            v = self.v
            if v == ".":
                self.i += 1
                if self.got("("):
                    if not self.got("type"):
                        self.type_()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif v == "[":
                self.i += 1
                hold, self.lit = self.lit, True
                if not self.attempt(self.index):
                    self.many(self.type_, "]")
                self.lit = hold
            elif v == "(":
                self.i += 1
                hold, self.lit = self.lit, True

                def arg() -> None:
                    if not self.attempt(lambda: (self.expr(), None if self.v in (",", ")", "...") else self.need(","))):
                        self.type_()
                    self.got("...")

                self.many(arg, ")")
                self.lit = hold
                literal = False
            elif v == "{" and literal and self.lit:
                self.composite()
                literal = False
            else:
                return

    def index(self) -> None:
        if self.v != ":":
            self.expr()
            while self.got(","):
                if self.v != "]":
                    self.type_()
        while self.got(":"):
            if self.v not in (":", "]"):
                self.expr()
        self.need("]")

    def composite(self) -> None:
        self.need("{")
        hold, self.lit = self.lit, True

        def value() -> None:
            if self.v == "{":
                self.composite()
            else:
                self.expr()

        def one() -> None:
            value()
            if self.got(":"):
                value()

        self.many(one, "}")
        self.lit = hold


# ---------------------------------------------------------------------------------------------------------------------
class Rust(Parser):
    TOKEN = re.compile(
        r"(?P<ws>(?:\s|//[^\n]*)+)|(?P<s>(?:b|c)?\"(?:[^\"\\]|\\(?s:.))*\"|(?:br|r|cr)(?P<h>\#*)\"(?s:.*?)\"(?P=h)|b?'(?:[^'\\\n\t]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|[nrt0\\'\"]))')"
        r"|(?P<l>'[^\W\d]\w*)|(?P<n>(?:r\#)?[^\W\d]\w*)"
        r"|(?P<n0>(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?(?!\w))"
        r"|(?P<p>\.\.\.|\.\.=|<<=|=>|->|::|\.\.|==|!=|<=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!?:=.@\#$~])"
    )
    RESERVED = frozenset(
        "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split()
    )
    PATH = frozenset(["self", "Self", "super", "crate"])
    BINARY = frozenset("== != < <= + - * / % & | ^ << && ||".split())
    ASSIGN = frozenset("= += -= *= /= %= <<= &= |= ^=".split())

    def scan(self, text: str) -> None:
        i, n, nl = 0, len(text), False
        if text.startswith("#!") and not text.startswith("#!["):
            i = (text.find("\n") + 1) or n
        take = self.TOKEN.match
        while i < n:
            if text.startswith("/*", i):
                depth, j = 1, i + 2
                while depth:
                    a, b = text.find("/*", j), text.find("*/", j)
                    if b < 0:
                        raise Bad("comment")
                    if 0 <= a < b:
                        depth, j = depth + 1, a + 2
                    else:
                        depth, j = depth - 1, b + 2
                i = j
                continue
            m = take(text, i)
            if not m or m.end() == i:
                raise Bad(text[i : i + 10])
            g = m.lastgroup
            if g == "ws":
                nl = True
            else:
                self.add("0" if g == "n0" else g if g != "h" else "s", m[0] if g in ("n", "p") else None, nl, i)
                nl = False
            i = m.end()

    def file(self) -> None:
        while not self.end():
            self.item(True)

    def attributes(self) -> None:
        while self.v == "#" and (self.peek() == "[" or self.peek() == "!" and self.peek(2) == "["):
            self.i += 1
            self.got("!")
            self.skip_group()

    def visibility(self) -> None:
        if self.got("pub") and self.v == "(" and self.peek() in ("crate", "super", "self", "in"):
            self.skip_group()

    def item(self, must: bool) -> bool:
        at = self.i
        self.attributes()
        if self.end() and self.i > at:
            return True
        self.visibility()
        v = self.v
        if v == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif v == "mod":
            self.i += 1
            self.name()
            if not self.got(";"):
                self.need("{")
                while not self.got("}"):
                    self.item(True)
        elif v == "struct" or v == "union" and self.is_name(1) and self.peek(2) in ("{", "<"):
            self.i += 1
            self.name()
            self.generics()
            if self.v == "(":
                self.tuple_fields()
                self.where()
                self.need(";")
            else:
                self.where()
                if not self.got(";"):
                    self.fields()
        elif v == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")

            def variant() -> None:
                self.attributes()
                self.visibility()
                self.name()
                if self.v == "(":
                    self.tuple_fields()
                elif self.v == "{":
                    self.fields()
                if self.got("="):
                    self.expr()

            self.many(variant, "}")
        elif v == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.got(":") and self.v not in ("=", ";"):
                self.bounds()
            self.where()
            if self.got("="):
                self.type_()
            self.where()
            self.need(";")
        elif v == "static" or v == "const" and (self.is_name(1) or self.peek() in ("_", "mut")):
            self.i += 1
            self.got("mut")
            self.name()
            self.need(":")
            self.type_()
            if self.got("="):
                self.expr()
            self.need(";")
        elif v == "impl" or v == "unsafe" and self.peek() in ("impl", "trait") or v == "trait" or v == "auto" and self.peek() == "trait":
            self.got("unsafe")
            self.got("auto")
            if self.got("trait"):
                self.name()
                self.generics()
                if self.got(":") and self.v not in ("{", "where"):
                    self.bounds()
            else:
                self.need("impl")
                if self.v == "<":
                    self.generics()
                self.got("const")
                self.got("!")
                self.type_()
                if self.got("for"):
                    self.type_()
            self.where()
            self.need("{")
            while not self.got("}"):
                at2 = self.i
                self.attributes()
                if self.v == "}":
                    break
                self.i = at2
                self.item(True)
        elif v == "safe" and self.peek() == "static":
            self.i += 1
            return self.item(must)
        elif v == "extern" and (self.peek() == "crate" or self.peek() == "{" or self.kind[self.i + 1] == "s" and self.peek(2) == "{") or (
            v == "unsafe" and self.peek() == "extern" and (self.peek(2) == "{" or self.kind[self.i + 2] == "s" and self.peek(3) == "{")
        ):
            self.got("unsafe")
            self.i += 1
            if self.got("crate"):
                self.name(False)
                if self.got("as"):
                    self.name()
                self.need(";")
            else:
                if self.kind[self.i] == "s":
                    self.i += 1
                self.need("{")
                while not self.got("}"):
                    self.item(True)
        elif v == "macro_rules" and self.peek() == "!":
            self.i += 2
            self.name()
            brace = self.v == "{"
            self.skip_group()
            if not brace:
                self.need(";")
        elif self.function_start():
            while self.v != "fn":
                self.i += 1
            self.i += 1
            self.name()
            self.generics()
            self.fn_params()
            if self.got("->"):
                self.type_()
            self.where()
            if not self.got(";"):
                self.block()
        elif must and (self.is_name() or self.v in self.PATH) and self.macro_call():
            pass
        else:
            if must:
                raise Bad(f"item at {self.pos[self.i]}")
            self.i = at
            return False
        return True

    def macro_call(self) -> bool:
        at = self.i
        try:
            self.simple_path()
            self.need("!")
            if self.is_name():
                self.i += 1
            brace = self.v == "{"
            self.skip_group()
            if not brace:
                self.need(";")
            return True
        except Bad:
            self.i = at
            return False

    def function_start(self) -> bool:
        k = 0
        while self.peek(k) in ("const", "async", "unsafe", "safe", "extern", "default") or k and self.kind[self.i + k] == "s" and self.peek(k - 1) == "extern":
            k += 1
        return self.peek(k) == "fn" and self.kind[self.i + k + 1] == "n"

    def simple_path(self) -> None:
        self.got("::")
        self.name(False)
        while self.got("::"):
            self.name(False)

    def use_tree(self) -> None:
        self.got("::")
        while True:
            if self.got("{"):
                self.many(self.use_tree, "}")
                return
            if self.got("*"):
                return
            if self.v in self.PATH:
                self.i += 1
            else:
                self.name()
            if not self.got("::"):
                break
        if self.got("as"):
            self.name()

    def generics(self) -> None:
        if not self.got("<"):
            return

        def one() -> None:
            self.attributes()
            if self.kind[self.i] == "l":
                self.i += 1
                if self.got(":") and self.v not in (",", ">"):
                    self.bounds()
                return
            const = self.got("const")
            self.name()
            if self.got(":"):
                if const:
                    self.type_()
                elif self.v not in (",", ">", "="):
                    self.bounds()
            if self.got("="):
                self.generic_arg()

        self.many(one, ">")

    def where(self) -> None:
        if not self.got("where"):
            return
        while self.v not in ("{", ";", "="):
            if self.kind[self.i] == "l":
                self.i += 1
            else:
                self.for_lifetimes()
                self.type_()
            self.need(":")
            if self.v not in (",", "{", ";"):
                self.bounds()
            if not self.got(","):
                return

    def for_lifetimes(self) -> None:
        if self.v == "for" and self.peek() == "<":
            self.i += 1
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.kind[self.i] == "l":
                self.i += 1
            elif self.v == "use" and self.peek() == "<":
                self.i += 2
                while not self.got(">"):
                    self.i += 1 if self.kind[self.i] == "l" or self.v == "Self" else 0
                    if self.kind[self.i - 1] != "l" and self.val[self.i - 1] != "Self":
                        self.name()
                    if self.v != ">":
                        self.need(",")
            else:
                paren = self.got("(")
                self.got("?", "~")
                self.got("const")
                self.for_lifetimes()
                self.type_path()
                if paren:
                    self.need(")")
            if not self.got("+"):
                return
            if self.v in ("{", ",", ">", "=", ";", ")", "where"):
                return

    def fields(self) -> None:
        self.need("{")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.name()
            self.need(":")
            self.type_()

        self.many(one, "}")

    def tuple_fields(self) -> None:
        self.need("(")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.type_()

        self.many(one, ")")

    def fn_params(self) -> None:
        self.need("(")

        def one() -> None:
            self.attributes()
            if self.got("..."):
                return
            if self.attempt(self.self_param):
                return
            self.pattern()
            self.need(":")
            if not self.got("..."):
                self.type_()

        self.many(one, ")")

    def self_param(self) -> None:
        if self.got("&") and self.kind[self.i] == "l":
            self.i += 1
        self.got("mut")
        self.need("self")
        if self.got(":"):
            self.type_()
        if self.v not in (",", ")"):
            raise Bad("self")

    # -- types and paths
    def generic_arg(self) -> None:
        if self.kind[self.i] == "l":
            self.i += 1
        elif self.kind[self.i] in "0s" or self.v in ("-", "true", "false"):
            self.got("-")
            self.i += 1
        elif self.v == "{":
            self.block()
        elif self.is_name() and self.peek() in ("=", ":"):
            self.i += 1
            if self.got("="):
                self.type_()
            else:
                self.need(":")
                self.bounds()
        else:
            self.type_()
            if self.got("="):
                self.type_()

    def generic_args(self) -> None:
        self.need("<")
        self.many(self.generic_arg, ">")

    def segment(self, expr: bool) -> None:
        if self.v in self.PATH:
            self.i += 1
        else:
            self.name()
        if not expr and self.v == "<":
            self.generic_args()
        elif not expr and self.v == "(" and self.val[self.i - 1] in ("Fn", "FnMut", "FnOnce"):
            self.need("(")
            self.many(self.type_, ")")
            if self.got("->"):
                self.type_()

    def type_path(self) -> None:
        self.path(False)

    def path(self, expr: bool) -> None:
        if self.got("<"):
            self.type_()
            if self.got("as"):
                self.path(False)
            self.need(">")
            self.need("::")
        self.got("::")
        self.segment(expr)
        while self.v == "::":
            self.i += 1
            if self.v == "<":
                self.generic_args()
                if self.v != "::":
                    return
            else:
                self.segment(expr)

    def type_(self) -> None:
        v, k = self.v, self.kind[self.i]
        if v in ("&", "&&"):
            self.i += 1
            if self.kind[self.i] == "l":
                self.i += 1
            self.got("mut")
            self.type_()
        elif v == "*":
            self.i += 1
            if not self.got("const", "mut"):
                raise Bad("pointer")
            self.type_()
        elif v == "(":
            self.i += 1
            self.many(self.type_, ")")
        elif v == "[":
            self.i += 1
            self.type_()
            if self.got(";"):
                self.expr()
            self.need("]")
        elif v == "!":
            self.i += 1
        elif v in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif v == "_":
            self.i += 1
        elif v in ("fn", "unsafe", "extern") or v == "for":
            self.for_lifetimes()
            self.got("unsafe")
            if self.got("extern") and self.kind[self.i] == "s":
                self.i += 1
            if self.v == "fn":
                self.i += 1
                self.need("(")

                def one() -> None:
                    if self.got("..."):
                        return
                    if self.kind[self.i] == "n" and self.peek() == ":":
                        self.i += 2
                    self.type_()

                self.many(one, ")")
                if self.got("->"):
                    self.type_()
            else:
                self.bounds()
        elif k == "n" or v in ("<", "::"):
            self.path(False)
            if self.v == "!":
                self.i += 1
                self.skip_group()
        else:
            raise Bad(f"type at {self.pos[self.i]}")

    # -- patterns
    def pattern(self) -> None:
        self.got("|")
        self.pattern_one()
        while self.got("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        k, v = self.kind[self.i], self.v
        if v == "_":
            self.i += 1
        elif v in ("..", "..="):
            self.i += 1
            if self.kind[self.i] in "0s" or self.v == "-":
                self.literal()
        elif k in "0s" or v == "-" or v in ("true", "false"):
            self.literal()
            self.range_end()
        elif v in ("&", "&&"):
            self.i += 1
            self.got("mut")
            self.pattern_one()
        elif v == "(":
            self.i += 1
            self.many(self.pattern, ")")
        elif v == "[":
            self.i += 1
            self.many(self.pattern, "]")
        elif v in ("ref", "mut", "box"):
            self.got("ref")
            self.got("mut")
            self.name()
            if self.got("@"):
                self.pattern_one()
        else:
            self.path(True)
            if self.v == "!":
                self.i += 1
                self.skip_group()
            elif self.got("@"):
                self.pattern_one()
            elif self.got("("):
                self.many(self.pattern, ")")
            elif self.v == "{":
                self.i += 1

                def one() -> None:
                    self.attributes()
                    if self.got(".."):
                        return
                    if (self.is_name() or self.kind[self.i] == "0") and self.peek() == ":":
                        self.i += 2
                        self.pattern()
                    else:
                        self.got("ref")
                        self.got("mut")
                        self.name()

                self.many(one, "}")
            else:
                self.range_end()

    def range_end(self) -> None:
        if self.got("..=", "...", "..") and (self.kind[self.i] in "0s" or self.v == "-" or self.is_name()):
            self.literal() if self.kind[self.i] in "0s" or self.v == "-" else self.path(True)

    def literal(self) -> None:
        self.got("-")
        if self.kind[self.i] in "0s" or self.v in ("true", "false"):
            self.i += 1
        else:
            raise Bad("literal")

    # -- statements and expressions
    lit = True

    def block(self) -> None:
        self.need("{")
        hold, self.lit = self.lit, True
        while not self.got("}"):
            self.statement()
        self.lit = hold

    def statement(self) -> None:
        if self.got(";"):
            return
        at = self.i
        self.attributes()
        if self.v == "}":
            if self.i > at and self.val[at + 1] != "!":
                raise Bad("attribute")
            return
        if self.got("let"):
            self.pattern()
            if self.got(":"):
                self.type_()
            if self.got("="):
                self.expr()
                if self.got("else"):
                    self.block()
            self.need(";")
            return
        if self.v != "#" and self.item(False):
            return
        closed = self.expr(True)
        if self.got(";") or self.v == "}":
            return
        if not closed:
            raise Bad(f"; at {self.pos[self.i]}")

    def expr(self, statement: bool = False) -> bool:
        """With ``statement``: whether it was a block-like expression that needs no semicolon."""
        start = self.i
        simple, blocky = self.unary(statement)
        if blocky and statement and self.v not in (".", "?"):
            return True
        if blocky and statement:
            self.postfix(False)
        while True:
            v = self.v
            if v == "as":
                self.i += 1
                self.type_()
            elif v in self.ASSIGN or v == ">" and self.shift_assign():
                self.i += 1
                self.expr()
                return False
            elif v == ">":
                self.greater(2)
                self.unary(False)
            elif v in self.BINARY:
                self.i += 1
                if self.v == "let":
                    self.i += 1
                    self.pattern()
                    self.need("=")
                self.unary(False)
            elif v in ("..", "..="):
                self.i += 1
                if self.starts():
                    self.unary(False)
            else:
                break
        # macro calls with braces stand alone
        return statement and self.val[self.i - 1] == "}" and self.val[start] is not None and self.peek_macro(start)

    def peek_macro(self, start: int) -> bool:
        k = start
        while self.val[k] in ("::",) or self.kind[k] == "n":
            k += 1
        return self.val[k] == "!" and self.val[k + 1] == "{"

    def shift_assign(self) -> bool:
        k = self.i
        while self.val[k] == ">" and self.pos[k + 1] == self.pos[k] + 1:
            k += 1
        if self.val[k] == "=" and k - self.i == 2:
            self.i = k
            return True
        return False

    def starts(self) -> bool:
        if self.v == "{":
            return self.lit
        return self.kind[self.i] in "0sl" or self.kind[self.i] == "n" and self.v not in ("as", "else", "in", "where") or self.v in ("(", "[", "-", "!", "*", "&", "|", "||", "<", "::")

    def unary(self, statement: bool) -> tuple[bool, bool]:
        while self.v in ("-", "!", "*", "&", "&&"):
            ref = self.v in ("&", "&&")
            self.i += 1
            if ref:
                if self.v == "raw" and self.peek() in ("const", "mut"):
                    self.i += 1
                    self.got("const")
                self.got("mut")
            statement = False
        if self.v in ("..", "..="):
            self.i += 1
            if self.starts():
                self.unary(False)
            return False, False
        blocky = self.primary()
        if blocky and statement:
            return False, True
        self.postfix(True)
        return True, False

    def postfix(self, _) -> None:
        while True:
            if self.v == "?":
                self.i += 1
            elif self.v == ".":
                self.i += 1
                if self.kind[self.i] == "0":
                    self.i += 1
                    continue
                if self.v == "await":
                    self.i += 1
                    continue
                self.name()
                if self.v == "::":
                    self.i += 1
                    self.generic_args()
            elif self.v == "(":
                self.args()
            elif self.v == "[":
                self.i += 1
                hold, self.lit = self.lit, True
                self.expr()
                self.lit = hold
                self.need("]")
            else:
                return

    def args(self) -> None:
        self.need("(")
        hold, self.lit = self.lit, True
        self.many(lambda: (self.attributes(), self.expr()), ")")
        self.lit = hold

    def condition(self) -> None:
        hold, self.lit = self.lit, False
        if self.got("let"):
            self.pattern()
            self.need("=")
        self.expr()
        self.lit = hold

    def primary(self) -> bool:
        k, v = self.kind[self.i], self.v
        if k == "l":
            self.i += 1
            self.need(":")
            if self.v not in ("loop", "while", "for", "{"):
                raise Bad("label")
            return self.primary()
        if k in "0s":
            self.i += 1
            return False
        if v == "(":
            self.args()
            return False
        if v == "[":
            self.i += 1
            hold, self.lit = self.lit, True
            if self.v != "]":
                self.expr()
                if self.got(";"):
                    self.expr()
                    self.need("]")
                    self.lit = hold
                    return False
                if self.v != "]":
                    self.need(",")
            self.many(self.expr, "]")
            self.lit = hold
            return False
        if v == "{":
            self.block()
            return True
        if v in ("unsafe", "async", "const") and (self.peek() == "{" or self.peek() == "move" and self.peek(2) == "{"):
            self.i += 1
            self.got("move")
            self.block()
            return True
        if v in ("|", "||", "move", "static") or v == "async" and self.peek() in ("|", "||", "move"):
            self.got("static")
            self.got("async")
            self.got("move")
            if not self.got("||"):
                self.need("|")

                def one() -> None:
                    self.attributes()
                    self.pattern_one()
                    if self.got(":"):
                        self.type_()

                self.many(one, "|")
            if self.got("->"):
                self.type_()
                self.block()
            else:
                self.expr()
            return False
        if v == "if":
            self.i += 1
            self.condition()
            self.block()
            if self.got("else"):
                if self.v == "if":
                    self.primary()
                else:
                    self.block()
            return True
        if v == "while":
            self.i += 1
            self.condition()
            self.block()
            return True
        if v == "loop":
            self.i += 1
            self.block()
            return True
        if v == "for":
            self.i += 1
            self.pattern()
            self.need("in")
            self.condition()
            self.block()
            return True
        if v == "match":
            self.i += 1
            self.condition()
            self.need("{")
            hold, self.lit = self.lit, True
            while not self.got("}"):
                self.attributes()
                self.pattern()
                if self.got("if"):
                    hold2, self.lit = self.lit, True
                    if self.got("let"):
                        self.pattern()
                        self.need("=")
                    self.expr()
                    self.lit = hold2
                self.need("=>")
                closed = self.v == "{" or self.v in ("if", "match", "loop", "while", "for", "unsafe")
                at = self.i
                if closed and self.primary() and self.v not in (".", "?") and self.v not in self.BINARY:
                    self.got(",")
                    continue
                self.i = at
                self.expr()
                if not self.got(",") and self.v != "}":
                    raise Bad("arm")
            self.lit = hold
            return True
        if v in ("return", "break"):
            self.i += 1
            if v == "break" and self.kind[self.i] == "l":
                self.i += 1
            if self.starts():
                self.expr()
            return False
        if v == "continue":
            self.i += 1
            if self.kind[self.i] == "l":
                self.i += 1
            return False
        if v in ("true", "false", "_"):
            self.i += 1
            return False
        self.path(True)
        if self.v == "!" and self.peek() in OPEN:
            self.i += 1
            brace = self.v == "{"
            self.skip_group()
            return brace and False
        if self.v == "{" and self.lit and (self.peek() in ("}", "..", "#") or self.kind[self.i + 1] in "n0" and self.peek(2) in (":", ",", "}")):
            self.i += 1

            def one() -> None:
                self.attributes()
                if self.got(".."):
                    if self.v != "}":
                        self.expr()
                    return
                if self.kind[self.i] == "0":
                    self.i += 1
                else:
                    self.name()
                if self.got(":"):
                    self.expr()

            self.many(one, "}")
        return False


# ---------------------------------------------------------------------------------------------------------------------
class Bash:
    """Shell grammar over characters: words with their quotes and expansions, here-documents, compound commands."""

    CLOSERS = frozenset("then elif else fi do done esac in } ;; ;;& ;& )".split())
    META = frozenset(" \t\n;&|()<>")

    def __init__(self, text: str):
        self.s = text.replace("\r\n", "\n")
        self.i = 0
        self.here: list[tuple[str, bool]] = []

    def file(self) -> None:
        self.commands(())
        if self.i < len(self.s):
            raise Bad(f"at {self.i}")

    def c(self, k: int = 0) -> str:
        return self.s[self.i + k : self.i + k + 1]

    def blanks(self) -> None:
        """Blanks, continued lines and comments, not newlines."""
        s = self.s
        while self.i < len(s):
            ch = s[self.i]
            if ch in " \t":
                self.i += 1
            elif ch == "\\" and self.c(1) == "\n":
                self.i += 2
            elif ch == "#":
                j = s.find("\n", self.i)
                self.i = len(s) if j < 0 else j
            else:
                return

    def newline(self) -> None:
        """Past a newline and the here-documents that begin there."""
        self.i += 1
        for word, strip in self.here:
            while True:
                if self.i >= len(self.s):
                    self.here = []  # a shell only warns about it
                    return
                j = self.s.find("\n", self.i)
                line = self.s[self.i : len(self.s) if j < 0 else j]
                self.i = len(self.s) if j < 0 else j + 1
                if (line.lstrip("\t") if strip else line) == word:
                    break
        self.here = []

    def gaps(self) -> None:
        while True:
            self.blanks()
            if self.c() == "\n":
                self.newline()
            else:
                return

    def look(self) -> str:
        """The plain word or mark that comes next."""
        at = self.i
        if self.c() in ("", "\n"):
            return self.c()
        for mark in (";;&", ";;", ";&"):
            if self.s.startswith(mark, at):
                return mark
        if self.c() in "();|&<>":
            return self.c()
        j = at
        while j < len(self.s) and self.s[j] not in self.META:
            if self.s[j] in "\\'\"$`":
                return "\0"
            j += 1
        return self.s[at:j]

    def need(self, word: str) -> None:
        self.gaps()
        if self.look() != word:
            raise Bad(f"{word} at {self.i}")
        self.i += len(word)

    def commands(self, ends: tuple, least: int = 0) -> None:
        """A list of commands up to one of ``ends``, which isn't taken."""
        n = 0
        while True:
            self.gaps()
            w = self.look()
            if w == "" or w in ends:
                break
            if w in self.CLOSERS and w != "in":
                raise Bad(f"{w} at {self.i}")
            self.and_or()
            n += 1
            self.blanks()
            ch = self.c()
            if ch == ";" and self.c(1) not in (";", "&"):
                self.i += 1
            elif ch == "&" and self.c(1) != "&":
                self.i += 1
            elif ch == "\n":
                self.newline()
            elif ch and self.look() not in ends:
                raise Bad(f"end of command at {self.i}")
        if n < least:
            raise Bad(f"empty list at {self.i}")
        if ends and self.look() not in ends:
            raise Bad("end of file")

    def and_or(self) -> None:
        self.pipeline()
        while True:
            self.blanks()
            if self.s.startswith(("&&", "||"), self.i):
                self.i += 2
                self.gaps()
                self.pipeline()
            else:
                return

    def pipeline(self) -> None:
        while True:
            self.blanks()
            w = self.look()
            if w == "!":
                self.i += 1
            elif w == "time":
                self.i += 4
                self.blanks()
                if self.s.startswith("-p", self.i):
                    self.i += 2
            else:
                break
        self.command()
        while True:
            self.blanks()
            if self.c() == "|" and self.c(1) != "|":
                self.i += 2 if self.c(1) == "&" else 1
                self.gaps()
                self.command()
            else:
                return

    def command(self) -> None:
        w = self.look()
        if w in self.CLOSERS and w != "in" or w in ("", "\n", ";", "&", "|"):
            raise Bad(f"{w!r} at {self.i}")
        if w == "(":
            if self.c(1) == "(" and self.arithmetic_command():
                pass
            else:
                self.i += 1
                self.commands((")",), 1)
                self.need(")")
        elif w == "{":
            self.i += 1
            if self.c() not in (" ", "\t", "\n"):
                raise Bad("{")
            self.commands(("}",), 1)
            self.need("}")
        elif w == "if":
            self.i += 2
            self.commands(("then",), 1)
            self.need("then")
            self.commands(("elif", "else", "fi"), 1)
            while self.look() == "elif":
                self.i += 4
                self.commands(("then",), 1)
                self.need("then")
                self.commands(("elif", "else", "fi"), 1)
            if self.look() == "else":
                self.i += 4
                self.commands(("fi",), 1)
            self.need("fi")
        elif w in ("while", "until"):
            self.i += 5
            self.commands(("do",), 1)
            self.body()
        elif w in ("for", "select"):
            self.i += len(w)
            self.blanks()
            if self.s.startswith("((", self.i):
                if not self.arithmetic_command():
                    raise Bad("for")
                self.blanks()
                if self.c() == ";":
                    self.i += 1
            else:
                self.identifier()
                self.gaps()
                if self.look() == "in":
                    self.i += 2
                    self.blanks()
                    while self.c() not in (";", "\n", ""):
                        self.word()
                        self.blanks()
                    if self.c() == ";":
                        self.i += 1
                elif self.c() == ";":
                    self.i += 1
            self.gaps()
            if self.look() == "{":
                self.command()
                return
            self.body()
        elif w == "case":
            self.case()
        elif w == "[[":
            self.i += 2
            self.conditional()
        elif w == "function":
            self.i += 8
            self.blanks()
            self.name()
            self.blanks()
            if self.c() == "(":
                self.i += 1
                self.blanks()
                if self.c() != ")":
                    raise Bad("function")
                self.i += 1
            self.gaps()
            self.compound()
        elif w == "coproc":
            self.i += 6
            self.blanks()
            named = re.compile(r"[A-Za-z_]\w*(?=[ \t]+[{(])").match(self.s, self.i)
            if named and named[0] not in ("if", "while", "until", "for", "case", "select", "function"):
                self.i = named.end()
                self.blanks()
            self.command()
            return
        else:
            self.simple()
            return
        self.redirects()

    def compound(self) -> None:
        if self.look() not in ("{", "(", "if", "while", "until", "for", "case", "[[", "select"):
            raise Bad("function body")
        self.command()

    def body(self) -> None:
        self.need("do")
        self.commands(("done",), 1)
        self.need("done")

    def identifier(self) -> None:
        m = re.compile(r"[A-Za-z_]\w*").match(self.s, self.i)
        if not m:
            raise Bad("name")
        self.i = m.end()

    def name(self) -> None:
        m = re.compile(r"[^\s;&|()<>$`\"'\\]+").match(self.s, self.i)
        if not m:
            raise Bad("name")
        self.i = m.end()

    def case(self) -> None:
        self.i += 4
        self.blanks()
        self.word()
        self.gaps()
        self.need("in")
        while True:
            self.gaps()
            if self.look() == "esac":
                break
            if self.c() == "(":
                self.i += 1
                self.blanks()
            while True:
                self.word(True)
                self.blanks()
                if self.c() == "|":
                    self.i += 1
                    self.blanks()
                else:
                    break
            if self.c() != ")":
                raise Bad(f"pattern at {self.i}")
            self.i += 1
            self.commands((";;&", ";;", ";&", "esac"))
            if self.s.startswith(";;&", self.i):
                self.i += 3
            elif self.s.startswith((";;", ";&"), self.i):
                self.i += 2
            else:
                break
        self.need("esac")

    def arithmetic_command(self) -> bool:
        """((...)), or False and nothing taken if it isn't one."""
        at = self.i
        self.i += 2
        try:
            self.arithmetic()
            return True
        except Bad:
            self.i = at
            return False

    def arithmetic(self) -> None:
        """Up to and including the closing ))."""
        depth = 0
        while True:
            ch = self.c()
            if ch == "":
                raise Bad("arithmetic")
            if ch == "(":
                depth += 1
                self.i += 1
            elif ch == ")":
                if depth:
                    depth -= 1
                    self.i += 1
                elif self.c(1) == ")":
                    self.i += 2
                    return
                else:
                    raise Bad("arithmetic")
            elif ch in "$`\"'\\":
                self.part()
            else:
                self.i += 1

    def conditional(self) -> None:
        """The inside of [[ ... ]]: balanced operators and words."""
        depth, expect = 0, True  # expect: an operand has to come
        pattern = False
        while True:
            self.gaps()
            if self.c() == "":
                raise Bad("[[")
            if self.look() == "]]" and not expect:
                if depth:
                    raise Bad("]]")
                self.i += 2
                return
            if self.s.startswith(("&&", "||"), self.i):
                if expect:
                    raise Bad("&&")
                self.i += 2
                expect = True
            elif self.c() == "(" and expect:
                depth += 1
                self.i += 1
            elif self.c() == ")":
                depth -= 1
                if depth < 0 or expect:
                    raise Bad(")")
                self.i += 1
            elif self.c() in "<>":
                if expect:
                    raise Bad("<")
                self.i += 1
                expect = True
            elif self.look() == "!" and expect:
                self.i += 1
            else:
                w = self.look()
                if expect and re.fullmatch(r"-[a-zA-Z]", w) or not expect and (w in ("=", "==", "!=", "=~") or re.fullmatch(r"-[a-z]{2}", w)):
                    pattern = w == "=~"
                    self.i += len(w)
                    expect = True
                elif not expect:
                    raise Bad(f"[[ at {self.i}")
                else:
                    self.word(pattern, pattern)
                    pattern = expect = False

    def redirects(self) -> None:
        while True:
            self.blanks()
            if not self.redirect():
                return

    def redirect(self) -> bool:
        m = re.compile(r"(?:\d+|\{[A-Za-z_]\w*\})?(<<<|<<-|<<|<>|<&|>&|>>|>\||&>>|&>|<(?!\()|>(?!\())").match(self.s, self.i)
        if not m:
            return False
        self.i = m.end()
        self.blanks()
        at = self.i
        if self.c() in ("", "\n", ";", "|", "&") or self.c() in "()":
            raise Bad("redirection")
        self.word()
        if m[1] in ("<<", "<<-"):
            self.here.append((re.sub(r"\\(.)|['\"]", lambda x: x[1] or "", self.s[at : self.i]), m[1] == "<<-"))
        return True

    def simple(self) -> None:
        n, assigning = 0, True
        while True:
            self.blanks()
            ch = self.c()
            if ch in ("", "\n", ";", "|", ")") or ch == "&" and not self.s.startswith("&>", self.i):
                break
            if self.redirect():
                n += 1
                continue
            if ch == "(":
                # name() { ... }
                if n == 1:
                    self.i += 1
                    self.blanks()
                    if self.c() == ")":
                        self.i += 1
                        self.gaps()
                        self.compound()
                        return
                raise Bad(f"( at {self.i}")
            m = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=\(").match(self.s, self.i)
            if m and (assigning or n):
                self.i = m.end()
                while True:
                    self.gaps()
                    if self.c() == ")":
                        self.i += 1
                        break
                    if self.c() == "" or self.c() in ";&|<>(":
                        raise Bad("array")
                    self.word()
                n += 1
                continue
            self.word()
            n += 1
            assigning = False
        if not n:
            raise Bad(f"command at {self.i}")

    def word(self, pattern: bool = False, regex: bool = False) -> None:
        at, s = self.i, self.s
        while self.i < len(s):
            ch = s[self.i]
            if ch in "\\'\"$`":
                self.part()
            elif ch in "<>" and self.c(1) == "(":
                self.i += 2
                self.commands((")",))
                self.need(")")
            elif ch in "?*+@!" and self.c(1) == "(" and (pattern or True) and self.i >= at and ch != "!":
                self.extglob()
            elif regex and ch in "(|)" and not (ch == ")" and self.i == at):
                self.i += 1
            elif ch in self.META:
                break
            else:
                self.i += 1
        if self.i == at:
            raise Bad(f"word at {self.i}")

    def extglob(self) -> None:
        self.i += 2
        while self.c() != ")":
            if self.c() in ("", "\n"):
                raise Bad("pattern")
            if self.c() in "\\'\"$`":
                self.part()
            elif self.c() in "?*+@!" and self.c(1) == "(":
                self.extglob()
            else:
                self.i += 1
        self.i += 1

    def part(self) -> None:
        """A quote or expansion."""
        s, ch = self.s, self.c()
        if ch == "\\":
            self.i += 2
        elif ch == "'":
            j = s.find("'", self.i + 1)
            if j < 0:
                raise Bad("'")
            self.i = j + 1
        elif ch == '"':
            self.i += 1
            while self.c() != '"':
                if self.c() == "":
                    raise Bad('"')
                if self.c() in "\\$`":
                    self.part()
                else:
                    self.i += 1
            self.i += 1
        elif ch == "`":
            j = self.i + 1
            while s[j : j + 1] != "`":
                if j >= len(s):
                    raise Bad("`")
                j += 2 if s[j] == "\\" else 1
            Bash(re.sub(r"\\([`$\\])", r"\1", s[self.i + 1 : j])).file()
            self.i = j + 1
        else:  # $
            if s.startswith("$((", self.i):
                at = self.i
                self.i += 3
                try:
                    self.arithmetic()
                    return
                except Bad:
                    self.i = at
            if s.startswith("$(", self.i):
                self.i += 2
                here, self.here = self.here, []
                self.commands((")",))
                self.need(")")
                self.here = here
            elif s.startswith("${", self.i):
                self.i += 2
                if not re.compile(r"[!#]?(?:[A-Za-z_]\w*|\d+|[@*#?$!-])|#\}").match(s, self.i):
                    raise Bad("${")
                while self.c() != "}":
                    if self.c() == "":
                        raise Bad("${")
                    if self.c() in "\\\"$`'":
                        self.part()
                    else:
                        self.i += 1
                self.i += 1
            elif s.startswith("$'", self.i):
                j = self.i + 2
                while s[j : j + 1] != "'":
                    if j >= len(s):
                        raise Bad("$'")
                    j += 2 if s[j] == "\\" else 1
                self.i = j + 1
            else:
                self.i += 1


# ---------------------------------------------------------------------------------------------------------------------
class Undecided(Exception):
    """The checker could not read the text to its end."""


def _python(text: str) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError) as e:
        raise Bad(str(e)) from None
    except MemoryError as e:
        raise Undecided(str(e)) from None


def _own(kind):
    def run(text: str) -> None:
        kind(text.lstrip("﻿")).file()

    return run


#: Calls that may be open at once; a bracket takes about ten.
DEPTH = 200_000
GRAMMARS = {
    "python": _python,
    "typescript": _own(TypeScript),
    "javascript": _own(JavaScript),
    "go": _own(Go),
    "rust": _own(Rust),
    "java": _own(Java),
    "c": _own(C),
    "bash": _own(Bash),
}


def parses(language: str, text: str) -> bool | None:
    """Whether ``text`` is a valid source file of ``language``; empty text is.

    None if that can't be told: nested more deeply than the checker can follow, or a fault of its own.
    """
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    try:
        GRAMMARS[language](text)
        return True
    except Bad:
        return False
    except (Undecided, RecursionError, IndexError, KeyError, TypeError, AttributeError):
        return None
