"""Go."""

from __future__ import annotations

import re

from .base import Parser

_TOKEN = re.compile(
    r"(?P<sp>[ \t\r]+)|(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*.*?\*/)"
    r"|(?P<num>0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?)"
    r"|(?P<name>\w+)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`|'(?:[^'\\\n]|\\[abfnrtv\\']|\\[0-7]{3}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})')"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])",
    re.S,
)
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
_TYPE_STARTS = frozenset("[ map chan * func interface struct <-".split())
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class Go(Parser):
    STARTS = frozenset("func var const type import if for switch select return go defer".split())
    BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}

    def lex(self) -> None:
        put_kind, put_text, put_fresh, put_place = self.kinds.append, self.texts.append, self.fresh.append, self.places.append
        match = _TOKEN.match
        src, n, at, fresh = self.source, len(self.source), 0, True
        if src.startswith("﻿"):
            at = 1

        def line_ends(place: int) -> None:
            if self.kinds and (self.kinds[-1] in ("0", '"') or (self.kinds[-1] == "n" and self.texts[-1] not in _KEYWORDS) or self.texts[-1] in _ENDS):
                self.add("p", ";", place, False)

        while at < n:
            if src[at] in " \t":
                at += 1
                continue
            m = match(src, at)
            if m is None:
                ch = src[at]
                self.error(at, "comment or text without an end" if src.startswith("/*", at) or ch in "`\"'" else f"unexpected {ch!r}")
                if src.startswith("/*", at) or ch == "`":
                    return
                at += 1
                if ch in "\"'":
                    while at < n and src[at] != "\n":
                        at += 1
                continue
            g = m.lastgroup
            if g == "nl" or (g == "bc" and "\n" in m.group()):
                line_ends(at)
                fresh = True
            elif g == "op":
                put_kind("p"), put_text(m.group()), put_place(at), put_fresh(fresh)
                fresh = False
            elif g == "name":
                put_kind("n"), put_text(m.group()), put_place(at), put_fresh(fresh)
                fresh = False
            elif g == "num":
                put_kind("0"), put_text("0"), put_place(at), put_fresh(fresh)
                fresh = False
                e = m.end()
                if e < n and (src[e].isalnum() or src[e] == "_"):
                    self.error(at, "number runs into a name")
            elif g == "str":
                self.add('"', '"', at, fresh)
                fresh = False
            at = m.end()
        line_ends(n)

    def end(self) -> None:
        if not self.eat(";") and self.t not in (")", "}") and self.kinds[self.i]:
            self.fail()

    def name(self) -> None:
        if not self.is_name(_KEYWORDS):
            self.fail("expected a name")
        self.i += 1

    def program(self) -> None:
        self.level = 0

        def package() -> None:
            self.need("package")
            self.name()
            self.end()

        self.guarded(package)
        self.late = False
        while self.kinds[self.i]:
            if self.t in ("}", ";"):
                if self.t == "}":
                    self.error(self.places[self.i], "unexpected '}'")
                self.i += 1
                continue
            self.level = 0
            self.guarded(self.top)

    def top(self) -> None:
        t = self.t
        if t == "import":
            if self.late:
                self.fail("import after other declarations")
            self.i += 1
            self.group(self.import_spec)
        elif t == "func":
            self.late = True
            self.function()
        elif t in ("var", "const", "type"):
            self.late = True
            self.declaration()
        else:
            self.fail()
        self.end()

    def group(self, spec) -> None:
        if self.eat("("):
            while not self.eat(")"):
                if not self.kinds[self.i]:
                    self.fail("end of file, expected ')'")
                spec()
                self.end()
        else:
            spec()

    def import_spec(self) -> None:
        if self.t == ".":
            self.i += 1
        elif self.is_name(_KEYWORDS):
            self.i += 1
        if self.kinds[self.i] != '"':
            self.fail("expected a text")
        self.i += 1

    def declaration(self) -> None:
        t = self.take()
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[t])

    def var_spec(self) -> None:
        self.name()
        while self.eat(","):
            self.name()
        if self.t != "=":
            self.type()
        if self.eat("="):
            self.expressions()

    def const_spec(self) -> None:
        self.name()
        while self.eat(","):
            self.name()
        if self.t not in ("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.t == "[":
            self.attempt(self.type_parameters)
        self.eat("=")
        self.type()

    def type_parameters(self) -> bool:
        self.need("[")
        while not self.eat("]"):
            self.name()
            while self.eat(","):
                self.name()
            self.constraint()
            if not self.eat(","):
                self.need("]")
                break
        return True

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def function(self) -> None:
        self.need("func")
        if self.t == "(":
            self.parameters()
        self.name()
        if self.t == "[":
            self.type_parameters()
        self.signature()
        if self.t == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.t == "(":
            self.parameters()
        elif self.t not in ("{", ";", ")", "]", "}", ",", "=", ":=", ":", "", ".") and self.kinds[self.i] != '"':
            self.type()

    def parameters(self) -> None:
        self.need("(")
        named, bare = False, 0
        while not self.eat(")"):
            began = self.i
            self.eat("...")
            self.type()
            if self.t not in (",", ")"):
                self.eat("...")
                self.type()
                if not named and bare > 1:
                    self.fail("parameters with and without names")
                named, bare = True, 0
            else:
                # Names that share the type which follows, or a type alone (2).
                bare = max(bare, 1 if self.i == began + 1 and self.kinds[began] == "n" else 2)
                if named and bare > 1:
                    self.fail("parameters with and without names")
            if not self.eat(","):
                self.need(")")
                break
        if named and bare:
            self.fail("parameters with and without names")

    def type(self) -> None:
        t, k = self.t, self.kinds[self.i]
        if k == "n" and t not in _KEYWORDS:
            self.i += 1
            if self.eat("."):
                self.name()
            if self.t == "[" and self.ahead() != "]":
                self.attempt(self.type_list)
            return
        if t == "*":
            self.i += 1
            self.type()
        elif t == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif t == "[":
            self.i += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    self.level += 1
                    self.expression()
                    self.level -= 1
                self.need("]")
            self.type()
        elif t == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif t == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif t == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t == "struct":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                if self.kinds[self.i] == '"':
                    self.i += 1
                self.end()
        elif t == "interface":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if self.is_name(_KEYWORDS) and self.ahead() == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            self.fail("expected a type")

    def type_list(self) -> bool:
        self.need("[")
        self.type()
        while self.eat(","):
            self.type()
        self.need("]")
        return True

    def field(self) -> None:
        if self.t == "*" or (self.kinds[self.i] == "n" and (self.ahead() in (";", "}", ".") or self.kinds[self.i + 1] == '"')):
            return self.type()
        self.name()
        while self.eat(","):
            self.name()
        self.type()

    def block(self) -> None:
        self.need("{")
        was, self.level = self.level, 0
        while self.t != "}":
            if not self.kinds[self.i]:
                self.fail("end of file, expected '}'")
            self.guarded(self.line)
        self.i += 1
        self.level = was

    def line(self) -> None:
        if self.eat(";"):
            return
        self.statement()
        self.end()

    def statement(self) -> None:
        t = self.t
        f = self.STATEMENTS.get(t) if self.kinds[self.i] in ("n", "p") else None
        if f is not None:
            return f(self)
        if self.is_name(_KEYWORDS) and self.ahead() == ":":
            self.i += 2
            if self.t not in ("}", ";"):
                self.statement()
            return
        self.simple()

    def simple(self) -> str:
        """A simple statement; says "range" after a range clause."""
        if self.t == "range":
            self.i += 1
            self.expression()
            return "range"
        kinds = [self.expression()]
        while self.eat(","):
            kinds.append(self.expression())
        t = self.t
        if t in _ASSIGN and self.kinds[self.i] == "p":
            if t == ":=" and any(k != "name" for k in kinds):
                self.fail("only names can be declared")
            if t not in ("=", ":=") and len(kinds) > 1:
                self.fail()
            self.i += 1
            if self.t == "range" and t in ("=", ":="):
                self.i += 1
                self.expression()
                return "range"
            self.expressions()
            return "assign"
        if len(kinds) > 1:
            self.fail()
        if t in ("++", "--"):
            self.i += 1
        elif t == "<-":
            self.i += 1
            self.expression()
        return "expr"

    def header(self, f) -> None:
        was, self.level = self.level, -1
        f()
        self.level = was

    def if_(self) -> None:
        self.i += 1

        def head() -> None:
            if self.t == "{":
                self.fail("expected a condition")
            if self.t != ";":
                self.simple()
            if self.eat(";"):
                self.expression()

        self.header(head)
        self.block()
        if self.eat("else"):
            if self.t == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.i += 1

        def head() -> None:
            if self.t == "{":
                return
            if self.t != ";" and self.simple() == "range":
                return
            if self.eat(";"):
                if self.t != ";":
                    self.expression()
                self.need(";")
                if self.t != "{":
                    self.simple()

        self.header(head)
        self.block()

    def switch(self) -> None:
        self.i += 1

        def head() -> None:
            if self.t == "{":
                return
            if self.t != ";":
                self.simple()
            if self.eat(";") and self.t != "{":
                self.simple()

        self.header(head)
        self.cases(self.types_or_values)

    def types_or_values(self) -> None:
        while True:
            self.either(self.expression, (",", ":"), self.type, _TYPE_STARTS)
            if not self.eat(","):
                return

    def cases(self, what) -> None:
        self.need("{")
        was, self.level = self.level, 0
        while not self.eat("}"):
            if self.eat("case"):
                what()
            else:
                self.need("default")
            self.need(":")
            while self.t not in ("case", "default", "}"):
                if not self.kinds[self.i]:
                    self.fail("end of file, expected '}'")
                self.guarded(self.line)
        self.level = was

    def select(self) -> None:
        self.i += 1
        self.cases(self.simple)

    def return_(self) -> None:
        self.i += 1
        if self.t not in (";", "}"):
            self.expressions()

    def call(self) -> None:
        self.i += 1
        if self.expression() != "call":
            self.fail("expected a call")

    def jump(self) -> None:
        t = self.take()
        if t != "fallthrough" and self.is_name(_KEYWORDS):
            self.i += 1

    STATEMENTS = {"if": if_, "for": for_, "switch": switch, "select": select, "return": return_, "go": call, "defer": call, "break": jump, "continue": jump, "goto": jump, "fallthrough": jump, "var": declaration, "const": declaration, "type": declaration, "{": block}

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self) -> str:
        return self.binary(1, self.unary)

    def unary(self) -> str:
        if self.kinds[self.i] == "p" and self.t in ("+", "-", "!", "^", "*", "&", "<-"):
            self.i += 1
            self.unary()
            return "value"
        return self.postfix()

    def postfix(self) -> str:
        t, k = self.t, self.kinds[self.i]
        literal = False
        if k in ("0", '"'):
            self.i += 1
            node = "value"
        elif k == "n" and t not in _KEYWORDS:
            self.i += 1
            node, literal = "name", True
        elif t == "(":
            self.i += 1
            was, self.level = self.level, 1
            self.either(self.expression, (")",), self.type, _TYPE_STARTS)
            self.level = was
            self.need(")")
            node = "value"
        elif t == "func":
            self.i += 1
            self.signature()
            node = "type"
            if self.t == "{":
                self.block()
                node = "value"
        elif t in ("[", "map", "struct", "chan", "interface", "*"):
            self.type()
            node, literal = "type", True
            if self.t == "{":
                self.composite()
                node, literal = "value", False
        else:
            self.fail()
        while True:
            t = self.t
            if t == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    node, literal = "value", False
                else:
                    self.name()
                    node = "value"
            elif t == "[":
                self.index()
                node = "value"
            elif t == "(":
                self.arguments()
                node, literal = "call", False
            elif t == "{" and literal and self.level >= 0:
                self.composite()
                node, literal = "value", False
            else:
                return node

    def index(self) -> None:
        self.need("[")
        was, self.level = self.level, 1
        if self.t != ":":
            self.either(self.expression, (":", "]", ","), self.type, _TYPE_STARTS)
            while self.eat(","):
                if self.t != "]":
                    self.type()
        for _ in range(2):
            if self.eat(":") and self.t not in (":", "]"):
                self.expression()
        self.level = was
        self.need("]")

    def arguments(self) -> None:
        self.need("(")
        was, self.level = self.level, 1
        while not self.eat(")"):
            self.either(self.expression, (",", ")", "..."), self.type, _TYPE_STARTS)
            self.eat("...")
            if not self.eat(","):
                self.need(")")
                break
        self.level = was

    def composite(self) -> None:
        self.need("{")
        was, self.level = self.level, 1
        while not self.eat("}"):
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                self.need("}")
                break
        self.level = was

    def element(self) -> None:
        if self.t == "{":
            self.composite()
        else:
            self.expression()
