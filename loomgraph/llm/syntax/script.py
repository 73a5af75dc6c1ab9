"""JavaScript (script or module) and TypeScript."""

from __future__ import annotations

import re

from .base import Fault, Parser

_TOKEN = re.compile(
    r"(?P<sp>[ \t\v\f ﻿]+)|(?P<nl>[\r\n  ]+)|(?P<lc>//[^\r\n  ]*)|(?P<bc>/\*.*?\*/)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?)"
    r"|(?P<name>[\w$\\‌‍]+)"
    r"|(?P<str>'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\")"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>>|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#])",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_FLAGS = frozenset("dgimsuvy")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_VALUE_WORDS = frozenset("this super null true false".split())
_NO_LET = _RESERVED
_MODIFIERS = frozenset("public private protected static abstract readonly override declare accessor async get set".split())
_KEYWORD_BEFORE_REGEX = frozenset("return typeof case do else in instanceof new delete void throw of await yield extends default".split())


class Script(Parser):
    STARTS = frozenset("var let const function class if for while do return switch try throw import export interface type enum break continue".split())
    BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "in": 8, "instanceof": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
    ts = False
    #: Whether the last closing parenthesis ended the head of a statement.
    head_ends = False

    # lexing
    def lex(self) -> None:
        put_kind, put_text, put_fresh, put_place = self.kinds.append, self.texts.append, self.fresh.append, self.places.append
        match = _TOKEN.match
        src, n, at, fresh = self.source, len(self.source), 0, True
        if src.startswith("#!"):
            at = src.find("\n") if "\n" in src else n
        html = not self.ts and ("<!--" in src or "-->" in src)
        braces: list[str] = []
        heads: list[bool] = []
        while at < n:
            ch = src[at]
            if ch == " ":
                at += 1
                continue
            if html and (src.startswith("<!--", at) or (fresh and src.startswith("-->", at))):
                # Comments as scripts in pages write them.
                at = src.find("\n", at) if "\n" in src[at:] else n
                continue
            if ch == "/" and src[at : at + 2] not in ("//", "/*") and self._regex_may_begin():
                m = _REGEX.match(src, at)
                if m:
                    flags = src[src.rfind("/", at, m.end()) + 1 : m.end()]
                    if len(set(flags)) < len(flags) or not set(flags) <= _FLAGS:
                        self.error(at, "flags of a regular expression")
                    put_kind("r"), put_text("/r/"), put_place(at), put_fresh(fresh)
                    at, fresh = m.end(), False
                    continue
            if ch == "`" or (ch == "}" and braces and braces[-1] == "`"):
                head = ch == "`"
                if not head:
                    braces.pop()
                m = _TEMPLATE.match(src, at + 1)
                end = m.end()
                if end >= n:
                    self.error(at, "template without an end")
                    return
                if src[end] == "`":
                    put_kind("`"), put_text("`" if head else "}`"), put_place(at), put_fresh(fresh)
                    at = end + 1
                else:
                    put_kind("`"), put_text("`{" if head else "}{"), put_place(at), put_fresh(fresh)
                    braces.append("`")
                    at = end + 2
                fresh = False
                continue
            m = match(src, at)
            if m is None:
                self.error(at, "comment or text without an end" if src.startswith("/*", at) or ch in "'\"" else f"unexpected {ch!r}")
                if src.startswith("/*", at):
                    return
                at += 1
                if ch in "'\"":
                    while at < n and src[at] not in "\r\n":
                        at += 1
                continue
            g = m.lastgroup
            if g == "op":
                t = m.group()
                if t == "{":
                    braces.append("{")
                elif t == "}" and braces:
                    braces.pop()
                elif t == "(":
                    heads.append(bool(self.texts) and self.texts[-1] in ("if", "while", "for", "with"))
                elif t == ")":
                    self.head_ends = bool(heads) and heads.pop()
                put_kind("p"), put_text(t), put_place(at), put_fresh(fresh)
                fresh = False
            elif g == "name":
                put_kind("n"), put_text(m.group()), put_place(at), put_fresh(fresh)
                fresh = False
            elif g == "num":
                put_kind("0"), put_text("0"), put_place(at), put_fresh(fresh)
                fresh = False
                e = m.end()
                if e < n and (src[e].isalnum() or src[e] in "_$"):
                    self.error(at, "number runs into a name")
            elif g == "str":
                self.add('"', '"', at, fresh)
                fresh = False
            elif g == "nl" or (g == "bc" and "\n" in m.group()):
                fresh = True
            at = m.end()

    def _regex_may_begin(self) -> bool:
        if not self.kinds:
            return True
        k, t = self.kinds[-1], self.texts[-1]
        if k == "n":
            return t in _KEYWORD_BEFORE_REGEX
        if k == "p":
            return self.head_ends if t == ")" else t not in ("]", "++", "--")
        return t in ("`{", "}{")

    # statements
    def program(self) -> None:
        self.in_function = self.in_loop = self.in_switch = 0
        self.no_in = False
        self.cover = None
        while self.kinds[self.i]:
            if self.t == "}":
                self.error(self.places[self.i], "unexpected '}'")
                self.i += 1
                continue
            self.guarded(self.module_item)

    def guarded(self, f) -> None:
        """One statement; a default value in an object that turned out to be no pattern is an error, too."""
        was, self.cover = self.cover, None
        began = self.i
        try:
            f()
        except Fault as x:
            self.error(x.at, x.why)
            self.recover(began)
        else:
            if self.cover is not None:
                self.error(self.cover, "default value outside of a pattern")
        self.cover = was

    def module_item(self) -> None:
        t = self.t
        if t == "import" and self.ahead() not in ("(", "."):
            self.import_()
        elif t == "export":
            self.export()
        else:
            self.statement(True)

    def end(self) -> None:
        if self.eat(";") or self.t == "}" or not self.kinds[self.i] or self.fresh[self.i]:
            return
        self.fail()

    def binding_name(self) -> None:
        if not self.is_name(_RESERVED):
            self.fail("expected a name")
        self.i += 1

    def string(self) -> None:
        if self.kinds[self.i] != '"':
            self.fail("expected a text")
        self.i += 1

    def import_(self) -> None:
        self.i += 1
        if self.kinds[self.i] == '"':
            self.i += 1
        else:
            if self.ts and self.t == "type" and self.ahead() not in (",", "from") or self.ts and self.t == "type" and self.ahead() == "from" and self.ahead(2) == "from":
                self.i += 1
            if self.is_name(_RESERVED):
                self.i += 1
                if self.ts and self.eat("="):
                    self.expression()
                    return self.end()
                if self.eat(",") and self.t not in ("{", "*"):
                    self.fail()
            if self.eat("*"):
                self.need("as")
                self.binding_name()
            elif self.t == "{":
                self.names()
            self.need("from")
            self.string()
        if self.t in ("with", "assert") and not self.fresh[self.i] and self.ahead() == "{":
            self.i += 1
            self.balanced()
        self.end()

    def names(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.ts and self.t == "type" and self.ahead() not in (",", "}", "as"):
                self.i += 1
            if self.kinds[self.i] not in ("n", '"'):
                self.fail()
            self.i += 1
            if self.eat("as"):
                if self.kinds[self.i] not in ("n", '"'):
                    self.fail()
                self.i += 1
            if not self.eat(","):
                self.need("}")
                return

    def export(self) -> None:
        self.i += 1
        if self.eat("*"):
            if self.eat("as"):
                self.take()
            self.need("from")
            self.string()
            return self.end()
        if self.ts and self.t == "=":
            self.i += 1
            self.expression()
            return self.end()
        if self.ts and self.t == "type" and self.ahead() in ("{", "*"):
            self.i += 1
            return self.export_names() if self.t == "{" else self.export_star()
        if self.t == "{":
            return self.export_names()
        if self.eat("default"):
            if self.t == "function" or (self.t == "async" and self.ahead() == "function"):
                return self.function(True)
            if self.t in ("class", "@") or (self.ts and self.t == "abstract" and self.ahead() == "class"):
                return self.class_(True)
            if self.ts and self.t == "interface":
                return self.interface()
            self.assignment()
            return self.end()
        if self.t in ("var", "let", "const", "function", "class", "async", "@") or (self.ts and self.t in ("interface", "type", "enum", "namespace", "module", "declare", "abstract", "import")):
            return self.import_() if self.t == "import" else self.statement(True)
        self.fail()

    def export_star(self) -> None:
        self.need("*")
        if self.eat("as"):
            self.take()
        self.need("from")
        self.string()
        self.end()

    def export_names(self) -> None:
        self.names()
        if self.eat("from"):
            self.string()
        self.end()

    def block(self) -> None:
        self.need("{")
        while self.t != "}":
            if not self.kinds[self.i]:
                self.fail("end of file, expected '}'")
            self.guarded(lambda: self.statement(True))
        self.i += 1

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def loop_body(self) -> None:
        self.in_loop += 1
        try:
            self.statement(False)
        finally:
            self.in_loop -= 1

    def statement(self, declaration: bool) -> None:
        t, k = self.t, self.kinds[self.i]
        if k == "p":
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return
            if t == "@":
                return self.class_(False)
        elif k == "n":
            f = self.STATEMENTS.get(t)
            if f is not None:
                return f(self)
            n = self.ahead()
            if t == "let" and (self.kinds[self.i + 1] == "n" and n not in ("in", "instanceof", "of") or n in ("[", "{")):
                return self.declaration()
            if t == "async" and n == "function" and not self.fresh[self.i + 1]:
                return self.function(False)
            if t == "import" and n not in ("(", "."):
                self.fail("import within a block")
            if t == "export":
                self.fail("export within a block")
            if self.ts and self.ts_statement(t, n):
                return
            if n == ":" and t not in _RESERVED:
                self.i += 2
                return self.statement(False)
        self.expression()
        self.end()

    def ts_statement(self, t: str, n: str) -> bool:
        same = not self.fresh[self.i + 1]
        name = self.kinds[self.i + 1] == "n"
        if t == "interface" and name and same:
            self.interface()
        elif t == "type" and name and same:
            self.i += 1
            self.binding_name()
            self.type_parameters()
            self.need("=")
            self.type()
            self.end()
        elif t == "enum" and name:
            self.enum()
        elif t in ("namespace", "module") and same and (name or self.kinds[self.i + 1] == '"') or (t == "global" and n == "{"):
            self.i += 1
            if t != "global":
                self.take()
            while self.eat("."):
                self.take()
            if self.t == "{":
                self.need("{")
                while not self.eat("}"):
                    if not self.kinds[self.i]:
                        self.fail()
                    self.guarded(self.module_item)
            else:
                self.end()
        elif t == "declare" and name and same:
            self.i += 1
            self.statement(True)
        elif t == "abstract" and n == "class":
            self.class_(False)
        else:
            return False
        return True

    def enum(self) -> None:
        self.i += 1
        self.binding_name()
        self.need("{")
        while not self.eat("}"):
            if self.t == "[":
                self.balanced()
            elif self.kinds[self.i] in ("n", '"'):
                self.i += 1
            else:
                self.fail()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                self.need("}")
                return

    def interface(self) -> None:
        self.i += 1
        self.binding_name()
        self.type_parameters()
        if self.eat("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.object_type()

    def declaration(self) -> None:
        word = self.take()
        const = word == "const"
        if word != "var" and self.t == "let":
            self.fail("let is no name here")
        if const and self.ts and self.t == "enum":
            return self.enum()
        self.declarators(const, False)
        self.end()

    def declarators(self, const: bool, in_for: bool) -> None:
        while True:
            pattern = self.t in ("[", "{")
            self.pattern()
            if self.ts:
                self.eat("!")
                self.annotation()
            if self.eat("="):
                self.assignment()
            elif (const or pattern) and not (in_for and self.t in ("of", "in")) and not (self.ts and const and not pattern):
                self.fail("expected '='")
            if not self.eat(","):
                return

    def annotation(self) -> None:
        if self.ts and self.eat(":"):
            self.type()

    def pattern(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                if self.eat("..."):
                    self.pattern()
                else:
                    self.pattern()
                    if self.eat("="):
                        self.assignment()
                if not self.eat(","):
                    self.need("]")
                    return
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.pattern()
                else:
                    plain = self.is_name(_RESERVED)
                    self.property_name()
                    if self.eat(":"):
                        self.pattern()
                    elif not plain:
                        self.fail()
                    if self.eat("="):
                        self.assignment()
                if not self.eat(","):
                    self.need("}")
                    return
        else:
            self.binding_name()

    def property_name(self) -> None:
        if self.eat("["):
            self.assignment()
            self.need("]")
        elif self.kinds[self.i] in ("n", '"', "0"):
            self.i += 1
        elif self.t == "#" and self.kinds[self.i + 1] == "n":
            self.i += 2
        else:
            self.fail()

    def function(self, optional_name: bool) -> None:
        self.eat("async")
        self.need("function")
        self.eat("*")
        if self.is_name(_RESERVED):
            self.i += 1
        elif not optional_name:
            self.fail("expected a name")
        self.signature()
        if self.ts and self.t != "{":
            return self.end()
        self.body()

    def signature(self) -> None:
        if self.ts:
            self.type_parameters()
        self.parameters()
        if self.ts and self.eat(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            while self.t == "@":
                self.decorator()
            if self.ts:
                while self.t in _MODIFIERS and self.kinds[self.i + 1] == "n":
                    self.i += 1
            rest = self.eat("...")
            if self.ts and self.t == "this":
                self.i += 1
            else:
                self.pattern()
            if self.ts:
                self.eat("?")
                self.annotation()
            if not rest and self.eat("="):
                self.assignment()
            if rest or not self.eat(","):
                self.need(")")
                return

    def body(self) -> None:
        was = self.in_loop, self.in_switch, self.no_in
        self.in_loop = self.in_switch = 0
        self.no_in = False
        self.in_function += 1
        try:
            self.block()
        finally:
            self.in_function -= 1
            self.in_loop, self.in_switch, self.no_in = was

    def decorator(self) -> None:
        self.need("@")
        if self.t == "(":
            self.paren()
        else:
            self.take()
            while self.eat("."):
                self.take()
        if self.t == "(":
            self.arguments()

    def class_(self, optional_name: bool) -> None:
        while self.t == "@":
            self.decorator()
        if self.t == "export":
            self.i += 1
            self.eat("default")
        if self.ts:
            self.eat("abstract")
        self.need("class")
        if self.t not in ("extends", "implements", "{", "<"):
            self.binding_name()
        elif not optional_name:
            self.fail("expected a name")
        if self.ts:
            self.type_parameters()
        if self.eat("extends"):
            self.postfix()
            if self.ts and self.t == "<":
                self.type_arguments()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.eat("}"):
            if not self.kinds[self.i]:
                self.fail("end of file, expected '}'")
            if self.eat(";"):
                continue
            self.guarded(self.member)

    def member(self) -> None:
        while self.t == "@":
            self.decorator()
        if self.t == "static" and self.ahead() == "{":
            self.i += 1
            return self.body()
        words = _MODIFIERS if self.ts else frozenset(("static", "async", "get", "set", "accessor"))
        while self.t in words and (self.kinds[self.i + 1] in ("n", '"', "0") or self.ahead() in ("[", "#", "*")):
            if self.fresh[self.i + 1] and self.t not in ("static", "public", "private", "protected"):
                break
            self.i += 1
        self.eat("*")
        if self.ts and self.t == "[" and self.kinds[self.i + 1] == "n" and self.ahead(2) == ":":
            self.balanced()
            self.annotation()
            return self.end()
        self.property_name()
        if self.ts:
            if not self.eat("?"):
                self.eat("!")
        if self.t in ("(", "<"):
            self.signature()
            if self.ts and self.t != "{":
                return self.end()
            return self.body()
        self.annotation()
        if self.eat("="):
            self.in_function += 1
            try:
                self.assignment()
            finally:
                self.in_function -= 1
        self.end()

    def if_(self) -> None:
        self.i += 1
        self.paren()
        self.statement(False)
        if self.eat("else"):
            self.statement(False)

    def for_(self) -> None:
        self.i += 1
        self.eat("await")
        self.need("(")
        self.no_in = True
        try:
            if self.t in ("var", "const") or (self.t == "let" and (self.kinds[self.i + 1] == "n" and self.ahead() not in ("in", "of") or self.ahead() in ("[", "{"))):
                self.declarators(self.take() == "const", True)
            elif self.t != ";":
                self.expression()
        finally:
            self.no_in = False
        if self.eat("of"):
            self.assignment()
        elif self.eat("in"):
            self.expression()
        else:
            self.need(";")
            if self.t != ";":
                self.expression()
            self.need(";")
            if self.t != ")":
                self.expression()
        self.need(")")
        self.loop_body()

    def while_(self) -> None:
        self.i += 1
        self.paren()
        self.loop_body()

    def do(self) -> None:
        self.i += 1
        self.loop_body()
        self.need("while")
        self.paren()
        self.eat(";")

    def jump(self) -> None:
        t = self.take()
        if self.kinds[self.i] == "n" and not self.fresh[self.i] and self.t not in _RESERVED:
            self.i += 1
        elif not self.in_loop and not (t == "break" and self.in_switch):
            self.i -= 1
            self.fail(f"{t} outside of a loop")
        self.end()

    def return_(self) -> None:
        if not self.in_function:
            self.fail("return outside of a function")
        self.i += 1
        if self.t not in (";", "}") and self.kinds[self.i] and not self.fresh[self.i]:
            self.expression()
        self.end()

    def throw(self) -> None:
        self.i += 1
        if self.fresh[self.i]:
            self.fail("throw without a value")
        self.expression()
        self.end()

    def try_(self) -> None:
        self.i += 1
        self.block()
        done = False
        if self.eat("catch"):
            done = True
            if self.eat("("):
                self.pattern()
                self.annotation()
                self.need(")")
            self.block()
        if self.eat("finally"):
            done = True
            self.block()
        if not done:
            self.fail("expected catch or finally")

    def switch(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        self.in_switch += 1
        try:
            while not self.eat("}"):
                if self.eat("case"):
                    self.expression()
                else:
                    self.need("default")
                self.need(":")
                while self.t not in ("case", "default", "}"):
                    if not self.kinds[self.i]:
                        self.fail("end of file, expected '}'")
                    self.guarded(lambda: self.statement(True))
        finally:
            self.in_switch -= 1

    def with_(self) -> None:
        self.i += 1
        self.paren()
        self.statement(False)

    def debugger(self) -> None:
        self.i += 1
        self.end()

    STATEMENTS = {
        "var": declaration, "const": declaration, "function": lambda self: self.function(False), "class": lambda self: self.class_(False), "if": if_, "for": for_, "while": while_, "do": do,
        "return": return_, "break": jump, "continue": jump, "throw": throw, "try": try_, "switch": switch, "with": with_, "debugger": debugger,
    }

    # expressions; a node is "ref" (can be assigned), "pattern" (an array or object literal) or "value"
    def expression(self) -> None:
        self.assignment()
        while self.eat(","):
            self.assignment()

    def operator(self) -> str:
        t = self.t
        if self.no_in and t == "in":
            return ""
        if self.kinds[self.i] == "n" and t not in ("in", "instanceof"):
            return ""
        return t

    def right_side(self, op: str, p: int, operand) -> None:
        if op == "??":
            self.binary(self.BINARY["|"], operand)
            if self.t in ("||", "&&") and self.kinds[self.i] == "p":
                self.fail("?? mixed with another operator")
            return
        self.binary(p if op == "**" else p + 1, operand)
        if op in ("||", "&&") and self.t == "??":
            self.fail("?? mixed with another operator")

    def operand(self) -> str:
        node = self.unary()
        if self.ts:
            while self.t in ("as", "satisfies") and self.kinds[self.i] == "n" and not self.fresh[self.i]:
                self.i += 1
                if not self.eat("const"):
                    self.type()
        return node

    def assignment(self) -> str:
        t = self.t
        if t == "yield":
            self.i += 1
            if not self.fresh[self.i]:
                if self.eat("*") or self.t not in (")", "]", "}", ",", ";", ":", "") :
                    self.assignment()
            return "value"
        if self.arrow():
            return "value"
        mark = self.cover
        node = self.binary(1, self.operand)
        if node == "pattern" and self.t in ("=", "of", "in"):
            self.cover = mark
        if self.t == "?":
            self.i += 1
            was, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = was
            self.need(":")
            self.assignment()
            return "value"
        t = self.t
        if t in _ASSIGN and self.kinds[self.i] == "p":
            if node == "value" or (node == "pattern" and t != "="):
                self.fail("cannot assign to this")
            self.i += 1
            self.assignment()
            return "value"
        return node

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        i, k = self.i, self.kinds[self.i]
        t = self.texts[i]
        if k == "n":
            if self.texts[i + 1] == "=>" and t not in _RESERVED:
                self.i += 2
                self.arrow_body()
                return True
            if t == "async" and not self.fresh[i + 1]:
                if self.kinds[i + 1] == "n" and self.texts[i + 2] == "=>":
                    self.i += 3
                    self.arrow_body()
                    return True
                if self.texts[i + 1] in ("(", "<"):
                    return self.arrow_list(i + 1)
            return False
        if t == "(" or (t == "<" and self.ts):
            return self.arrow_list(i)
        return False

    def arrow_list(self, i: int) -> bool:
        # Most parentheses are none: look for the arrow behind the partner first.
        depth, j = 0, i
        texts, kinds = self.texts, self.kinds
        if texts[j] == "(":
            while kinds[j]:
                t = texts[j]
                if t in ("(", "[", "{", "`{"):
                    depth += 1
                elif t in (")", "]", "}", "}`"):
                    depth -= 1
                    if not depth:
                        break
                j += 1
            nxt = texts[j + 1] if j + 1 < len(texts) else ""
            if nxt != "=>" and not (self.ts and nxt == ":"):
                return False
        was, errors = self.i, len(self.errors)
        self.i = i
        try:
            self.signature()
            if self.t != "=>" or self.fresh[self.i]:
                self.fail()
        except Fault:
            self.i = was
            del self.errors[errors:]
            return False
        self.i += 1
        self.arrow_body()
        return True

    def arrow_body(self) -> None:
        if self.t == "{":
            self.body()
        else:
            self.assignment()

    def unary(self) -> str:
        t, k = self.t, self.kinds[self.i]
        if (k == "p" and t in ("!", "~", "+", "-")) or (k == "n" and t in ("typeof", "void", "delete")):
            self.i += 1
            self.unary()
            if self.t == "**" and self.kinds[self.i] == "p":
                self.fail("a sign before a power")
            return "value"
        if k == "p" and t in ("++", "--"):
            self.i += 1
            if self.unary() != "ref":
                self.fail("cannot assign to this")
            return "value"
        if t == "await" and k == "n" and (self.kinds[self.i + 1] in ("n", '"', "0", "`") or self.ahead() in ("(", "[", "{")) and not self.fresh[self.i + 1] and self.ahead() not in ("in", "of", "instanceof"):
            self.i += 1
            self.unary()
            return "value"
        if self.ts and t == "<" and k == "p":
            self.i += 1
            self.type()
            self.need(">")
            self.unary()
            return "value"
        node = self.postfix()
        if self.t in ("++", "--") and not self.fresh[self.i]:
            if node != "ref":
                self.fail("cannot assign to this")
            self.i += 1
            return "value"
        return node

    def arguments(self) -> None:
        self.need("(")
        was, self.no_in = self.no_in, False
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if not self.eat(","):
                self.need(")")
                break
        self.no_in = was

    def postfix(self) -> str:
        node = self.primary()
        while True:
            t = self.t
            k = self.kinds[self.i]
            if t == ".":
                self.i += 1
                self.eat("#")
                if self.kinds[self.i] != "n":
                    self.fail()
                self.i += 1
                node = "ref"
            elif t == "?.":
                self.i += 1
                if self.t == "(":
                    self.arguments()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                else:
                    self.eat("#")
                    if self.kinds[self.i] != "n":
                        self.fail()
                    self.i += 1
                node = "value"
            elif t == "[":
                self.i += 1
                was, self.no_in = self.no_in, False
                self.expression()
                self.no_in = was
                self.need("]")
                node = "ref"
            elif t == "(":
                self.arguments()
                node = "value"
            elif k == "`" and t in ("`", "`{"):
                self.template()
                node = "value"
            elif self.ts and t == "!" and not self.fresh[self.i]:
                self.i += 1
            elif self.ts and t in ("<", "<<") and k == "p":
                def call():
                    self.type_arguments()
                    if self.t not in ("(", "`", "`{", ")", "]", ",", ";", ":", "}", ".", "?."):
                        self.fail()
                    return True

                if not self.attempt(call):
                    return node
                node = "value"
            else:
                return node

    def template(self) -> None:
        t = self.take()
        while t not in ("`", "}`"):
            self.expression()
            t = self.take()
            if t not in ("}{", "}`"):
                self.i -= 1
                self.fail()

    def new(self) -> str:
        self.i += 1
        if self.eat("."):
            self.need("target")
            return "value"
        if self.t == "new":
            self.new()
        else:
            self.primary()
        while True:
            if self.eat("."):
                self.eat("#")
                if self.kinds[self.i] != "n":
                    self.fail()
                self.i += 1
            elif self.eat("["):
                self.expression()
                self.need("]")
            else:
                break
        if self.ts and self.t == "<":
            self.attempt(lambda: self.type_arguments() or True)
        if self.t == "(":
            self.arguments()
        return "value"

    def primary(self) -> str:
        t, k = self.t, self.kinds[self.i]
        if k == "n":
            if t == "function" or (t == "async" and self.ahead() == "function" and not self.fresh[self.i + 1]):
                self.function(True)
                return "value"
            if t == "class":
                self.class_(True)
                return "value"
            if t == "new":
                return self.new()
            if t == "import":
                self.i += 1
                if self.eat("."):
                    self.take()
                elif self.t != "(":
                    self.fail()
                return "value"
            if t in _RESERVED and t not in _VALUE_WORDS:
                self.fail()
            self.i += 1
            return "value" if t in _VALUE_WORDS else "ref"
        if k in ("0", '"', "r"):
            self.i += 1
            return "value"
        if k == "`" and t in ("`", "`{"):
            self.template()
            return "value"
        if t == "(":
            self.i += 1
            was, self.no_in = self.no_in, False
            node = self.assignment()
            while self.eat(","):
                self.assignment()
                node = "value"
            self.no_in = was
            self.need(")")
            return "ref" if node == "ref" else "value"
        if t == "[":
            self.i += 1
            was, self.no_in = self.no_in, False
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if not self.eat(","):
                    self.need("]")
                    break
            self.no_in = was
            return "pattern"
        if t == "{":
            was, self.no_in = self.no_in, False
            self.object()
            self.no_in = was
            return "pattern"
        if t == "@":
            self.class_(True)
            return "value"
        if t == "#" and self.kinds[self.i + 1] == "n" and self.ahead(2) == "in":
            self.i += 2
            return "value"
        self.fail()

    def object(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                while self.t in ("get", "set", "async") and (self.kinds[self.i + 1] in ("n", '"', "0") or self.ahead() in ("[", "*")):
                    self.i += 1
                self.eat("*")
                plain = self.is_name(_RESERVED)
                self.property_name()
                if self.t in ("(", "<"):
                    self.signature()
                    self.body()
                elif self.eat(":"):
                    self.assignment()
                elif not plain:
                    self.fail()
                elif self.eat("="):
                    place = self.places[self.i - 1]
                    self.assignment()
                    self.cover = place if self.cover is None else self.cover
            if not self.eat(","):
                self.need("}")
                return

    # types
    def type_parameters(self) -> None:
        if self.t != "<":
            return
        self.i += 1
        while not self.close_angle():
            while self.t in ("const", "in", "out") and self.kinds[self.i + 1] == "n":
                self.i += 1
            self.binding_name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                if not self.close_angle():
                    self.fail("expected '>'")
                return

    def close_angle(self) -> bool:
        t = self.t
        if t == ">":
            self.i += 1
            return True
        if t in (">>", ">>>", ">=", ">>=", ">>>="):
            self.texts[self.i] = t[1:]
            return True
        return False

    def type_arguments(self) -> None:
        self.need("<")
        was = list(self.texts[self.i : self.i + 400])
        at = self.i
        try:
            while True:
                self.type()
                if not self.eat(","):
                    break
            if not self.close_angle():
                self.fail("expected '>'")
        except Fault:
            self.texts[at : at + len(was)] = was
            raise

    def return_type(self) -> None:
        if self.t == "asserts" and self.kinds[self.i + 1] == "n" and not self.fresh[self.i + 1]:
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        if self.kinds[self.i] == "n" and self.ahead() == "is" and not self.fresh[self.i + 1]:
            self.i += 2
        self.type()

    def type(self) -> None:
        if self.t in ("(", "<") and self.attempt(self.function_type):
            return
        if self.t == "new" or (self.t == "abstract" and self.ahead() == "new"):
            self.eat("abstract")
            self.i += 1
            if not self.function_type():
                self.fail()
            return
        self.union_type()
        if self.t == "extends" and not self.fresh[self.i]:
            self.i += 1
            self.union_type()
            if self.eat("?"):
                self.type()
                self.need(":")
                self.type()

    def function_type(self) -> bool:
        self.type_parameters()
        self.parameters()
        self.need("=>")
        self.return_type()
        return True

    def union_type(self) -> None:
        if self.t in ("|", "&"):
            self.i += 1
        self.unit_type()
        while self.t in ("|", "&") and self.kinds[self.i] == "p":
            self.i += 1
            self.unit_type()

    def unit_type(self) -> None:
        while self.t in ("keyof", "readonly", "unique", "infer") and (self.kinds[self.i + 1] in ("n", '"') or self.ahead() in ("(", "[", "{")):
            self.i += 1
        t, k = self.t, self.kinds[self.i]
        if k == "n":
            if t == "typeof":
                self.i += 1
                if self.t == "import":
                    return self.unit_type()
                self.take()
            elif t == "import":
                self.i += 1
                self.balanced()
            elif t in _RESERVED and t not in ("void", "null", "this", "true", "false", "undefined"):
                self.fail("expected a type")
            else:
                self.i += 1
            while self.eat("."):
                if self.kinds[self.i] != "n":
                    self.fail()
                self.i += 1
            if self.t == "<" and not self.fresh[self.i]:
                self.type_arguments()
        elif k in ('"', "0"):
            self.i += 1
        elif t == "-" and self.kinds[self.i + 1] == "0":
            self.i += 2
        elif k == "`":
            x = self.take()
            while x not in ("`", "}`"):
                self.type()
                x = self.take()
        elif t == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif t == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("...")
                if self.kinds[self.i] == "n" and (self.ahead() == ":" or (self.ahead() == "?" and self.ahead(2) == ":")):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if not self.eat(","):
                    self.need("]")
                    break
        elif t == "{":
            self.object_type()
        else:
            self.fail("expected a type")
        while self.t == "[" and not self.fresh[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def object_type(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.t in ("+", "-") and self.ahead() == "readonly":
                self.i += 1
            while self.t in ("readonly", "get", "set") and (self.kinds[self.i + 1] in ("n", '"', "0") or self.ahead() == "["):
                self.i += 1
            if self.t in ("(", "<"):
                self.signature()
            elif self.t == "new" and self.ahead() in ("(", "<"):
                self.i += 1
                self.signature()
            else:
                if self.t == "[" and self.kinds[self.i + 1] == "n" and self.ahead(2) in (":", "in"):
                    self.i += 3
                    self.type()
                    if self.eat("as"):
                        self.type()
                    self.need("]")
                    if self.t in ("+", "-"):
                        self.i += 1
                else:
                    self.property_name()
                self.eat("?")
                if self.t in ("(", "<"):
                    self.signature()
                else:
                    self.annotation()
            if not (self.eat(",") or self.eat(";") or self.t == "}" or self.fresh[self.i]):
                self.fail()


class TypeScript(Script):
    ts = True
