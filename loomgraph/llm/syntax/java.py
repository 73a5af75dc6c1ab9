"""Java."""

from __future__ import annotations

import re

from .base import Parser

_TOKEN = re.compile(
    r"(?P<sp>[ \t\f]+)|(?P<nl>[\r\n]+)|(?P<lc>//[^\r\n]*)|(?P<bc>/\*.*?\*/)"
    r"|(?P<num>0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[lLfFdD]?)"
    r"|(?P<name>[\w$]+)"
    r"|(?P<str>\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[btnfrs\"'\\]))')"
    r"|(?P<op><<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[{}()\[\];,.@=<>!~?:+\-*/&|^%])",
    re.S,
)
_PRIMITIVE = frozenset("boolean byte short int long char float double".split())
_KEYWORDS = frozenset(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
) | _PRIMITIVE
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())


class Java(Parser):
    STARTS = frozenset("class interface enum import package public private protected static final if for while do switch try return break continue throw".split())
    BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}

    def lex(self) -> None:
        put_kind, put_text, put_fresh, put_place = self.kinds.append, self.texts.append, self.fresh.append, self.places.append
        match = _TOKEN.match
        src, n, at, fresh = self.source, len(self.source), 0, True
        if src.startswith("﻿"):
            at = 1
        while at < n:
            if src[at] in " \t":
                at += 1
                continue
            m = match(src, at)
            if m is None:
                ch = src[at]
                self.error(at, "comment or text without an end" if src.startswith("/*", at) or ch in "\"'" else f"unexpected {ch!r}")
                if src.startswith(("/*", '"""'), at):
                    return
                at += 1
                if ch in "\"'":
                    while at < n and src[at] not in "\r\n":
                        at += 1
                continue
            g = m.lastgroup
            if g == "op":
                # Signs that close generics stand alone; shifts are put together again by place.
                put_kind("p"), put_text(m.group()), put_place(at), put_fresh(fresh)
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
            elif g == "nl":
                fresh = True
            at = m.end()

    def name(self) -> None:
        if not self.is_name(_KEYWORDS):
            self.fail("expected a name")
        self.i += 1

    def dotted(self) -> None:
        self.name()
        while self.t == "." and self.kinds[self.i + 1] == "n":
            self.i += 1
            self.name()

    def program(self) -> None:
        self.loops = self.switches = 0
        while self.kinds[self.i]:
            if self.t == "}":
                self.error(self.places[self.i], "unexpected '}'")
                self.i += 1
                continue
            if self.eat(";"):
                continue
            self.guarded(self.top)

    def top(self) -> None:
        t = self.t
        if t == "package" or t == "import":
            self.i += 1
            if t == "import":
                self.eat("static")
            self.name()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.name()
            return self.need(";")
        self.modifiers()
        if self.t == "package":
            return self.top()
        if not self.type_declaration():
            self.fail("expected a class, interface, enum or record")

    def modifiers(self) -> None:
        while True:
            t = self.t
            if t == "@" and self.ahead() != "interface":
                self.i += 1
                self.dotted()
                if self.t == "(":
                    self.annotation_values()
            elif t == "default" and self.ahead() in (":", "->"):
                return
            elif t in _MODIFIERS or (t == "sealed" and self.kinds[self.i + 1] == "n"):
                self.i += 1
            elif t == "non" and self.ahead() == "-" and self.ahead(2) == "sealed":
                self.i += 3
            else:
                return

    def annotation_values(self) -> None:
        self.need("(")
        while not self.eat(")"):
            if self.is_name(_KEYWORDS) and self.ahead() == "=":
                self.i += 2
            self.annotation_value()
            if not self.eat(","):
                self.need(")")
                return

    def annotation_value(self) -> None:
        if self.eat("{"):
            while not self.eat("}"):
                self.annotation_value()
                if not self.eat(","):
                    self.need("}")
                    return
        elif self.t == "@":
            self.modifiers()
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        t = self.t
        if t == "class":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.eat("extends"):
                self.type()
            self.supers("implements")
            self.class_body(False)
        elif t == "interface" or (t == "@" and self.ahead() == "interface"):
            self.eat("@")
            self.i += 1
            self.name()
            self.type_parameters()
            self.supers("extends")
            self.class_body(False)
        elif t == "enum":
            self.i += 1
            self.name()
            self.supers("implements")
            self.class_body(True)
        elif t == "record" and self.kinds[self.i + 1] == "n" and self.ahead(2) in ("(", "<"):
            self.i += 1
            self.name()
            self.type_parameters()
            self.parameters()
            self.supers("implements")
            self.class_body(False)
        else:
            return False
        return True

    def supers(self, word: str) -> None:
        for w in (word, "permits"):
            if self.eat(w):
                self.type()
                while self.eat(","):
                    self.type()

    def class_body(self, enum: bool) -> None:
        self.need("{")
        if enum:
            while self.t not in (";", "}"):
                self.modifiers()
                self.name()
                if self.t == "(":
                    self.arguments()
                if self.t == "{":
                    self.class_body(False)
                if not self.eat(","):
                    break
            if self.t != "}":
                self.need(";")
        while not self.eat("}"):
            if not self.kinds[self.i]:
                self.fail("end of file, expected '}'")
            if not self.eat(";"):
                self.guarded(self.member)

    def member(self) -> None:
        if self.t == "{" or (self.t == "static" and self.ahead() == "{"):
            self.eat("static")
            return self.body()
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        if self.is_name(_KEYWORDS) and self.ahead() == "(":
            self.i += 1
            self.parameters()
            return self.rest()
        if self.is_name(_KEYWORDS) and self.ahead() == "{":
            self.i += 1
            return self.body()
        if not self.eat("void"):
            self.type()
        self.name()
        if self.t == "(":
            self.parameters()
            self.dims()
            return self.rest()
        self.declarators()
        self.need(";")

    def rest(self) -> None:
        if self.eat("throws"):
            self.type()
            while self.eat(","):
                self.type()
        if self.eat("default"):
            self.annotation_value()
        if self.t == "{":
            self.body()
        else:
            self.need(";")

    def body(self) -> None:
        was = self.loops, self.switches
        self.loops = self.switches = 0
        try:
            self.block()
        finally:
            self.loops, self.switches = was

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.eat("{"):
            while not self.eat("}"):
                self.initializer()
                if not self.eat(","):
                    self.need("}")
                    return
        else:
            self.expression()

    def dims(self) -> None:
        while self.t == "[" and self.ahead() == "]":
            self.i += 2

    def type_parameters(self) -> None:
        if self.t != "<":
            return
        self.i += 1
        while True:
            self.modifiers()
            self.name()
            if self.eat("extends"):
                self.type()
                while self.eat("&"):
                    self.type()
            if not self.eat(","):
                break
        self.need(">")

    def type(self) -> None:
        self.modifiers()
        if self.t in _PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.t == "." and (self.kinds[self.i + 1] == "n" or self.ahead() == "@"):
                self.i += 1
                self.modifiers()
                self.name()
                self.type_arguments()
        while self.t == "[" and self.ahead() == "]":
            self.i += 2

    def type_arguments(self) -> None:
        if self.t != "<":
            return
        self.i += 1
        if self.eat(">"):
            return
        while True:
            self.modifiers()
            if self.eat("?"):
                if self.eat("extends") or self.eat("super"):
                    self.type()
            else:
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.modifiers()
            self.type()
            self.eat("...")
            if self.eat("this"):
                pass
            else:
                self.name()
                if self.t == "." and self.ahead() == "this":
                    self.i += 2
            self.dims()
            if not self.eat(","):
                self.need(")")
                return

    # statements
    def block(self) -> None:
        self.need("{")
        while self.t != "}":
            if not self.kinds[self.i]:
                self.fail("end of file, expected '}'")
            self.guarded(self.block_statement)
        self.i += 1

    def block_statement(self) -> None:
        t = self.t
        if t in ("final", "abstract", "class", "interface", "enum", "@", "static", "strictfp") or (t == "record" and self.kinds[self.i + 1] == "n" and self.ahead(2) in ("(", "<")):
            self.modifiers()
            if self.type_declaration():
                return
            self.type()
            self.name()
            self.declarators()
            return self.need(";")
        if self.local():
            self.declarators()
            return self.need(";")
        self.statement()

    def local(self) -> bool:
        """Past the type and the first name of a local variable, if one is declared here."""
        t = self.t
        if self.kinds[self.i] != "n" or (t in _KEYWORDS and t not in _PRIMITIVE) or (t == "yield" and self.ahead() not in ("=", ".", "[")):
            return False

        def head() -> bool:
            self.type()
            self.name()
            if self.t not in ("=", ";", ",", "[", ":"):
                self.fail()
            return True

        n = self.ahead()
        if t not in _PRIMITIVE and self.kinds[self.i + 1] != "n" and n not in ("<", "[", ".", "@"):
            return False
        return bool(self.attempt(head))

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def loop_body(self) -> None:
        self.loops += 1
        try:
            self.statement()
        finally:
            self.loops -= 1

    def statement(self) -> None:
        t, k = self.t, self.kinds[self.i]
        if t == "{":
            return self.block()
        if t == ";":
            self.i += 1
            return
        if k == "n":
            f = self.STATEMENTS.get(t)
            if f is not None:
                return f(self)
            if t == "yield" and self.ahead() not in ("=", ".", "[", "(", "++", "--"):
                self.i += 1
                self.expression()
                return self.need(";")
            if self.ahead() == ":" and t not in _KEYWORDS:
                self.i += 2
                return self.statement()
        node = self.expression()
        if node not in ("call", "assign"):
            self.fail("not a statement")
        self.need(";")

    def if_(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.paren()
        self.loop_body()

    def do(self) -> None:
        self.i += 1
        self.loop_body()
        self.need("while")
        self.paren()
        self.need(";")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        self.modifiers()
        if self.local():
            if self.eat(":"):
                self.expression()
                self.need(")")
                return self.loop_body()
            self.declarators()
        elif self.t != ";":
            self.expressions()
        self.need(";")
        if self.t != ";":
            self.expression()
        self.need(";")
        if self.t != ")":
            self.expressions()
        self.need(")")
        self.loop_body()

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def return_(self) -> None:
        self.i += 1
        if self.t != ";":
            self.expression()
        self.need(";")

    def throw(self) -> None:
        self.i += 1
        self.expression()
        self.need(";")

    def jump(self) -> None:
        self.i += 1
        if self.is_name(_KEYWORDS):
            self.i += 1
        self.need(";")

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    def synchronized(self) -> None:
        self.i += 1
        self.paren()
        self.block()

    def try_(self) -> None:
        self.i += 1
        done = False
        if self.eat("("):
            done = True
            while not self.eat(")"):
                self.modifiers()
                if self.local():
                    self.need("=")
                self.expression()
                if not self.eat(";"):
                    self.need(")")
                    break
        self.block()
        while self.eat("catch"):
            done = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
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
        style = None
        while not self.eat("}"):
            if self.eat("case"):
                while True:
                    if not self.eat("default"):
                        self.label()
                    if not self.eat(","):
                        break
                if self.eat("when"):
                    self.expression()
            else:
                self.need("default")
            style = style or self.t
            if self.t in ("->", ":") and self.t != style:
                self.fail("arrows and colons in one switch")
            if self.eat("->"):
                if self.t == "{":
                    self.block()
                elif self.t == "throw":
                    self.throw()
                else:
                    self.expression()
                    self.need(";")
                continue
            self.need(":")
            while self.t not in ("case", "default", "}"):
                if not self.kinds[self.i]:
                    self.fail("end of file, expected '}'")
                self.guarded(self.block_statement)

    def label(self) -> None:
        if not self.attempt(lambda: self.pattern() or True):
            self.ternary()

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.eat("("):
            while not self.eat(")"):
                self.pattern()
                if not self.eat(","):
                    self.need(")")
                    break
            if self.is_name(_KEYWORDS) and self.t != "when":
                self.i += 1
        else:
            self.name()

    STATEMENTS = {"if": if_, "while": while_, "do": do, "for": for_, "return": return_, "throw": throw, "break": jump, "continue": jump, "assert": assert_, "synchronized": synchronized, "try": try_, "switch": switch}

    # expressions
    def expression(self) -> str:
        if self.lambda_():
            return "value"
        node = self.ternary()
        op = self.operator()
        if op in _ASSIGN:
            if node != "ref":
                self.fail("cannot assign to this")
            self.consume_operator(op)
            self.expression()
            return "assign"
        return node

    def lambda_(self) -> bool:
        if self.kinds[self.i] == "n" and self.ahead() == "->" and self.t not in _KEYWORDS:
            self.i += 2
        elif self.t == "(":
            depth, j = 0, self.i
            while self.kinds[j]:
                t = self.texts[j]
                depth += t == "("
                if t == ")":
                    depth -= 1
                    if not depth:
                        break
                j += 1
            if j + 1 >= len(self.texts) or self.texts[j + 1] != "->":
                return False

            def names() -> bool:
                self.need("(")
                while not self.eat(")"):
                    self.name()
                    if not self.eat(","):
                        self.need(")")
                        break
                return True

            if not self.attempt(names):
                self.parameters()
            self.need("->")
        else:
            return False
        if self.t == "{":
            self.body()
        else:
            self.expression()
        return True

    def ternary(self) -> str:
        node = self.binary(1, self.unary)
        if self.eat("?"):
            self.lambda_() or self.ternary()
            self.need(":")
            self.lambda_() or self.ternary()
            return "value"
        return node

    def operator(self) -> str:
        t = self.t
        if t not in (">", ">="):
            return t if self.kinds[self.i] == "p" or t == "instanceof" else ""
        out, i = t, self.i
        while out[-1] == ">" and self.texts[i + 1] in (">", ">=") and self.places[i + 1] == self.places[i] + 1:
            i += 1
            out += self.texts[i]
        return out

    def consume_operator(self, op: str) -> None:
        # ">", ">" and ">=" are tokens of their own: as many as there are signs, the last with its "=".
        self.i += op.count(">") if op[0] == ">" else 1

    def right_side(self, op: str, p: int, operand) -> None:
        if op == "instanceof":
            self.modifiers()
            if not self.attempt(lambda: self.pattern() or True):
                self.type()
            return
        self.binary(p + 1, operand)

    def unary(self) -> str:
        t = self.t
        if self.kinds[self.i] == "p":
            if t in ("+", "-", "!", "~"):
                self.i += 1
                self.unary()
                return "value"
            if t in ("++", "--"):
                self.i += 1
                if self.unary() != "ref":
                    self.fail("cannot assign to this")
                return "assign"
            if t == "(" and self.cast():
                return "value"
        elif t == "switch":
            self.switch()
            return "value"
        node = self.postfix()
        while self.t in ("++", "--"):
            if node != "ref":
                self.fail("cannot assign to this")
            self.i += 1
            node = "assign"
        return node

    def cast(self) -> bool:
        primitive = self.ahead() in _PRIMITIVE
        if not primitive and (self.kinds[self.i + 1] != "n" or self.ahead() in _KEYWORDS):
            return False

        def head() -> bool:
            self.need("(")
            self.type()
            while self.eat("&"):
                self.type()
            self.need(")")
            if not primitive and not (self.kinds[self.i] in ("n", "0", '"') and self.t != "instanceof" or self.t in ("(", "!", "~")):
                self.fail()
            return True

        if not self.attempt(head):
            return False
        self.lambda_() or self.unary()
        return True

    def arguments(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.expression()
            if not self.eat(","):
                self.need(")")
                return

    def postfix(self) -> str:
        node = self.primary()
        while True:
            t = self.t
            if t == ".":
                self.i += 1
                if self.eat("new"):
                    self.creator()
                    node = "call"
                    continue
                self.type_arguments()
                if self.t in ("this", "class", "super"):
                    self.i += 1
                    node = "value"
                else:
                    self.name()
                    node = "ref"
                if self.t == "(":
                    self.arguments()
                    node = "call"
            elif t == "[":
                self.i += 1
                self.expression()
                self.need("]")
                node = "ref"
            elif t == "::":
                self.i += 1
                self.type_arguments()
                if not self.eat("new"):
                    self.name()
                node = "value"
            else:
                return node

    def creator(self) -> None:
        self.modifiers()
        self.type_arguments()
        if self.t in _PRIMITIVE:
            self.i += 1
        else:
            self.dotted()
            while self.t == "<" or self.t == ".":
                self.type_arguments()
                if self.eat("."):
                    self.name()
        if self.t == "(":
            self.arguments()
            if self.t == "{":
                self.class_body(False)
        elif self.t == "[":
            sized = False
            while self.eat("["):
                if not self.eat("]"):
                    self.expression()
                    self.need("]")
                    sized = True
            if self.t == "{" and not sized:
                self.initializer()
            elif not sized:
                self.fail("an array without a size")
        else:
            self.fail()

    def primary(self) -> str:
        t, k = self.t, self.kinds[self.i]
        if k in ("0", '"'):
            self.i += 1
            return "value"
        if t == "(":
            self.i += 1
            node = self.expression()
            self.need(")")
            return "ref" if node == "ref" else "value"
        if k == "n":
            if t in ("true", "false", "null"):
                self.i += 1
                return "value"
            if t in ("this", "super"):
                self.i += 1
                if self.t == "(":
                    self.arguments()
                    return "call"
                return "value"
            if t == "new":
                self.i += 1
                self.creator()
                return "call"
            if t in _PRIMITIVE or t == "void":
                self.i += 1
                self.dims()
                if self.t not in (".", "::"):
                    self.fail()
                return "value"
            if t not in _KEYWORDS:
                if self.ahead() in ("<", "["):
                    def generic() -> bool:
                        self.type()
                        if self.t != "::" and not (self.t == "." and self.ahead() == "class"):
                            self.fail()
                        return True

                    if self.attempt(generic):
                        return "value"
                self.i += 1
                if self.t == "(":
                    self.arguments()
                    return "call"
                return "ref"
        self.fail()
