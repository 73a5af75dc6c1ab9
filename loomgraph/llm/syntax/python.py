"""Python 3."""

from __future__ import annotations

import re

from .base import Fault, Parser

_TOKEN = re.compile(
    r"(?P<sp>[ \t\f]+|\\\n)|(?P<nl>\n)|(?P<lc>#[^\n]*)"
    r"|(?P<str>(?P<pre>[rRbBuUfFtT]{0,2})(?P<q>'''|\"\"\"|'|\"))"
    r"|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)"
    r"|(?P<name>[^\W\d][\w·]*)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[+\-*/%@&|^~<>()\[\]{},:.;=!])",
)
_SHORT = {"'": re.compile(r"(?:[^'\\\n]|\\.)*'", re.S), '"': re.compile(r'(?:[^"\\\n]|\\.)*"', re.S), "'''": re.compile(r"(?:[^\\]|\\.)*?'''", re.S), '"""': re.compile(r'(?:[^\\]|\\.)*?"""', re.S)}
_PREFIXES = frozenset(("", "r", "b", "u", "f", "t", "br", "rb", "fr", "rf", "tr", "rt"))
_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)(?!\w)")
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_COMPARE = frozenset("< > == >= <= != in not is".split())
_TARGETS = frozenset(("name", "attribute", "item", "tuple", "list", "star"))
_INDENT, _DEDENT, _LINE = "\0in", "\0out", "\0line"


class Python(Parser):
    STARTS = frozenset()
    BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "@": 6, "/": 6, "%": 6, "//": 6}

    # lexing
    def lex(self) -> None:
        put_kind, put_text, put_fresh, put_place = self.kinds.append, self.texts.append, self.fresh.append, self.places.append
        match = _TOKEN.match
        src = self.source
        if "\0" in src:
            self.error(src.index("\0"), "null byte")
        src = self.source = src.replace("\r\n", "\n").replace("\r", "\n")
        at, n = (1 if src.startswith("﻿") else 0), len(src)
        levels, alternatives = [0], [0]
        pairs: list[tuple[str, int]] = []
        begin = True
        add = self.add
        while at < n:
            if begin and not pairs:
                begin = False
                wide = narrow = 0
                while at < n and src[at] in " \t\f":
                    ch = src[at]
                    if ch == " ":
                        wide, narrow = wide + 1, narrow + 1
                    elif ch == "\t":
                        wide, narrow = (wide // 8 + 1) * 8, narrow + 1
                    else:
                        wide = narrow = 0
                    at += 1
                if at >= n:
                    break
                if src[at] in "#\n":
                    if src[at] == "#":
                        at = src.find("\n", at)
                        if at < 0:
                            at = n
                            break
                    at += 1
                    begin = True
                    continue
                if src[at] == "\\" and src[at + 1 : at + 2] == "\n":
                    at += 2
                if wide == levels[-1]:
                    if narrow != alternatives[-1]:
                        self.error(at, "tabs and spaces are mixed")
                elif wide > levels[-1]:
                    if narrow <= alternatives[-1]:
                        self.error(at, "tabs and spaces are mixed")
                    levels.append(wide)
                    alternatives.append(narrow)
                    put_kind("i"), put_text(_INDENT), put_place(at), put_fresh(True)
                else:
                    while wide < levels[-1]:
                        levels.pop()
                        alternatives.pop()
                        put_kind("i"), put_text(_DEDENT), put_place(at), put_fresh(True)
                    if wide != levels[-1]:
                        self.error(at, "unindent to no outer level")
                        levels.append(wide)
                        alternatives.append(narrow)
                    elif narrow != alternatives[-1]:
                        self.error(at, "tabs and spaces are mixed")
            if src[at] == " ":
                at += 1
                continue
            m = match(src, at)
            if m is None:
                self.error(at, f"unexpected {src[at]!r}")
                at += 1
                continue
            g = m.lastgroup
            if g in ("q", "pre"):
                g = "str"
            if g == "name":
                put_kind("n"), put_text(m.group()), put_place(at), put_fresh(False)
            elif g == "op":
                t = m.group()
                if t in "([{":
                    pairs.append((t, at))
                elif t in ")]}":
                    if pairs and self.OPENERS[pairs[-1][0]] == t:
                        pairs.pop()
                    else:
                        self.error(at, "bracket without its partner")
                        if pairs:
                            pairs.pop()
                elif t == "!":
                    self.error(at, "unexpected '!'")
                put_kind("p"), put_text(t), put_place(at), put_fresh(False)
            elif g == "num":
                put_kind("0"), put_text("0"), put_place(at), put_fresh(False)
                t, e = m.group(), m.end()
                if len(t) > 1 and t[0] == "0" and t.replace("_", "").isdigit() and t.strip("0_"):
                    self.error(at, "number with a leading zero")
                if e < n and (src[e].isalnum() or src[e] == "_") and not (_AFTER_NUMBER.match(src, e)):
                    self.error(at, "number runs into a name")
            elif g == "str":
                prefix, q = m.group("pre").lower(), m.group("q")
                if prefix not in _PREFIXES:
                    self.error(at, "unknown prefix of a text")
                if "f" in prefix or "t" in prefix:
                    end = self.formatted(m.end(), q, "r" in prefix)
                else:
                    e = _SHORT[q].match(src, m.end())
                    end = e.end() if e else -1
                if end < 0:
                    self.error(at, "text without an end")
                    if len(q) == 3:
                        at = n
                        break
                    end = src.find("\n", at)
                    end = n if end < 0 else end
                add('"', "b" if "b" in prefix else '"', at, False)
                at = end
                continue
            elif g == "nl":
                if not pairs:
                    put_kind("e"), put_text(_LINE), put_place(at), put_fresh(False)
                    begin = True
            at = m.end()
        if pairs:
            self.error(pairs[-1][1], "bracket without its partner")
        if self.kinds and self.kinds[-1] not in ("e", "i"):
            add("e", _LINE, n, False)
        for _ in levels[1:]:
            add("i", _DEDENT, n, True)

    def formatted(self, at: int, q: str, raw: bool) -> int:
        """The end of a formatted text; its fields are parsed as expressions."""
        src, n = self.source, len(self.source)
        depth_spec = 0
        while at < n:
            if src.startswith(q, at):
                return at + len(q)
            ch = src[at]
            if ch == "\n" and len(q) == 1:
                return -1
            if ch == "\\" and not (raw and src[at + 1 : at + 2] in ("{", "}")):
                if not raw and src.startswith("\\N{", at):
                    e = src.find("}", at)
                    if e < 0:
                        return -1
                    at = e + 1
                else:
                    at += 2
            elif ch == "{":
                if src.startswith("{{", at) and not depth_spec:
                    at += 2
                    continue
                at = self.field(at + 1, q)
                if at < 0:
                    return -1
            elif ch == "}":
                if src.startswith("}}", at):
                    at += 2
                    continue
                self.error(at, "single '}' in a formatted text")
                at += 1
            else:
                at += 1
        return -1

    def field(self, at: int, q: str) -> int:
        """Past the field that begins at ``at``; -1 if it has no end."""
        src, n, begin = self.source, len(self.source), at
        pairs: list[str] = []
        while at < n:
            ch = src[at]
            if ch in "([{":
                pairs.append(self.OPENERS[ch])
            elif ch in ")]}" and pairs:
                if ch != pairs.pop():
                    self.error(at, "bracket without its partner")
            elif ch in "'\"":
                three = src[at : at + 3]
                quote = three if three in ("'''", '"""') else ch
                if src.startswith(q, at) and q == quote and len(q) == 1 and not self._closed_inside(at, q):
                    return -1
                k = at
                while k > begin and src[k - 1].isalpha():
                    k -= 1
                if src[k:at].lower() in ("f", "rf", "fr", "t", "tr", "rt"):
                    at = self.formatted(at + len(quote), quote, "r" in src[k:at].lower())
                    if at < 0:
                        return -1
                    continue
                e = _SHORT[quote].match(src, at + len(quote))
                if e is None:
                    return -1
                at = e.end()
                continue
            elif ch == "\n" and len(q) == 1 and not pairs and False:
                return -1
            elif ch == "#":
                e = src.find("\n", at)
                if e < 0:
                    return -1
                at = e
            elif not pairs and (ch == "}" or ch == ":" or (ch == "!" and src[at + 1 : at + 2] != "=")):
                break
            at += 1
        if at >= n:
            return -1
        text = src[begin:at]
        plain = text.rstrip()
        if plain.endswith("=") and not plain.endswith(("==", "!=", "<=", ">=", ":=")):
            text = plain[:-1]
        inner = Python.__new__(Python)
        inner.errors, inner.kinds, inner.texts, inner.fresh, inner.places, inner.i = [], [], [], [], [], 0
        inner.source = "(" + text + ")"
        inner.lex()
        inner.add("", "", len(inner.source), True)
        try:
            inner.need("(")
            if inner.t == "yield":
                inner.yield_()
            else:
                inner.star_expressions()
            inner.need(")")
            if inner.t != _LINE:
                inner.fail()
        except Fault as x:
            inner.error(x.at, x.why)
        for _, why in inner.errors[:1]:
            self.error(begin, why)
        if src[at] == "!":
            if not re.match(r"![sra]\s*[:}]", src[at : at + 20]):
                self.error(at, "unknown conversion")
            at += 2
            while at < n and src[at].isspace():
                at += 1
        if at < n and src[at] == ":":
            at += 1
            while at < n and src[at] != "}":
                if src[at] == "{":
                    at = self.field(at + 1, q)
                    if at < 0:
                        return -1
                elif src.startswith(q, at) or (src[at] == "\n" and len(q) == 1):
                    return -1
                else:
                    at += 1
        return at + 1 if at < n else -1

    def _closed_inside(self, at: int, q: str) -> bool:
        """Whether a quote like the outer one opens a text of its own within a field."""
        e = _SHORT[q].match(self.source, at + 1)
        return e is not None and "}" in self.source[e.end() : self.source.find("\n", e.end()) if self.source.find("\n", e.end()) >= 0 else len(self.source)]

    # statements
    def program(self) -> None:
        while self.kinds[self.i]:
            self.guarded(self.statement)

    def recover(self, began: int) -> None:
        """Past the end of the line, and past blocks that belong to it."""
        if self.i == began and self.kinds[self.i] and self.t != _LINE:
            self.i += 1
        while self.kinds[self.i] and self.t != _LINE:
            if self.t == _DEDENT:
                return
            self.i += 1
        if self.kinds[self.i]:
            self.i += 1

    def name(self) -> None:
        if not self.is_name(_KEYWORDS):
            self.fail("expected a name")
        self.i += 1

    def statement(self) -> None:
        t = self.t
        f = self.COMPOUND.get(t)
        if f is not None:
            return f(self)
        if t in (_INDENT, _DEDENT):
            self.i += 1
            if t == _INDENT:
                raise Fault(self.places[self.i - 1], "unexpected indent")
            return
        if t == "match" and self.kinds[self.i] == "n" and self.attempt(self.match_head):
            return self.match_body()
        self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.eat(";"):
                break
            if self.t == _LINE:
                break
        self.need_line()

    def need_line(self) -> None:
        if self.t != _LINE:
            self.fail()
        self.i += 1

    def block(self, what: str = "statement") -> None:
        self.need(":")
        if not self.eat(_LINE):
            return self.simple_line()
        if self.t != _INDENT:
            self.fail(f"expected an indented block after {what}")
        self.i += 1
        while self.t != _DEDENT:
            if not self.kinds[self.i]:
                self.fail()
            self.guarded(self.statement)
        self.i += 1

    def simple(self) -> None:
        t = self.t
        f = self.SIMPLE.get(t) if self.kinds[self.i] == "n" else None
        if f is not None:
            return f(self)
        if t == "type" and self.kinds[self.i] == "n" and self.kinds[self.i + 1] == "n" and self.ahead() not in _KEYWORDS and self.attempt(self.type_alias):
            return
        if t in ("print", "exec") and self.kinds[self.i + 1] in ("n", '"', "0") and self.ahead() not in _KEYWORDS:
            self.fail("missing parentheses in a call")
        at = self.places[self.i]
        parenthesized = t == "("
        node = self.yield_() if t == "yield" else self.star_expressions()
        t = self.t
        if t == "=":
            while self.eat("="):
                if node not in _TARGETS or node == "star":
                    raise Fault(at, "cannot assign to this")
                at = self.places[self.i]
                node = self.yield_() if self.t == "yield" else self.star_expressions()
        elif t in _AUGMENTED:
            if node not in ("name", "attribute", "item"):
                raise Fault(at, "cannot assign to this")
            self.i += 1
            self.yield_() if self.t == "yield" else self.star_expressions()
        elif t == ":":
            if node not in ("name", "attribute", "item") or (parenthesized and node == "tuple"):
                raise Fault(at, "illegal target for an annotation")
            self.i += 1
            self.expression()
            if self.eat("="):
                self.yield_() if self.t == "yield" else self.star_expressions()

    def type_alias(self) -> bool:
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("=")
        self.expression()
        return True

    def type_parameters(self) -> None:
        if not self.eat("["):
            return
        while True:
            if self.t in ("*", "**"):
                self.i += 1
            self.name()
            if self.eat(":"):
                self.expression()
            if self.eat("="):
                self.star_expression()
            if not self.eat(",") or self.t == "]":
                break
        self.need("]")

    def pass_(self) -> None:
        self.i += 1

    def return_(self) -> None:
        self.i += 1
        if self.t not in (_LINE, ";"):
            self.star_expressions()

    def raise_(self) -> None:
        self.i += 1
        if self.t not in (_LINE, ";"):
            self.expression()
            if self.eat("from"):
                self.expression()

    def global_(self) -> None:
        self.i += 1
        self.name()
        while self.eat(","):
            self.name()

    def del_(self) -> None:
        self.i += 1
        at = self.places[self.i]
        if self.star_expressions() not in ("name", "attribute", "item", "tuple", "list"):
            raise Fault(at, "cannot delete this")

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.eat(","):
            self.expression()

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def import_(self) -> None:
        self.i += 1
        while True:
            self.dotted()
            if self.eat("as"):
                self.name()
            if not self.eat(","):
                return

    def from_(self) -> None:
        self.i += 1
        dots = 0
        while self.t in (".", "..."):
            dots += 1
            self.i += 1
        if not (dots and self.t == "import"):
            self.dotted()
        self.need("import")
        if self.eat("*"):
            return
        paren = self.eat("(")
        while True:
            self.name()
            if self.eat("as"):
                self.name()
            if not self.eat(","):
                break
            if self.t == ")" and paren:
                break
            if not paren and self.t == _LINE:
                self.fail("comma at the end")
        if paren:
            self.need(")")

    SIMPLE = {
        "pass": pass_, "break": pass_, "continue": pass_, "return": return_, "raise": raise_, "global": global_, "nonlocal": global_, "del": del_, "assert": assert_, "import": import_, "from": from_,
    }

    def if_(self) -> None:
        self.i += 1
        self.named()
        self.block()
        while self.t == "elif":
            self.i += 1
            self.named()
            self.block()
        self.else_()

    def else_(self) -> None:
        if self.eat("else"):
            self.block()

    def while_(self) -> None:
        self.i += 1
        self.named()
        self.block()
        self.else_()

    def for_(self) -> None:
        self.i += 1
        self.targets()
        self.need("in")
        self.star_expressions()
        self.block()
        self.else_()

    def targets(self) -> None:
        at, many = self.places[self.i], False
        while True:
            starred = self.eat("*")
            if self.binary(1, self.unary) not in _TARGETS:
                raise Fault(at, "cannot assign to this")
            if not self.eat(","):
                if starred and not many:
                    self.fail()
                return
            many = True
            if self.t == "in":
                return

    def try_(self) -> None:
        self.i += 1
        self.block("try")
        done = False
        star = None
        while self.eat("except"):
            done = True
            s = self.eat("*")
            if star is not None and s != star:
                self.fail("except and except* are mixed")
            star = s
            if self.t != ":":
                self.expression()
                while self.eat(","):
                    self.expression()
                if self.eat("as"):
                    self.name()
            elif s:
                self.fail()
            self.block("except")
        if done:
            self.else_()
        if self.eat("finally"):
            done = True
            self.block("finally")
        if not done:
            self.fail("expected except or finally")

    def with_(self) -> None:
        self.i += 1

        def grouped() -> bool:
            self.need("(")
            while True:
                self.item()
                if not self.eat(",") or self.t == ")":
                    break
            self.need(")")
            if self.t != ":":
                self.fail()
            return True

        if self.t != "(" or not self.attempt(grouped):
            self.item()
            while self.eat(","):
                self.item()
        self.block("with")

    def item(self) -> None:
        self.expression()
        if self.eat("as"):
            at = self.places[self.i]
            if self.binary(1, self.unary) not in _TARGETS:
                raise Fault(at, "cannot assign to this")

    def def_(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.eat("->"):
            self.expression()
        self.block("a function definition")

    def parameters(self, end: str, typed: bool) -> None:
        star = slash = default = double = False
        first = True
        while self.t != end:
            if double:
                self.fail("parameter after **")
            if self.eat("**"):
                double = True
                self.name()
                if typed and self.eat(":"):
                    self.expression()
            elif self.eat("*"):
                if star:
                    self.fail("second *")
                star = True
                if self.is_name(_KEYWORDS):
                    self.name()
                    if typed and self.eat(":"):
                        self.star_expression()
                elif self.t != "," or self.ahead() in (end, "**"):
                    self.fail("named parameters must follow a single *")
            elif self.eat("/"):
                if slash or star or first:
                    self.fail()
                slash = True
            else:
                self.name()
                if typed and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default after one with it")
            first = False
            if not self.eat(","):
                return

    def class_(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        if self.t == "(":
            self.arguments()
        self.block("a class definition")

    def decorated(self) -> None:
        while self.eat("@"):
            self.named()
            self.need_line()
        if self.t == "async" and self.ahead() == "def":
            self.i += 1
        if self.t == "def":
            self.def_()
        elif self.t == "class":
            self.class_()
        else:
            self.fail("expected a definition after a decorator")

    def async_(self) -> None:
        self.i += 1
        if self.t not in ("def", "for", "with"):
            self.fail()
        self.COMPOUND[self.t](self)

    COMPOUND = {"if": if_, "while": while_, "for": for_, "try": try_, "with": with_, "def": def_, "class": class_, "@": decorated, "async": async_}

    # match
    def match_head(self) -> bool:
        self.i += 1
        self.star_expressions()
        if self.t != ":" or self.ahead() != _LINE or self.ahead(2) != _INDENT or self.ahead(3) != "case":
            self.fail()
        return True

    def match_body(self) -> None:
        self.i += 3
        while self.t != _DEDENT:
            if self.t != "case":
                self.fail("expected case")
            self.i += 1
            self.patterns()
            if self.eat("if"):
                self.named()
            self.block("case")
        self.i += 1

    def patterns(self) -> None:
        self.pattern()
        while self.eat(","):
            if self.t in (":", "if"):
                return
            self.pattern()

    def pattern(self) -> None:
        if self.eat("*"):
            return self.name()
        self.closed_pattern()
        while self.eat("|"):
            self.closed_pattern()
        if self.eat("as"):
            self.name()

    def closed_pattern(self) -> None:
        t, k = self.t, self.kinds[self.i]
        if k in ("0", '"') or t in ("-", "None", "True", "False"):
            self.eat("-")
            if self.kinds[self.i] == '"':
                while self.kinds[self.i] == '"':
                    self.i += 1
                return
            self.take()
            if self.t in ("+", "-"):
                self.i += 1
                if self.kinds[self.i] != "0":
                    self.fail()
                self.i += 1
        elif t in ("(", "["):
            close = self.OPENERS[self.take()]
            while not self.eat(close):
                self.pattern()
                if not self.eat(","):
                    self.need(close)
                    return
        elif t == "{":
            self.i += 1
            while not self.eat("}"):
                if self.eat("**"):
                    self.name()
                else:
                    self.closed_pattern()
                    self.need(":")
                    self.pattern()
                if not self.eat(","):
                    self.need("}")
                    return
        else:
            self.dotted()
            if self.eat("("):
                while not self.eat(")"):
                    if self.kinds[self.i] == "n" and self.ahead() == "=":
                        self.i += 2
                    self.pattern()
                    if not self.eat(","):
                        self.need(")")
                        return

    # expressions
    def yield_(self) -> str:
        self.i += 1
        if self.eat("from"):
            self.expression()
        elif self.t not in (_LINE, ")", "]", "}", "=", ";"):
            self.star_expressions()
        return "value"

    def star_expressions(self) -> str:
        node = self.star_expression()
        if self.t != ",":
            return "value" if node in ("star", "starred") else node
        ok = node in _TARGETS or node == "starred"
        while self.eat(","):
            if self.ends():
                break
            x = self.star_expression()
            ok &= x in _TARGETS or x == "starred"
        return "tuple" if ok else "value"

    def ends(self) -> bool:
        return self.t in (_LINE, ")", "]", "}", "=", ":", ";", "") or self.t in _AUGMENTED

    def star_expression(self) -> str:
        if self.eat("*"):
            return "starred" if self.binary(1, self.unary) in _TARGETS else "star"
        return self.named()

    def named(self) -> str:
        if self.kinds[self.i] == "n" and self.ahead() == ":=":
            self.name()
            self.i += 1
            self.expression()
            return "value"
        return self.expression()

    def expression(self) -> str:
        if self.t == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return "value"
        node = self.disjunction()
        if self.t == "if":
            self.i += 1
            self.disjunction()
            self.need("else")
            self.expression()
            return "value"
        return node

    def disjunction(self) -> str:
        node = self.conjunction()
        while self.eat("or"):
            self.conjunction()
            node = "value"
        return node

    def conjunction(self) -> str:
        node = self.inversion()
        while self.eat("and"):
            self.inversion()
            node = "value"
        return node

    def inversion(self) -> str:
        if self.eat("not"):
            self.inversion()
            return "value"
        node = self.binary(1, self.unary)
        while self.t in _COMPARE and self.kinds[self.i] in ("n", "p"):
            t = self.take()
            if t == "not":
                self.need("in")
            elif t == "is":
                self.eat("not")
            self.binary(1, self.unary)
            node = "value"
        return node

    def unary(self) -> str:
        if self.kinds[self.i] == "p" and self.t in ("+", "-", "~"):
            self.i += 1
            self.unary()
            return "value"
        awaited = self.eat("await")
        node = self.postfix()
        if self.t == "**":
            self.i += 1
            self.unary()
            return "value"
        return "value" if awaited else node

    def postfix(self) -> str:
        node = self.atom()
        while True:
            t = self.t
            if t == ".":
                self.i += 1
                self.name()
                node = "attribute"
            elif t == "(":
                self.arguments()
                node = "value"
            elif t == "[":
                self.i += 1
                while True:
                    self.slice()
                    if not self.eat(","):
                        break
                    if self.t == "]":
                        break
                self.need("]")
                node = "item"
            else:
                return node

    def slice(self) -> None:
        if self.t == "*":
            self.star_expression()
            return
        if self.t != ":":
            self.named()
        for _ in range(2):
            if self.eat(":") and self.t not in (":", "]", ","):
                self.expression()

    def arguments(self) -> None:
        self.need("(")
        named = double = False
        n = 0
        while not self.eat(")"):
            n += 1
            if self.eat("**"):
                self.expression()
                double = True
            elif self.eat("*"):
                if double:
                    self.fail("* after **")
                self.expression()
            elif self.kinds[self.i] == "n" and self.ahead() == "=":
                self.name()
                self.i += 1
                self.expression()
                named = True
            else:
                if named or double:
                    self.fail("positional argument after a named one")
                self.named()
                if self.t in ("for", "async"):
                    self.comprehension()
                    if n > 1 or self.t != ")":
                        self.fail("generator without parentheses")
            if not self.eat(","):
                self.need(")")
                return

    def comprehension(self) -> None:
        while self.t == "for" or (self.t == "async" and self.ahead() == "for"):
            self.eat("async")
            self.i += 1
            self.targets()
            self.need("in")
            self.disjunction()
            while self.eat("if"):
                if self.kinds[self.i] == "n" and self.ahead() == ":=":
                    self.named()
                else:
                    self.disjunction()

    def atom(self) -> str:
        t, k = self.t, self.kinds[self.i]
        if k == "n":
            if t in ("True", "False", "None"):
                self.i += 1
                return "value"
            if t in _KEYWORDS:
                self.fail()
            self.i += 1
            return "name"
        if k == "0":
            self.i += 1
            return "value"
        if k == '"':
            while self.kinds[self.i] == '"':
                if self.t != t:
                    self.fail("bytes and text are mixed")
                self.i += 1
            return "value"
        if t == "...":
            self.i += 1
            return "value"
        if t == "(":
            self.i += 1
            if self.eat(")"):
                return "tuple"
            if self.t == "yield":
                self.yield_()
                self.need(")")
                return "value"
            node = self.star_expression()
            if self.t in ("for", "async"):
                if node in ("star", "starred"):
                    self.fail()
                self.comprehension()
                self.need(")")
                return "value"
            if self.t == ",":
                ok = node in _TARGETS or node == "starred"
                while self.eat(","):
                    if self.t == ")":
                        break
                    x = self.star_expression()
                    ok &= x in _TARGETS or x == "starred"
                node = "tuple" if ok else "value"
            elif node in ("star", "starred"):
                self.fail("cannot use a starred expression here")
            self.need(")")
            return node
        if t == "[":
            self.i += 1
            ok = True
            if self.eat("]"):
                return "list"
            x = self.star_expression()
            ok &= x in _TARGETS or x == "starred"
            if self.t in ("for", "async"):
                if x in ("star", "starred"):
                    self.fail()
                self.comprehension()
                self.need("]")
                return "value"
            while self.eat(","):
                if self.t == "]":
                    break
                x = self.star_expression()
                ok &= x in _TARGETS or x == "starred"
            self.need("]")
            return "list" if ok else "value"
        if t == "{":
            self.i += 1
            if self.eat("}"):
                return "value"
            if self.eat("**"):
                self.binary(1, self.unary)
                pairs = True
            else:
                x = self.star_expression()
                pairs = x not in ("star", "starred") and self.eat(":")
                if pairs:
                    self.expression()
            if self.t in ("for", "async"):
                self.comprehension()
                self.need("}")
                return "value"
            while self.eat(","):
                if self.t == "}":
                    break
                if pairs:
                    if self.eat("**"):
                        self.binary(1, self.unary)
                    else:
                        self.expression()
                        self.need(":")
                        self.expression()
                else:
                    self.star_expression()
            self.need("}")
            return "value"
        self.fail()
