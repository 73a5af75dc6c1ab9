"""Rust."""

from __future__ import annotations

import re

from .base import Parser

_TOKEN = re.compile(
    r"(?P<sp>[ \t\f]+)|(?P<nl>[\r\n]+)|(?P<lc>//[^\n]*)"
    r"|(?P<str>b?r(?P<h>#*)\".*?\"(?P=h)(?!#)|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[nrt0\\'\"]))')"
    r"|(?P<life>'[A-Za-z_]\w*)"
    r"|(?P<num>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?)(?:_?[iu](?:8|16|32|64|128|size)|_?f(?:32|64))?)"
    r"|(?P<name>r#\w+|\w+)"
    r"|(?P<op><<=|\.\.\.|\.\.=|\.\.|->|=>|::|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|[{}()\[\];,.@=<>!~?:+\-*/&|^%#$])",
    re.S,
)
_KEYWORDS = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())
_PATH = frozenset(("self", "Self", "super", "crate"))
_ITEMS = frozenset("use mod fn struct enum impl trait const static type extern unsafe pub async macro_rules union".split())
_ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
_BLOCKS = frozenset("if match while for loop unsafe { async const".split())


class Rust(Parser):
    STARTS = frozenset("fn pub impl struct enum trait use mod let if for while loop match return".split())
    BINARY = {"..": 1, "..=": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}

    def lex(self) -> None:
        put_kind, put_text, put_fresh, put_place = self.kinds.append, self.texts.append, self.fresh.append, self.places.append
        match = _TOKEN.match
        src, n, at, fresh = self.source, len(self.source), 0, True
        if src.startswith("#!") and not src.startswith("#!["):
            at = src.find("\n") if "\n" in src else n
        while at < n:
            ch = src[at]
            if ch == " ":
                at += 1
                continue
            if ch == "/" and src.startswith("/*", at):
                end = self._comment(at)
                if end < 0:
                    return self.error(at, "comment without an end")
                fresh |= "\n" in src[at:end]
                at = end
                continue
            m = match(src, at)
            if m is None:
                ch = src[at]
                self.error(at, "text without an end" if ch in "\"'" else f"unexpected {ch!r}")
                if ch == '"':
                    return
                at += 1
                continue
            g = m.lastgroup if m.lastgroup != "h" else "str"
            if g == "nl":
                fresh = True
            elif g not in ("sp", "lc"):
                kind, text = {"op": ("p", m.group()), "name": ("n", m.group()), "num": ("0", "0"), "str": ('"', '"'), "life": ("l", "'")}[g]
                put_kind(kind), put_text(text), put_place(at), put_fresh(fresh)
                fresh = False
                if g == "num" and m.end() < n and (src[m.end()].isalnum() or src[m.end()] == "_"):
                    self.error(at, "number runs into a name")
            at = m.end()

    def _comment(self, at: int) -> int:
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.source, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return -1

    def name(self) -> None:
        if not self.is_name(_KEYWORDS):
            self.fail("expected a name")
        self.i += 1

    def program(self) -> None:
        while self.kinds[self.i]:
            if self.t == "}":
                self.error(self.places[self.i], "unexpected '}'")
                self.i += 1
                continue
            self.guarded(self.item_line)

    def item_line(self) -> None:
        self.attributes()
        if not self.kinds[self.i]:
            return
        if not self.item():
            self.fail("expected an item")

    def attributes(self) -> None:
        while self.t == "#":
            self.i += 1
            self.eat("!")
            if self.t != "[":
                self.fail()
            self.balanced()

    def visibility(self) -> None:
        if self.eat("pub") and self.t == "(" and self.ahead() in ("crate", "self", "super", "in"):
            self.balanced()

    def item(self) -> bool:
        """An item, if one begins here."""
        was = self.i
        self.visibility()
        t, n = self.t, self.ahead()
        if t == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif t == "mod":
            self.i += 1
            self.name()
            if not self.eat(";"):
                self.items()
        elif t == "struct" or (t == "union" and self.kinds[self.i + 1] == "n" and self.ahead(2) in ("{", "<")):
            self.i += 1
            self.name()
            self.generics()
            self.where()
            if self.t == "{":
                self.fields()
            elif self.t == "(":
                self.tuple_fields()
                self.where()
                self.need(";")
            else:
                self.need(";")
        elif t == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            while not self.eat("}"):
                self.attributes()
                self.visibility()
                self.name()
                if self.t == "{":
                    self.fields()
                elif self.t == "(":
                    self.tuple_fields()
                if self.eat("="):
                    self.expression()
                if not self.eat(","):
                    self.need("}")
                    break
        elif t == "trait" or (t == "unsafe" and n == "trait"):
            self.eat("unsafe")
            self.i += 1
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            self.items()
        elif t == "impl" or (t == "unsafe" and n == "impl"):
            self.eat("unsafe")
            self.i += 1
            if self.t == "<":
                self.generics()
            self.eat("!")
            self.type()
            if self.eat("for"):
                self.type()
            self.where()
            self.items()
        elif t == "static" or (t == "const" and (n == "_" or self.kinds[self.i + 1] == "n" and n not in ("fn", "unsafe", "extern", "async"))):
            self.i += 1
            self.eat("mut")
            self.name()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expression()
            self.need(";")
        elif t == "type" and self.kinds[self.i + 1] == "n":
            self.i += 1
            self.name()
            self.generics()
            if self.eat(":"):
                self.bounds()
            self.where()
            if self.eat("="):
                self.type()
            self.where()
            self.need(";")
        elif t == "extern" and n == "crate":
            self.i += 2
            self.take()
            if self.eat("as"):
                self.name()
            self.need(";")
        elif t == "extern" and (n == "{" or self.ahead(2) == "{"):
            self.i += 1
            if self.kinds[self.i] == '"':
                self.i += 1
            self.items()
        elif t == "fn" or (t in ("const", "async", "unsafe", "extern") and self.fn_ahead()):
            while self.t in ("const", "async", "unsafe", "extern"):
                self.i += 1
                if self.kinds[self.i] == '"':
                    self.i += 1
            self.function()
        elif t == "macro_rules" and n == "!":
            self.i += 2
            self.name()
            brace = self.t == "{"
            if self.t not in self.OPENERS:
                self.fail()
            self.balanced()
            if not brace:
                self.need(";")
        elif t not in _KEYWORDS | {""} and self.kinds[self.i] == "n" and self.i == was and n in ("!", "::") and self.macro_item():
            pass
        else:
            if self.i != was:
                self.fail("expected an item")
            return False
        return True

    def fn_ahead(self) -> bool:
        j = self.i
        while self.texts[j] in ("const", "async", "unsafe", "extern") or self.kinds[j] == '"':
            j += 1
        return self.texts[j] == "fn"

    def macro_item(self) -> bool:
        j = self.i
        while self.kinds[j] == "n" and self.texts[j + 1] == "::":
            j += 2
        if self.kinds[j] != "n" or self.texts[j + 1] != "!" or self.texts[j + 2] not in self.OPENERS:
            return False
        if self.nested:
            return False
        self.i = j + 2
        brace = self.t == "{"
        self.balanced()
        if not brace:
            self.need(";")
        return True

    nested = 0

    def items(self) -> None:
        self.need("{")
        was, self.nested = self.nested, 0
        while self.t != "}":
            if not self.kinds[self.i]:
                self.fail("end of file, expected '}'")
            self.guarded(self.item_line)
        self.i += 1
        self.nested = was

    def use_tree(self) -> None:
        self.eat("::")
        while True:
            if self.eat("*"):
                return
            if self.eat("{"):
                while not self.eat("}"):
                    self.use_tree()
                    if not self.eat(","):
                        self.need("}")
                        return
                return
            if self.kinds[self.i] != "n" or (self.t in _KEYWORDS and self.t not in _PATH):
                self.fail("expected a name")
            self.i += 1
            if self.eat("as"):
                self.take()
                return
            if not self.eat("::"):
                return

    def fields(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.attributes()
            self.visibility()
            self.name()
            self.need(":")
            self.type()
            if not self.eat(","):
                self.need("}")
                return

    def tuple_fields(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.attributes()
            self.visibility()
            self.type()
            if not self.eat(","):
                self.need(")")
                return

    def generics(self) -> None:
        if not self.eat("<"):
            return
        while not self.eat(">"):
            self.attributes()
            if self.kinds[self.i] == "l":
                self.i += 1
            elif self.eat("const"):
                self.name()
                self.need(":")
                self.type()
                if self.eat("="):
                    self.argument()
                if not self.eat(","):
                    self.need(">")
                    return
                continue
            else:
                self.name()
            if self.eat(":"):
                self.bounds()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                self.need(">")
                return

    def bounds(self) -> None:
        while self.t not in ("{", ",", ">", "=", ";", "where", ")"):
            self.bound()
            if not self.eat("+"):
                return

    def bound(self) -> None:
        if self.kinds[self.i] == "l":
            self.i += 1
            return
        if self.eat("("):
            self.bound()
            return self.need(")")
        self.eat("?")
        if self.eat("for"):
            self.generics()
        self.type_path()

    def where(self) -> None:
        if not self.eat("where"):
            return
        while self.t not in ("{", ";", "="):
            if self.kinds[self.i] == "l":
                self.i += 1
            else:
                if self.eat("for"):
                    self.generics()
                self.type()
            self.need(":")
            self.bounds()
            if not self.eat(","):
                return

    def function(self) -> None:
        self.need("fn")
        self.name()
        self.generics()
        self.need("(")
        while not self.eat(")"):
            self.attributes()
            if self.eat("..."):
                pass
            elif not self.attempt(self.receiver):
                self.pattern()
                self.need(":")
                if not self.eat("..."):
                    self.type()
            if not self.eat(","):
                self.need(")")
                break
        if self.eat("->"):
            self.type()
        self.where()
        if not self.eat(";"):
            self.block()

    def receiver(self) -> bool:
        if self.eat("&") and self.kinds[self.i] == "l":
            self.i += 1
        self.eat("mut")
        self.need("self")
        if self.eat(":"):
            self.type()
        return True

    # types
    def type(self) -> None:
        t, k = self.t, self.kinds[self.i]
        if t in ("&", "&&"):
            self.i += 1
            if self.kinds[self.i] == "l":
                self.i += 1
            self.eat("mut")
            self.type()
        elif t == "*":
            self.i += 1
            if not self.eat("const"):
                self.need("mut")
            self.type()
        elif t == "(":
            self.i += 1
            while not self.eat(")"):
                self.type()
                if not self.eat(","):
                    self.need(")")
                    break
        elif t == "[":
            self.i += 1
            self.type()
            if self.eat(";"):
                self.expression()
            self.need("]")
        elif t in ("!", "_"):
            self.i += 1
        elif t in ("dyn", "impl"):
            self.i += 1
            self.bound()
            while self.eat("+"):
                self.bound()
        elif t in ("fn", "unsafe", "extern"):
            self.eat("unsafe")
            if self.eat("extern") and self.kinds[self.i] == '"':
                self.i += 1
            self.need("fn")
            self.need("(")
            while not self.eat(")"):
                if self.kinds[self.i] == "n" and self.ahead() == ":":
                    self.i += 2
                self.type()
                if not self.eat(","):
                    self.need(")")
                    break
            if self.eat("->"):
                self.type()
        elif t == "for":
            self.i += 1
            self.generics()
            self.type()
        elif t == "<":
            self.qualified()
            while self.eat("::"):
                self.segment()
        elif k == "n" or t == "::":
            self.type_path()
            if self.t == "!" and self.ahead() in self.OPENERS:
                self.i += 1
                self.balanced()
        else:
            self.fail("expected a type")

    def qualified(self) -> None:
        self.need("<")
        self.type()
        if self.eat("as"):
            self.type_path()
        self.need(">")

    def segment(self) -> None:
        if self.kinds[self.i] != "n" or (self.t in _KEYWORDS and self.t not in _PATH):
            self.fail("expected a name")
        self.i += 1

    def type_path(self) -> None:
        self.eat("::")
        while True:
            self.segment()
            if self.t == "::" and self.ahead() == "<":
                self.i += 1
            if self.t == "<":
                self.angle_arguments()
            elif self.t == "(":
                self.i += 1
                while not self.eat(")"):
                    self.type()
                    if not self.eat(","):
                        self.need(")")
                        break
                if self.eat("->"):
                    self.type()
            if not self.eat("::"):
                return

    def angle_arguments(self) -> None:
        self.need("<")
        while not self.eat(">"):
            self.argument()
            if not self.eat(","):
                self.need(">")
                return

    def argument(self) -> None:
        if self.kinds[self.i] in ("l", "0", '"') or self.t in ("true", "false"):
            self.i += 1
        elif self.t == "-":
            self.i += 2
        elif self.t == "{":
            self.block()
        else:
            if self.kinds[self.i] == "n" and self.ahead() in ("=", ":"):
                self.i += 1
                if self.eat(":"):
                    return self.bounds()
                self.i += 1
                return self.argument()
            self.type()

    # patterns
    def pattern(self) -> None:
        self.eat("|")
        self.one_pattern()
        while self.eat("|"):
            self.one_pattern()

    def one_pattern(self) -> None:
        t, k = self.t, self.kinds[self.i]
        if t in ("&", "&&"):
            self.i += 1
            self.eat("mut")
            return self.one_pattern()
        if t in ("(", "["):
            close = self.OPENERS[self.take()]
            while not self.eat(close):
                self.pattern()
                if not self.eat(","):
                    self.need(close)
                    return
            return
        if t in ("..", "..="):
            self.i += 1
            if self.kinds[self.i] in ("0", '"'):
                self.i += 1
            return
        if k in ("0", '"') or t == "-" or t in ("true", "false"):
            self.eat("-")
            self.take()
        elif t in ("ref", "mut"):
            self.eat("ref")
            self.eat("mut")
            self.name()
            if self.eat("@"):
                self.one_pattern()
            return
        elif t == "_":
            self.i += 1
            return
        elif t == "<" or k == "n" or t == "::":
            if t == "<":
                self.qualified()
                self.need("::")
            self.expression_path()
            if self.t == "!" and self.ahead() in self.OPENERS:
                self.i += 1
                return self.balanced()
            if self.t == "(":
                return self.one_pattern()
            if self.eat("{"):
                while not self.eat("}"):
                    self.attributes()
                    if self.eat(".."):
                        self.need("}")
                        return
                    self.eat("ref")
                    self.eat("mut")
                    if self.kinds[self.i] == "0":
                        self.i += 1
                    else:
                        self.name()
                    if self.eat(":"):
                        self.pattern()
                    if not self.eat(","):
                        self.need("}")
                        return
                return
            if self.eat("@"):
                return self.one_pattern()
        else:
            self.fail("expected a pattern")
        if self.t in ("..", "..=", "..."):
            self.i += 1
            if self.kinds[self.i] in ("0", '"', "n") or self.t == "-":
                self.eat("-")
                self.take()
                while self.eat("::"):
                    self.segment()

    # statements
    def block(self) -> str:
        self.need("{")
        was, self.no_struct, self.nested = (self.no_struct, self.nested), False, 1
        while self.t != "}":
            if not self.kinds[self.i]:
                self.fail("end of file, expected '}'")
            self.guarded(self.statement)
        self.i += 1
        self.no_struct, self.nested = was
        return "value"

    no_struct = False

    def statement(self) -> None:
        if self.eat(";"):
            return
        self.attributes()
        t = self.t
        if t == "let":
            self.i += 1
            self.pattern()
            if self.eat(":"):
                self.type()
            if self.eat("="):
                self.expression()
                if self.eat("else"):
                    self.block()
            return self.need(";")
        if t in _ITEMS and not (t in ("unsafe", "const", "async") and self.ahead() in ("{", "move", "|", "||")) and not (t == "union") and self.item():
            return
        if t in _BLOCKS or (self.kinds[self.i] == "l" and self.ahead() == ":"):
            # A block stands for itself unless something follows that needs its value.
            self.block_like()
            if self.t in (".", "?"):
                self.postfix_rest("value")
                self.rest_of_expression()
            elif self.t in ("as",):
                self.rest_of_expression()
            else:
                self.eat(";")
                return
        elif self.kinds[self.i] == "n" and self.ahead() == "!" and self.ahead(2) == "{" and t not in _KEYWORDS:
            self.i += 2
            self.balanced()
            if self.t in (".", "?"):
                self.postfix_rest("value")
                self.rest_of_expression()
            else:
                self.eat(";")
                return
        else:
            self.expression()
        if self.t != "}":
            self.need(";")

    def rest_of_expression(self) -> None:
        self.binary(1, self.unary, self.casts("value"))
        if self.operator() in _ASSIGN:
            self.consume_operator(self.operator())
            self.expression()

    def expression(self) -> str:
        t = self.t
        if t in ("return", "break", "continue", "yield"):
            return self.jump()
        if t in ("..", "..="):
            self.i += 1
            if not self.range_ends():
                self.binary(2, self.unary)
            return "value"
        node = self.binary(1, self.unary)
        op = self.operator()
        if op in _ASSIGN:
            if node == "call" or node == "literal":
                self.fail("cannot assign to this")
            self.consume_operator(op)
            self.expression()
            return "value"
        return node

    def range_ends(self) -> bool:
        return self.t in (")", "]", "}", ";", ",", "=>", "") or (self.t == "{" and self.no_struct)

    def jump(self) -> str:
        t = self.take()
        if t != "return" and self.kinds[self.i] == "l":
            self.i += 1
        if t != "continue" and self.t not in (";", "}", ",", ")", "]", "=>", "") and not (self.t == "{" and self.no_struct):
            self.expression()
        return "value"

    def operator(self) -> str:
        t = self.t
        if self.kinds[self.i] != "p":
            return ""
        if t != ">":
            return t
        out, i = ">", self.i
        while self.texts[i + 1] in (">", "=", "==") and self.places[i + 1] == self.places[i] + 1 and len(out) < 3:
            i += 1
            out += self.texts[i][0]
            if out.endswith("="):
                break
        return out

    def consume_operator(self, op: str) -> None:
        self.i += len(op) if op[0] == ">" else 1

    def right_side(self, op: str, p: int, operand) -> None:
        if p == 1 and self.range_ends():
            return
        if self.t in ("return", "break", "continue"):
            self.jump()
            return
        self.binary(p + 1, operand)
        if p == 4 and self.BINARY.get(self.operator()) == 4:
            self.fail("comparisons in a row")

    def unary(self) -> str:
        t = self.t
        if self.kinds[self.i] == "p":
            if t in ("-", "!", "*"):
                self.i += 1
                self.unary()
                return self.casts("value")
            if t in ("&", "&&"):
                self.i += 1
                if self.t == "raw" and self.ahead() in ("const", "mut"):
                    self.i += 1
                    self.eat("const")
                self.eat("mut")
                self.unary()
                return self.casts("value")
        if t == "let":
            self.i += 1
            self.pattern()
            self.need("=")
            self.binary(4, self.unary)
            return "value"
        if t in ("|", "||", "move", "static") or (t == "async" and self.ahead() in ("move", "|", "||") and self.ahead(2) != "{"):
            return self.closure()
        if t in ("return", "break", "continue"):
            return self.jump()
        return self.casts(self.postfix())

    def casts(self, node: str) -> str:
        while self.t == "as" and self.kinds[self.i] == "n":
            self.i += 1
            self.type()
            node = "value"
        return node

    def closure(self) -> str:
        while self.t in ("move", "static", "async"):
            self.i += 1
        if not self.eat("||"):
            self.need("|")
            while not self.eat("|"):
                self.attributes()
                self.one_pattern()
                if self.eat(":"):
                    self.type()
                if not self.eat(","):
                    self.need("|")
                    break
        if self.eat("->"):
            self.type()
            self.block()
        else:
            self.expression()
        return "value"

    def expression_path(self) -> None:
        self.eat("::")
        self.segment()
        while self.t == "::":
            self.i += 1
            if self.t == "<":
                self.angle_arguments()
            else:
                self.segment()

    def arguments(self) -> None:
        self.need("(")
        was, self.no_struct = self.no_struct, False
        while not self.eat(")"):
            self.attributes()
            self.expression()
            if not self.eat(","):
                self.need(")")
                break
        self.no_struct = was

    def postfix(self) -> str:
        return self.postfix_rest(self.primary())

    def postfix_rest(self, node: str) -> str:
        while True:
            t = self.t
            if t == "?":
                self.i += 1
                node = "call"
            elif t == ".":
                self.i += 1
                if self.kinds[self.i] == "0":
                    self.i += 1
                elif not self.eat("await"):
                    self.name()
                    if self.t == "::":
                        self.i += 1
                        self.angle_arguments()
                node = "ref"
                if self.t == "(":
                    self.arguments()
                    node = "call"
            elif t == "(":
                self.arguments()
                node = "call"
            elif t == "[":
                self.i += 1
                was, self.no_struct = self.no_struct, False
                self.expression()
                self.no_struct = was
                self.need("]")
                node = "ref"
            else:
                return node

    def condition(self) -> None:
        was, self.no_struct = self.no_struct, True
        self.expression()
        self.no_struct = was

    def block_like(self) -> str:
        if self.kinds[self.i] == "l":
            self.i += 1
            self.need(":")
        t = self.t
        if t == "if":
            self.i += 1
            self.condition()
            self.block()
            if self.eat("else"):
                if self.t == "if":
                    self.block_like()
                else:
                    self.block()
        elif t == "match":
            self.i += 1
            self.condition()
            self.need("{")
            was, self.no_struct = self.no_struct, False
            while not self.eat("}"):
                if not self.kinds[self.i]:
                    self.fail("end of file, expected '}'")
                self.attributes()
                self.pattern()
                if self.eat("if"):
                    self.expression()
                self.need("=>")
                block = self.t == "{"
                if block:
                    self.block()
                    if self.t in (".", "?"):
                        self.postfix_rest("value")
                        self.rest_of_expression()
                        block = False
                else:
                    block = self.t in _BLOCKS
                    self.expression()
                if not self.eat(",") and self.t != "}" and not block:
                    self.fail()
            self.no_struct = was
        elif t == "while":
            self.i += 1
            self.condition()
            self.block()
        elif t == "for":
            self.i += 1
            self.pattern()
            self.need("in")
            self.condition()
            self.block()
        elif t == "loop":
            self.i += 1
            self.block()
        elif t in ("unsafe", "async", "const"):
            self.i += 1
            self.eat("move")
            self.block()
        else:
            self.block()
        return "value"

    def primary(self) -> str:
        t, k = self.t, self.kinds[self.i]
        if k in ("0", '"') or t in ("true", "false"):
            self.i += 1
            return "literal"
        if t in _BLOCKS and (k == "n" or t == "{") or k == "l":
            return self.block_like()
        if t == "(":
            self.i += 1
            was, self.no_struct = self.no_struct, False
            while not self.eat(")"):
                self.expression()
                if not self.eat(","):
                    self.need(")")
                    break
            self.no_struct = was
            return "value"
        if t == "[":
            self.i += 1
            was, self.no_struct = self.no_struct, False
            while not self.eat("]"):
                self.expression()
                if self.eat(";"):
                    self.expression()
                    self.need("]")
                    break
                if not self.eat(","):
                    self.need("]")
                    break
            self.no_struct = was
            return "value"
        if t == "<":
            self.qualified()
            self.need("::")
            self.expression_path()
            return "ref"
        if t == "_":
            self.i += 1
            return "ref"
        if k == "n" and (t not in _KEYWORDS or t in _PATH) or t == "::":
            self.expression_path()
            if self.t == "!" and self.ahead() in self.OPENERS:
                self.i += 1
                self.balanced()
                return "value"
            if self.t == "{" and not self.no_struct:
                self.struct()
                return "value"
            return "ref"
        self.fail()

    def struct(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.attributes()
            if self.eat(".."):
                if self.t != "}":
                    self.expression()
                self.need("}")
                return
            if self.kinds[self.i] == "0":
                self.i += 1
            else:
                self.name()
            if self.eat(":"):
                self.expression()
            if not self.eat(","):
                self.need("}")
                return
