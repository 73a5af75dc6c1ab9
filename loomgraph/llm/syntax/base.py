"""What the parsers share: tokens, expectations, precedence climbing and panic mode.

A parser is a set of recursive-descent methods, one per statement, over a token
list; expressions climb a table of precedences. A statement that fails is
recorded, tokens are skipped up to a place where a statement may begin, and
parsing goes on, so all errors of a file are found.
"""

from __future__ import annotations

import re
import sys
import threading

#: Frames of a first try, and of a second one for deeply nested texts, which has a thread and a stack of its own.
FRAMES, DEEP_FRAMES, DEEP_STACK = 20_000, 5_000_000, 1 << 29


class Fault(Exception):
    """A place at which the text is not in the language."""

    def __init__(self, at: int, why: str) -> None:
        super().__init__(why)
        self.at, self.why = at, why


#: Rows that version control leaves behind.
CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: .*)?$", re.M)


class Parser:
    """Tokens have a kind (n name, 0 number, " string, p mark, '' end) and a text.

    The text of a literal is its kind, so no literal is taken for a mark.
    """

    OPENERS = {"(": ")", "[": "]", "{": "}"}
    #: Words that begin a statement: panic mode stops in front of them.
    STARTS: frozenset = frozenset()
    BINARY: dict = {}

    def __init__(self, source: str) -> None:
        self.source = source
        self.errors: list[tuple[int, str]] = []
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.fresh: list[bool] = []
        self.places: list[int] = []
        self.i = 0
        self.lex()
        self.add("", "", len(source), True)

    # tokens
    def lex(self) -> None:
        raise NotImplementedError

    def add(self, kind: str, text: str, at: int, fresh: bool) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.places.append(at)
        self.fresh.append(fresh)

    def error(self, at: int, why: str) -> None:
        self.errors.append((at, why))

    @property
    def t(self) -> str:
        return self.texts[self.i]

    def ahead(self, n: int = 1) -> str:
        j = self.i + n
        return self.texts[j] if j < len(self.texts) else ""

    def fail(self, why: str | None = None):
        t = self.texts[self.i]
        raise Fault(self.places[self.i], why or (f"unexpected {t!r}" if self.kinds[self.i] else "unexpected end of file"))

    def take(self) -> str:
        t = self.texts[self.i]
        if not self.kinds[self.i]:
            self.fail()
        self.i += 1
        return t

    def eat(self, text: str) -> bool:
        if self.texts[self.i] == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if self.texts[self.i] != text:
            self.fail(f"expected {text!r}" if self.kinds[self.i] else f"end of file, expected {text!r}")
        self.i += 1

    def is_name(self, reserved: frozenset) -> bool:
        return self.kinds[self.i] == "n" and self.texts[self.i] not in reserved

    def attempt(self, f, *args):
        """What ``f`` returns, or None with nothing consumed when it fails."""
        was, errors = self.i, len(self.errors)
        try:
            return f(*args)
        except Fault:
            self.i = was
            del self.errors[errors:]
            return None

    def either(self, first, ends: tuple, second, begins: frozenset) -> None:
        """``first`` up to one of ``ends``, or, where one of ``begins`` stands, ``second``."""
        was, errors = self.i, len(self.errors)
        try:
            first()
            if self.texts[self.i] not in ends:
                self.fail()
        except Fault:
            if self.texts[was] not in begins:
                raise
            self.i = was
            del self.errors[errors:]
            second()

    # precedence climbing
    def binary(self, level: int, operand, node: str | None = None) -> str:
        """An expression of operators that bind at least as tightly as ``level``; ``node`` if its first operand is past."""
        node = node or operand()
        while True:
            op = self.operator()
            p = self.BINARY.get(op)
            if p is None or p < level:
                return node
            self.consume_operator(op)
            self.right_side(op, p, operand)
            node = "value"

    def operator(self) -> str:
        return self.t

    def consume_operator(self, op: str) -> None:
        self.i += 1

    def right_side(self, op: str, p: int, operand) -> None:
        self.binary(p + 1, operand)

    # panic mode
    def recover(self, began: int) -> None:
        """Skip to a place where a statement may begin."""
        if self.i == began and self.kinds[self.i]:
            self.i += 1
        depth = 0
        while self.kinds[self.i]:
            t = self.t
            if t in ("(", "[", "{"):
                depth += 1
            elif t in (")", "]", "}"):
                if depth == 0 and t == "}":
                    return
                depth = max(0, depth - 1)
            elif depth == 0 and t == ";":
                self.i += 1
                return
            elif self.fresh[self.i] and t in self.STARTS:
                return
            self.i += 1

    def guarded(self, f) -> None:
        """One statement; a failure is recorded and skipped over."""
        began = self.i
        try:
            f()
        except Fault as x:
            self.error(x.at, x.why)
            self.recover(began)

    def program(self) -> None:
        raise NotImplementedError

    def parse(self) -> list[tuple[int, str]]:
        """All errors as (place, why), by place."""
        self.program()
        return sorted(self.errors)

    def balanced(self) -> None:
        """A token tree: a bracket, what it holds and its partner."""
        pairs = [self.OPENERS[self.take()]]
        while pairs:
            t = self.take()
            if t in self.OPENERS:
                pairs.append(self.OPENERS[t])
            elif t in (")", "]", "}"):
                if t != pairs.pop():
                    self.i -= 1
                    self.fail("bracket without its partner")


def parsed(parser: type[Parser], source: str) -> tuple[Parser, list[tuple[int, str]]]:
    """A parser and the errors that it found, however deeply the text is nested."""
    was = sys.getrecursionlimit()
    sys.setrecursionlimit(max(was, FRAMES))
    try:
        p = parser(source)
        return p, p.parse()
    except RecursionError:
        pass
    finally:
        sys.setrecursionlimit(was)
    out: list = []

    def deep() -> None:
        p = parser(source)
        out.extend((p, p.parse()))

    size = threading.stack_size(DEEP_STACK)
    sys.setrecursionlimit(DEEP_FRAMES)
    try:
        t = threading.Thread(target=deep)
        t.start()
        t.join()
    finally:
        threading.stack_size(size)
        sys.setrecursionlimit(was)
    if not out:
        raise RecursionError("a text nested more deeply than the memory for frames allows")
    return out[0], out[1]
