"""Recursive-descent parsers of Python 3, JavaScript, TypeScript, Java, Go and Rust."""

from __future__ import annotations

from .base import CONFLICT, Parser, parsed
from .go import Go
from .java import Java
from .python import Python
from .rust import Rust
from .script import Script, TypeScript

#: Language to parser.
PARSERS: dict[str, type[Parser]] = {"python": Python, "javascript": Script, "typescript": TypeScript, "java": Java, "go": Go, "rust": Rust}
#: What an extension stands for.
EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "java": "java", "go": "go", "rs": "rust"}


def errors(language: str, source: str) -> list[tuple[int, str]]:
    """All errors of a text as (line, why), the first first; none if it is in the language."""
    parser, found = parsed(PARSERS[language], source)
    text = parser.source
    out, line, at = [], 1, 0
    for place, why in found:
        line += text.count("\n", at, place) if place > at else 0
        at = max(at, place)
        out.append((line, why))
    return out


def first_cause(language: str, source: str, found: list[tuple[int, str]]) -> str | None:
    """Why a text is not in its language: conflict, other_language, truncated or damaged."""
    if not found:
        return None
    if CONFLICT.search(source.replace("\r\n", "\n")):
        return "conflict"
    if any(not errors(other, source) for other in PARSERS if other != language and not (language == "typescript" and other == "javascript")):
        return "other_language"
    lines = source.rstrip().count("\n") + 1
    if found[0][0] >= lines or "end of file" in found[-1][1] or "without an end" in found[-1][1]:
        return "truncated"
    return "damaged"
