"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from factloom.errors import QueryError

_PATTERN = re.compile(
    r"""(?P<space>\s+)
      | (?P<string>"[^"]*"|'[^']*')
      | (?P<int>-?[0-9]+)
      | (?P<word>[^\W\d]\w*)
      | (?P<sign><=|[(),.;=])""",
    re.VERBOSE,
)
_LIMITS = range(-(1 << 63), 1 << 63)


@dataclass(frozen=True)
class Token:
    """``kind`` is word, string, int or the sign itself."""

    kind: str
    value: str | int = ""


def lex(source: str) -> list[Token]:
    """Words, quoted strings (no escapes), signed 64-bit integers and signs; anything else is an error."""
    out, at = [], 0
    while at < len(source):
        found = _PATTERN.match(source, at)
        if not found:
            raise QueryError(f"unterminated string at {at}" if source[at] in "\"'" else f"unexpected {source[at]!r} at {at}")
        text, kind = found.group(), found.lastgroup
        at = found.end()
        if kind == "int":
            if int(text) not in _LIMITS:
                raise QueryError(f"integer out of range: {text}")
            out.append(Token("int", int(text)))
        elif kind == "string":
            out.append(Token("string", text[1:-1]))
        elif kind == "word":
            out.append(Token("word", text))
        elif kind == "sign":
            out.append(Token(text))
    return out
